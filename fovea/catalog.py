"""Named queries over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from fovea.plans import feature_queries, line_queries, scheme_queries, score_queries, stat_queries  # noqa: F401  they register themselves
from fovea.plans.registry import QUERIES, SQL, Query

FLAGSHIP = "prototype_cosine"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
