"""The same features over streams of fixation events. An extension: batch tables need none of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Event times with a zone: those stored without one are taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed_means(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """keys, window, n, mean value; state of windows older than the watermark goes."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))


def sessions(events: DataFrame, time: str, who: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """who, session, n: runs of events without a longer gap."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap), who).agg(F.count(F.lit(1)).alias("n"))


def running_transitions(events: DataFrame, who: str, order: str, word: str) -> DataFrame:
    """who, i, j, n: transitions between consecutive words of a reader, carried over micro-batches.

    The state is the reader's last word: two numbers, whatever the stream's length.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(events.dtypes)[who]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = int(state.get[0]) if state.exists else None
        path = pd.concat(list(frames)).sort_values(order)[word].dropna().astype(int).tolist()
        words = ([last] if last is not None else []) + path
        if words:
            state.update((words[-1],))
        counts = pd.Series(list(zip(words[:-1], words[1:], strict=True)), dtype=object).value_counts()
        yield pd.DataFrame({who: [key[0]] * len(counts), "i": [a for a, _ in counts.index], "j": [b for _, b in counts.index], "n": counts.to_numpy()})

    return events.select(who, order, word).groupBy(who).applyInPandasWithState(step, f"`{who}` {kind}, i int, j int, n long", "last int", "append", GroupStateTimeout.NoTimeout)
