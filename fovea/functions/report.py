"""Small result tables as text. Formatting happens on the driver, over a table of a page's size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ROWS = 10_000


def best_marked(df: DataFrame, block: Sequence[str], metrics: Mapping[str, str], digits: int = 3) -> DataFrame:
    """Each metric as printed, and whether it is the block's best as printed ('max' or 'min'); equal prints all are."""
    out = df
    for metric, best in metrics.items():
        shown = F.round(metric, digits)
        w = Window.partitionBy(*block)
        target = F.max(shown).over(w) if best == "max" else F.min(shown).over(w)
        out = out.withColumns({f"{metric}_text": F.format_number(shown, digits), f"{metric}_best": F.coalesce(shown == target, F.lit(False))})
    return out


def latex(df: DataFrame, columns: Mapping[str, str], order: Sequence[str], caption: str = "", bold: str = "_best") -> str:
    """A LaTeX table of the columns (name -> heading), bold where the column's flag says so."""
    rows = df.orderBy(*order).limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError("too many rows for a printed table")
    escape = lambda v: "" if v is None else "".join(f"\\{c}" if c in "&%$#_{}" else c for c in str(v))

    def cell(row, c: str) -> str:
        text = escape(row[f"{c}_text"] if f"{c}_text" in df.columns else row[c])
        return f"\\textbf{{{text}}}" if f"{c}{bold}" in df.columns and row[f"{c}{bold}"] else text

    body = " \\\\\n".join(" & ".join(cell(r, c) for c in columns) for r in rows)
    head = " & ".join(map(escape, columns.values()))
    note = f"\\caption{{{escape(caption)}}}\n" if caption else ""
    return f"\\begin{{table}}\n{note}\\begin{{tabular}}{{{'l' * len(columns)}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body} \\\\\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}\n"
