"""Secret scans driven by a trigram inverted index. Built-in functions only, nothing leaves the JVM.

Each rule's regular expression gives a Boolean trigram query: an AND over its literal parts of an OR over that
part's strings of an AND over the string's trigrams. The index posts, for every trigram that some rule asks for,
the keys of the texts that hold it; queries are answered by joining postings and counting what each key meets.
Only a rule's candidates are searched with its expression. A rule without a mandatory trigram searches all texts.

Main cost: two passes over the texts, one to post and one to verify, without shuffling a text. Postings, at most
one for each key and rule trigram, are what moves. Candidates are broadcast only below a checked count.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.llm.storage import fresh, keep

BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """kind; the expression, the same in Python and Java; the group whose length must reach `least`; whether case counts;
    whether redaction takes it before the others, whose shorter matches would break its own."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    early: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # a shorter run fails and can't hide a longer one, so this equals searching [0-9a-f]+
)
# A key's body: all up to its END line if that holds no sentence ends and no other marker; else what follows of base64
# runs (16 letters or more, padded, or a line of its own), header fields and what stands between them: line ends, also
# escaped ones, quotes, comment and quote marks.
_END = r"-----END [A-Z ]*PRIVATE KEY-----"
_BETWEEN = r"[^A-Za-z0-9/=.!?-]{1,16}+"
_RUN = r"[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]{2,15}={1,2}+|(?:Proc-Type|DEK-Info):\x20?[A-Za-z0-9,-]++"
_SHORT_LINE = r"[\r\n]++[\x20\t>#*|]*+[A-Za-z0-9+/]++={0,2}+(?=[\x20\t]*+(?![^\r\n]))"
_BODY = rf"(?:[^.!?-]*+(?:-(?!----)[^.!?-]*+)*+{_END}|(?:{_SHORT_LINE}|{_BETWEEN}(?:{_RUN}))*+(?:(?:{_BETWEEN})?{_END})?)"
MORE = (
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----{_BODY}", early=True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("url_login", r"[a-z][a-z0-9+]*://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!-]+@"),
)
RULES = BASE + MORE


def _strings(node: tuple, most: int) -> set[str] | None:
    """All strings that one parsed element can match, or None if they are many."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg)}
    if op == "IN":
        letters = [chr(x[1]) for x in arg if str(x[0]) == "LITERAL"]
        return set(letters) if len(letters) == len(arg) <= most else None
    if op == "SUBPATTERN":
        return _product(arg[-1], most)
    if op == "BRANCH":
        parts = [_product(x, most) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 8:
        one = _product(arg[2], most)
        if one is not None:
            found = {"".join(c) for k in range(int(arg[0]), int(arg[1]) + 1) for c in itertools.product(one, repeat=k)} if len(one) ** int(arg[1]) <= most else None
            return found
    return None


def _product(nodes, most: int) -> set[str] | None:
    found = {""}
    for node in nodes:
        part = _strings(node, most)
        if part is None or len(found) * len(part) > most:
            return None
        found = {a + b for a in found for b in part}
    return found


def trigram_query(pattern: str, most: int = 16) -> list[list[list[str]]]:
    """AND of ORs of ANDs of lower-case trigrams that any match holds; empty if none is mandatory."""
    parts: list[set[str]] = []
    run = {""}
    for node in re._parser.parse(pattern):
        part = _strings(node, most)
        if part is not None and len(run) * len(part) <= most:
            run = {a + b for a in run for b in part}
            continue
        parts.append(run)
        run = part or {""}
    parts.append(run)
    query = []
    for strings in parts:
        if all(len(s) >= 3 for s in strings):
            query.append(sorted(sorted({s[k : k + 3].lower() for k in range(len(s) - 2)}) for s in strings))
    return query


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, kinds: the rules with mandatory trigrams whose query a text meets. Keys that meet none have no row."""
    spark = docs.sparkSession
    asked = [(r.kind, p, a, g, len(alt)) for r in rules for p, part in enumerate(trigram_query(r.pattern)) for a, alt in enumerate(part) for g in alt]
    needed = [(r.kind, len(q)) for r in rules if (q := trigram_query(r.pattern))]
    folded = docs.select(F.col(key).alias("key"), F.lower(text_col).alias("folded"))
    grams = sorted({x[3] for x in asked})
    postings = folded.select("key", F.explode(F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams]))).alias("gram")).distinct()
    asks = F.broadcast(spark.createDataFrame(asked, "kind string, part int, alt int, gram string, size int"))
    met = postings.join(asks, "gram").groupBy("key", "kind", "part", "alt", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    parts = met.select("key", "kind", "part").distinct().groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(spark.createDataFrame(needed, "kind string, n long"))
    return parts.join(whole, ["kind", "n"]).groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _marked(docs: DataFrame, rules: tuple[Rule, ...], key: str, text_col: str) -> tuple[DataFrame, str]:
    """The rows of docs with a column of the indexed rules they are candidates for, and that column's name."""
    at, kinds = fresh(docs.columns, "_key", "_kinds")
    found = keep(candidates(docs, rules, key, text_col).select(F.col("key").alias(at), F.col("kinds").alias(kinds)))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, docs[key].eqNullSafe(found[at]), "left").drop(at), kinds


def _wanted(rule: Rule, kinds: str) -> Column:
    return F.array_contains(kinds, rule.kind) if trigram_query(rule.pattern) else F.lit(True)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, spans array<struct<start, rank, kind, end>> by start, then by the rule's rank.

    Spans are leftmost and non-overlapping within a rule, in code points, end exclusive. Null and empty texts have
    none. Whole texts are searched, however long and however often a rule matches. Repeated rows and null keys give a
    row each. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked, kinds = _marked(docs, rules, "doc_id", "text")

    def pieces(rank: int, rule: Rule) -> Column:
        expr = F.lit(rule.java)
        gaps = F.transform(F.split("text", rule.java, -1), F.length)
        whole, value = F.transform(F.regexp_extract_all("text", expr, F.lit(0)), F.length), F.transform(F.regexp_extract_all("text", expr, F.lit(rule.group)), F.length)
        found = F.when(F.coalesce(_wanted(rule, kinds), F.lit(False)) & F.col("text").rlike(rule.java), F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")))
        return F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), found.alias("runs"))

    rows = keep(marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.filter(F.array(*[pieces(k, r) for k, r in enumerate(rules)]), lambda p: p["runs"].isNotNull()).alias("found")))
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.rank", "f.kind", "f.least", F.posexplode("f.runs").alias("pos", "run")).select("row", "rank", "kind", "least", "pos", "run.gap", "run.whole", "run.value")
    upto = Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = each.withColumn("end", F.sum(F.coalesce("gap", F.lit(0)) + F.coalesce("whole", F.lit(0))).over(upto)).where("value >= least and whole is not null")
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("whole")).alias("start"), "rank", "kind", "end"))).alias("spans"))
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by comma."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, rule: Rule) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == rule.kind)).cast("long")


def _replaced(text_col: str, rule: Rule) -> Column:
    expr = F.lit(rule.java)
    gaps, whole, value = F.split(text_col, rule.java, -1), F.regexp_extract_all(text_col, expr, F.lit(0)), F.regexp_extract_all(text_col, expr, F.lit(rule.group))
    kept = F.zip_with(whole, value, lambda w, v: F.when(F.length(v) >= rule.least, F.lit(f"<{rule.kind}>")).otherwise(w))
    return F.array_join(F.zip_with(gaps, kept, lambda g, k: F.concat(g, F.coalesce(k, F.lit("")))), "")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with every secret replaced by <kind>; all else, null texts included, stays as it is.

    Rules apply in their order, early ones first, each to what the ones before have left.
    """
    columns = docs.columns
    marked, kinds = _marked(docs, rules, key, text_col)
    for rule in sorted(rules, key=lambda r: not r.early):
        marked = marked.withColumn(text_col, F.when(F.coalesce(_wanted(rule, kinds), F.lit(False)) & F.col(text_col).rlike(rule.java), _replaced(text_col, rule)).otherwise(F.col(text_col)))
    return marked.select(*columns)
