"""The registered query of each operator: whole tables in, full results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.llm import htmltext, importance, jaccard, langid, license_scan, manifest, packing, piecelattice, secret_scan, simhash, substrings, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [secret_scan.count(F.col("spans"), rule).alias(f"n_{rule.kind}") for rule in secret_scan.BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_neighbours(table(spark, sf_dir, "documents"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8's block tables find: the documents within three bits of each one."""
    return simhash.neighbourhoods(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages, htmltext.fit(pages))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecelattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder for each source, in it one for each thousand keys."""
    docs = table(spark, sf_dir, "documents")
    shelf = F.floor(F.col("doc_id") / 1000).cast("string")
    return license_scan.scan(docs.select("doc_id", F.concat_ws("/", "source", shelf, F.col("doc_id").cast("string")).alias("path"), "text"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, longest=1)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest.manifest(table(spark, sf_dir, "documents"), changed={"text": lowered}, where=tampered)


QUERIES = {f.__name__: f for f in (op1_packing, op10_langid, op2_toxicity, op9_jaccard, op6_secrets, op8_fingerprints, op7_topk, op5_html, op3_sentencepiece, op4_licenses, op11_substrings, op12_importance, op13_manifest, near_fingerprints)}
# DuckDB has no CRC-32: eight steps a byte over a list of bytes, the byte joining at the first.
_CRC = "xor(4294967295, list_reduce(flatten(list_transform({bytes}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0])), lambda a, v: xor(xor(a, v) >> 1, (xor(a, v) & 1) * 3988292384), 4294967295))"


def _crc(text: str) -> str:
    return _CRC.format(bytes=f"list_transform(range(1, len(hex({text})), 2), lambda i: CAST('0x' || substr(hex({text}), i, 2) AS BIGINT))")


def _manifest_sql(levels: int, tops: int) -> str:
    """Trees of at most 16 ** levels leaves and 16 ** tops groups: a table for each level, then joins down a document's path."""
    field = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-'))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {leaf.format("text")} AS leaf,
  CASE WHEN ({_crc("CAST(doc_id AS VARCHAR)")}) % 5 = 0 THEN {leaf.format(lowered)} END AS changed FROM documents)""",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS i FROM d)",
        "r0 AS (SELECT tree, i // 16 AS run, list(leaf ORDER BY i) AS h, any_value(w) AS w FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM n0) GROUP BY ALL)",
    ]
    for k in range(1, levels):
        parts.append(f"r{k} AS (SELECT tree, run // 16 AS run, list(CASE WHEN w = 1 THEN h[1] ELSE sha256(array_to_string(h, '')) END ORDER BY run) AS h, any_value((w + 15) // 16) AS w FROM r{k - 1} GROUP BY tree, run // 16)")
    parts.append(f"s AS (SELECT tree, CASE WHEN w = 1 THEN h[1] ELSE sha256(array_to_string(h, '')) END AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS j, count(*) OVER () AS w FROM r{levels - 1})")
    parts.append("t0 AS (SELECT j // 16 AS run, list(subroot ORDER BY j) AS h, any_value(w) AS w FROM s GROUP BY j // 16)")
    for k in range(1, tops):
        parts.append(f"t{k} AS (SELECT run // 16 AS run, list(CASE WHEN w = 1 THEN h[1] ELSE sha256(array_to_string(h, '')) END ORDER BY run) AS h, any_value((w + 15) // 16) AS w FROM t{k - 1} GROUP BY run // 16)")
    parts.append(f"z AS (SELECT CASE WHEN w = 1 THEN h[1] ELSE sha256(array_to_string(h, '')) END AS root FROM t{tops - 1})")
    last = "n0.doc_id, n0.leaf, s.subroot, z.root, coalesce(n0.changed, n0.leaf) AS f0, '' AS p0, n0.tree, n0.i, s.j"
    parts.append(f"f0 AS (SELECT {last} FROM n0 JOIN s USING (tree) CROSS JOIN z)")
    steps = [(f"r{k}", "i", f"f.i // {16 ** (k + 1)}", 16**k, "r.tree = f.tree AND ") for k in range(levels)] + [(f"t{k}", "j", f"f.j // {16 ** (k + 1)}", 16**k, "") for k in range(tops)]
    for n, (name, at, run, unit, tree) in enumerate(steps):
        here = f"(f.{at} // {unit} % 16)"
        sides = f"array_to_string(r.h[1:{here}], ''), array_to_string(r.h[{here} + 2:], '')"
        left, right = sides.split(", array", 1)[0], "array" + sides.split(", array", 1)[1]
        parts.append(f"f{n + 1} AS (SELECT f.doc_id, f.leaf, f.subroot, f.root, CASE WHEN r.w = 1 THEN f.f0 ELSE sha256({left} || f.f0 || {right}) END AS f0, CASE WHEN r.w = 1 THEN f.p0 ELSE f.p0 || {left} || {right} END AS p0, f.tree, f.i, f.j FROM f{n} f JOIN {name} r ON {tree}r.run = {run})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p0) AS proof_sha256, f0 AS folded_root, f0 = root AS verified FROM f{len(steps)}"


ORACLE_SQL: dict[str, str] = {
    "op11_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, x.i AS i, x.g AS g
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 'g': sha256(array_to_string(w[i:i + 12], ' '))})) AS x FROM w)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE first < doc_id),
a AS (SELECT doc_id, list(p) AS p FROM r GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(w) AS n, coalesce(len(p), 0) AS gone, CASE WHEN p IS NULL THEN w ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(p, i)))) END AS kept
  FROM w LEFT JOIN a ON a.doc_id = w.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op12_importance": rf"""
WITH x AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
y AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM benchmark),
c AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(w) AS g FROM x) GROUP BY ALL),
b AS (SELECT g, ({_crc("g")}) % 10000 AS b FROM (SELECT g FROM c UNION SELECT g FROM y)),
s AS (SELECT b, sum(n) AS s FROM c JOIN b USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM y JOIN b USING (g) GROUP BY b),
k AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM s) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
m AS (SELECT doc_id, sum(n) AS f, sum(n * gain) AS total FROM c JOIN b USING (g) JOIN k USING (b) GROUP BY doc_id),
d AS (
  SELECT x.doc_id, len(w) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / CAST(f AS DOUBLE)), 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || CAST(x.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM x LEFT JOIN m USING (doc_id)),
e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20 QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= (SELECT count(*) // 10 FROM e WHERE n_features >= 20))
SELECT e.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(r.rank AS BIGINT) AS rank FROM e LEFT JOIN r USING (doc_id)""",
    "op13_manifest": _manifest_sql(levels=5, tops=2),
    "op9_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT u.b, r.root FROM r JOIN u ON r.doc_id = u.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY ALL""",
    "op7_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
