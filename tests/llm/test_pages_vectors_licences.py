"""Pages, vectors, licences, the registered queries and the pipeline on small tables."""

import math
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from fovea.llm import htmltext, license_scan, queries, storage, topk


# -- pages -------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="home">
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu one</a></li><li>Menu two</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<main><article><h1>Big&nbsp;title &amp; more</h1><p>First  para
graph &lt;ok&gt; <b>bold</b><br>line<p>Second paragraph without an end tag<div class="ad">Buy now</div><ul><li>item one<li>item two</ul>
<pre>a
  b</pre></article></main>
<aside class="sidebar"><p>Related things</p></aside><section id="comments"><p>Nice post!</p></section><form><p>Your name</p></form>
<footer><p>&copy; site</p></footer></body></html>"""
TEXT = "Big title & more\nFirst para graph <ok> bold line\nSecond paragraph without an end tag\nitem one\nitem two\na b"


@pytest.fixture(scope="module")
def model(spark, sf):
    return htmltext.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def test_blocks_follow_the_page_structure():
    found = htmltext.blocks(PAGE)
    assert "\n".join(b.text for b in found if htmltext.named_label(b)) == TEXT
    assert not any("hidden" in b.text or "var a" in b.text for b in found)
    assert htmltext.blocks("") == [] and [b.text for b in htmltext.blocks("plain <b>text")] == ["plain text"]
    assert [b.text for b in htmltext.blocks("<p title='a>b'>x</p><p>y &#233; <")] == ["x", "y é <"]


@pytest.mark.parametrize(
    "between",
    ['<svg-icon name="x"></svg-icon>', "<template-card></template-card>", "<STYLE-GUIDE/>", "<svg/>", '<svg viewBox="0 > 1" />', "<svg\nwidth=1/>", "<svg><path d='M0'/>in</svg>", "<script src='a'>in</script >", "<style>in</style>"],
)
def test_text_after_custom_and_self_closed_elements_stays(between):
    assert [b.text for b in htmltext.blocks(f"<p>a</p>{between}<p>lost text</p>")] == ["a", "lost text"]


def test_text_inside_custom_elements_stays():
    assert [b.text for b in htmltext.blocks("<template-card><p>one</p></template-card><p>two</p>")] == ["one", "two"]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = htmltext.Labeller(1)
    x, y = rng.normal(size=(5, 3, htmltext.DIMS)), rng.integers(0, 2, (5, 3)).astype(float)
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = mask[1:, 2] = False

    def loss():
        s = net.scores(x, mask)
        return float((np.where(mask, np.logaddexp(0, s) - y * s, 0)).sum() / mask.sum())

    grads = net.gradients(x, mask, y)
    for name, value in net.w.items():
        flat = value.reshape(-1)
        for k in rng.choice(flat.size, min(4, flat.size), replace=False):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-5, abs=5e-5)


def test_open_quotes_end_at_the_next_bracket():
    assert [b.text for b in htmltext.blocks('<p title="a>b</p><p>c')] == ["b", "c"]


def test_forward_pass_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    net = htmltext.Labeller(3)
    x = rng.normal(size=(6, htmltext.DIMS)).astype(np.float32)
    h, sigma = htmltext.HIDDEN, lambda v: 1 / (1 + math.exp(-v))

    def states(order, d):
        out, hidden, cell = {}, [0.0] * h, [0.0] * h
        for t in order:
            z = [float(x[t] @ net.w["x" + d][:, j]) + net.w["b" + d][j] + sum(hidden[k] * net.w["h" + d][k, j] for k in range(h)) for j in range(4 * h)]
            cell = [sigma(z[h + j]) * cell[j] + sigma(z[j]) * math.tanh(z[3 * h + j]) for j in range(h)]
            hidden = [sigma(z[2 * h + j]) * math.tanh(cell[j]) for j in range(h)]
            out[t] = hidden
        return out

    forward, backward = states(range(6), "f"), states(range(5, -1, -1), "b")
    want = [float(np.dot([*forward[t], *backward[t]], net.w["o"]) + x[t] @ net.w["s"] + net.w["c"][0]) for t in range(6)]
    padded, mask = htmltext._padded([x, x[:2]])
    assert np.allclose(net.scores(padded, mask)[:, 0], want, atol=1e-4)


SENTENCES = (
    "The committee met again on Tuesday to talk about the new bridge over the river and how it should be paid for by the two towns.",
    "Nobody expected that the old mill would still be standing after the flood, yet there it was, dry and whole, in the morning light.",
    "Three engineers had written a report on the piers, and all of them agreed that the work could begin before the end of the summer.",
    "A path on the northern side was asked for by people who live near the water, which would cost a little more than planned.",
)
PROSE = "".join(f"<p>{p}</p>" for p in SENTENCES)
LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("One", "Two", "Three", "Four"))
HEAD = "<h1>Bridge news</h1>"
#: Pages of unlike shape whose article is the heading and the four sentences.
TEMPLATES = {
    "legal section": f'{HEAD}<section class="legal">{PROSE}</section>',
    "legal section with heading": f'<section class="legal">{HEAD}{PROSE}</section>',
    "notice": f'<div class="notice">{HEAD}{PROSE}</div><nav><a href="/">Home</a></nav>',
    "widget": f'<div class="widget">{HEAD}{PROSE}</div><div class="footer"><p>all rights reserved</p></div>',
    "related": f'<ul>{LINKS}</ul><div class="related">{HEAD}{PROSE}</div>',
    "unnamed list before": f"<ul>{LINKS}</ul><div>{HEAD}{PROSE}</div>",
    "unnamed lists around": f"<div><ul>{LINKS}</ul></div><div><div>{HEAD}{PROSE}</div></div><div><ul>{LINKS}</ul></div>",
    "unnamed divs of links": f"<div><div><a href=1>Start</a></div><div><a href=1>Sport</a></div><div><a href=1>Culture</a></div></div>{HEAD}{PROSE}",
    "layout table": f"<table><tr><td><ul>{LINKS}</ul></td><td>{HEAD}{PROSE}</td></tr></table>",
    "bare": f"{HEAD}{PROSE}",
    "deep": f"<div><div><div><div>{HEAD}<div>{PROSE}</div></div></div></div></div>",
    "content id": f'<header><a href="/">Site</a></header><div id="content">{HEAD}{PROSE}</div><footer>imprint</footer>',
    "main": f"<nav><ul>{LINKS}</ul></nav><main>{HEAD}{PROSE}</main>",
    "article in main": f'<main><article>{HEAD}{PROSE}</article></main><aside><p>{SENTENCES[1]}</p></aside>',
    "comments": f'<div class="post">{HEAD}{PROSE}</div><div class="comments"><p>{SENTENCES[1]}</p><p>I liked it</p></div>',
    "comments by id": f'<article>{HEAD}{PROSE}</article><section id="comments"><p>{SENTENCES[2]}</p></section>',
    "cookie banner": f'<div class="cookie-consent"><p>We use cookies</p><button>Fine</button></div><div class="entry">{HEAD}{PROSE}</div>',
    "advert inside": f'<div class="story">{HEAD}<p>{SENTENCES[0]}</p><div class="ad">Buy now</div>{"".join(f"<p>{p}</p>" for p in SENTENCES[1:])}</div>',
    "sidebar": f'<div class="sidebar"><h3>More</h3><ul>{LINKS}</ul></div><div class="page">{HEAD}{PROSE}</div>',
    "newsletter form": f'<div class="blog">{HEAD}{PROSE}</div><form class="newsletter"><label>Mail</label><button>Subscribe</button></form>',
    "breadcrumbs": f'<div class="breadcrumbs"><a href="/">Home</a> <a href="/n">News</a></div><section>{HEAD}{PROSE}</section>',
    "share bar": f'<article>{HEAD}<div class="social share"><a href="#">Share</a></div>{PROSE}</article>',
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_article_text_of_unlike_templates(model, name):
    page = f"<!DOCTYPE html><html><head><title>Bridge news</title></head><body>{TEMPLATES[name]}</body></html>"
    assert htmltext.main_texts([page], model)[0].split("\n") == ["Bridge news", *SENTENCES]


def para(*which):
    return "".join(f"<p>{SENTENCES[k]}</p>" for k in which)


OWN = "<ul><li>Two streets</li><li>One hall</li><li>The old mill</li></ul>"
COOKIES = "She baked cookies for the whole school and everyone took one home in a paper bag."
#: Pages whose article holds more than its sentences, or stands beside what says nothing by its names.
MIXED = {
    "own list": (f"<article>{HEAD}{para(0, 1)}{OWN}{para(2, 3)}</article>", [*SENTENCES[:2], "Two streets", "One hall", "The old mill", *SENTENCES[2:]]),
    "own list in a div": (f"<div>{HEAD}{para(0, 1)}{OWN}{para(2, 3)}</div>", [*SENTENCES[:2], "Two streets", "One hall", "The old mill", *SENTENCES[2:]]),
    "own list at the end": (f"<article>{HEAD}{para(0, 1, 2)}{OWN}</article><footer>x</footer>", [*SENTENCES[:3], "Two streets", "One hall", "The old mill"]),
    "links between prose": (f'<div class="post">{HEAD}{para(0, 1)}<ul>{LINKS}</ul>{para(2, 3)}</div>', [*SENTENCES[:2], "One", "Two", "Three", "Four", *SENTENCES[2:]]),
    "links between prose, no name": (f"<div>{HEAD}{para(0, 1)}<ul>{LINKS}</ul>{para(2, 3)}</div>", [*SENTENCES[:2], "One", "Two", "Three", "Four", *SENTENCES[2:]]),
    "remarks after main": (f"<main>{HEAD}{PROSE}</main><div><p>I walked there yesterday and it was closed already.</p><p>Thanks for writing about it!</p></div>", [*SENTENCES]),
    "remarks after an article": (f"<article>{HEAD}{PROSE}</article><div><h3>Three answers</h3><p>What a shame, the view from there was the best in town.</p></div>", [*SENTENCES]),
    "cookies before": (f'<div class="cc-window">This website uses cookies to ensure you get the best experience.</div><div>{HEAD}{PROSE}</div>', [*SENTENCES]),
    "cookies after": (f'<div>{HEAD}{PROSE}</div><div class="cc-window"><p>We and our partners use cookies to remember you.</p></div>', [*SENTENCES]),
    "footer without a name": (f"<div>{HEAD}{PROSE}</div><div>© 2023 River Town Herald. All rights reserved.</div>", [*SENTENCES]),
    "footer line after main": (f"<main>{HEAD}{PROSE}</main><p>Copyright 2022 The Herald</p>", [*SENTENCES]),
    "definitions": (f"<article>{HEAD}{para(0, 1)}<dl><dt>Length</dt><dd>40 metres</dd></dl>{para(2)}</article>", [*SENTENCES[:2], "Length", "40 metres", SENTENCES[2]]),
    "table of facts": (f"<article>{HEAD}{para(0, 1)}<table><tr><td>Year</td><td>1902</td></tr></table>{para(2)}</article>", [*SENTENCES[:2], "Year", "1902", SENTENCES[2]]),
    "short paragraphs": (f"<article>{HEAD}<p>It rained.</p><p>Nobody came.</p>{para(0, 1, 2)}</article>", ["It rained.", "Nobody came.", *SENTENCES[:3]]),
    "an article about cookies": (f"<article>{HEAD}{para(0, 1)}<p>{COOKIES}</p>{para(2)}</article>", [*SENTENCES[:2], COOKIES, SENTENCES[2]]),
}


@pytest.mark.parametrize("name", MIXED)
def test_lists_remarks_and_notices(model, name):
    body, want = MIXED[name]
    page = f"<!DOCTYPE html><html><head><title>Bridge news</title></head><body>{body}</body></html>"
    assert htmltext.main_texts([page], model)[0].split("\n") == ["Bridge news", *want]


@pytest.mark.parametrize("page", ["<svg a b c " * 95_000, '<script x="a ' * 77_000, '<a x="' * 170_000 + ">", '<a "> ' * 170_000 + "'>", '<a "> <a " ' * 90_000 + "'", "<" * 1_000_000, "<div>" * 100_000 + "<p>x</p>" * 20_000, "<!--" * 250_000, "<svg>" + "</svg     " * 100_000, "<div>x" * 100_000])
def test_pages_of_a_megabyte_left_open_take_a_moment(page):
    began = time.process_time()
    htmltext.blocks(page)
    assert time.process_time() - began < 3


def test_labels_come_from_several_signals():
    label = lambda body: list(htmltext.page_labels(htmltext.blocks(f"<html><body>{body}</body></html>")))
    assert label(TEMPLATES["legal section"]) == [1] * 5 and label(TEMPLATES["unnamed list before"]) == [0] * 4 + [1] * 5
    assert label(TEMPLATES["comments"]) == [1] * 5 + [0] * 2
    assert label(f"{HEAD}{PROSE[:140]}<ul>{LINKS}</ul>{PROSE}")[2:6] == [1] * 4  # links between the article's prose stay


def test_extraction_on_known_and_unknown_templates(spark, sf, model):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in htmltext.extract(pages.select("page_id", "html"), model).join(pages, "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", article.replace("<br>", " "))
        import html

        want = "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if t)
        assert r["text"] == want and r["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, PAGE, "t"), (1, PAGE, "t"), (2, None, "t"), (3, "", "t"), (None, "<nav>x</nav>", "t")], "page_id long, html string, text string")
    got = htmltext.extract(odd, model).collect()
    assert len(got) == 5 and {r["text"] for r in got if r["page_id"] in (2, 3)} == {""}
    kept = set(next(r["text"] for r in got if r["page_id"] == 1).split("\n"))
    assert {"First para graph <ok> bold line", "Second paragraph without an end tag"} <= kept
    assert not kept & {"Menu one", "We use cookies", "Buy now", "Related things", "Nice post!", "Your name", "© site"}
    assert htmltext.extract(odd.limit(0), model).count() == 0
    assert htmltext.fit(odd.limit(0)) is not None


# -- vectors -----------------------------------------------------------------------------------------------------------


def brute_top(rows, k, scale=1024):
    fine = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, qv in fine:
        if q % 10 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in fine if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("count,rows", [(3, 8), (130, 8), (300, 64)])
def test_top_k_equals_brute_force(spark, count, rows):
    rng = np.random.default_rng(count)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=6).round(2)]) for i in range(count)]
    data += [(count + j, data[0][1]) for j in range(5)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, []), (None, [1.0] * 6), (1005, [0.5, 0.25])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.col("id") % 10 == 0, k=7, pivots=5, annulus_rows=rows, group_queries=3)
    assert {tuple(r) for r in got.collect()} == brute_top(data, 7)
    assert topk.top_k(df.limit(0), F.col("id") % 10 == 0).count() == 0


# -- licences ----------------------------------------------------------------------------------------------------------


def brute_best(text, df, n, least):
    """Highest cosine over lines, paragraphs and the whole."""
    idf, vectors, _ = license_scan.weigh(df, n, license_scan.TEMPLATES, 0.0)
    rarest = math.log(n + 1) + 1
    best = None
    for unit in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]:
        tf = {}
        for w in license_scan._tokens(unit):
            tf[w] = tf.get(w, 0) + 1
        x = {w: c * idf.get(w, rarest) for w, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        for (name, _), t in zip(license_scan.TEMPLATES, vectors, strict=True):
            c = round(sum(v * t.get(w, 0) for w, v in x.items()) / norm, 9) if norm else 0
            if c >= least and (best is None or (-c, name) < best):
                best = (-c, name)
    return best


FILES = [
    ("a/LICENSE", "Released under the MIT License.\nCopyright someone."),
    ("a/x.py", "# Licensed under the Apache License, Version 2.0.\ncode here and more code " + "and more of it " * 9),
    ("a/b/y.py", "nothing of note"),
    ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("a/b/c/d/z.py", "plain text"),
    ("other/q.py", "the license of the work under a version of the public"),
    ("LICENSE.txt", "All rights reserved."),
    ("a/b/w.py", None),
    ("a/b/w.py", ""),
    (None, "text"),
    ("top.py", "x " * 5000 + "\n\nreleased under the mit license"),
]


def test_licences_and_inheritance(spark):
    df = spark.createDataFrame([(p, t, "clash") for p, t in FILES], "path string, text string, license string").repartition(2)
    got = license_scan.scan(df).collect()
    assert len(got) == len(FILES)
    texts = [t or "" for _, t in FILES]
    counts = {}
    for t in texts:
        for w in set(license_scan._tokens(t)):
            counts[w] = counts.get(w, 0) + 1
    for path, text in FILES:
        best = brute_best(text or "", counts, len(FILES), 0.75)
        for r in (r for r in got if r["path"] == path):
            if best:
                assert (r["origin"], r["license"]) == ("own", best[1]) and r["similarity"] == pytest.approx(-best[0])
            else:
                assert r["origin"] != "own"
    by = {r["path"]: (r["license"], r["origin"], r["licensed_by"]) for r in got}
    assert by["a/b/y.py"] == ("MIT", "inherited", "a") and by["a/b/c/d/z.py"] == ("GPL-3.0", "inherited", "a/b/c")
    assert by["other/q.py"] == ("Proprietary", "inherited", "") and by[None] == (None, "none", None)
    assert license_scan.scan(df.limit(0)).count() == 0


NOTICES = [
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY 3.0.", None),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("Posts here may be copied by all who read them. Licensed under the Apache License, Version 2.0. Please write to the keeper of the list for more about it.", "Apache-2.0"),
    ("Some words come first here. This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. And other words follow it in the same paragraph.", "MPL-2.0"),
    ("                    GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n", "LGPL-3.0"),
    ("BSD 2-Clause License\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD-2-Clause"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
]


def test_files_inherit_beside_clashing_columns(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [("LICENSE", notice), ("top.txt", "no"), ("a/LICENSE", "Released under the ISC License."), ("a/b/c/x.txt", None), ("a/y.txt", ""), ("/rooted.txt", "no"), ("b//z.txt", "no"), (None, "no")]
    names = ["dir", "given", "_row", "mostly", "folder", "path2"]
    df = spark.createDataFrame([(p, t, *names) for p, t in rows], ", ".join(["path string", "text string", *(f"`{n}` string" for n in names)]))
    out = license_scan.scan(df)
    assert out.columns == ["path", *names, "license", "origin", "similarity", "licensed_by"]
    got = {r["path"]: (r["license"], r["origin"], r["licensed_by"]) for r in out.collect()}
    assert got["top.txt"] == got["/rooted.txt"] == got["b//z.txt"] == ("Apache-2.0", "inherited", "")
    assert got["a/b/c/x.txt"] == got["a/y.txt"] == ("ISC", "inherited", "a") and got["a/LICENSE"][1] == "own" and got[None] == (None, "none", None)


def test_notices_of_like_licences_and_inside_prose(spark):
    got = license_scan.scan(spark.createDataFrame([(f"{k}/x", t) for k, (t, _) in enumerate(NOTICES)], "path string, text string"))
    assert {r["path"]: r["license"] for r in got.collect()} == {f"{k}/x": want for k, (_, want) in enumerate(NOTICES)}


# -- queries and pipeline ----------------------------------------------------------------------------------------------


def test_registered_queries_cover_the_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_a_row_for_each_input(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    n = df.count()
    table = {"op5_html": "pages", "op7_topk": None, "op1_packing": None}.get(name, "documents")
    assert n == spark.read.parquet(f"{sf}/{table}.parquet").count() if table else n > 0
    if name in queries.ORACLE_SQL:
        import duckdb

        con = duckdb.connect()
        for t in ("embeddings", "documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.sql(queries.ORACLE_SQL[name])
        order = sorted(df.columns)
        assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[list(want.columns).index(c)] for c in order) for r in want.fetchall())


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10_001, "123 456 !!", "en", "s", 10), (10_002, None, None, None, None), (10_003, "", "en", "s", 0), (10_004, "the password = hunter2secret and the rest of it is fine", "en", "s", 1)], docs.schema)
    now = docs.unionByName(junk)
    clean = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = storage.keep(stage(spark, now, sf))
        assert now.columns == docs.columns
        left = {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}
        if name == "language":
            assert not left.keys() & {10_001, 10_002, 10_003} and len(left) == clean + 1
    assert left[10_004] == "the <assign> and the rest of it is fine"
    assert len(set(left.values())) == len(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left)


@pytest.mark.parametrize("name", ["language", "toxicity", "near_duplicates", "secrets"])
def test_stages_keep_clashing_columns_repeats_and_null_keys(spark, sf, name):
    text = "the old bridge over the river is closed and the path along the water is open again " * 3
    extra = {"score": -7.0, "lang_pred": "xx", "toxic_score": 5.0, "toxic_spans": "s", "kinds": "k", "key": "y", "component_id": "c", "class": "z"}
    base = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(20_001, text, "en", "s", 1), (20_001, text, "en", "s", 1), (None, "another text of plain words that nobody else has written down here", "en", "s", 1), (20_002, text + "and so on " * 30_000, "en", "s", 1)], base.schema)
    docs = base.unionByName(odd)
    for column, value in extra.items():
        docs = docs.withColumn(column, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(value))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert out.columns == docs.columns
    rows = out.where("doc_id > 20000 or doc_id is null").collect()
    assert len(rows) == (3 if name == "near_duplicates" else 4) and all(r[c] == v for r in rows for c, v in extra.items())


def test_near_duplicates_go_by_row(spark, sf):
    a, b, c = (f"{x} and many more words of the kind that only this text has in this order {x}" for x in ("bridge", "cat", "house"))
    c2 = "a text of its own about rivers, boats and the people who mend them every spring"
    rows = [(3, a), (5, a), (5, c2), (7, c), (7, c), (None, a), (None, a), (8, ""), (8, ""), (9, None), (9, None), (4, b)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], spark.read.parquet(f"{sf}/documents.parquet").schema).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, storage.keep(docs), sf).collect()
    want = [(3, a), (5, c2), (7, c), (None, a), (None, a), (8, ""), (8, ""), (9, None), (9, None), (4, b)]
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert stage(spark, docs, sf).count() == 0
