"""Licences by sparse TF-IDF cosine to templates, handed down the directory tree. Built-in functions only.

Every line, sentence, paragraph and whole text is a unit; its vector holds tf * idf of its words. Document frequencies of
the templates' words are counted over all texts; any other word counts as the rarest. A unit is a notice of the
template with the highest cosine, if that reaches `least` and the words agree that tell apart licences of much the
same wording: the template's numbers and its family's words (lesser, affero, sa, nd and the like).

A unit that shares only words S with template t has a cosine of at most |t restricted to S| / |t|. So each template
has anchors, its heaviest words, without which the cosine can't reach `least`; a text without anchors is skipped
unsplit, and no notice is lost.

A licence file is a file named so, or one whose notices hold half of its words or more. It licenses its directory,
and every file below that has no notice of its own takes the licence of its nearest ancestor directory: each file's
ancestors are joined to the licensed directories and the deepest wins.

Main cost: two passes over the texts, neither shuffled. What moves is anchored units' words and a few short rows a
file. The template vectors are a few hundred rows and broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.llm.storage import keep

# Notices of well-known licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
    # titles and openings of licence files
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "Released under the Unlicense."),
    *((f"BSD-{k}-Clause", f"Licensed under the BSD {k}-Clause License.") for k in (2, 3)),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("BSD-2-Clause", "ISC", "Unlicense", "MPL-2.0", "CC0-1.0")),
    *(
        (f"{short}-{version}.0" if "." not in version else f"{short}-{version}", text)
        for short, kind, version in (("GPL", "", "2"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3"), ("AGPL", "Affero ", "3"))
        for text in (
            f"This work is licensed under the GNU {kind}General Public License, version {version}.",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or any later version.",
            f"SPDX-License-Identifier: {short}-{version if '.' in version else version + '.0'}-or-later",
        )
    ),
    *(
        (f"CC-{short}-4.0", text)
        for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
        for text in (
            f"This work is licensed under a Creative Commons {name} 4.0 International License.",
            f"Creative Commons {name} 4.0 International Public License",
            f"Licensed under CC {short.replace('-', ' ', 1)} 4.0.",
            f"SPDX-License-Identifier: CC-{short}-4.0",
        )
    ),
)
# What tells members of a family of licences apart.
FAMILIES = {
    ("GPL-", "LGPL-", "AGPL-"): frozenset("lesser library affero lgpl agpl".split()),
    ("CC-BY",): frozenset("sa sharealike alike nd noderivatives noderivs derivatives nc noncommercial commercial".split()),
}
FILE_NAMES = r"(?i)^(licen[sc]es?|copying|notice|unlicense)([._-].*)?$"
_SPLIT = r"[^a-z0-9]+"
# after a sentence's end, but not after the point of a single letter; the same in Python and Java
_SENTENCE_END = r"""(?:(?<=[A-Za-z0-9)"'][A-Za-z0-9)"'][.!?;])|(?<=[0-9][.!?;]))\s+|\n[ \t\r]*\n"""


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def _tokens(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def telling(license: str, text: str) -> tuple[list[str], list[str]]:
    """The words that a unit must hold to be this template's notice, and those that it mustn't."""
    words = set(_tokens(text))
    family = next((told for names, told in FAMILIES.items() if license.startswith(names)), frozenset())
    return sorted({w for w in words if w.isdigit()} | (words & family)), sorted(family - words)


def weigh(df: dict[str, int], texts: int, templates: tuple[tuple[str, str], ...], least: float) -> tuple[dict[str, float], list[dict[str, float]], set[str]]:
    """idf by word, the templates' unit vectors, and the anchors."""
    idf = {w: math.log((texts + 1) / (df.get(w, 0) + 1)) + 1 for _, t in templates for w in _tokens(t)}
    vectors, anchors = [], set()
    for _, text in templates:
        raw = {w: n * idf[w] for w, n in Counter(_tokens(text)).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vector = {w: v / norm for w, v in raw.items()}
        vectors.append(vector)
        left = 1.0
        for w, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if left < least * least - 1e-9:
                break
            anchors.add(w)
            left -= v * v
    return idf, vectors, anchors


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = 0.75, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """The rows of files without the text, with: license string, origin ('own', 'inherited' or 'none'), similarity
    double (of its notice), licensed_by string (the directory it inherits from).

    The own licence is that of the notice with the highest cosine, ties to the name first in order. Null and empty
    texts have none of their own; a null path inherits nothing. Directories are what comes before each '/', the root
    is ''. Two licence files of one directory: higher cosine, then name. Repeated rows give a row each; columns of
    these names are replaced.
    """
    spark = files.sparkSession
    made = ["license", "origin", "similarity", "licensed_by"]
    files = files.drop(*made)
    others = [c for c in files.columns if c != text_col]
    vocabulary = sorted({w for _, t in templates for w in _tokens(t)})
    known = F.array(*map(F.lit, vocabulary))
    counted = files.select(F.explode(F.array_intersect(F.split(F.lower(text_col), _SPLIT), known)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    df = {r["w"]: r["n"] for r in counted.collect()}
    texts = files.select(F.count(F.lit(1))).first()[0]
    idf, vectors, anchors = weigh(df, texts, templates, least)
    rarest = math.log(texts + 1) + 1

    anchored = F.arrays_overlap(F.split(F.lower(text_col), _SPLIT), F.array(*map(F.lit, sorted(anchors))))
    rows = keep(files.select(F.monotonically_increasing_id().alias("_row"), F.struct(*others).alias("_file"), F.col(path_col).alias("_path"), F.when(anchored, F.col(text_col)).alias("_text")))
    lines = F.transform(F.split("_text", "\n"), lambda x: F.struct(F.lit("line").alias("kind"), x.alias("unit")))
    passages = F.transform(F.split("_text", r"\n[ \t\r]*\n"), lambda x: F.struct(F.lit("paragraph").alias("kind"), x.alias("unit")))
    sentences = F.transform(F.split("_text", _SENTENCE_END), lambda x: F.struct(F.lit("sentence").alias("kind"), x.alias("unit")))
    whole = F.array(F.struct(F.lit("whole").alias("kind"), F.col("_text").alias("unit")))
    units = rows.where("_text is not null").select("_row", F.posexplode(F.concat(lines, sentences, passages, whole)).alias("at", "u")).select("_row", "at", "u.kind", _words(F.col("u.unit")).alias("words"))
    units = units.where(F.arrays_overlap("words", F.array(*map(F.lit, sorted(anchors)))) | (F.col("kind") == "whole"))
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "w string, idf double"))
    shares = F.broadcast(spark.createDataFrame([(templates[k][0], k, w, v) for k, x in enumerate(vectors) for w, v in x.items()], "license string, template int, w string, share double"))
    terms = units.select("_row", "at", "kind", F.size("words").alias("size"), F.explode("words").alias("w")).groupBy("_row", "at", "kind", "size", "w").agg(F.count(F.lit(1)).alias("tf"))
    terms = terms.join(weights, "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rarest)))
    rules = [telling(*t) for t in templates]
    told = sorted({w for r in rules for words in r for w in words})
    norms = terms.groupBy("_row", "at", "kind", "size").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_set(F.when(F.col("w").isin(told), F.col("w"))).alias("told"))
    agree = F.broadcast(spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "template int, asked array<string>, barred array<string>"))
    dots = terms.join(shares, "w").groupBy("_row", "at", "license", "template").agg(F.sum(F.col("x") * F.col("share")).alias("dot"))
    near = dots.join(norms, ["_row", "at"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= least)
    near = near.join(agree, "template").where((F.size(F.array_except("asked", "told")) == 0) & ~F.arrays_overlap("barred", "told"))
    best = near.groupBy("_row", "at", "kind", "size").agg(F.max("cosine").alias("cosine"), F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("first"))
    best = best.select("_row", "kind", "size", "cosine", F.col("first.license").alias("license"))
    own = best.groupBy("_row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"), F.greatest(*[F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)) for k in ("line", "sentence")]).alias("held"), F.max(F.when(F.col("kind") == "whole", 1).otherwise(0)).alias("all"))
    sizes = norms.where("kind = 'whole'").select("_row", F.col("size").alias("words"))
    own = keep(own.join(sizes, "_row", "left").select("_row", F.col("b.license").alias("license"), (-F.col("b.c")).alias("similarity"), ((F.col("all") == 1) | (2 * F.col("held") >= F.col("words"))).alias("mostly")))

    placed = rows.drop("_text").join(own, "_row", "left")
    parts = F.split("_path", "/")
    placed = placed.withColumn("folder", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    named = F.element_at(parts, -1).rlike(FILE_NAMES)
    licensed = placed.where(F.col("_path").isNotNull() & F.col("license").isNotNull() & (F.col("mostly") | named)).groupBy(F.col("folder").alias("dir")).agg(F.min(F.struct((-F.col("similarity")).alias("c"), "license")).alias("b")).select("dir", F.col("b.license").alias("given"))
    # a folder asks once for all its files, so the root and other upper folders are asked by folders, not by files
    steps = F.split("folder", "/")
    ways = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("dir")))
    above = placed.where("license is null and folder is not null").select("folder").distinct().select("folder", F.explode(ways).alias("a")).select("folder", "a.depth", "a.dir")
    handed = above.join(licensed, "dir").groupBy("folder").agg(F.max_by(F.struct("given", "dir"), "depth").alias("g")).select("folder", "g.given", "g.dir")
    placed = placed.join(handed, "folder", "left").withColumns({c: F.when(F.col("license").isNull(), F.col(c)) for c in ("given", "dir")})
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return placed.select(*[F.col("_file").getField(c).alias(c) for c in others], F.coalesce("license", "given").alias("license"), origin.alias("origin"), "similarity", F.col("dir").alias("licensed_by"))
