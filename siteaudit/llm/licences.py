"""Licence scans by a trained paragraph classifier, in DataFrame functions alone.

Paragraphs are lines, and neighbouring lines joined where a line alone is not named. One with a cue (``CUE``) becomes a sparse set of words and word pairs;
a multinomial logistic regression over those that the templates contain names a licence family
or the class ``unknown``. The regression is trained here on paragraphs made from the templates
below and, as the unknown class, on ordinary sentences with licence words and on paragraphs of
the corpus without cues (``NEGATIVES`` at most, of as many documents, the first by hash). A family is reported only
above the ``LEAST`` probability and only if the paragraph holds enough of one of that family's
templates: their shared words are at least ``COVER`` of the template's. All else is unknown.

A line with a cue that is not named alone is tried again with its neighbours: every run of lines
around it up to a line without words or one named alone, with ``LONGEST`` words at most on each
side, which is the longest template. The run that holds most of a template is taken, of equal
ones the shortest; runs of one family that overlap are one licence.

A line may hold more than one notice, or a notice amid other words, and a notice may begin or end
within a line. So around every cue word, wherever it stands, every window of as many words as some
template has is tried too (``_inner``); the one that holds most of a template names the cue. A line
counts once for each family found in it.

Weights are a table of a few thousand rows, fixed by the templates, so its broadcast is bounded.
The templates are a table of a row a family, for the same reason.
Paragraphs without a cue cost one pattern search and are no licence: the cues (``SIGNS`` among them)
are such that the terms of a template that hold none of them are less than ``COVER`` of it. So no
notice is lost by them, whichever of its words it lacks. Of the neighbours of a cue, only those that
hold enough of some template together are cut into windows.

Edges: null and empty texts have no paragraphs and get a row without licences; repeated rows
are scanned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.plans.session import cut, spread

LEAST = 0.5
COVER = 0.6
NEGATIVES = 400
# Words of the templates chosen so that whoever holds ``COVER`` of a template holds one of them or a
# word of the law; common words were left out where rarer ones do.
SIGNS = (
    "1.0 2.0 affero associated attribution author binary cc commons compliance conditions creative distribute "
    "distributed documentation domain fee forms foundation gnu governed granted hereby january june lesser "
    "modification modify neighboring obtaining permitted publication publisher released reproduced reserved "
    "restriction rights software subject under version waived"
).split()
CUE = (
    r"(?i)(?<![a-z0-9])(?:licen[cs]|unlicen|sublicen|copyright|copyleft|warrant|permission|redistribut|[al]?gpl|"
    r"apache|mozilla|cc0|spdx|(?:mit/x11|isc|bsd|" + "|".join(map(re.escape, SIGNS)) + r")(?![a-z0-9]))"
)
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

# Notices in the wording of the public licences.
TEMPLATES = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ],
    "MIT": [
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license.",
    ],
    "GPL-3.0": [
        "GNU General Public License Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "Licensed under GPLv3.",
    ],
    "GPL-2.0": [
        "GNU General Public License Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under GPLv2.",
    ],
    "LGPL": [
        "GNU Lesser General Public License",
        "This library is licensed under the GNU Lesser General Public License, version 2.1 or 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "you can redistribute it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "GNU Affero General Public License",
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "under the terms of the GNU Affero General Public License",
    ],
    "BSD": [
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the 3-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "CC0 1.0 Universal",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "All-Rights-Reserved": [
        "All rights reserved.",
        "Copyright 2020 by the authors. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
UNKNOWN = "unknown"
LONGEST = max(len(re.findall(WORD, t.lower())) for ts in TEMPLATES.values() for t in ts)
ORDINARY = [
    "He lost his driving licence after the accident and had to take the bus to work.",
    "The city issued a new license for the restaurant on the corner last week.",
    "She asked for permission to leave the room and went home early.",
    "Copyright law differs from country to country, said the professor in the lecture.",
    "The warranty on the washing machine ends after two years.",
    "Apache helicopters were seen over the hills in the morning.",
    "A license to fish in the lake costs twenty euros a year.",
    "The library explains which licence to choose for your own photographs.",
    "Without a warrant the police could not search the house.",
    "The band performed with the permission of the mayor in the public park.",
    "The mozilla of the film monsters was a large lizard.",
    "General knowledge of the public in version after version of the story.",
    "This is free of charge for any person, and the following conditions are met by all.",
]


def terms(words: Column) -> Column:
    """Words and neighbouring pairs, each once."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.array_distinct(F.concat(words, pairs))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal."""
    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def training(spark: SparkSession, docs: DataFrame | None, negatives: int = NEGATIVES) -> DataFrame:
    """(family, terms): every template whole and without its first or last words, and unknowns."""
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split(" ")
            parts = {text, f"{text} Copyright 2021 the authors.", f"Note. {text}"}
            if len(words) > 8:
                parts |= {" ".join(words[: len(words) * 3 // 4]), " ".join(words[len(words) // 4 :])}
            rows += [{"family": family, "text": p} for p in sorted(parts)]
    rows += [{"family": UNKNOWN, "text": t} for t in ORDINARY for _ in range(3)]
    made = _table(spark, rows, "family: string, text: string")
    if docs is not None:
        # Ids and digests are picked first: one task never gathers more than the picked texts.
        given = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
        picked = (
            given.select(F.col("doc_id").alias("id"), F.col("digest").alias("picked"))
            .orderBy(F.xxhash64("id"), "id", "picked")
            .limit(negatives)
            .distinct()
        )
        same = given["doc_id"].eqNullSafe(picked["id"]) & (given["digest"] == picked["picked"])
        plain = (
            given.join(F.broadcast(picked), same, "left_semi")
            .groupBy("doc_id", "digest")
            .agg(F.first("text").alias("text"))
            .select(F.explode(F.split("text", "\n")).alias("text"))
            .where(~F.col("text").rlike(CUE) & (F.length("text") > 20))
            .select("text")
            .orderBy(F.xxhash64("text"), "text")
            .limit(negatives)
            .select(F.lit(UNKNOWN).alias("family"), "text")
        )
        made = made.unionByName(plain)
    return made.select("family", terms(words_of(F.col("text"))).alias("terms"))


def fit(spark: SparkSession, docs: DataFrame | None = None) -> tuple[list[str], DataFrame, list[float]]:
    """(families, (term, weights) table, intercepts)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    rows = cut(training(spark, docs))
    known = (
        rows.where(F.col("family") != UNKNOWN).select(F.explode("terms").alias("t")).distinct()
    )
    # Only the templates' terms are features, so the model does not grow with the corpus.
    listed = known.groupBy().agg(F.collect_set("t").alias("known"))
    inside = cut(
        rows.join(F.broadcast(listed)).select("family", F.array_intersect("terms", "known").alias("terms"))
    )
    words = CountVectorizer(inputCol="terms", outputCol="features", binary=True, minDF=1).fit(inside)
    names = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(inside)
    model = LogisticRegression(regParam=0.003, maxIter=60, family="multinomial").fit(
        names.transform(words.transform(inside))
    )
    grid = model.coefficientMatrix.toArray()
    table = [
        {"term": t, "w": [round(float(v), 4) for v in grid[:, i]]} for i, t in enumerate(words.vocabulary)
    ]
    # Written once, so that the plans of the scan hold no literal of it.
    return list(names.labels), cut(_table(spark, table, "term: string, w: array<double>")), [
        float(v) for v in model.interceptVector
    ]


def _templates(spark: SparkSession) -> DataFrame:
    """(guess, templates): each family's templates, their terms by weight and the sum of the weights.

    Each term counts by how few families use it, so common words prove little. This is a table, as
    an expression of all templates made large plans and generated code, which the driver holds.
    """
    of: dict[str, list[set[str]]] = {}
    for family, texts in TEMPLATES.items():
        for text in texts:
            w = re.findall(WORD, text.lower())
            of.setdefault(family, []).append(set(w) | {f"{a} {b}" for a, b in pairwise(w)})
    spread = Counter(t for sets in of.values() for t in set().union(*sets))
    rows = []
    for family, sets in of.items():
        listed = []
        for s in sets:
            weights = {t: math.log(1 + len(of) / spread[t]) for t in sorted(s)}
            by: dict[float, list[str]] = {}
            for t, v in weights.items():
                by.setdefault(round(v, 6), []).append(t)
            parts = [{"weight": v, "terms": ts} for v, ts in sorted(by.items())]
            listed.append({"total": sum(weights.values()), "parts": parts})
        rows.append({"guess": family, "templates": listed})
    return _table(
        spark,
        rows,
        "guess: string, templates: array<struct<total: double, parts: array<struct<weight: double, terms: array<string>>>>>",
    )


def _every(templates: DataFrame) -> DataFrame:
    """One row: the templates of all families."""
    return templates.groupBy().agg(F.flatten(F.collect_list("templates")).alias("every"))


def _cover(got: Column, templates: Column) -> Column:
    """The largest share of one of the templates' terms that the paragraph's terms hold."""
    held = lambda s, p: s + F.size(F.array_intersect(got, p["terms"])) * p["weight"]
    return F.array_max(F.transform(templates, lambda t: F.aggregate(t["parts"], F.lit(0.0), held) / t["total"]))


def _may_hold(words: Column, cover: float) -> Column:
    """Whether the words together hold ``cover`` of some template of ``every``; their terms are made once."""
    return F.exists(F.array(terms(words)), lambda got: _cover(got, F.col("every")) >= cover)


def _head(words: Column, n: Column) -> Column:
    return F.slice(words, F.lit(1), F.greatest(n, F.lit(0)))


def _tail(words: Column, n: Column) -> Column:
    n = F.greatest(F.least(n, F.size(words)), F.lit(0))
    return F.slice(words, F.size(words) - n + 1, n)


def _near(lines: Column, side) -> Column:
    """The words of the lines, nearest first, up to one without words and to LONGEST in all."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit(LONGEST).alias("left"))

    def step(s, x):
        w = words_of(x)
        more = F.struct(
            F.concat(s["out"], F.array(F.concat_ws(" ", side(w, s["left"])))).alias("out"),
            F.when(F.size(w) > 0, s["left"] - F.size(w)).otherwise(0).alias("left"),
        )
        return F.when(s["left"] > 0, more).otherwise(s)

    return F.filter(F.aggregate(lines, start, step)["out"], lambda x: x != "")


def cued(docs: DataFrame) -> DataFrame:
    """(doc_id, row, lines): every document, with its paragraphs that have a cue and their neighbours."""
    every = F.split("text", "\n")

    def around(x):
        i = x["line"]
        from_ = F.greatest(i - LONGEST, F.lit(0))
        return F.struct(
            i.alias("line"),
            x["paragraph"].alias("paragraph"),
            _near(F.reverse(F.slice(every, from_ + 1, i - from_)), _tail).alias("back"),
            _near(F.slice(every, i + 2, F.lit(LONGEST)), _head).alias("ahead"),
        )

    lines = F.transform(
        F.filter(
            F.transform(every, lambda p, i: F.struct(i.alias("line"), p.alias("paragraph"))),
            lambda x: x["paragraph"].rlike(CUE),
        ),
        around,
    )
    none = F.array().cast("array<struct<line:int,paragraph:string,back:array<string>,ahead:array<string>>>")
    return cut(
        docs.select(
            F.col("doc_id").cast("long"),
            F.monotonically_increasing_id().alias("row"),
            F.when(F.col("text").rlike(CUE), lines).otherwise(none).alias("lines"),
        )
    )


def _windows(alone: DataFrame, every: DataFrame, cover: float) -> DataFrame:
    """(row, line, first, last, paragraph): joined lines around each line that is not named alone."""
    named = F.col("family") != UNKNOWN
    taken = alone.where(named).groupBy("row").agg(F.collect_set("line").alias("taken"))
    w = words_of(F.col("paragraph"))
    back, ahead = F.col("back_n"), F.col("ahead_n")
    # A template that goes on at both sides holds the whole line; at one side, that end of it.
    own = (
        F.when((back > 0) & (ahead > 0), F.col("w"))
        .when(back > 0, _head(F.col("w"), F.lit(LONGEST)))
        .otherwise(_tail(F.col("w"), F.lit(LONGEST)))
    )
    around = F.concat(words_of(F.concat_ws(" ", F.reverse("back"))), F.col("w"), words_of(F.concat_ws(" ", "ahead")))
    return (
        alone.where(~named)
        .withColumn("w", w)
        .join(F.broadcast(every))
        .where(_may_hold(around, cover))
        .drop("every")
        .withColumn("back_n", F.explode(F.sequence(F.lit(0), F.size("back"))))
        .withColumn("ahead_n", F.explode(F.sequence(F.lit(0), F.size("ahead"))))
        .where((back + ahead > 0) & ((back == 0) | (ahead == 0) | (F.size("w") <= LONGEST)))
        .join(taken, "row", "left")
        .withColumns({"first": F.col("line") - back, "last": F.col("line") + ahead})
        .where(
            ~F.coalesce(F.exists("taken", lambda t: t.between(F.col("first"), F.col("last"))), F.lit(False))
        )
        .select(
            "row",
            "line",
            "first",
            "last",
            F.concat_ws(
                " ", F.reverse(_head(F.col("back"), back)), own, _head(F.col("ahead"), ahead)
            ).alias("paragraph"),
        )
    )


def _lengths() -> Column:
    """(words, known): each length that templates have, with the words of the templates of that length."""
    by: dict[int, set[str]] = {}
    for text in (t for ts in TEMPLATES.values() for t in ts):
        w = re.findall(WORD, text.lower())
        by.setdefault(len(w), set()).update(w)
    return F.array(
        *(F.struct(F.lit(n).alias("words"), F.array(*map(F.lit, sorted(ws))).alias("known")) for n, ws in sorted(by.items()))
    )


def _inner(alone: DataFrame, every: DataFrame, cover: float) -> DataFrame:
    """(row, line, cue, first, last, paragraph): windows of a template's length around every cue word of a line.

    A window begins with a word of a template of its length, or with the cue: one that begins before
    holds no more of that template. Near the ends of the words it is what is left.
    """
    named = F.col("family") != UNKNOWN
    taken = alone.where(named).groupBy("row").agg(F.collect_set("line").alias("taken"))
    split = lambda x: F.split(x, " ")
    back = F.reverse("back")
    lines_back = F.transform(back, lambda x, i: F.array_repeat(F.col("line") - F.size("back") + i, F.size(split(x))))
    lines_ahead = F.transform("ahead", lambda x, i: F.array_repeat(F.col("line") + 1 + i, F.size(split(x))))
    own = alone.withColumn("own", words_of(F.col("paragraph"))).select(
        "row",
        "line",
        F.concat(F.flatten(F.transform(back, split)), "own", F.flatten(F.transform("ahead", split))).alias("w"),
        F.concat(
            F.flatten(lines_back), F.array_repeat("line", F.size("own")), F.flatten(lines_ahead)
        ).alias("at"),
    )
    cues = F.filter(
        F.transform("at", lambda t, i: F.when((t == F.col("line")) & F.get("w", i).rlike(CUE), i)),
        lambda i: i.isNotNull(),
    )
    # Only what a window can reach goes along with a cue.
    low = lambda i: F.greatest(i - (LONGEST - 1), F.lit(0))
    reach = lambda c, i: F.slice(c, low(i) + 1, i - low(i) + LONGEST)
    near = own.select(
        "row",
        "line",
        F.inline(
            F.transform(
                cues,
                lambda i: F.struct(
                    i.alias("cue"), (i - low(i)).alias("i"), reach(F.col("w"), i).alias("w"), reach(F.col("at"), i).alias("at")
                ),
            )
        ),
    )
    # A window holds no more of a template than all words within its reach.
    near = near.join(F.broadcast(every)).where(_may_hold(F.col("w"), cover)).drop("every")
    sized = near.select("*", F.inline(_lengths()))
    starts = F.filter(
        F.sequence(F.greatest(F.col("i") - F.col("words") + 1, F.lit(0)), F.col("i")),
        lambda s: (s == F.col("i")) | F.array_contains("known", F.get("w", s)),
    )
    return (
        sized.withColumn("s", F.explode(starts))
        .select(
            "row",
            "line",
            "cue",
            F.get("at", F.col("s")).alias("first"),
            F.get("at", F.least(F.col("s") + F.col("words"), F.size("w")) - 1).alias("last"),
            F.array_join(F.slice("w", F.col("s") + 1, F.col("words")), " ").alias("paragraph"),
        )
        .distinct()
        .join(taken, "row", "left")
        .where(
            ~F.coalesce(
                F.exists("taken", lambda t: (t != F.col("line")) & t.between(F.col("first"), F.col("last"))), F.lit(False)
            )
        )
        .drop("taken")
    )


def scan(marked: DataFrame, model, least: float = LEAST, cover: float = COVER) -> DataFrame:
    """(paragraph, doc_id, row, line, family, probability, cover, first, last) of each paragraph of ``cued``.

    first and last are the lines that the family was found in. A line with further families has a
    row for each of them.
    """
    templates = cut(_templates(marked.sparkSession))
    every = cut(_every(templates))
    given = marked.select("doc_id", "row", F.inline("lines"))
    alone = cut(given.join(_judged(given, model, templates, least, cover), "paragraph"))
    windows = cut(_windows(alone, every, cover))
    best = (
        windows.join(_judged(windows, model, templates, least, cover).where(F.col("family") != UNKNOWN), "paragraph")
        .groupBy("row", "line")
        .agg(
            F.max(
                F.struct(
                    "cover", (F.col("first") - F.col("last")).alias("short"), "probability", "family", "first", "last"
                )
            ).alias("best")
        )
    )
    of = lambda c, alone_: F.coalesce(F.col("best")[c], F.col(alone_)).alias(c)
    by_line = cut(
        alone.join(best, ["row", "line"], "left").select(
            "paragraph",
            "doc_id",
            "row",
            "line",
            *(of(c, c) for c in ("family", "probability", "cover")),
            *(of(c, "line") for c in ("first", "last")),
        )
    )
    inner = cut(_inner(spread(alone), every, cover))
    rank = F.struct("cover", (-F.length("paragraph")).alias("short"), "probability", "family", "first", "last")
    by_cue = (
        inner.join(_judged(inner, model, templates, least, cover).where(F.col("family") != UNKNOWN), "paragraph")
        .groupBy("row", "line", "cue")
        .agg(F.max(rank).alias("best"))
        .groupBy("row", "line", F.col("best.family").alias("family"))
        .agg(F.max("best").alias("best"))
    )
    more = (
        by_cue.join(by_line, ["row", "line", "family"], "left_anti")
        .join(by_line.select("row", "line", "paragraph", "doc_id"), ["row", "line"])
        .select(*(F.col(f"best.{c}") if c in ("probability", "cover", "first", "last") else c for c in by_line.columns))
    )
    return by_line.unionByName(more)


def _judged(given: DataFrame, model, templates: DataFrame, least: float, cover: float) -> DataFrame:
    """(paragraph, family, probability, cover) of each distinct paragraph."""
    families, weights, intercepts = model
    # One paragraph is scored once, however many documents carry it.
    distinct = cut(given.select("paragraph").distinct())
    used = distinct.select("paragraph", F.explode(terms(words_of(F.col("paragraph")))).alias("term"))
    sums = [F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(len(families))]
    scored = used.join(F.broadcast(weights), "term").groupBy("paragraph").agg(*sums)
    raw = F.array(*(F.coalesce(F.col(f"w{i}"), F.lit(0.0)) + F.lit(intercepts[i]) for i in range(len(families))))
    top = F.array_max("raw")
    share = F.aggregate(F.col("raw"), F.lit(0.0), lambda s, x: s + F.exp(x - top))
    guessed = (
        distinct.join(scored, "paragraph", "left")
        .select("paragraph", raw.alias("raw"))
        .select(
            "paragraph",
            (1 / share).alias("probability"),
            F.array(*map(F.lit, families))[F.array_position("raw", top).cast("int") - 1].alias("guess"),
            words_of(F.col("paragraph")).alias("words"),
        )
        .withColumn("got", terms(F.col("words")))
    )
    judged = (
        guessed.join(F.broadcast(templates), "guess", "left")
        .withColumn("cover", F.coalesce(_cover(F.col("got"), F.col("templates")), F.lit(0.0)))
        .withColumn(
            "family",
            F.when((F.col("probability") >= least) & (F.col("cover") >= cover), F.col("guess")).otherwise(UNKNOWN),
        )
        .select("paragraph", "family", "probability", "cover")
    )
    return cut(judged)


def scanned(docs: DataFrame, model, least: float = LEAST, cover: float = COVER) -> DataFrame:
    """(doc_id, n_cued, n_licences, families): a row for each document."""
    marked = cued(docs)
    named = F.col("family") != UNKNOWN
    none = F.struct(F.lit(0).alias("n"), F.lit("").alias("family"), F.lit(-1).alias("last"))

    def fold(s, x):
        new = (x["family"] != s["family"]) | (x["first"] > s["last"])
        return F.struct(
            (s["n"] + new.cast("int")).alias("n"),
            x["family"].alias("family"),
            F.when(new, x["last"]).otherwise(F.greatest(s["last"], x["last"])).alias("last"),
        )

    by_doc = (
        scan(marked, model, least, cover)
        .where(named)
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("family", "first", "last"))).alias("found"))
        .select(
            "row",
            F.aggregate("found", none, fold)["n"].alias("n_licences"),
            F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))).alias("families"),
        )
    )
    return marked.join(by_doc, "row", "left").select(
        "doc_id",
        F.size("lines").cast("long").alias("n_cued"),
        F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
    )
