"""Licence notices found by Dice coefficient over word bigrams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import ascii_lower

MIN_DICE = 0.8
SEPARATORS = "[^a-z0-9]+"
#: (licence, notice): short notices and the opening grants of common licences.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def words_of(text: Column) -> Column:
    """Words `[a-z0-9]+` once A-Z is lowered."""
    return F.filter(F.split(ascii_lower(text), SEPARATORS, -1), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(words, F.slice(words, 2, 1_000_000_000), lambda a, b: F.concat(a, F.lit(" "), b))  # null behind the last word
    return F.array_distinct(F.array_compact(pairs))


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def units_of(text: Column) -> Column:
    """What is compared as it stands: every line, every paragraph, and the text as a whole."""
    whole = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(F.split(whole, "\n", -1), F.split(whole, "\n[ \t\r]*\n", -1), F.array(whole)))


def template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def necessary(text: str, min_dice: float) -> tuple[list[str], list[str]]:
    """(words, bigrams) of a template, the longest words first: one of the bigrams is in everything as similar as asked.

    Dice d asks for d / (2 - d) of a template's bigrams, whatever else is there;
    so of any set of the template's bigrams larger than the rest, one is met.
    """
    grams = template_bigrams(text)
    spare = len(grams) - math.ceil(len(grams) * min_dice / (2 - min_dice) - 1e-9)
    words, held = [], []
    for word in sorted(dict.fromkeys(template_words(text)), key=lambda w: (-len(w), w)):
        if len(held) > spare:
            break
        words.append(word)
        held += [g for g in grams if word in g.split() and g not in held]
    return words, held


def anchors_of(templates: list[tuple[str, str]], min_dice: float) -> list[tuple[int, str, int, int]]:
    """(template number, necessary bigram, its place in the template, words of the template), for windows."""
    out = []
    for number, (_, text) in enumerate(templates):
        words, (_, grams) = template_words(text), necessary(text, min_dice)
        out += [(number, f"{a} {b}", i, len(words)) for i, (a, b) in enumerate(zip(words, words[1:], strict=False)) if f"{a} {b}" in grams]
    return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """(doc_id, license, dice): for each document and licence found, the greatest Dice coefficient, at least `min_dice`.

    Compared are lines, paragraphs, whole texts and, for notices within a longer
    line or wrapped over lines with marks of a comment, windows of a template's
    number of words, wherever a necessary bigram of the template puts one.

    Dice over sets of word bigrams is 2 |A & B| / (|A| + |B|), which reaches d
    only if |A| lies within |B| * d / (2 - d) and |B| * (2 - d) / d, and only if
    A holds a necessary bigram: texts, then units, without any necessary word go
    before a bigram is made, units outside the bounds of all templates next, the
    others meet only the templates whose bounds they lie in. The templates are a
    constant of the program and are broadcast; texts stay in their row.

    Null and empty texts, and units of one word, have no bigrams and match
    nothing. Rows without an id are reported with a null id; rows repeated with
    one id count once. Other columns are not read.
    """
    known = [(name, text) for name, text in (TEMPLATES if templates is None else templates) if template_bigrams(text)]
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    rows = [(i, name, g, len(g), len(g) * low - 1e-9, len(g) * high + 1e-9) for i, (name, g) in enumerate((name, template_bigrams(text)) for name, text in known)]
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(rows, "number int, license string, grams array<string>, m int, lo double, hi double"))
    wanted = sorted({w for _, text in known for w in necessary(text, min_dice)[0]})
    grams = sorted({g for _, text in known for g in necessary(text, min_dice)[1]})
    least, most = min((r[4] for r in rows), default=0), max((r[5] for r in rows), default=-1)
    if not known:
        return spark.createDataFrame([], "license string, dice double").join(docs.select(F.col(id_col).alias("doc_id")).limit(0), F.lit(True)).select("doc_id", "license", "dice")
    some = lambda words: F.arrays_overlap(words, F.array(*map(F.lit, wanted)))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).filter(some(F.col("w")))

    units = own.select("doc_id", F.explode(units_of(F.col("_text"))).alias("unit")).select("doc_id", words_of(F.col("unit")).alias("w"))
    units = units.filter((F.size("w") > least) & some(F.col("w"))).select("doc_id", bigrams_of(F.col("w")).alias("own"))
    units = units.filter(F.size("own").between(least, most) & F.exists("own", lambda g: g.isin(grams)))
    met = units.join(table, (F.size("own") >= F.col("lo")) & (F.size("own") <= F.col("hi")))

    anchors = F.broadcast(spark.createDataFrame(anchors_of(known, min_dice), "number int, gram string, place int, n int"))
    pairs = F.zip_with("w", F.slice("w", 2, 1_000_000_000), lambda a, b: F.concat(a, F.lit(" "), b))
    at = own.select("doc_id", "w", F.posexplode(pairs).alias("i", "gram")).filter(F.col("gram").isNotNull()).join(anchors, "gram")
    windows = at.select("doc_id", "number", bigrams_of(F.slice("w", F.greatest(F.col("i") - F.col("place"), F.lit(0)) + 1, F.col("n"))).alias("own"))
    windows = windows.join(table, "number").filter((F.size("own") >= F.col("lo")) & (F.size("own") <= F.col("hi")))

    dice = 2 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.col("m"))
    each = met.select("doc_id", "license", dice.alias("dice")).unionAll(windows.select("doc_id", "license", dice.alias("dice")))
    return each.filter(F.col("dice") >= min_dice).groupBy("doc_id", "license").agg(F.max("dice").alias("dice"))


def license_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_dice: float = MIN_DICE) -> DataFrame:
    """One row per document: doc_id, license (the best match, of equals the first by name; null if none), dice (0 if none), licenses (all found, sorted)."""
    found = scan_licenses(docs, id_col=id_col, text_col=text_col, min_dice=min_dice)
    best = found.groupBy("doc_id").agg(F.min(F.struct(-F.col("dice"), F.col("license").alias("license"))).alias("b"), F.array_sort(F.collect_set("license")).alias("licenses"))
    best = best.select(F.col("doc_id").alias("_id"), F.col("b.license").alias("license"), (-F.col("b.col1")).alias("dice"), "licenses")
    joined = docs.select(F.col(id_col).alias("doc_id")).join(best, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "license", F.round(F.coalesce("dice", F.lit(0.0)), 6).alias("dice"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))


def oracle_sql(min_dice: float = MIN_DICE) -> str:
    """The report in SQL, every unit and window against every template whose size bounds it lies in."""
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    anchors = ", ".join(f"({i}, '{g}', {place}, {n})" for i, g, place, n in anchors_of(TEMPLATES, min_dice))
    words = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, greatest(len(w), 1))])"
    dice = "2.0 * len(list_intersect(o.g, t.g)) / (len(o.g) + len(t.g))"
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    return rf"""
        WITH t AS (SELECT number, license, {grams} AS g FROM (SELECT number, license, {words.format("notice")} AS w FROM (VALUES {values}) v(number, license, notice))),
        x AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(x, chr(10)), string_split_regex(x, '\n[ \t\r]*\n'), [x])) AS unit FROM x),
        o AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words.format("unit")} AS w FROM u)),
        p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 1))) AS i FROM (SELECT doc_id, {words.format("x")} AS w FROM x)),
        c AS (SELECT DISTINCT doc_id, a.number, list_slice(w, greatest(i - place, 1), greatest(i - place, 1) + n - 1) AS w FROM p JOIN (VALUES {anchors}) a(number, gram, place, n) ON a.gram = w[i] || ' ' || w[i + 1]),
        ow AS (SELECT doc_id, number, {grams} AS g FROM c),
        m AS (SELECT doc_id, license, {dice} AS dice FROM o JOIN t ON len(o.g) BETWEEN len(t.g) * {low} - 1e-9 AND len(t.g) * {high} + 1e-9 UNION ALL SELECT doc_id, license, {dice} FROM ow o JOIN t USING (number)),
        f AS (SELECT doc_id, license, max(dice) AS dice FROM m WHERE dice >= {min_dice} GROUP BY ALL),
        b AS (SELECT doc_id, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice, list_sort(list(license)) AS licenses FROM f GROUP BY doc_id)
        SELECT d.doc_id, license, round(coalesce(dice, 0.0), 6) AS dice, coalesce(licenses, []) AS licenses FROM documents d LEFT JOIN b USING (doc_id)"""
