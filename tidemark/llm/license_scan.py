"""License scan with MinHash bands over overlapping windows, by DataFrame functions alone.

Templates are short notices, as sets of five-word shingles.  For a template of L words, a text is cut
into windows of 1.5 L words whose starts lie so close that any run of up to 1.25 L words is inside one.
A band is one MinHash value (a row count of 1), and there are ``BANDS`` of them: a window that holds at
least 0.8 of the template's shingles has a Jaccard similarity s of at least 1/4 (for five words; near
1/2 for long templates), and shares a band with probability ``1 - (1 - s)**BANDS``, over 0.9998.
Windows that share a band with the template are verified by exact containment of shingles:
a match has at least ``CONTAINED`` of them.  Neighbouring licenses share most of their words, so at each
shingle of a text the match counts that has most of its template (of the longer one, if equal), and a
match that is outdone at half of its shingles or more is left out.

A window can only share a band with a template if it holds the shingle that is the template's least in
that band.  So texts, and windows, without any of these few shingles are passed over before any
MinHash is taken; that loses nothing.

Words are runs of letters and digits of any script, in lower case.  The template table is a parameter
with a size bound (``MOST_TEMPLATES``); beyond it, hand in blocks of templates and unite the results.
The result has a row per document and license found.  Null and empty texts, and texts or templates of
fewer than five words, match nothing.  Rows that repeat both id and text count once.  Extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import documents, keyed

SHINGLE, CONTAINED, BANDS = 5, 0.8, 32
MOST_TEMPLATES = 2_000
_SPLIT = r"[^\p{L}\p{N}]+"

#: Notices as their licenses word them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]



def _gnu(kind: str, name: str, version: str, mark: str) -> str:
    return (f"This {kind} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published "
            f"by the Free Software Foundation{mark.replace(':', ',')} either version {version} of the License, or (at your option) any later version.")


_LESSER, _AFFERO = "Lesser General Public License", "Affero General Public License"
TEMPLATES += [
    ("GPL-2.0", _gnu("program", "General Public License", "2", ";")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", _gnu("library", _LESSER, "2.1", ";")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", _gnu("program", _LESSER, "3", ":")),
    ("LGPL-3.0", _gnu("library", _LESSER, "3", ":")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", _gnu("program", _AFFERO, "3", ":")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
                "which accompanies this distribution, and is available at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                "which is available at"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
                "software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    *((f"CC-BY-{short}-4.0", f"This work is licensed under a Creative Commons Attribution-{name} 4.0 International License.")
      for short, name in (("NC", "NonCommercial"), ("ND", "NoDerivatives"), ("NC-SA", "NonCommercial-ShareAlike"),
                          ("NC-ND", "NonCommercial-NoDerivatives"))),
    *((f"CC-BY-{short}-4.0", f"Licensed under CC BY-{short} 4.0.") for short in ("ND", "NC-SA", "NC-ND")),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
             "any damages arising from the use of this software."),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), "")


def shingles(word_list: Column) -> Column:
    """A 64-bit hash of each five words, in order."""
    def at(i: Column) -> Column:
        return F.xxhash64(*(F.get(word_list, i + k) for k in range(SHINGLE)))
    return F.when(F.size(word_list) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(word_list) - SHINGLE, F.lit(0))), at)).otherwise(F.array().cast("array<long>"))


def phrases(word_list: Column) -> Column:
    """The distinct runs of five words as text."""
    return F.array_distinct(F.when(F.size(word_list) >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(word_list) - SHINGLE + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(word_list, i, SHINGLE), " "))).otherwise(F.array().cast("array<string>")))


def bands(hashes: Column) -> Column:
    """The MinHash value of each band."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)),
                       lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def once(value: Column) -> Column:
    """A row with the value worked out, so that what uses it many times does not work it out again."""
    return F.explode(F.array(value))


def window_shape(n_words: int) -> tuple[int, int]:
    """Length of a template's windows and the step between their starts, in words."""
    length = math.ceil(1.5 * n_words)
    return length, length - math.ceil(1.25 * n_words) + 1


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Templates with their words, bands and window shape."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; hand in blocks of {MOST_TEMPLATES}")
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, notice string")
    return (rows.withColumn("w", words(F.col("notice"))).filter(F.size("w") >= SHINGLE)
            .withColumn("h", shingles(F.col("w")))
            .select("template", "license", F.size("w").alias("n_words"), phrases(F.col("w")).alias("phrases"),
                    bands(F.col("h")).alias("bands"), F.transform(
                        F.sequence(F.lit(1), F.lit(BANDS)),
                        lambda k: F.array_min(F.transform(F.col("h"), lambda h: F.struct(F.xxhash64(h, k).alias("v"), h.alias("h"))))["h"]).alias("least")))


def best(found: DataFrame) -> DataFrame:
    """The matches that no match of another license outdoes at half of their shingles or more."""
    runs = F.transform(F.sequence(F.lit(1), F.size("ww") - SHINGLE + 1), lambda i: F.array_join(F.slice("ww", i, SHINGLE), " "))
    hits = F.filter(F.transform(runs, lambda p, i: F.when(F.array_contains("phrases", p), F.col("start") + i)), lambda i: i.isNotNull())
    grade = F.struct("contained", F.size("phrases").alias("size"))
    spots = found.select("rk", "doc_id", "license", "template", "start", "contained", grade.alias("grade"), F.explode(hits).alias("spot"))
    place = Window.partitionBy("rk", "doc_id", "spot")
    own = F.max("grade").over(Window.partitionBy("rk", "doc_id", "spot", "license"))
    return (spots.withColumn("own", own).withColumn("top", F.max("grade").over(place))
            .groupBy("rk", "doc_id", "license", "template", "start")
            .agg(F.max("contained").alias("contained"), F.avg((F.col("own") == F.col("top")).cast("int")).alias("won"))
            .filter(F.col("won") > 0.5))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id``, ``license``, ``first_word`` (start of the first matching window) and ``contained``."""
    spark = docs.sparkSession
    known = template_table(spark, templates).collect()
    result = "doc_id long, license string, first_word int, contained double"
    if not known:
        return spark.createDataFrame([], result)
    marks = F.array(*(F.lit(h) for h in sorted({h for t in known for h in t.least})))
    texts = (keyed(docs).select("rk", "doc_id", once(words(F.col("text"))).alias("w"))
             .select("rk", "doc_id", "w", once(shingles(F.col("w"))).alias("h"))
             .filter(F.arrays_overlap("h", marks))
             .select("rk", "doc_id", "w", "h", once(F.filter(
                 F.transform("h", lambda h, i: F.when(F.array_contains(marks, h), i)), lambda i: i.isNotNull())).alias("spots")))
    shapes = sorted({t.n_words for t in known})
    shaped = F.explode(F.array(*(F.struct(F.lit(n).alias("n_words"), F.lit(window_shape(n)[0]).alias("length"),
                                          F.lit(window_shape(n)[1]).alias("step")) for n in shapes)))
    step, length = F.col("shape.step"), F.col("shape.length")
    starts = F.array_distinct(F.flatten(F.transform("spots", lambda i: F.transform(
        F.sequence(F.ceil(F.greatest(i - length + SHINGLE, F.lit(0)) / step).cast("int"),
                   F.floor(i / step).cast("int") + 1), lambda k: k * step))))
    windows = (texts.withColumn("shape", shaped).withColumn("start", F.explode(starts))
               .withColumn("ww", once(F.slice("w", F.col("start") + 1, length))).filter(F.size("ww") >= SHINGLE)
               .withColumn("hh", once(F.slice("h", F.col("start") + 1, F.size("ww") - SHINGLE + 1)))
               .select("rk", "doc_id", "start", "ww", F.col("shape.n_words").alias("n_words"), once(bands(F.col("hh"))).alias("band")))
    notices = spark.createDataFrame([(t.n_words, t.template, t.license, t.phrases, t.bands) for t in known],
                                    "n_words int, template int, license string, phrases array<string>, bands array<long>")
    alike = F.exists(F.zip_with("band", "bands", lambda a, b: a == b), lambda same: same)
    found = (windows.join(F.broadcast(notices), "n_words").filter(alike)
             .withColumn("contained", F.size(F.array_intersect(phrases(F.col("ww")), F.col("phrases"))) / F.size("phrases"))
             .filter(F.col("contained") >= CONTAINED))
    return best(found).groupBy("rk", "doc_id", "license").agg(
        F.min("start").alias("first_word"), F.max("contained").alias("contained")).drop("rk")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    """Every window of every text against every template, without bands, and the best match of each shingle."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH raw(template, license, notice) AS (VALUES {rows}),
t AS (SELECT template, license, list_filter(string_split_regex(lower(notice), '[^\\pL\\pN]+'), lambda x: x <> '') AS ws FROM raw),
ts AS (SELECT template, license, len(ws) AS n, CAST(ceil(1.5 * len(ws)) AS BIGINT) AS length,
              CAST(ceil(1.5 * len(ws)) - ceil(1.25 * len(ws)) + 1 AS BIGINT) AS step,
              list_distinct(list_transform(generate_series(1, CAST(len(ws) AS BIGINT) - 4),
                            lambda i: array_to_string(ws[i:i + 4], ' '))) AS ps FROM t WHERE len(ws) >= 5),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda x: x <> '') AS ws FROM documents),
dp AS (SELECT doc_id, ws, list_transform(generate_series(1, CAST(len(ws) AS BIGINT) - 4),
              lambda i: array_to_string(ws[i:i + 4], ' ')) AS ps FROM d WHERE len(ws) >= 5),
c AS (SELECT dp.*, ts.template, ts.license, ts.length, ts.step, ts.ps AS tps FROM dp JOIN ts ON list_has_any(dp.ps, ts.ps)),
w AS (SELECT doc_id, template, license, tps, ps[step * k + 1:step * k + length - 4] AS ps, step * k AS start
      FROM c, LATERAL (SELECT unnest(generate_series(0, CAST(len(ws) AS BIGINT) // step)) AS k)),
m AS (SELECT *, len(list_intersect(list_distinct(ps), tps)) / len(tps) AS contained FROM w),
h AS (SELECT doc_id, template, license, start, contained, row(contained, len(tps)) AS grade,
             unnest(list_filter(list_transform(ps, lambda p, i: CASE WHEN list_contains(tps, p) THEN start + i END), lambda i: i IS NOT NULL)) AS spot
      FROM m WHERE contained >= 0.8),
g AS (SELECT *, max(grade) OVER (PARTITION BY doc_id, spot) AS top, max(grade) OVER (PARTITION BY doc_id, spot, license) AS own FROM h),
b AS (SELECT doc_id, license, start, max(contained) AS contained FROM g GROUP BY doc_id, license, template, start
      HAVING avg(CAST(own = top AS INTEGER)) > 0.5)
SELECT doc_id, license, CAST(min(start) AS INTEGER) AS first_word, CAST(max(contained) AS DOUBLE) AS contained
FROM b GROUP BY doc_id, license
"""


OP2_SQL = _sql()
