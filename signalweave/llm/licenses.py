"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment confirms them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import BLOCK, words

#: Wordings of well-known public licenses by SPDX name and kind.
TEMPLATES = [
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
]
#: Words of a shingle; share of a template's shingles that a window must hold; bands of one row each.
SHINGLE, CONTAINED, BANDS = 5, 0.75, 24
#: Template shingles up to which they are written into the plan.
MOST_SHINGLES = 50_000


def template_shingles(text: str, shingle: int = SHINGLE) -> list[str]:
    """Different shingles of a template, in order; the whole of a shorter one."""
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    n = min(shingle, len(found))
    return list(dict.fromkeys(" ".join(found[i : i + n]) for i in range(len(found) - n + 1))) if found else []


def window_step(shingles: int) -> int:
    """Power of two with a third to spare: windows of two steps, one step apart, hold every occurrence."""
    return 1 << max(2, -(-shingles * 4 // 3) - 1).bit_length()


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, shingle: int = SHINGLE, contained: float = CONTAINED, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, template, name, kind, at, held): windows that hold at least ``contained`` of a template's shingles.

    Only shingles that some template has can count for containment, so windows
    are sketched by those alone: a window that holds a share c of a template and
    nothing of others meets it in one of ``bands`` one-row bands with probability
    1 - (1 - c)^bands, over 1 - 4e-15 at 0.75 (and 1 - 6e-8 where as much of
    other templates stands beside it). ``at`` is the window's first word.
    """
    spark = docs.sparkSession
    shingles = [template_shingles(t, shingle) for _, _, t in templates]
    every = sorted({s for ss in shingles for s in ss})
    if len(every) > MOST_SHINGLES:
        raise ValueError(f"{len(every)} template shingles; scan them in lists of {MOST_SHINGLES}")
    by_words: dict[int, list[str]] = {}
    for s in every:
        by_words.setdefault(s.count(" ") + 1, []).append(s)
    whole = docs.select("doc_id", words(F.col("text")).alias("all")).where("size(all) > 0")
    base = F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(block)))
    blocks = whole.withColumn("base", base).select("doc_id", "base", F.slice("all", F.col("base") + 1, F.lit(block + shingle - 1)).alias("w"))
    firsts = sorted({s.split(" ")[0] for s in every})
    begun = F.filter(F.transform("w", lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull() & (i < block))

    # A shorter whole template and a longer one's shingle may begin at one word: all lengths are asked for.
    def begin(n: int, listed: list[str]):
        text = lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " ")
        return F.transform("begun", lambda i: F.struct(i.alias("i"), F.when(text(i).isin(listed), F.xxhash64(text(i))).alias("code")))

    asked = [begin(n, listed) for n, listed in by_words.items()]
    empty = F.array().cast("array<struct<i:int,code:bigint>>")
    hits = F.filter(F.concat(*asked) if asked else empty, lambda x: x["code"].isNotNull())
    places = blocks.withColumn("begun", begun).where("size(begun) > 0").select("doc_id", "base", F.explode(hits).alias("x")).select("doc_id", (F.col("base") + F.col("x.i")).alias("at"), F.col("x.code").alias("code"))
    steps = sorted({window_step(len(ss)) for ss in shingles if ss}) or [4]
    sized = places.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).withColumn("n", F.explode(F.array((F.col("at") / F.col("step")).cast("int"), (F.col("at") / F.col("step")).cast("int") - 1)))
    lows = [F.min(F.xxhash64(F.lit(b), "code")).alias(f"b{b}") for b in range(bands)]
    windows = sized.groupBy("doc_id", "step", "n").agg(F.collect_set("code").alias("codes"), *lows)
    rows = [(i, name, kind, window_step(len(ss)), len(ss), ss) for i, ((name, kind, _), ss) in enumerate(zip(templates, shingles, strict=True)) if ss]
    listed = spark.createDataFrame(rows, "template int, name string, kind string, step int, size int, shingles array<string>").withColumn("own", F.transform("shingles", lambda x: F.xxhash64(x)))
    # Bounded by MOST_SHINGLES: a constant of the plan.
    banded = listed.select("template", "step", F.explode("own").alias("code")).groupBy("template", "step").agg(F.array(*[F.min(F.xxhash64(F.lit(b), "code")) for b in range(bands)]).alias("low")).select("template", "step", F.posexplode("low").alias("band", "low"))
    met = windows.select("doc_id", "step", "n", "codes", F.posexplode(F.array(*[f"b{b}" for b in range(bands)])).alias("band", "low")).join(F.broadcast(banded), ["step", "band", "low"])
    pairs = met.groupBy("doc_id", "step", "n", "template").agg(F.first("codes").alias("codes"))
    held = (F.size(F.array_intersect("codes", "own")) / F.col("size"))
    checked = pairs.join(F.broadcast(listed.select("template", "name", "kind", "size", "own")), "template").withColumn("held", held).where(F.col("held") >= contained)
    return checked.select("doc_id", "template", "name", "kind", F.greatest(F.lit(0), F.col("n") * F.col("step")).alias("at"), "held")


def license_report(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, **how) -> DataFrame:
    """Per document: doc_id, licenses (names, sorted, comma-joined), n_licenses, kinds, n_windows, best (largest share held).

    Documents without a match, with null or empty texts, have empty strings and
    zeros. Rows that share a doc_id share their matches, each with its row.
    """
    per = scan(docs.select("doc_id", "text"), templates, **how).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("licenses"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.count_distinct("name").alias("n_licenses"), F.count_distinct("template", "at").alias("n_windows"), F.max("held").alias("best"))
    joined = docs.select("doc_id").alias("d").join(per.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("d.doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_licenses", zero).alias("n_licenses"), F.coalesce("kinds", F.lit("")).alias("kinds"), F.coalesce("n_windows", zero).alias("n_windows"), F.coalesce("best", F.lit(0.0)).alias("best"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def _op5_sql() -> str:
    values = []
    for i, (name, kind, text) in enumerate(TEMPLATES):
        ss = template_shingles(text)
        values += [f"({i}, '{name}', '{kind}', {window_step(len(ss))}, {len(ss)}, {s.count(' ') + 1}, '{s}')" for s in ss]
    return rf"""
WITH t(template, name, kind, step, size, n, s) AS (VALUES {', '.join(values)}),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), lens AS (SELECT DISTINCT n FROM t
), occ AS (
  SELECT doc_id, i - 1 AS spot, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), hit AS (
  SELECT DISTINCT doc_id, template, name, kind, size, step, s, unnest([CAST(floor(spot / step) AS BIGINT), CAST(floor(spot / step) AS BIGINT) - 1]) AS win FROM occ JOIN t USING (s)
), held AS (
  SELECT doc_id, template, name, kind, greatest(0, win * step) AS spot, count(*) / size AS held
  FROM hit GROUP BY doc_id, template, name, kind, size, step, win HAVING count(*) / size >= 0.75
), per AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
    count(DISTINCT (template, spot)) AS n_windows, max(held) AS best
  FROM held GROUP BY doc_id
)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_licenses, 0) AS n_licenses, coalesce(kinds, '') AS kinds, coalesce(n_windows, 0) AS n_windows, coalesce(best, 0.0) AS best
FROM documents LEFT JOIN per USING (doc_id)
"""


OP5_SQL = _op5_sql()
