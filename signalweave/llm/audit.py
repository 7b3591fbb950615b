"""Interaction of document filters: what each removes in every order of application."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, hot_join, table

#: Bytes of a text looked at at once; bytes of words that are held to tell different ones.
SLICE, HELD = 1 << 20, 1 << 24
#: Labelled rows up to which they are broadcast.
BROADCAST_LABELS = 1_000_000

_BLANK = re.compile(rb"[ \t-\r]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that go on a code point.
_INNER = bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]")


def _slices(raw: pa.Buffer) -> Iterator[bytes]:
    """``raw`` in slices that end between words; a word that is longer stays whole."""
    at = 0
    while at < raw.size:
        end, grown = min(at + SLICE, raw.size), SLICE
        part = raw[at:end].to_pybytes()
        while end < raw.size and not _BLANK.match(part, len(part) - 1):
            if (cut := max((part.rfind(bytes([b])) for b in b" \t\n\x0b\x0c\r"), default=-1)) >= 0:
                part, end = part[: cut + 1], at + cut + 1
                break
            end, grown = min(end + grown, raw.size), 2 * grown
            part = raw[at:end].to_pybytes()
        yield part
        at = end


def text_facts(raw: pa.Buffer) -> tuple[bytes, int, int, int, int, bool]:
    """(digest, words, different words, capitals, code points, marked) of a whole text, in memory bounded by slices.

    Different words are counted exactly, in as many passes as keep the words held
    in one of them below ``HELD`` bytes.
    """
    digest, words, capitals, points, marked = hashlib.sha256(), 0, 0, 0, False
    passes = max(1, -(-raw.size // HELD))
    different = 0
    for p in range(passes):
        met: set[bytes] = set()
        for part in _slices(raw):
            split = part.split()
            if passes == 1:
                met.update(split)
            else:
                met.update(w for w in split if hash(w) % passes == p)
            if p == 0:
                digest.update(part)
                words += len(split)
                capitals += len(part) - len(part.translate(None, _CAPITALS))
                points += len(part.translate(None, _INNER))
                marked = marked or _MARKS.search(part) is not None
        different += len(met)
    return digest.digest(), words, different, capitals, points, marked


FACTS = "doc_id long, part string, digest binary, words long, different long, capitals long, points long, marked boolean"


def document_facts(docs: DataFrame) -> DataFrame:
    """One slim row for each document; a null text counts as empty, a null source as the empty part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_facts(t.as_buffer()) for t in batch.column(2)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), *[pa.int64()] * 4, pa.bool_()), strict=True)] if found else [pa.array([], t) for t in (pa.binary(), *[pa.int64()] * 4, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "part", "digest", "words", "different", "capitals", "points", "marked"])

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8").alias("text"))
    return slim.mapInArrow(read, FACTS)


def with_copies(facts: DataFrame) -> DataFrame:
    """``facts`` with ``copy``: a smaller doc_id has the same text. Null ids have no order and are no copies."""
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return hot_join(facts, first, ["digest"], "n").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first", "n", "digest")


def with_labels(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """``facts`` with ``good`` and ``toxic``: any label of the id says so; ids without labels, and null ids, are neither."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    named = facts.where("doc_id is not null").join(broadcast_if_small(marks.where("good or toxic"), BROADCAST_LABELS), "doc_id", "left")
    rest = facts.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return named.unionByName(rest).fillna(False, ["good", "toxic"])


def interactions(rows: DataFrame, filters: dict[str, Column], part: str, lost: dict[str, Column], scratch: Scratch) -> DataFrame:
    """One row for each part, order of all ``filters`` and step; ``filters``: name and condition of removal, never null.

    The orders form a trie; prefixes of the same filters leave the same rows, so
    each set of filters is entered once, depth first. Its survivors are persisted
    while the states below it are made from them, and one aggregate counts what
    every next filter removes there. Sets already entered are only looked up.
    At most as many survivor tables are held as there are filters; each can be
    made again from ``rows``, which should be a written table.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    a count of removed rows for each of ``lost``, shapley. Parts without
    survivors count zero. No rows: no parts.
    """
    names = list(filters)
    if any(len(n) != 1 for n in names):
        raise ValueError("filters have names of one letter")
    bit = {n: 1 << k for k, n in enumerate(names)}
    entered: set[int] = set()

    def enter(state: int, survivors: DataFrame) -> None:
        entered.add(state)
        left = [n for n in names if not state & bit[n]]
        edges = [F.struct(F.lit(n).alias("filter"), F.count_if(filters[n]).alias("removed"), *(F.count_if(filters[n] & c).alias(k) for k, c in lost.items())) for n in left]
        found = survivors.groupBy(part).agg(F.count("*").alias("survivors"), F.array(*edges).alias("edges"))
        found.select(part, "survivors", F.inline("edges")).coalesce(1).write.mode("overwrite").parquet(f"{scratch.path}/edges/state={state}")
        for n in left:
            if len(left) > 1 and (state | bit[n]) not in entered:
                child = survivors.where(~filters[n]).persist()
                enter(state | bit[n], child)
                child.unpersist()

    enter(0, rows.persist())
    rows.unpersist()
    edges = rows.sparkSession.read.parquet(f"{scratch.path}/edges").withColumn("state", F.col("state").cast("int"))
    only = {n: functools.reduce(operator.and_, (~filters[m] for m in names if m != n), filters[n]) for n in names}
    alone = [F.struct(F.lit(n).alias("filter"), F.count_if(filters[n]).alias("fails"), F.count_if(only[n]).alias("unique_fails")) for n in names]
    totals = scratch.save(rows.groupBy(part).agg(F.array(*alone).alias("t")).select(part, F.inline("t")), "totals")
    n = len(names)
    weight = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n))), F.bit_count("state").cast("int") + 1)
    value = scratch.save(edges.groupBy(part, "filter").agg(F.sum(F.col("removed") * weight).alias("shapley")), "value")
    steps = [{"filter_order": "".join(o), "step": k + 1, "state": sum(bit[x] for x in o[:k]), "filter": o[k]} for o in itertools.permutations(names) for k in range(n)]
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, state int, filter string>>")
    grid = totals.groupBy(part).agg(F.count("*")).select(part, F.inline(every))
    out = grid.join(totals, [part, "filter"]).join(value, [part, "filter"]).join(edges, [part, "state", "filter"], "left").fillna(0, ["survivors", "removed", *lost])
    return out.select(part, "filter_order", "step", (F.col("survivors") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")


def corpus_filters() -> dict[str, Column]:
    """Short, repetitive, shouting, marked and copied texts, as conditions of removal over ``document_facts``."""
    return {"A": F.expr("words < 200"), "B": F.expr("100 * different < 50 * words"), "C": F.expr("100 * capitals > 2 * points"), "D": F.expr("marked"), "E": F.expr("copy")}


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of a corpus in all 120 orders, by source.

    Nulls: text as empty, source as the empty part (with it, should it exist);
    a null id is no copy of anything and has no labels. Repeated rows count each;
    rows of one id and text are no copies of one another, as none has a smaller
    id. Texts of any length are read whole, in slices. Empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    facts = scratch.save(document_facts(docs), "facts")
    rows = scratch.save(with_labels(with_copies(facts), labels), "rows")
    scratch.drop("facts")
    return interactions(rows, corpus_filters(), "part", {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}, scratch)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH facts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM facts LEFT JOIN marks USING (doc_id)),
classes AS (SELECT part, good, toxic, f, count(*) AS n FROM fails GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS x FROM orders, range(1, 6) r(s)),
counted AS (
  SELECT part, filter_order, step, x,
    sum(n) FILTER (NOT list_bool_or(list_transform(string_split(filter_order[1:step], ''), lambda y: f[y]))) AS kept,
    sum(n) FILTER (f[x] AND NOT coalesce(list_bool_or(list_transform(string_split(filter_order[1:step], '')[1:step - 1], lambda y: f[y])), false)) AS removed,
    sum(n) FILTER (f[x]) AS fails,
    sum(n) FILTER (f[x] AND len(list_filter(map_values(f), lambda v: v)) = 1) AS unique_fails,
    sum(n) FILTER (good AND f[x] AND NOT coalesce(list_bool_or(list_transform(string_split(filter_order[1:step], '')[1:step - 1], lambda y: f[y])), false)) AS good_lost,
    sum(n) FILTER (toxic AND f[x] AND NOT coalesce(list_bool_or(list_transform(string_split(filter_order[1:step], '')[1:step - 1], lambda y: f[y])), false)) AS toxic_lost
  FROM classes, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(fails, 0) - coalesce(removed, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""
