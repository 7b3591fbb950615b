"""Work that outgrows one task or one batch: rounds, slices and sums that give what the plain way gives."""

import json
import random
import threading
from contextlib import contextmanager
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalweave.operators import diagnostics, identity, phrases, topics


@contextmanager
def within(spark, seconds):
    """Jobs that go on longer are cancelled, which fails the test."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


@pytest.mark.parametrize("clusters", [3, 7])
def test_long_lists_link_as_short_ones(spark, clusters):
    """Lists of more than a task's clusters merge in rounds, with ties, as one task merges them."""
    r = random.Random(6)
    rows = [(k % 2 if k % 5 else None, k * 3, [round(r.gauss(0, 1), 1) for _ in range(3)]) for k in range(70)]
    rows += [(0, 1000 + k, rows[k * 3][2]) for k in range(12)]
    t = spark.createDataFrame(rows, "g int, k long, v array<double>").repartition(4)
    for least in (0.2, 0.9):
        want = {(x.g, x.k, x.group) for x in diagnostics.complete_link(t, "g", "k", "v", least).collect()}
        got = [(x.g, x.k, x.group) for x in diagnostics.complete_link(t, "g", "k", "v", least, clusters=clusters).collect()]
        assert len(got) == len(rows) and set(got) == want


def test_a_list_over_the_former_bound(spark):
    x = np.random.default_rng(2).normal(size=(2100, 4)).tolist()
    got = diagnostics.complete_link(spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "g int, k long, v array<double>"), "g", "k", "v", 0.9)
    assert got.select("k").distinct().count() == 2100 and got.where("`group` > k").count() == 0


def test_spans_leave_in_slices():
    texts = ["deep nets learn fast " * 200, None, "solar cells " * 300, "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], names=["id", "title"])
    cut = [*phrases._span_batches(iter([batch]), "id", ["title"], 2, 3, frozenset(["a"]), 100)]
    whole = [*phrases._span_batches(iter([batch]), "id", ["title"], 2, 3, frozenset(["a"]))]
    assert max(b.num_rows for b in cut) <= 100 and len(cut) > 20 and len(whole) == 1
    assert pa.Table.from_batches(cut).to_pylist() == whole[0].to_pylist()


def test_a_hot_identifier_multiplies_nothing(spark):
    known = spark.range(200_000).select(F.col("id").alias("work"), F.lit("doi").alias("kind"), (F.col("id") % 2).alias("value"))
    asked = spark.range(200_000).select(F.col("id").alias("record"), F.lit("doi").alias("kind"), (F.col("id") % 3).alias("value"))
    with within(spark, 60):
        got = identity.identifier_lookup(asked, known, ["url", "doi"]).groupBy("work").count().collect()
    assert {tuple(r) for r in got} == {(0, 66_667), (1, 66_667)}


def test_a_hot_title_multiplies_nothing(spark):
    none = F.array().cast("array<string>")
    side = lambda c: spark.range(100_000).select(F.col("id").alias(c), F.lit("t").alias("title_key"), F.array(F.col("id") % 5, F.lit(None)).alias("authors"), F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("d"), F.col("id") % 4))).alias("dois"), none.alias("arxiv_ids"))
    with within(spark, 60):
        got = {r.record: r.work for r in identity.title_author_matches(side("record").where("record >= 5"), side("work")).collect()}
    apart = lambda a, b: a % 2 == b % 2 == 0 and a % 4 != b % 4
    assert got == {a: next(b for b in range(40) if a % 5 == b % 5 and not apart(a, b)) for a in range(5, 100_000)}


def test_many_rows_of_a_family(spark):
    """A group's rows are as many as its days allow and more; also rows without a day and a group without a name."""
    start = date(2020, 1, 1)
    rows = [(g, k, start + timedelta(days=k * 7 % 900) if k % 10 else None) for g in (None, 1) for k in range(500)]
    want, at = {}, {}
    for g, k, d in sorted((r for r in rows if r[2]), key=lambda r: (r[0] or 0, r[2], r[1])):
        if g not in at or (d - at[g][0]).days > 365:
            at[g] = (d, k)
        want[g, k] = at[g][1]
    t = spark.createDataFrame(rows, "g int, k long, d date").withColumn("k", F.col("k") + F.when(F.col("g").isNull(), 1000).otherwise(0))
    got = {x.k: x.family for x in topics.variant_families(t, ["g"], "d", "k").collect()}
    assert got == {k + (1000 if g is None else 0): (want[g, k] if d else k) + (1000 if g is None else 0) for g, k, d in rows}
    hot = spark.range(400_000).select(F.lit(1).alias("g"), F.date_add(F.lit(start), (F.col("id") % 700).cast("int")).alias("d"), F.col("id").alias("k"))
    with within(spark, 60):
        assert topics.variant_families(hot, ["g"], "d", "k").groupBy("family").count().count() == 2


def test_links_of_two_keys_come_once(spark):
    one = spark.createDataFrame([(1, "d", "t", ["p"], 2000), (2, None, "t", ["q"], 2001)], "id int, doi string, title_key string, authors array<string>, year int")
    two = spark.createDataFrame([(7, "d", "t", ["z"], 2005), (8, "d", "u", ["p"], 2000), (9, "e", "t", ["p"], 2002)], one.schema)
    want = {(1, 7, "confirmed"), (1, 8, "review"), (1, 9, "probable"), (2, 7, "review"), (2, 9, "review")}
    met = identity.cross_links(one, two)
    assert {(r.a, r.b, r.status) for r in met.collect()} == want and met.count() == 5
    assert "Aggregate" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert identity.cross_links(one.unionAll(one), two).count() == 5


def test_recorded_pages_are_read_once(spark, tmp_path, monkeypatch):
    """A month of 300 refused pages in several files, in any order: no real wait, and each file's rows are decoded once."""
    import pyarrow.parquet as pq

    from signalweave.sources import collectors

    body = lambda k: json.dumps({"meta": {"count": 300, "next_cursor": None if k == 299 else f"c{k + 1}"}, "results": [{"id": f"https://s.example/W{k}", "publication_date": "2024-01-05"}]})
    rows = [("2024-01", "*" if k == 0 else f"c{k}", n, 429 if n == 0 else 200, "9", "" if n == 0 else body(k)) for k in range(300) for n in (0, 1)]
    for part in range(3):
        some = [r for i, r in enumerate(rows) if i // 2 % 3 == part]
        spark.createDataFrame(some, "month string, cursor string, attempt int, status int, retry_after string, body string").coalesce(1).write.mode("append").partitionBy("month").parquet(f"{tmp_path}/pages")
    monkeypatch.setattr(collectors.time, "sleep", lambda seconds: pytest.fail("a recorded page was waited for"))
    decoded, plain = [], pq.ParquetFile.iter_batches
    monkeypatch.setattr(pq.ParquetFile, "iter_batches", lambda self, *a, **b: (decoded.append(x.num_rows) or x for x in plain(self, *a, **b)))
    pages = collectors.RecordedPages(str(tmp_path / "pages"))
    found = [*collectors.walk(pages, (date(2024, 1, 1), date(2024, 1, 31)))]
    assert found[-1][0]["complete"] and len(found) == 300 and sum(decoded) == 2 * len(rows)
    # A page behind is found as well.
    assert pages.get("2024-01", "c7", 1)[2] == body(7).encode() and pages.get("2024-01", "c7", 0)[0] == 429 and pages.get("2024-01", "c300", 0)[0] == 404 and pages.get("2024-02", "*", 0)[0] == 404


def test_large_cohorts_are_not_copied(spark):
    """Cohorts of 40,000 members: a row for each of the first members once carried the whole list."""
    from signalweave.operators import greedy

    some = lambda rank, phrase, least, most: spark.range(1).select(F.lit(rank).cast("long").alias("rank"), F.lit(phrase).alias("phrase"), F.lit(phrase).alias("inflection"), F.sequence(F.lit(least).cast("long"), F.lit(most).cast("long")).alias("members"))
    t = some(1, "a", 1, 40_000).unionAll(some(2, "b", 1, 36_000)).unionAll(some(3, "c", 20_000, 55_000)).unionAll(some(4, "d", 1, 30_000))
    with within(spark, 60):
        got = {r.phrase: (r.representative, r.jaccard) for r in greedy.display_groups(t).collect()}
    assert got == {"a": ("a", 1.0), "b": ("a", 0.9), "c": ("c", 1.0), "d": ("d", 1.0)}


def test_large_compositions_are_sized_once(spark):
    from signalweave.operators import hybrid

    side = lambda n: spark.range(400_000).groupBy((F.col("id") % n).alias("candidate")).agg(F.collect_list("id").alias("works"))
    with within(spark, 60):
        got = {(r.a, r.b): (r.shared, r.n_a, r.n_b) for r in hybrid.overlap_join(side(2), side(3)).collect()}
    assert len(got) == 6 and got[0, 0] == (66_667, 200_000, 133_334)


def test_long_lines_of_previews(spark):
    """Components over the arrays' bound give in one task what arrays and rounds give, with a line of 3,000 rows."""
    from signalweave.operators import previews

    kind = "place long, key string, title string, doi string, arxiv array<string>, authors array<string>, year long"
    r = random.Random(8)
    some = lambda xs, p: r.choice(xs) if r.random() < p else None
    rows = [(k, some(["title:a", "k1", "k2"], 0.5), some(["deep nets", "solar", "solar cells", ""], 0.8), some(["10.1/A", "10.1/a", "10.2/b", "10.48550/arXiv.1"], 0.4), some([["x1"], ["x2"], ["x1", "x3"]], 0.3), some([["p"], ["q"], ["p", "s"]], 0.8), some([2000, 2001, 2004, 2009], 0.9)) for k in range(120)]
    t = spark.createDataFrame(rows, kind).repartition(5)
    plain = {tuple(x) for x in previews.folded_previews(t).select("place", "into").collect()}
    assert {tuple(x) for x in previews.folded_previews(t, 3).select("place", "into").collect()} == plain
    few = t.where("place < 12")
    assert {tuple(x) for x in previews.folded_previews(few, 2, 2).select("place", "into").collect()} == {(a, b) for a, b in plain if a < 12}
    line = spark.range(3000).select(F.col("id").alias("place"), F.lit("title:t").alias("key"), F.concat(F.lit("t"), "id").alias("title"), F.lit("10.1/a").alias("doi"), F.array().cast("array<string>").alias("arxiv"), F.array(F.lit("p")).alias("authors"), F.lit(2000).cast("long").alias("year"))
    with within(spark, 60):
        assert previews.folded_previews(line, 100).where("into = 0").count() == 3000


def test_copies_of_a_row_stay_few(spark, monkeypatch):
    """The blocks of a large group: a row is copied eight times, not once for each 1,024 others, and slices change nothing."""
    from signalweave.operators import blocks, vectors

    assert blocks.wide(200_000) == 25_000 and blocks.wide(2_000_000) == blocks.WIDE and blocks.wide(100, 16) == 16
    x = np.random.default_rng(3).normal(size=(3000, 4)).round(1).tolist()
    t = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k long, v array<double>")
    plain = {tuple(r) for r in vectors.nearest(t, "k", "v", t, "k", "v", 3, exclude_self=True).collect()}
    monkeypatch.setattr(vectors, "ANCHORS", 10)
    monkeypatch.setattr(blocks, "wide", lambda n, block=0: 2000)
    assert {tuple(r) for r in vectors.nearest(t, "k", "v", t, "k", "v", 3, exclude_self=True).collect()} == plain
