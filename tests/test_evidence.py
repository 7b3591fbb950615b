"""Evidence operators against plain loops, with their edges."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from signalweave.operators import blocks, evidence, previews, vectors
from signalweave.operators.components import components
from signalweave.storage import Scratch, hot_join

ITEM = "place long, key string, title string, doi string, arxiv array<string>, authors array<string>, year long"


def one_work(a, b):
    """The rule of previews in plain words, for pairs (key, title, doi, arxiv, authors, year)."""
    if a[3] and b[3]:
        return bool(a[3] & b[3])
    strangers = a[4] and b[4] and not a[4] & b[4]
    if a[2] and a[2] == b[2]:
        return a[1] == b[1] or not strangers
    if all(d and not d.startswith("10.48550/arxiv.") for d in (a[2], b[2])):
        return False
    if a[0] and a[0] == b[0] and not a[0].startswith("title:"):
        return True
    return bool(a[1] and a[1] == b[1] and a[4] & b[4] and None not in (a[5], b[5]) and abs(a[5] - b[5]) <= 2)


@pytest.mark.parametrize(("seed", "n", "together"), [(1, 80, 1000), (2, 80, 1000), (3, 80, 1000), (4, 12, 2)])
def test_previews_like_a_loop(spark, seed, n, together):
    r = random.Random(seed)
    some = lambda xs, p: r.choice(xs) if r.random() < p else None
    rows = [(k, some(["title:a", "k1", "k2"], 0.5), some(["deep nets", "solar", "solar cells", ""], 0.8), some(["10.1/A", "10.1/a", "10.2/b", "10.48550/arXiv.1"], 0.4), some([["x1"], ["x2"], ["x1", "x3"]], 0.3), some([["p"], ["q"], ["p", "s"]], 0.8), some([2000, 2001, 2004, 2009], 0.9)) for k in range(n)]
    works, want = {}, {}
    for place, key, title, doi, arxiv, authors, year in rows:
        row = (key or "", title or "", (doi or "").lower(), set(arxiv or []), set(authors or []), year)
        into = next((p for p in sorted(works) if one_work(works[p], row)), place)
        want[place] = into
        p = works.get(into)
        works[into] = row if p is None else (p[0] if p[2] else row[0], max(p[1], row[1], key=len), p[2] or row[2], p[3] | row[3], p[4] | row[4], min((y for y in (p[5], row[5]) if y is not None), default=None))
    got = previews.folded_previews(spark.createDataFrame(rows, ITEM).repartition(5), together)
    assert {x.place: x.into for x in got.collect()} == want
    assert previews.folded_previews(spark.createDataFrame([], ITEM)).count() == 0


def test_profile_refuses_gaps_and_partial_years(spark):
    year = lambda g, y, n, ok=True: (g, date(y, 1, 1), date(y + 1, 1, 1), n, ok)
    rows = [year("a", y, 5) for y in range(2015, 2021)] + [year("b", y, 5) for y in (2015, 2017, 2018, 2019, 2020)] + [year("c", y, 5) for y in (2018, 2019)] + [year("d", y, 1) for y in (2018, 2019, 2020)] + [year("e", 2020, 3), ("e", date(2021, 1, 1), date(2022, 1, 1), 9, False)]
    got = {x.g: x for x in evidence.recent_profile(spark.createDataFrame(rows, "g string, start date, end date, works long, complete boolean"), ["g"], "2021-06-01").collect()}
    assert (got["a"].covered, got["a"].recent_works, got["a"].recent_share, got["a"].small_sample) == (True, 15, 50.0, False)
    assert not any(got[k].covered for k in "bce") and got["d"].small_sample


def test_subset_is_required(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert evidence.require_subset(b, a, "k").count() == 1
    with pytest.raises(ValueError, match="1 rows"):
        evidence.require_subset(a, b, "k")


def test_blocks_cut_groups(spark):
    """Any block size gives the same neighbours and clusters; more anchors than one matrix holds meet in blocks."""
    r = random.Random(3)
    rows = [(k % 2, k, [r.gauss(0, 1) for _ in range(3)]) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, k long, v array<double>")
    want = {(x.k, x.near_k, x["rank"]) for x in vectors.nearest(df, "k", "v", df, "k", "v", 4, exclude_self=True).collect()}
    clusters = {x.k: x.cluster for x in vectors.density_clusters(df, ["g"], "k", "v", 0.9, 3).collect()}
    held, block = vectors.ANCHORS, blocks.across.__defaults__
    try:
        vectors.ANCHORS, blocks.across.__defaults__ = 10, (7,)
        assert {(x.k, x.near_k, x["rank"]) for x in vectors.nearest(df, "k", "v", df, "k", "v", 4, exclude_self=True).collect()} == want
        assert {x.k: x.cluster for x in vectors.density_clusters(df, ["g"], "k", "v", 0.9, 3).collect()} == clusters
    finally:
        vectors.ANCHORS, blocks.across.__defaults__ = held, block


def test_clusters_need_enough_cores(spark):
    """One core with two borders is no cluster of three; three cores are."""
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.8, 0.6]), (0, 3, [0.8, -0.6]), (1, 4, [1.0, 0.0]), (1, 5, [1.0, 0.01]), (1, 6, [1.0, -0.01]), (1, 7, [0.0, 1.0])]
    got = vectors.density_clusters(spark.createDataFrame(rows, "g int, k long, v array<double>"), ["g"], "k", "v", 0.75, 3)
    assert {x.k: x.cluster for x in got.collect()} == {1: -1, 2: -1, 3: -1, 4: 0, 5: 0, 6: 0, 7: -1}


def test_a_hot_key_is_not_shuffled(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    small = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = hot_join(rows, small, ["k"], "n")
    assert got.count() == 1000 and got.where("k = 7").agg(F.max("n")).first()[0] == 666
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    star = spark.range(1, 500).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    assert {r.component for r in components(star, Scratch(spark, "test")).collect()} == {0}
