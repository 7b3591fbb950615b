"""Diagnostics against plain loops, and rules that raise."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from signalweave.operators import diagnostics
from signalweave.sources import evidence, metadata


def complete_link(keys, vectors, least):
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    groups = [[i] for i in range(len(keys))]
    while True:
        found = [(min(s[a, b] for a in g for b in h), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        found = [f for f in found if f[0] >= least]
        if not found:
            return {keys[i]: keys[min(g)] for g in groups for i in g}
        _, i, j = max(found)
        groups = sorted([g for k, g in enumerate(groups) if k not in (-i, -j)] + [sorted(groups[-i] + groups[-j])], key=min)


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_complete_link_like_loops(spark, least):
    r = random.Random(4)
    rows = [(k % 2, k * 3, [r.gauss(0, 1) for _ in range(3)]) for k in range(40)]
    got = diagnostics.complete_link(spark.createDataFrame(rows, "g int, k long, v array<double>").repartition(4), "g", "k", "v", least)
    want = {}
    for g in (0, 1):
        want |= complete_link([k for h, k, _ in rows if h == g], [v for h, _, v in rows if h == g], least)
    assert {x.k: x.group for x in got.collect()} == want
    with pytest.raises(PySparkException, match="at most 5"):
        diagnostics.complete_link(spark.createDataFrame(rows, "g int, k long, v array<double>"), "g", "k", "v", least, 5).collect()


def test_periods_and_freshness(spark):
    t = spark.createDataFrame([(date(2020, 1, 2), date(2020, 3, 5)), (date(2020, 1, 1), date(2020, 2, 1)), (date(2020, 1, 2), date(2020, 2, 20))], "s date, a date")
    got = [r.m for r in t.select(diagnostics.complete_months(F.col("s"), F.col("a")).alias("m")).collect()]
    assert [m and (m["start"], m["end"]) for m in got] == [(date(2020, 2, 1), date(2020, 3, 1)), (date(2020, 1, 1), date(2020, 2, 1)), None]
    t = spark.createDataFrame([("complete", 86_400), ("failed", 601), ("failed", 600), ("complete", -1), (None, 5)], "s string, a long")
    assert [r.f for r in t.select(diagnostics.fresh(F.col("s"), F.col("a")).alias("f")).collect()] == [True, False, True, False, True]


def test_checks_raise(spark):
    with pytest.raises(ValueError, match="repeated"):
        metadata.checked_catalogue(spark.createDataFrame([(1, "A", "e"), (2, "a", "e")], "id int, title string, edition string"), "e")
    stored = spark.createDataFrame([(1, "h", [1.0, 2.0])], "work int, text_hash string, vector array<double>")
    assert metadata.import_vectors(stored, stored, 2).count() == 1
    for size, expected in ((3, stored), (2, stored.withColumn("text_hash", F.lit("x"))), (2, stored.limit(0))):
        with pytest.raises(ValueError, match="expected works"):
            metadata.import_vectors(stored, expected, size)
    with pytest.raises(ValueError, match="lacks"):
        metadata.checked_mirror(stored)
    with pytest.raises(ValueError, match="no reader"):
        metadata.reader("x", "y.json")
    late = spark.createDataFrame([(1, '{"data": [{"paperId": "p", "title": "t", "publicationDate": "2030-01-01"}]}')], "page long, payload string")
    with pytest.raises(PySparkException, match="outside the period"):
        evidence.parse(late, evidence.PROVIDERS["semantic_scholar"], "2020-01-01", "2021-01-01").collect()


def test_frozen_rows_are_sealed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    m = metadata.freeze(spark, rows, f"file://{tmp_path}/s", "k", F.col("k") == 3).first()
    assert (m["rows"], m["quarantined"]) == (2, 1) and metadata.verified(spark, f"file://{tmp_path}/s", "k").count() == 2
    spark.createDataFrame([(9, "z")], "k int, v string").write.mode("append").parquet(f"file://{tmp_path}/s/rows")
    with pytest.raises(ValueError, match="differ"):
        metadata.verified(spark, f"file://{tmp_path}/s", "k")


def test_identities(spark):
    urls = ["https://www.arXiv.org/abs/2101.00001v2", "https://doi.org/10.1/AB/", "http://www.X.org/a/b/?q=1", "http://x.org", None]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(diagnostics.url_key(F.col("u")).alias("k")).collect()]
    assert got == ["arxiv:2101.00001", "doi:10.1/ab", "url:x.org/a/b", None, None]
    t = spark.createDataFrame([("https://a.b.org/x", True), ("http://b.org:80/", True), ("http://b.org:81/", False), ("http://u@b.org/", False), ("http://notb.org/", False), ("ftp://b.org/", False), (None, False)], "u string, w boolean")
    assert all(r.w == r.g for r in t.select("w", metadata.publisher_url(F.col("u"), F.lit("b.org")).alias("g")).collect())
