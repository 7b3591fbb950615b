"""Mixes against SQL on awkward rows, routes against all splits, targets against the sharing loop."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalweave.llm import mixing
from signalweave.llm.common import Scratch


def rows(seed=2):
    rng = random.Random(seed)
    out = [(i, rng.choice([None, "", " \t\n", "one", "a b c", "x " * rng.randint(1, 90), "y\x0bz " * rng.choice([5, 800])]), rng.choice([None, "", "b", "é", "a", "hot", "hot", "hot", "Z"])) for i in range(300)]
    return out + [(7, "the same row", "hot")] * 200 + [(None, "w " * k, "a") for k in (1, 4, 4)] + [(9, "other text", "b")]


SCHEMA = "doc_id long, text string, source string, size int, key string, n int, q int, target int"


def test_mix_like_sql(spark):
    import duckdb

    data = rows()
    docs = spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in data], SCHEMA)
    got = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")), Scratch(spark, "test"))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in data], pa.int64()), "text": pa.array([r[1] for r in data], pa.string()), "source": pa.array([r[2] for r in data], pa.string())}))
    want = con.sql(mixing.OP11_SQL).fetchall()
    names = ["doc_id", "size", "source_size", "target", "taken"]
    found = got.collect()
    assert sorted((tuple(r[c] for c in names) for r in found), key=repr) == sorted(want, key=repr)
    assert len(found) == len(data)
    sums = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        of = sums.setdefault(r.source, [r.target, 0, 0])
        of[1:] = of[1] + r.taken, max(of[2], r["size"])
    # Whole documents: at worst one of 1,600 words is too much or missing.
    assert all(abs(target - taken) <= max(0.02 * target, largest / 2) for target, taken, largest in sums.values())
    again = mixing.mix(docs.repartition(7, F.rand(1)), F.array("source"), mixing.word_count(F.col("text")), Scratch(spark, "test"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, found))


def test_words(spark):
    texts = [None, "", " ", "a", "\ta\x0b b\x0c\r\n", "é日 x", "a\x1cb c", "x" * 100_000 + " y" * 100_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}


@pytest.mark.parametrize("per_task", [mixing.RANKED, 3])
def test_targets_like_the_sharing_loop(spark, per_task):
    sizes = {None: 5, "a": 1000, "b": 10, "c": 10, "d": 0, "e": 400, "é": 37, "B": 2}
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    held = set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in held), sum(weight[s] for s in sizes if s not in held)
        above = {s for s in sizes if s not in held and left * weight[s] / w > 3 * sizes[s]}
        if not above:
            break
        held |= above
    want = {s: 3.0 * sizes[s] if s in held else left * weight[s] / w for s in sizes}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), total, Scratch(spark, "test"), per_task=per_task).collect()
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long"), 0, Scratch(spark, "test")).count() == 0


def test_routes_cost_least():
    """Against all ways to split small patterns among their sources."""
    rng = random.Random(1)
    for _ in range(40):
        sizes = {p: rng.randint(0, 3) for p in "pqr"}
        members = [(p, s) for p in sizes for s in "xy" if rng.random() < 0.7]
        quotas = {s: rng.randint(0, 6) for s in "xy"}

        def cost(flow, sizes=sizes):
            used = {p: sum(v for (a, _), v in flow.items() if a == p) for p in sizes}
            return sum(sum(k // sizes[p] for k in range(used[p])) for p in sizes)

        best = None
        for amounts in itertools.product(*(range(min(3 * sizes[p], quotas[s]) + 1) for p, s in members)):
            flow = dict(zip(members, amounts, strict=True))
            if all(sum(v for (a, _), v in flow.items() if a == p) <= 3 * sizes[p] for p in sizes) and all(sum(v for (_, b), v in flow.items() if b == s) <= quotas[s] for s in quotas):
                key = (-sum(amounts), cost(flow))
                best = key if best is None else min(best, key)
        found = mixing.cheapest_routes(sizes, members, quotas)
        assert (-sum(found.values()), cost(found)) == best


def test_overlapping_sources(spark):
    rng = random.Random(4)
    data = [(i, "w " * rng.randint(1, 40), rng.choice([["a"], ["a", "b"], ["b", "a", "b"], ["c"], ["c", None], None])) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, of array<string>")
    got = mixing.mix(docs, F.col("of"), mixing.word_count(F.col("text")), Scratch(spark, "test")).collect()
    assert len(got) == len(data)
    words = {i: len(t.split()) for i, t, _ in data}
    sums = {}
    for r in got:
        assert r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] == 3 * words[r.doc_id]
        assert r.source in r.sources
        sums.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert set(sums) == {None, "a", "b", "c"}
    assert all(abs(target - taken) <= 0.02 * target + 5 for target, taken in sums.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")), Scratch(spark, "test")).count() == 0
