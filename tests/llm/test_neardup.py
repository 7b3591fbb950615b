"""Near-duplicates against all pairs."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.llm import neardup
from signalweave.storage import Scratch

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def corpus(seed, bases=12, copies=14):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(bases):
        base = [r.choice(words) for _ in range(r.randrange(3, 160))]
        for _ in range(r.randrange(1, copies)):
            one = list(base)
            for _ in range(r.randrange(0, 5)):
                one[r.randrange(len(one))] = r.choice(words)
            rows.append((len(rows) * 3 + 7, " ".join(one) if r.random() < 0.8 else " ".join(one).upper()))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(spark, seed):
    rows = corpus(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows)


def test_large_group_with_outliers(spark):
    """A star of copies that are less like each other than like their source."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for k in range(1, 80):
        one = list(base)
        for at in r.sample(range(100), r.choice([1, 1, 2, 2, 2])):
            one[at] = f"x{k}_{at}"
        rows.append((k, " ".join(one)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows)


def template(n, own=40, core=100):
    """``n`` texts of one template, each with one partner at 0.77 and far from the rest (at most 0.62)."""
    rows, same = [], [f"c{i}" for i in range(core)]
    for k in range(n // 2):
        mine = [f"o{k}_{i}" for i in range(own)]
        rows += [(k, " ".join(same + mine)), (1_000_000 + k, " ".join(same + mine[:-17] + [f"y{k}_{i}" for i in range(17)]))]
    return rows


@pytest.mark.parametrize("n", [600, 4000])
def test_regions_wider_than_a_block(spark, monkeypatch, n):
    """Pairs that lie anywhere in a region of one template; blocks are small enough to cut the region."""
    rows = template(n)
    if n <= 600:
        assert len({v[1] for v in brute(rows).values()}) == n // 2
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 100 if n <= 600 else 512)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert {x.doc_id: x.component_id for x in got.collect()} == {i: i % 1_000_000 for i, _ in rows}


def test_regions_cut_by_a_seam_are_dense(spark):
    """Four close prefixes in two batches of two rows."""
    rows = spark.createDataFrame([(0, bytes(8), i) for i in range(4)], "tree int, key binary, id long")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, 2)
    try:
        got = neardup._neighbours(rows.coalesce(1).sortWithinPartitions("id"), Scratch(spark, "test"), "seam", 2, 2, 2).collect()
    finally:
        spark.conf.set(size, was)
    assert {r.a for r in got if r.kind == 1} == {0, 1, 2, 3}
    assert {(r.a, r.b) for r in got if r.kind == 0} == {(0, 1), (1, 2), (2, 3), (0, 2), (1, 3)}


def test_groups_may_span_batches(spark):
    """A block's rows in many batches meet as one group."""
    rows = template(60)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set(size, was)
    assert {x.doc_id: x.component_id for x in got} == {i: i % 1_000_000 for i, _ in rows}


def test_very_long_texts(spark):
    """Over a megabyte each: whole texts count, so a change of a third at the end parts them."""
    base = [f"w{i}" for i in range(180_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:170_000])), (3, " ".join(base[:120_000] + [f"z{i}" for i in range(60_000)]))]
    assert len(rows[0][1]) > 1 << 20
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_nulls_blanks_ties_repeats_and_extra_columns(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "a b"), (9, "A  b"), (10, "b a"), (11, "x " * 3000), (12, "x " * 2000), (12, "x " * 2000)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA + ", kept int, component_id int")
    got = sorted(map(tuple, neardup.near_duplicates(df).drop("text_hash", "stays").collect()))
    assert got == [(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (10, 1, 10, True), (11, 1, 11, True), (12, 1, 11, False), (12, 1, 11, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sets_are_exact():
    texts = [b"", b"one", b"a b c d e", b"a b c d e f", b"A b\tc\x0bd  e\nf", b"a b c d e a b c d e a"]
    hashes, n = neardup.Shingler(5).sets(texts)
    parts = np.split(hashes, np.cumsum(n)[:-1])
    assert n.tolist() == [len(shingles(t.decode())) for t in texts]
    assert set(parts[3]) == set(parts[4]) and set(parts[2]) < set(parts[3])
    by = defaultdict(set)
    for t, p in zip(texts, parts):
        by[frozenset(shingles(t.decode()))].add(frozenset(p.tolist()))
    assert all(len(v) == 1 for v in by.values())


def test_one_id_with_two_texts(spark):
    """The likeness of an id's second text counts, whichever comes first, and its first text stays out of it."""
    x = " ".join(f"w{i}" for i in range(1000))
    y = " ".join(f"v{i}" for i in range(1000))
    near, other = x + " more", "nothing like it at all here"
    for rows in itertools.permutations([(1, x), (2, y), (2, near)]):
        got = neardup.near_duplicates(spark.createDataFrame([*rows, (None, near), (None, other), (None, other), (3, "")], "doc_id long, text string")).collect()
        hashes = {t: h for t, h in spark.createDataFrame([(t,) for t in (x, y, near, other, "")], "text string").select("text", neardup.text_hash(F.col("text"))).collect()}
        found = {(r.doc_id, r.text_hash): (r.component_id, r.kept, r.stays) for r in got}
        assert found[1, hashes[x]] == (1, True, True)
        assert found[2, hashes[y]] == (2, True, True)
        assert found[2, hashes[near]] == found[None, hashes[near]] == (1, False, False)
        assert found[None, hashes[other]] == (None, True, True)
        assert found[3, hashes[""]] == (3, True, True)
        assert len(got) == 7


def test_near_texts_of_one_id(spark):
    x = " ".join(f"w{i}" for i in range(200))
    got = neardup.near_duplicates(spark.createDataFrame([(4, x), (4, x + " more"), (9, x + " else")], "doc_id long, text string")).collect()
    assert all(r.component_id == 4 for r in got) and sorted(r.kept for r in got) == [False, True, True] and sum(r.stays for r in got) == 1
