"""Trees over rows against a plain recursive build, however the rows are dealt."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from signalweave.llm import manifest
from signalweave.llm.common import Scratch


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Root, and for each leaf its siblings as (before, after) of each level."""
    paths, levels = [[] for _ in leaves], [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for k, path in enumerate(paths):
            at = k // 3 ** (len(levels) - 1)
            run = range(at - at % 3, min(at - at % 3 + 3, len(now)))
            path.append(("".join(now[j] for j in run if j < at), "".join(now[j] for j in run if j > at)))
        levels.append([h(*now[k : k + 3]) for k in range(0, len(now), 3)])
    return levels[-1][0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        groups.setdefault(r[1], []).append((r[0], leaf(r), leaf((*r[:4], text))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = tree([r[1] for r in groups[g]])
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (doc_id, mine, now), path in zip(groups[g], trees[g][1], strict=True):
            whole = [*path, *top]
            out.append((doc_id, mine, trees[g][0], root, h(*(a + b for a, b in whole)), manifest.fold(now, whole), manifest.fold(now, whole) == root))
    return sorted(out, key=repr)


def some_rows(n, sources, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), n)
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([5, None]), rng.choice([None, "", "a\nb", "\n", "é\r\n日", "plain", f"t{i}\n"])) for i in ids]
    return rows + rows[:3] + [(None, sources[0], "en", 1, "x\n"), (None, sources[0], None, 1, "y"), (ids[0], "zz", "en", 2, "\n"), (ids[0], rows[0][1], "en", 2, "other\n")]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, hash int, other int, at int, name string"


@pytest.mark.parametrize(("n", "sources", "per_part"), [(1, ["a"], 100), (150, [None, "", "a", "B", "é", "hot", "hot", "hot", "hot"], 7), (80, ["one"], 4), (60, [f"s{i}" for i in range(40)], 6), (20, ["a", None], 1)])
def test_manifest_like_a_plain_tree(spark, monkeypatch, n, sources, per_part):
    monkeypatch.setattr(manifest, "MERGED", 3)
    rows = some_rows(n, sources)
    docs = spark.createDataFrame([(*r, "z", 1, 2, 3, "n") for r in rows], SCHEMA)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = manifest.dataset_manifest(docs, tampered={"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}, rows_per_part=per_part)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == brute(rows)
    assert n == 1 or {r[-1] for r in found} == {True, False}


def test_empty_and_untampered(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.dataset_manifest(none).count() == 0
    docs = spark.createDataFrame([(*r, "z", 1, 2, 3, "n") for r in some_rows(30, ["a", "b"])], SCHEMA)
    assert manifest.dataset_manifest(docs).where("not verified").count() == 0


def test_mountain_range_and_hot_rows(spark):
    """Equal rows, nearly all of the table, are dealt to many partitions; a partition hands on few nodes."""
    docs = spark.createDataFrame([(1, "a", "en", 1, "same\n")] * 900 + [(i, "a", "en", 1, "x") for i in range(2, 50)], "doc_id long, source string, lang string, n_chars long, text string")
    scratch = Scratch(spark, "test")
    rows = scratch.save(docs.select(F.lit("1a").alias("g"), "doc_id", F.unhex(manifest.leaf_hash({c: F.col(c) for c in manifest.COLUMNS})).alias("hash"), F.lit(None).cast("binary").alias("other"), F.lit(None).cast("string").alias("name")), "rows")
    leaves, runs = manifest.indexed(rows, scratch, "t", ["doc_id", "hash"], 12)
    assert max(r.n for r in runs.collect()) < 300
    peaks = scratch.save(manifest._pass(leaves, runs).mapInArrow(manifest._peaks, manifest.NODES), "peaks")
    assert max(r["count"] for r in peaks.groupBy("pid").count().collect()) <= 4 * 8
    assert len(sorted(map(tuple, manifest.dataset_manifest(docs, rows_per_part=100).collect()))) == 948
    range_ = manifest.MountainRange(4)
    for k in range(4):
        range_.push(k, f"{k}")
    assert range_.top == h(h("0", "1", "2"), h("3")) and not range_.loose
