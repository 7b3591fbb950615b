"""Repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from signalweave.llm import suffix

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        left = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n, alphabet, size):
    r = random.Random(seed)
    made = ["".join(r.choice(alphabet) for _ in range(r.randrange(size))) for _ in range(n)]
    for _ in range(n):
        a, b = r.randrange(n), r.randrange(n)
        i, j = r.randrange(len(made[a]) + 1), r.randrange(len(made[b]) + 1)
        made[b] = made[b][:j] + made[a][i : i + r.randrange(1, 60)] + made[b][j:]
    return list(enumerate(made))


@pytest.mark.parametrize("length,gram,fan", [(8, 4, 2), (20, 5, 3), (40, 9, 7)])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é"])
def test_like_brute_force(spark, length, gram, fan, alphabet):
    rows = texts(length, 40, alphabet, 120)
    got = suffix.repeated_text(spark.createDataFrame(rows, SCHEMA).repartition(5), length, gram, fan)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == brute(rows, length)


def test_long_texts_are_cut_without_losing_starts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 64)
    rows = texts(3, 6, "abc", 900)
    # Workers read the constant when they import the module; the cut itself is tested here.
    parts = list(suffix._texts(__import__("pyarrow").RecordBatch.from_pydict({"doc_id": [0], "text": ["x" * 700]}), 20, 64))
    starts = sorted(int(add[0]) + k for _, _, first, count, add in parts for k in range(int(count[0])))
    assert starts == list(range(681))
    got = suffix.repeated_text(spark.createDataFrame(rows, SCHEMA), 20, 5, 3)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == brute(rows, 20)


def test_nulls_ties_repeated_rows_and_clashing_names(spark):
    t = "the quick brown fox jumps over it"
    rows = [(1, t), (1, t), (2, None), (3, ""), (None, t), (4, "short"), (5, "x" * 50)]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], SCHEMA + ", tx int, n_removed int, other int")
    got = suffix.repeated_text(df, 20, 5, 3, want_text=True)
    assert got.columns == ["doc_id", "text", "tx", "other", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == brute(rows, 20)
    assert {r.doc_id: r.kept_text for r in got.collect()}[4] == "short"


def test_empty_table(spark):
    assert suffix.repeated_text(spark.createDataFrame([], SCHEMA)).collect() == []
