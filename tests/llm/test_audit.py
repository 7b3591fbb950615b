"""Filters in all orders against a plain loop over documents."""

import itertools
import random

import pyarrow as pa
import pytest

from signalweave.llm import audit

BLANKS = " \t\n\x0b\x0c\r"


def brute(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    marks = {n: {i for i, *m in labels if m[k] == 1 and i is not None} for k, n in enumerate(("good", "toxic"))}
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = t.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)}
        fails |= {"D": any(c in t for c in "#$%&*|"), "E": i is not None and i > least[t]}
        rows.append((source or "", {n for n in fails if fails[n]}, i in marks["good"], i in marks["toxic"]))
    out = {}
    for part in {r[0] for r in rows}:
        mine, value = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                value[f] += len(gone)
                fails = [r for r in mine if f in r[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(value[order[step - 1]])
    return out


def some_documents():
    rng = random.Random(5)
    docs = [(None, "no id " * 150, "a"), (7, None, None), (8, "", ""), (9, " \t\r\n", "b"), (10, "x" * 3000, "b"), (11, "A|" * 400, None)]
    for i in range(20, 140):
        n = rng.choice([3, 150, 199, 200, 201, 400])
        words = [rng.choice(["alpha", "beta", "Gamma", "déjà", "ZZ"] + [f"w{k}" for k in range(rng.choice([2, 500]))]) for _ in range(n)]
        docs.append((i, rng.choice(BLANKS).join(words) + rng.choice(["", "", "#", " 5 % of"]), rng.choice(["a", "b", "hot", "hot", "hot"])))
    docs += [(200 + i, docs[30][1], "hot") for i in range(60)] + [docs[40]] * 3 + [(None, docs[40][1], "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 240)] + [(20, 1, 1), (None, 1, 1)]
    return docs, labels


def test_every_order_like_a_plain_loop(spark):
    docs, labels = some_documents()
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, source string, part int, digest string, words int")
    got = audit.filter_audit(table, spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int, good int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {tuple(r[:3]): list(r[3:]) for r in got.collect()}
    want = brute(docs, labels)
    assert len(want) == 4 * 120 * 5
    assert found == want


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs, labels).count() == 0
    one = audit.filter_audit(spark.createDataFrame([(1, "a #", None)], docs.schema), labels)
    assert one.where("removed = 1").count() == 120 and {r.part for r in one.collect()} == {""}


@pytest.mark.parametrize("held", [audit.HELD, 64])
def test_long_texts_in_slices(monkeypatch, held):
    monkeypatch.setattr(audit, "SLICE", 50)
    monkeypatch.setattr(audit, "HELD", held)
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice([*"ab é$Z", *BLANKS, "long" * rng.choice([1, 40])]) for _ in range(rng.choice([0, 5, 300])))
        raw = text.encode()
        _, words, different, capitals, points, marked = audit.text_facts(pa.py_buffer(raw))
        assert (words, different, capitals, points, marked) == (len(raw.split()), len(set(raw.split())), sum("A" <= c <= "Z" for c in text), len(text), "$" in text)
        assert b"".join(audit._slices(pa.py_buffer(raw))) == raw
