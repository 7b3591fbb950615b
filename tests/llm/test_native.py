"""Decontamination, licenses, URL filters and WARC revisits on small fixtures."""

import hashlib
import random
import re

import pytest

from signalweave.llm import decontaminate, licenses, urls, warc
from signalweave.storage import Scratch

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, n=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            b = words(it)
            size = min(n, len(b))
            wins = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if b else set()
            for k in range(len(w) - size + 1):
                if size and tuple(w[k : k + size]) in wins:
                    hit.update(range(k, k + size))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,plan_words", [(2048, 50_000), (16, 50_000), (16, 3)])
def test_contamination_like_brute_force(spark, block, plan_words):
    r = random.Random(block)
    vocab = [f"t{i}" for i in range(30)] + ["É", "9"]
    items = [(k * 7, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 25)))) for k in range(12)] + [(100, None), (7, "a b")]
    docs = []
    for k in range(25):
        t = [r.choice(vocab) for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(3)):
            at, b = r.randrange(len(t) + 1), words(r.choice(items)[1])
            t[at:at] = b[r.randrange(len(b) + 1) :]
        docs.append((k, ", ".join(t).upper()))
    docs += [(90, None), (91, ""), (None, items[1][1])]
    df = spark.createDataFrame([(*d, 3) for d in docs], DOCS + ", n_hit int")
    got = decontaminate.contamination(df, spark.createDataFrame(items, ITEMS), block=block, plan_words=plan_words)
    assert sorted(map(tuple, got.drop("text_hash").collect()), key=repr) == brute(docs, items)
    assert decontaminate.contamination(df, spark.createDataFrame([], ITEMS)).where("contaminated").count() == 0
    assert decontaminate.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], ITEMS)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d x f e g h i j"), (3, "a b c q r s t")], DOCS)
    _, found = decontaminate.matches(docs, items, Scratch(spark, "test"), gap=2)
    assert {(r.doc_id, r.exact) for r in found.collect()} == {(1, True), (2, False)}


def test_licenses(spark):
    gpl = licenses.TEMPLATES[7][2]
    rows = [(1, "Released under the MIT License."), (2, "x " * 500 + gpl + " y" * 500), (3, None), (4, ""), (5, "released under the apache license"), (6, gpl[: len(gpl) // 3]), (1, "Released under the MIT License.")]
    got = sorted((r.doc_id, r.licenses, r.best) for r in licenses.license_report(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, "MIT", 1.0), (1, "MIT", 1.0), (2, "GPL-3.0", 1.0), (3, "", 0.0), (4, "", 0.0), (5, "", 0.0), (6, "", 0.0)]
    assert licenses.license_report(spark.createDataFrame([], DOCS)).count() == 0


def test_url_rules_and_aliases(spark):
    pages = [
        (1, "HTTP://WWW.Example.com/en/1", None), (2, "https://example.com/en/712", ""), (3, "https://a.net/de/1?x=1", "<p>"), (4, None, None), (5, "nonsense", None), (6, "x://b.org", None),
        (7, "http://other.io/p", '<link rel="canonical" href="https://bad.org/es/9">'), (8, "http://third.io/q", '<meta http-equiv="refresh" content="0; url=http://other.io/p">'),
        (9, "http://example.net/de/80", '<link href="/de/81" rel=canonical>'), (10, "http://four.io/", '<link rel="canonical" href="http://example.net/de/82">'), (11, "http://four.io", '<link rel="canonical" href="http://bad.org/es/1">'), (3, "https://a.net/de/1?x=1", "<p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {1: ("www.example.com", "/en/1", "com/en/", "block"), 2: ("example.com", "/en/712", "example.com/en/7", "allow"), 3: ("a.net", "/de/1", "net/de/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("b.org", "", None, "allow"), 7: ("other.io", "/p", None, "block"), 8: ("third.io", "/q", None, "block"), 9: ("example.net", "/de/80", "example.net/de/8", "allow"), 10: ("four.io", "/", None, "allow"), 11: ("four.io", "", None, "allow")}
    table = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    for rules in (urls.RULES, table):
        got = urls.judged(df, rules).collect()
        assert len(got) == 12 and {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    assert urls.judged(spark.createDataFrame([], df.schema), urls.RULES).count() == 0


def test_url_rules_of_the_contract(spark, tmp_path):
    """The query on both sides of each rule; the words are those of the contract."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/6": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://s.example.com/en/70": ("example.com/en/7", "allow"), "http://notexample.com/en/7": ("com/en/", "block"),
        "http://a.net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://s.Example.NET/de/80?x#y": ("example.net/de/8", "block"), "http://notexample.net/de/8": ("net/de/", "allow"),
        "http://a.org/es/1": ("org/es/", "block"), "http://example.org/es/": ("org/es/", "block"), "http://a.org/de/8": (None, "allow"), "http://com.io/en/1": (None, "allow"),
    }
    spark.createDataFrame([(k, url, None) for k, url in enumerate(want)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.op6_url_filters(spark, str(tmp_path)).collect()}
    assert {url: got[k] for k, url in enumerate(want)} == want


def test_relative_link_targets(spark):
    want = {"page.html": "http://h.io/a/b/page.html", "../x?y#z": "http://h.io/a/x?y#z", "?id=2": "http://h.io/a/b/c?id=2", "./": "http://h.io/a/b/", "../../../..": "http://h.io/", "d/./e/../f": "http://h.io/a/b/d/f", "/r?u=http://o.io/": "http://h.io/r?u=http://o.io/", "//o.io/p": "http://o.io/p", "https://o.io/q": "https://o.io/q", "mailto:a@b.c": None, "g?u=http://o.io/": "http://h.io/a/b/g?u=http://o.io/"}
    for k, (given, full) in enumerate(want.items()):
        tag = f'<link rel="canonical" href="{given}">' if k % 2 else f'<meta http-equiv="refresh" content="0; url={given}">'
        got = urls.links(spark.createDataFrame([(1, "http://h.io/a/b/c?old=1#top", tag)], "page_id long, url string, html string")).collect()
        assert [r.dst for r in got] == ([full] if full else []), given
    bare = urls.links(spark.createDataFrame([(1, "http://h.io", '<link rel=canonical href="p">')], "page_id long, url string, html string")).collect()
    assert [r.dst for r in bare] == ["http://h.io/p"]
    pages = [(1, "http://h.org/es/1", None), (2, "http://other.io/x/y", '<link rel="canonical" href="../z">'), (3, "http://other.io/z", '<link rel="canonical" href="http://h.org/es/1">')]
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), urls.RULES).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block"}


def test_revisits(spark):
    rows = [
        (1, "http://a.com/x", 10, "response", {"ETag": '"1"', "Content-Type": "t", "X": "old"}, "one"), (2, "https://www.a.com/x/", 20, "response", {"ETag": '"2"', "Date": "d"}, "two"),
        (3, "http://a.com/x", 15, "revisit", {"etag": 'W/"1"', "X": "new", "Date": "n"}, None), (4, "http://a.com/x", 500_000, "revisit", {"ETag": '"2"', "Content-Type": "no"}, None), (5, "http://a.com/x", 30, "revisit", {"ETag": '"1"'}, None),
        (6, "http://a.com/x", 10, "revisit", {}, None), (7, "http://b.com/", 5, "revisit", {"ETag": "q"}, None), (8, None, 5, "revisit", None, None), (9, "http://a.com/x", 9, "revisit", {"ETag": '"1"'}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, body string")
    got = {r.record_id: r for r in warc.resolve_revisits(df, 100).collect()}
    assert {k: (v.response_id, v.status, v.body) for k, v in got.items()} == {3: (1, "resolved", "one"), 4: (2, "resolved", "two"), 5: (2, "mismatch", None), 6: (1, "unchecked", None), 7: (None, "orphan", None), 8: (None, "orphan", None), 9: (None, "orphan", None)}
    assert got[3].headers == {"etag": 'W/"1"', "content-type": "t", "x": "old", "date": "n"} and got[4].headers == {"etag": '"2"', "date": "d"}
    assert warc.resolve_revisits(spark.createDataFrame([], df.schema)).count() == 0


def test_contamination_by_text_and_large_benchmarks(spark):
    """Texts of one id are judged apart; a benchmark of half a million words needs no search for codes."""
    from pyspark.sql import functions as F

    item = " ".join(f"word{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "see " + item), (1, "clean text of the same id"), (None, item), (None, "clean")], DOCS)
    items = spark.range(40_000).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("word"), (F.col("id") * 12 + i).cast("string"))), " ").alias("text")).withColumnRenamed("id", "item_id")
    got = decontaminate.contamination(docs, items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in got) == [(0, 1, 0, False), (0, 12, 12, True), (1, 6, 0, False), (1, 13, 12, True)]
