"""Empty tables, nulls, ties, repeated rows, very long texts and clashing column names, for every operator."""

import hashlib
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from signalweave.llm import decontaminate, licenses, media, neardup, packing, quality, suffix, urls, warc, wordpiece

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, tx int, score int, n_words int, licenses int, component_id int, payload int, start int, length int, tokens int, kept int, at int, h int"
EXTRA = tuple(range(12))
LONG = " ".join(f"w{i % 5000}" for i in range(220_000))
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \t\n"), (None, "no id here"), (5, LONG), (6, "Released under the MIT License."), (7, "a b c d e f")]


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


OPERATORS = {
    "near": lambda s, d: neardup.near_duplicates(d),
    "media": lambda s, d: media.media_payloads(d),
    "packing": lambda s, d: packing.packed_documents(d, vocabulary("byte_bpe_50k.json"), added=True).where("start = 0"),
    "quality": lambda s, d: quality.quality_scores(d, s.read.parquet(f"{DATA}/labels.parquet"), s.read.parquet(f"{DATA}/documents.parquet")),
    "license": lambda s, d: licenses.license_report(d),
    "suffix": lambda s, d: suffix.repeated_text(d),
    "tokens": lambda s, d: wordpiece.token_counts(d, vocabulary("byte_bpe_50k.json")),
    "leaks": lambda s, d: decontaminate.contamination(d, s.read.parquet(f"{DATA}/benchmark.parquet")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(spark, name):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in ROWS], DOCS)
    got = OPERATORS[name](spark, docs)
    assert len(LONG) > 1 << 20
    rows = got.collect()
    assert len(rows) == len(ROWS)
    mine = [c for c in got.columns if c not in ("sequence_id", "offset", "component_id", "kept", "doc_id")]
    values = {}
    for r in rows:
        values.setdefault(r.doc_id, []).append(tuple(r[c] for c in mine))
    # Repeated rows share their values; a row comes for each, also for the null id.
    assert {k: len(v) for k, v in values.items()} == {1: 2, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 6: 1, 7: 1}
    assert values[1][0] == values[1][1]
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_long_text_repeats(spark):
    """A line without end is one span, whatever the number of its places; over a megabyte."""
    line = "the same line again "
    rows = [(1, line * 60_000), (2, "x" * 1_200_000), (3, "short")]
    got = {r.doc_id: r for r in suffix.repeated_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_removed == len(t) and got[i].n_spans == 1 and got[i].kept_sha256 == hashlib.sha256(b"").hexdigest() for i, t in rows[:2])
    assert got[3].n_removed == 0
    runs = suffix.anchor_runs(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tx long"), 400, 50)
    # Each mebibyte is cut by itself; runs at a cut's edges differ from those inside.
    assert runs.where("doc_id < 3").select(F.sum(F.size("spans"))).first()[0] < 60


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "link" and a.get("rel") == "canonical":
            self.found.append(a["href"])
        if tag == "meta" and a.get("http-equiv") == "refresh":
            self.found.append(a["content"].split("url=", 1)[1])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_url_verdicts_on_random_graphs(spark, seed):
    """Every verdict against union-find over canonical forms, links and redirects, read by the standard library."""
    r = random.Random(seed)
    hosts = ["a.com", "www.a.com", "m.b.net", "b.net", "example.com", "s.example.net", "c.org", "d.io", "e.io", "f.io"]
    paths = ["/en/1", "/en/7x", "/de/8", "/de/1/", "/es/2", "/p", "/p.html", "/q/index.html", "/q", "/r/s"]
    made = [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(60)]
    pages = []
    for k, url in enumerate(made):
        html = None
        if r.random() < 0.45:
            to = r.choice([r.choice(made), r.choice(paths), r.choice(["t", "../u", "?v=1", "./"])])
            html = f'<link rel="canonical" href="{to}">' if r.random() < 0.5 else f'<meta http-equiv="refresh" content="0; url={to}">'
        pages.append((k, url, html))
    edges = [(r.choice(made), r.choice(made)) for _ in range(4)]

    def sited(url):
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        return rest[:cut].lower(), rest[cut:].split("#")[0].split("?")[0]

    def rule(url):
        host, path = sited(url)
        fit = [(len(h + p), v == "allow") for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1] if fit else None

    def form(url):
        host, path = sited(url)
        for head in ("www.", "m."):
            if host.startswith(head):
                host = host[len(head) :]
                break
        for tail in ("/index.html", "/index.htm", ".html", ".htm", "/"):
            if path.endswith(tail):
                path = path[: -len(tail)]
                break
        query = url.split("#")[0].split("?", 1)[1] if "?" in url else ""
        return "=" + host + path + ("?" + query if query else "")

    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    links = list(edges)
    for _, url, html in pages:
        reader = _Links()
        reader.feed(html or "")
        links += [(url, urljoin(url, to)) for to in reader.found]
    every = {u for p in links for u in p} | set(made)
    for a, b in links + [(u, form(u)) for u in every]:
        up[root(a)] = root(b)
    groups = {}
    for u in every:
        if rule(u) is not None:
            groups.setdefault(root(u), set()).add(rule(u))
    want = {}
    for k, url, _ in pages:
        own, shared = rule(url), groups.get(root(url), set())
        want[k] = "allow" if (own if own is not None else (True in shared or not shared)) else "block"
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = urls.judged(df, urls.RULES, spark.createDataFrame(edges, "src string, dst string"))
    assert {x.page_id: x.verdict for x in got.collect()} == want


def test_a_hot_response_and_clashing_names(spark):
    """A third of all records ask one response; columns of the input have the names of results."""
    rows = [(0, "http://a.com/x", 1, "response", {"ETag": "t"}, "body", "s")] + [(k, "http://a.com/x", 1 + k, "revisit", {"etag": "t"}, None, "s") for k in range(1, 300)]
    rows += [(1000 + k, f"http://b.com/{k}", 1, "response", {"ETag": "u"}, f"b{k}", "s") for k in range(100)] + [(2000 + k, f"http://b.com/{k}", 2, "revisit", {"etag": "u"}, None, "s") for k in range(100)]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, body string, status string")
    got = {r.record_id: (r.response_id, r.status, r.body) for r in warc.resolve_revisits(df).collect()}
    assert got == {**{k: (0, "resolved", "body") for k in range(1, 300)}, **{2000 + k: (1000 + k, "resolved", f"b{k}") for k in range(100)}}



def test_revisits_against_all_earlier_responses(spark):
    """Random histories, repeated rows, equal ids and times, null and empty bodies; few and many of the responses are asked for."""
    r = random.Random(9)
    for asks in (40, 400):
        rows = []
        for k in range(300):
            u, at = r.choice("ppppqrstuvw"), r.randrange(60)
            rows.append((k, f"http://h.io/{u}", at, "response", r.choice([{"ETag": f"{u}{r.randrange(2)}"}, {"Last-Modified": "m"}, {}]), r.choice([None, "", f"b{k}"])))
        rows += [*rows[:50], *[(k, u, at, kind, {"ETag": "other"}, "z") for k, u, at, kind, _, _ in rows[50:80]]]
        rows += [(1000 + k, f"http://h.io/{u}", r.randrange(80), "revisit", r.choice([{"etag": f"W/{u}{r.randrange(2)}"}, {"last-modified": r.choice("mn")}, None]), None) for k, u in enumerate(r.choices("ppppqrstuvwx", k=asks))]
        want = {}
        for k, u, at, kind, asked, _ in rows:
            if kind != "revisit":
                continue
            earlier = [x for x in rows if x[3] == "response" and x[1] == u and (x[2], x[0]) < (at, k)]
            if not earlier:
                want[k] = (None, "orphan", None)
                continue
            last = max((x[2], x[0]) for x in earlier)
            digest = lambda b: "" if b is None else hashlib.md5(b.encode()).hexdigest()
            _, headers, body = min((digest(x[5]), sorted((a.lower(), b) for a, b in x[4].items()), x[5]) for x in earlier if (x[2], x[0]) == last)
            had, asked = dict(headers), asked or {}
            pairs = [(asked[n].removeprefix("W/"), had[n]) for n in ("etag", "last-modified") if n in asked and n in had]
            status = "unchecked" if not pairs else "resolved" if pairs[0][0] == pairs[0][1] else "mismatch"
            want[k] = (last[1], status, body if status == "resolved" else None)
        df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, body string")
        got = warc.resolve_revisits(df, 20).collect()
        assert len(got) == asks and {x.record_id: (x.response_id, x.status, x.body) for x in got} == want
        assert {s for _, s, _ in want.values()} == {"orphan", "unchecked", "resolved", "mismatch"}
