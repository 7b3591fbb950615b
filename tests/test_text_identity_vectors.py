"""Text, identity, graph and vector operators on fixtures."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.functions import text, vectors as fv
from signalweave.operators import identity, phrases, vectors
from signalweave.operators.components import components, components_bounded
from signalweave.storage import Scratch


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_keys(spark):
    x = F.col("x")
    assert one(spark, text.title_key(x), "  Ｆull—Width:  Ünïted_ States ") == "full width ünïted states".replace("ü", "ü")
    assert one(spark, text.author_key(x), "Ada  Mary LOVELACE") == "lovelace a" and one(spark, text.author_key(x), "Plato") == "plato"
    assert one(spark, text.clean_doi(x), " https://doi.org/10.1/AbC ") == "10.1/abc" and one(spark, text.clean_doi(x), "  ") is None
    assert one(spark, text.bare_arxiv_id(x), "arXiv:2401.01234v3") == "2401.01234" and one(spark, text.bare_arxiv_id(x), "http://arxiv.org/abs/hep-th/9901001v1") == "hep-th/9901001"
    assert one(spark, text.plural_key(x), "neural Batteries") == "neural battery" and one(spark, text.plural_key(x), "time series") == "time series" and one(spark, text.plural_key(x), "glasses") == "glass"
    assert one(spark, text.inflection_key(x), "sensors of cities bus") == "sensor of city bus"
    assert one(spark, text.inverted_abstract(x), {"b": [1, 3], "a": [0, 2]}, "map<string,array<int>>") == "a b a b"
    assert one(spark, text.url_host(x), "https://www.Example.com/a") == "example.com" and one(spark, text.url_host(x), "http://u:p@x.com/") is None
    assert one(spark, text.trigrams(x), "abcab") == ["abc", "bca", "cab"] and one(spark, text.trigrams(x), "ab") == []
    assert len(one(spark, text.source_view(x), "a \\n b")) == len("a \\n b")


def test_phrases_match_whole_words_in_one_field(spark):
    t = spark.createDataFrame([(1, "Graph  Neural\nnetworks", "x"), (2, "graphs", "neural networks"), (3, "graph", "neural networks"), (4, "graph-neural networks!", "survey"), (5, None, None)], "id int, title string, abstract string")
    f = [F.col("title"), F.col("abstract")]
    got = lambda c: {r.id for r in t.where(c).collect()}
    assert got(text.plan_matches(f, ["graph neural networks"])) == {1}
    assert got(text.plan_matches(f, ["graph neural networks"], orthographic=True)) == {1, 4}
    assert got(text.plan_matches(f, ["neural networks"], ["survey"])) == {1, 2, 3}
    assert got(text.concept_matches(f, ["missing"], [["graph"], ["neural networks"]])) == {1, 3, 4}
    hits = {r.id: [len(g.hits) for g in r.h] for r in t.select("id", text.group_hits({"t": f[0], "a": f[1]}, {"g": ["graph"], "n": ["neural"]}).alias("h")).collect()}
    assert hits == {1: [1, 1], 2: [0, 1], 3: [1, 1], 4: [1, 1], 5: [0, 0]}


def test_phrase_spans_recover_text(spark):
    t = "Deep Learning of sparse-data sets, fast 3 times"
    rows = phrases.phrase_spans(spark.createDataFrame([(1, t)], "id long, title string"), "id", ["title"], 2, 3).collect()
    assert {r.phrase for r in rows} == {"deep learning", "sparse-data sets"} and all(t[r.start : r.end].lower() == r.phrase for r in rows)
    got = spark.createDataFrame([("a b c",)], "x string").select(phrases.ngrams(F.split("x", " "), 1, 3).alias("y")).first().y
    assert got == ["a", "b", "c", "a b", "b c", "a b c"]


def test_doi_conflicts(spark):
    rows = [("d1", "t", ["x"], "1"), ("d1", "u", ["y"], "1"), ("d2", "t", ["x"], "1"), ("d2", "t", ["y"], "2"), ("d3", "t", ["x"], None), ("d3", "u", ["x", "y"], None), ("10.48550/arxiv.9", "t", ["x"], "8"), (None, "t", ["x"], "1")]
    got = {r.doi: tuple(r)[1:] for r in identity.doi_conflicts(spark.createDataFrame(rows, "doi string, title_key string, authors array<string>, arxiv_id string")).collect()}
    assert got == {"d1": (False, True, False), "d2": (True, False, False), "10.48550/arxiv.9": (False, False, True)}


def test_teams_and_families(spark):
    rows = [("t", 1, ["a", "b"], [7]), ("t", 2, ["c"], [7]), ("t", 3, ["a", "b", "z"], []), ("t", 4, ["a", "q", "r", "s"], []), ("u", 1, [], []), ("u", 2, ["a"], [])]
    got = {r.topic: r.teams for r in identity.teams(spark.createDataFrame(rows, "topic string, work long, authors array<string>, orgs array<long>"), "work", "authors", "orgs").collect()}
    assert got == {"t": 2, "u": None}
    works = [(1, "k", date(2020, 1, 1), "x", "a" * 99), (2, "k", date(2020, 6, 1), None, "a" * 98 + "b"), (3, "k", date(2024, 1, 1), "x", "a" * 99), (4, "k", date(2020, 2, 1), None, "zzz"), (5, "m", date(2020, 1, 1), "x", "a" * 99)]
    fam = {r.work: r.family for r in identity.version_families(spark.createDataFrame(works, "work long, title_key string, day date, doi string, abstract string")).collect()}
    assert fam == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("find", [components, components_bounded])
def test_components(spark, find):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges[:-1]:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in find(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in list(up)}


def test_vectors(spark):
    rows = [(i, i % 2, np.random.default_rng(i).normal(size=4).tolist()) for i in range(30)]
    t = spark.createDataFrame(rows, "id long, g int, v array<float>")
    x = np.array([r[2] for r in rows], np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {(r.id, r.rank): r.near_id for r in vectors.nearest(t, "id", "v", t, "id", "v", 2, True).collect()}
    s = u @ u.T - 9 * np.eye(30)
    assert all(near[i, 1] == s[i].argmax() for i in range(30))
    c = {r.g: r.coherence for r in vectors.coherence(t, ["g"], "v").collect()}
    for g in (0, 1):
        part = (u @ u.T)[g::2, g::2]
        assert c[g] == pytest.approx(part[np.triu_indices(15, 1)].mean())
    assert spark.createDataFrame([([1.0, 0.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([1.0],)], "v array<float>").select(fv.valid(F.col("v"), 2).alias("k")).collect() == [(True,), (False,), (False,), (False,)]


def test_anchor_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, np.random.default_rng(i).normal(size=3).tolist()) for i in range(40)]
    t = spark.createDataFrame(rows, "id long, v array<double>")
    want = sorted(map(tuple, vectors.nearest(t, "id", "v", t, "id", "v", 3, True).collect()))
    monkeypatch.setattr(vectors, "ANCHORS", 25)
    assert sorted(map(tuple, vectors.nearest(t, "id", "v", t, "id", "v", 3, True).collect())) == want


def test_density_clusters(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.99, 0.1]), (0, 3, [-1.0, 0.0]), (0, 4, [-1.0, 0.05]), (0, 5, [0.0, -1.0]), (1, 6, [1.0, 0.0])]
    got = {r.id: r.cluster for r in vectors.density_clusters(spark.createDataFrame(rows, "w int, id long, v array<double>"), ["w"], "id", "v", 0.9, 2).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: -1, 6: -1}


def test_temporal_neighbours_never_look_ahead(spark):
    rows = [(i, i // 2 * 10, np.random.default_rng(i).normal(size=3).tolist()) for i in range(40)]
    got = vectors.temporal_neighbours(spark.createDataFrame(rows, "id long, d int, v array<double>"), "id", "d", "v", 3, 35, 35).collect()
    x = np.array([r[2] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(40):
        ok = [j for j in range(40) if (rows[j][1], j) < (rows[i][1], i) and rows[i][1] - rows[j][1] <= 35]
        want = sorted(ok, key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:3]
        assert [r.near for r in sorted((r for r in got if r.id == i), key=lambda r: r.rank)] == want


def test_acronyms_labels_and_identity(spark):
    t = spark.createDataFrame([(1, "Graph neural networks (GNN)", "use of graph neural networks (GNN) and large models (LM)"), (2, "Gas (GNN)", "x"), (3, "deep nets (DN)", "dark night (DN)"), (4, None, "state of the art (SA)")], "id long, t string, a string")
    assert {(r.id, r.acronym): (r.long_form, r.definitions) for r in phrases.acronyms(t, "id", ["t", "a"]).collect()} == {(1, "GNN"): ("graph neural networks", 2), (1, "LM"): ("large models", 1), (4, "SA"): ("state of the art", 1)}
    terms = spark.createDataFrame([(1, "Robots", 9), (1, "soft robot", 5), (1, "gripper", 5), (2, "robots", 3)], "topic int, term string, n int")
    assert [tuple(r) for r in phrases.topic_labels(terms, "topic", "term", "n", ["robots"]).collect()] == [(1, "soft robot", 5)]
    r = spark.createDataFrame([("https://doi.org/10.48550/arXiv.2401.00001", ["http://arxiv.org/abs/2401.00002v1"]), (None, ["https://arxiv.org/pdf/2401.00003.pdf", "x"]), ("10.1/x", None)], "d string, l array<string>")
    assert [tuple(x.i) for x in r.select(identity.arxiv_identity(F.col("d"), F.col("l")).alias("i")).collect()] == [("2401.00001", ["2401.00002"], True), ("2401.00003", ["2401.00003"], False), (None, [], False)]


def test_status_and_admission(spark):
    from signalweave.operators.review import withdrawal_status
    from signalweave.sources.evidence import admitted

    t = spark.createDataFrame([("This paper has been withdrawn", None, None), (None, "ok", True), ("reply to a withdrawn paper", "x" * 300 + " is withdrawn", None)], "c string, s string, r boolean")
    assert [x.s for x in t.select(withdrawal_status(F.col("c"), F.col("s"), F.col("r")).alias("s")).collect()] == ["withdrawn", "retracted", "not_reported"]
    day, ok = date(2024, 1, 1), "https://x.org/a"
    rows = [(1, "Soft robots grip", ok, day, True, False), (2, "Grip: soft robot", ok, day, True, False), (3, "Soft robots", ok, None, True, False), (4, "Soft robots", ok, date(2030, 1, 1), True, False), (5, "Other", ok, day, True, False), (6, "Soft robots", "ftp://x", day, True, False), (7, "Soft robots", ok, day, False, False), (8, "Soft robots", ok, day, True, True)]
    items = spark.createDataFrame([(r[0], "market", *r[1:]) for r in rows], "item int, axis string, title string, url string, day date, fresh boolean, repeated boolean")
    got = {r.item: r.reason for r in admitted(items, F.array(F.lit("soft"), F.lit("robot")), "2025-01-01").collect()}
    assert got == {1: None, 2: "story_told_before", 3: "no_date", 4: "date_ahead", 5: "too_few_topic_words", 6: "no_safe_link", 7: "stale_answer", 8: "repeated_by_source"}


def test_lineage_stays_inside_the_frozen_set(spark):
    topics = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 9)] + [(None,)], "topic long")
    edges = spark.createDataFrame([(2, 5), (5, 1), (5, 1), (None, 3)], "left long, right long")
    assert {r.topic: r.family for r in identity.lineage_families(topics, edges).collect()} == {1: 1, 2: 1, 5: 1, 3: 3, 9: 9}
    with pytest.raises(ValueError, match="1 topics"):
        identity.lineage_families(topics, spark.createDataFrame([(1, 7)], "left long, right long"))
    assert identity.lineage_families(topics.limit(0), edges.limit(0)).count() == 0
