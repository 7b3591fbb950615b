"""Plans, index equivalence, caches, branches and compositions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from signalweave.operators import hybrid
from signalweave.plans import retrieval
from signalweave.plans.retrieval import Plan, branches, build_index, cached_or_full, search, select, thematic_cache

ROWS = [(1, "Graph neural networks", "survey of nets"), (2, "graph-neural  networks", "x"), (3, "Paragraph neural networks", None), (4, "Robots", "soft robot arms and graph neural networks"), (5, "graph", "neural networks"), (6, None, None)]


@pytest.fixture
def works(spark):
    return spark.createDataFrame([(*r, date(2020 + r[0] % 3, 1, r[0])) for r in ROWS], "id long, title string, abstract string, day date")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_plans(works):
    assert ids(select(works, Plan(("graph neural networks",)))) == [1, 4]
    assert ids(select(works, Plan(("graph neural networks",), orthographic=True))) == [1, 2, 4]
    assert ids(select(works, Plan(groups=(("robot", "robots"), ("graph",)), exclude=("survey",)))) == [4]
    assert Plan(("a b",), exclude=('c"',)).expression() == '("a b") NOT ("c")' and Plan(groups=(("x",), ("y", "z"))).expression() == '(("x") AND ("y" OR "z"))'
    for bad in ({}, {"include": (" ",)}, {"groups": ((),)}, {"include": ("a",), "exclude": tuple("abcdefghijk")}):
        with pytest.raises(ValueError):
            Plan(**bad)
    assert Plan(("graph neural networks",)).implied_by(["neural networks"]) and not Plan(("paragraphs",)).implied_by(["graph"]) and Plan(groups=(("soft robot",), ("x",))).implied_by(["robot"])


def test_index_and_cache_give_what_a_scan_gives(spark, works, tmp_path):
    build_index(works, "id", ["title", "abstract"], str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for plan in (Plan(("neural networks",)), Plan(("graph neural networks", "soft robot"), exclude=("survey",)), Plan(groups=(("graph",),)), Plan(("ab",))):
        assert ids(search(works, index, "id", plan)) == ids(select(works, plan))
    counts = {r.anchor: r.rows for r in thematic_cache(works, ["neural networks", "robots"], ["title", "abstract"], str(tmp_path / "cache")).collect()}
    assert counts == {"neural networks": 5, "robots": 1}
    cache = spark.read.parquet(str(tmp_path / "cache"))
    for plan in (Plan(("graph neural networks",)), Plan(("graph",))):
        assert ids(cached_or_full(works, cache, list(counts), plan)) == ids(select(works, plan))


def test_branches(works):
    plans = {"nets": Plan(("neural networks",)), "robots": Plan(("robots",))}
    got = branches(works, plans, "id", "day", 2).collect()
    assert len(got) == 3 and len({r.day.year for r in got if r.branch == "nets"}) == 2
    latest = branches(works, plans, "id", "day", 1, False).collect()
    assert {(r.branch, r.id) for r in latest} == {("nets", 5), ("robots", 4)}


def test_compositions(spark):
    found = spark.createDataFrame([("lexical", "a", [2, 1]), ("semantic", "b", [1, 2, 2]), ("lexical", "c", [3])], "channel string, label string, works array<long>")
    got = {tuple(r.labels): (r.channels, r["size"]) for r in hybrid.merge_compositions(found).collect()}
    assert got == {("a", "b"): (["lexical", "semantic"], 2), ("c",): (["lexical"], 1)}
    a = spark.createDataFrame([("x", [1, 2, 3, 4]), ("y", [9])], "candidate string, works array<long>")
    b = spark.createDataFrame([("p", [1, 2]), ("q", [1, 2, 3, 7, 8, 9])], "candidate string, works array<long>")
    assert [(r.a, r.b, r.shared, round(r.jaccard, 3), r["rank"]) for r in hybrid.overlap_join(a, b).orderBy("a", "rank").collect()] == [("x", "q", 3, 0.429, 1), ("x", "p", 2, 0.5, 2), ("y", "q", 1, 0.167, 1)]
    r = {x.target: (x.candidate, x.recall) for x in hybrid.best_recovery(a.withColumnRenamed("candidate", "target").unionAll(spark.createDataFrame([("z", [77])], "t string, w array<long>")), b).collect()}
    assert r == {"x": ("q", 0.75), "y": ("q", 1.0), "z": (None, None)}
    p = hybrid.portfolio(spark.createDataFrame([(0.1, None, True), (0.2, 0.3, None)], "s double, m double, c boolean"), F.col("s"), F.col("m"), F.col("c")).collect()
    assert [(x.x, x.y, x.missing) for x in p] == [(None, None, ["slope_unknown"]), (0.2, 0.3, ["coverage_not_comparable"])]
    t = hybrid.transitions(spark.createDataFrame([(1, "in"), (2, "out")], "k int, d string"), spark.createDataFrame([(1, "out"), (3, "in")], "k int, d string"), "k", "d")
    assert {(x.before, x.after, x.was_there, x.is_there, x.n) for x in t.collect()} == {("in", "out", True, True, 1), ("out", None, True, False, 1), (None, "in", False, True, 1)}


def test_compiled_plans_say_what_a_plan_says(spark):
    """The table form against the class, plan by plan."""
    many = [f"p{i}" for i in range(retrieval.MOST_PHRASES + 1)]
    rows = [
        (1, ["deep nets", "solar"], [["a", "b"], ["c"]], ["toy"], ["solar"]), (2, ["thin solar cells", "solar"], None, None, ["solar"]), (3, ["deep-nets"], [], [], ["nets", "x"]), (4, ["x (y)"], None, None, ["(y)"]),
        (5, None, None, ["x"], ["x"]), (6, [" "], None, None, []), (7, many, None, None, []), (8, ["a"], [["b", "c", "d", "e"]], None, []), (9, ["a"], [[]], None, []), (10, ["y" * 2100], None, None, []), (11, None, [["solar cell"], ["wind"]], None, ["solar"]), (12, ['say "so" \\ it'], None, None, ["so"]), (13, ["solarium"], None, None, ["solar"]),
    ]
    got = {r.plan: r for r in retrieval.compiled(spark.createDataFrame(rows, "plan int, include array<string>, groups array<array<string>>, exclude array<string>, anchors array<string>")).collect()}
    for k, include, groups, exclude, anchors in rows:
        try:
            plan = retrieval.Plan(tuple(include or ()), tuple(map(tuple, groups or ())), tuple(exclude or ()))
            want = (True, plan.indexable(), plan.expression(), plan.implied_by(anchors))
        except ValueError:
            want = (False, None, None, None)
        assert tuple(got[k])[1:] == want, k
