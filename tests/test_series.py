"""Series semantics on hand-made windows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from signalweave.operators import ranking, review, scoring, series

SERIES = "topic string, idx int, start date, end date, topic_works long, corpus_works long, complete boolean, coverage_comparable boolean"


def quarters(topic, works, totals, coverage=True, complete=None):
    out = []
    for i, (w, t) in enumerate(zip(works, totals)):
        y, q = 2020 + i // 4, i % 4
        out.append((topic, i, date(y, 3 * q + 1, 1), date(y + (q == 3), 3 * (q + 1) % 12 + 1, 1), w, t, True if complete is None else complete[i], coverage[i] if isinstance(coverage, list) else coverage))
    return out


def test_trend_needs_coverage_denominators_and_history(spark):
    rows = quarters("up", [1, 2, 3, 4], [100] * 4) + quarters("unknown", [1, 2, 3, 4], [100] * 4, None) + quarters("zero", [0, 0, 0, 0], [100, 100, 0, 100]) + quarters("short", [1, 2], [10, 10]) + quarters("flat", [2, 2, 2, 2], [100] * 4) + quarters("broken", [1, 2, 3, 4], [100] * 4, [True, False, None, True])
    got = {r.topic: r for r in series.share_trend(spark.createDataFrame(rows, SERIES), ["topic"]).collect()}
    assert got["up"].direction == "increasing" and got["up"].share_slope == pytest.approx(0.01) and got["up"].count_change == 3
    assert got["unknown"].coverage_comparable is None and got["broken"].coverage_comparable is False
    assert {k for k, r in got.items() if r.direction == "not_established" and r.share_slope is None} == {"unknown", "zero", "short", "broken"}
    assert got["flat"].direction == "flat_or_mixed"


def test_streaks_and_partial_window(spark):
    rows = quarters("a", [1, 0, 2, 3, 9], [10] * 5, True, [True] * 4 + [False]) + quarters("gap", [1, 1, 1], [5, 0, 5]) + quarters("none", [0, 0], [5, 5])
    got = {r.topic: (r.observed_streak, r.streak) for r in series.trailing_streaks(spark.createDataFrame(rows, SERIES), ["topic"]).collect()}
    assert got == {"a": (2, 2), "gap": (3, None), "none": (0, 0)}


def test_wilson_bounds(spark):
    t = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (1, 0), (1, None)], "n long, total long")
    low, high = series.wilson(F.col("n"), F.col("total"))
    got = [(r.l, r.h) for r in t.select(low.alias("l"), high.alias("h")).collect()]
    assert got[0][0] == pytest.approx(0) and got[1][1] == pytest.approx(1) and got[2] == (pytest.approx(0.10779, abs=1e-5), pytest.approx(0.60322, abs=1e-5)) and got[3] == got[4] == (None, None)


def test_decay_shapes(spark):
    rows = spark.createDataFrame(quarters("a", [0, 4, 0, 1], [9] * 4), SERIES)
    got = {s: [r.popularity for r in series.decayed_popularity(rows, ["topic"], "quarter", 91.0, s).orderBy("idx").collect()] for s in ("exponential", "gaussian", "none")}
    assert got["none"] == [4.0, 4.0, 5.0] and len(got["exponential"]) == 3
    days = [(date(2020, 8, 15) - date(2020, 5, 16)).days, (date(2020, 11, 15) - date(2020, 8, 15)).days]
    p = 4 * 0.5 ** (days[0] / 91)
    assert got["exponential"][1] == pytest.approx(p) and got["exponential"][2] == pytest.approx(p * 0.5 ** (days[1] / 91) + 1)
    assert got["gaussian"][1] == pytest.approx(4 * 0.5 ** ((days[0] / 91) ** 2))


def test_dense_windows_keep_zeros_and_the_cutoff(spark):
    rows = spark.createDataFrame([("a", date(2020, 1, 5)), ("a", date(2020, 7, 5)), ("b", date(2020, 4, 1)), ("a", date(2021, 1, 1)), ("c", None)], "topic string, day date")
    got = sorted((r.topic, r.idx, r.topic_works, r.corpus_works) for r in series.dense_counts(rows, "day", ["topic"], "quarter", F.lit("2021-01-01").cast("date")).collect())
    assert got == [("a", 0, 1, 1), ("a", 1, 0, 1), ("a", 2, 1, 1), ("b", 0, 0, 1), ("b", 1, 1, 1), ("b", 2, 0, 1)]


def test_stages(spark):
    rows = quarters("up", [1, 2, 3, 4], [1000] * 4) + quarters("big", [100, 200, 300, 400], [1000] * 4) + quarters("down", [4, 3, 2, 1], [1000] * 4) + quarters("few", [0, 0, 0, 1], [1000] * 4) + quarters("short", [1], [9]) + quarters("mixed", [2, 1, 2, 2], [1000] * 4)
    got = {r.topic: r.stage for r in series.descriptive_stage(spark.createDataFrame(rows, SERIES), ["topic"]).collect()}
    assert got == {"up": "publication_signal_candidate", "big": "widespread_topic", "down": "declining_activity", "few": "growth_watch", "short": "insufficient_history", "mixed": "stable_or_mixed"}


def test_percentiles_and_samples(spark):
    t = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, 5.0, None])], "id int, v double").withColumn("g", F.lit(1))
    got = {r.id: r.percentile for r in ranking.midrank_percentile(t, "v", ["g"]).collect()}
    assert got == {0: 10.0, 1: 40.0, 2: 40.0, 3: 70.0, 4: 90.0, 5: None}
    assert all(r.percentile is None for r in ranking.midrank_percentile(t.where("id < 4"), "v", ["g"]).collect())
    ids = spark.range(11).withColumn("g", F.lit(0))
    assert sorted(r.id for r in ranking.even_sample(ids, ["g"], ["id"], 5).collect()) == [0, 2, 5, 8, 10]
    assert [(r.id, r.landmark) for r in ranking.landmarks(ids, ["g"], ["id"]).orderBy("id").collect()] == [(0, "earliest"), (5, "middle"), (10, "latest")]
    mixed = ranking.interleave(spark.range(4), spark.range(10, 13), [F.col("id")])
    assert [r.id for r in mixed.orderBy("place").collect()] == [0, 1, 10, 2, 3, 11, 12]


def test_gates_have_three_values(spark):
    full = {g.column: (g.threshold + 1 if g.kind != "max" else 0) for g in scoring.GATES} | {"coverage_comparable": 1, "coherence_calibrated": 1} | dict.fromkeys([*scoring.WEIGHTS, *scoring.CONFIDENCE], 1.0)
    cases = {"forming": {}, "watch": {"coverage_comparable": None}, "candidate": {"doc_count": 1, "coverage_comparable": None}, "widespread": {"maturity_percentile": 90, "doc_count": 1}, "unsure": {"identity": None, "confirmation": None}, "blank": {"coherence": None}}
    names = sorted(full)
    rows = [(k, *[None if (v := (full | c)[n]) is None else float(v) for n in names]) for k, c in cases.items()]
    t = spark.createDataFrame(rows, "case string, " + ", ".join(f"{n} double" for n in names))
    got = {r.case: (r.status, r.emergence_score, r.evidence_confidence) for r in scoring.assess(t).collect()}
    assert got == {"forming": ("forming", 100.0, 100.0), "watch": ("watch", None, 100.0), "candidate": ("candidate", None, 100.0), "widespread": ("widespread", None, 100.0), "unsure": ("watch", None, 34.0), "blank": ("watch", None, 100.0)}


def test_kappa_and_threshold(spark):
    t = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (0, 1), (None, 1)], "a int, b int")
    r = review.cohen_kappa(t, "a", "b").first()
    assert (r["items"], r.observed, r.chance, r.kappa) == (4, 0.75, 0.5, 0.5)
    assert review.cohen_kappa(t.where("a = 1"), "a", "b").first().kappa is None
    v = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1), (None, 1)], "v double, y int")
    assert tuple(review.threshold_fit(v, "v", F.col("y") == 1).first()) == (2.5, 1.0, 0)
    assert review.threshold_fit(v, "v", F.col("y") == 1, minimum=3).collect() == []
