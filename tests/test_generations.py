"""Generations that appear whole, exports in order, and cohorts of which only some years are read."""

import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from signalweave.sources import generations, prepared


def test_a_killed_writer_leaves_the_old_generation(spark, tmp_path, monkeypatch):
    store = generations.Generations(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError):
        store.read("a")
    one = {"a": spark.range(5), "b": spark.createDataFrame([(1, None), (2, "x")], "k int, v string")}
    first = store.publish(one, "run1")
    assert store.current() == first and store.read("a", verify=True).count() == 5 and store.read("b", verify=True).count() == 2

    # Dies after one table, before the seal, and before the pointer moves.
    broken = spark.range(3).select(F.raise_error(F.lit("dead")).cast("long").alias("id"))
    with pytest.raises(Exception, match="dead"):
        store.publish({"a": spark.range(9), "z": broken}, "run2")
    with monkeypatch.context() as m:
        m.setattr(store, "switch", lambda name: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.publish({"a": spark.range(7), "b": one["b"]}, "run3")
    with pytest.raises(ValueError, match="more than 4"):
        store.publish({"a": spark.range(7)}, "run4", most_rows=4)
    assert store.current() == first and store.read("a").count() == 5
    assert store.clear_unfinished() == 2
    second = store.publish({"a": spark.range(8), "b": one["b"].limit(0)}, "run5")
    assert store.current() == second and store.read("a", verify=True).count() == 8 and store.read("b", verify=True).count() == 0
    assert store.read("a", name=first, verify=True).count() == 5
    with pytest.raises(ValueError, match="no table"):
        store.read("z")


def test_changed_tables_and_manifests_are_found(spark, tmp_path):
    store = generations.Generations(spark, f"file://{tmp_path}/store")
    name = store.publish({"a": spark.range(5)}, "run")
    spark.range(5, 6).write.mode("append").parquet(f"{store.root}/{name}/a")
    with pytest.raises(ValueError, match="not what its manifest says"):
        store.read("a", verify=True)
    held = json.loads((tmp_path / "store" / name / "manifest.json").read_text())
    held["body"]["tables"][0]["rows"] = 6
    store._write(f"{name}/manifest.json", json.dumps(held))
    with pytest.raises(ValueError, match="not the one that was sealed"):
        store.read("a")


def test_digest_is_blind_to_order_alone(spark):
    rows = [(1, "a", 1.5), (2, None, None), (2, None, None)]
    d = lambda r, s="k int, v string, x double": generations.content_digest(spark.createDataFrame(r, s))
    assert d(rows) == d(rows[::-1]) and d(rows)[0] == 3
    assert len({d(rows)[1], d(rows[:2])[1], d([])[1], d([(1, "a", 1.5), (2, "", None), (2, None, None)])[1], d(rows, "k int, w string, x double")[1]}) == 5


def test_export_in_order(spark, tmp_path):
    rows = spark.range(2500).select(F.col("id"), (F.col("id") * 7 % 11).alias("g"))
    chunks = generations.ordered_export(rows, [F.col("g").desc(), F.col("id")], F.concat_ws(",", "g", "id"), f"{tmp_path}/out", per_chunk=100)
    lines = [f"{i * 7 % 11},{i}" for i in sorted(range(2500), key=lambda i: (-(i * 7 % 11), i))]
    got = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert got == lines
    want = [hashlib.sha256("".join(f"{x}\n" for x in lines[k : k + 100]).encode()).hexdigest() for k in range(0, 2500, 100)]
    assert [r.sha256 for r in chunks.orderBy("chunk").collect()] == want
    assert generations.seal(chunks) == hashlib.sha256("".join(want).encode()).hexdigest()
    assert generations.seal(chunks.limit(0)) == hashlib.sha256(b"").hexdigest()


def test_only_the_period_is_read(spark, tmp_path):
    store = generations.Generations(spark, f"file://{tmp_path}/store")
    rows = [(y * 100 + k, f"A title {k % 3}" if k else None, "wanted words" if k % 2 else "other", date(y, 6, k + 1), "erratum" if k == 5 else None if k == 4 else "article", ["Ann Lee"]) for y in range(2015, 2023) for k in range(8)]
    works = spark.createDataFrame([*rows, rows[3], (None, "x", "wanted words", date(2018, 1, 1), "article", []), (9, "x", "wanted words", None, "article", [])], "work long, title string, abstract string, day date, kind string, authors array<string>")
    prepared.prepare(store, works, "r")
    assert store.read("works").count() == len(rows)
    plan = store.read("works").where("year >= 2017 and year <= 2019")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    got = prepared.prepared_search(store, {"b": (["wanted words"], [])}, "2017-06-02", "2019-06-08", 4).orderBy("place").collect()
    # Families of one title span the years; each is dated by its first version that matches inside the period.
    assert {(r.work, r.family_earliest, r.matches) for r in got} == {(201701, date(2017, 6, 2), 2), (201703, date(2017, 6, 4), 2)}
    files = prepared_files(spark, store)
    assert all(any(f"year={y}" in f for y in (2017, 2018, 2019)) for f in files) and len({f.split("year=")[1][:4] for f in files}) == 3
    with pytest.raises(ValueError):
        prepared.prepared_search(store, {"b": (["x"], [])}, "2019-01-01", "2018-01-01", 4)


def prepared_files(spark, store):
    held = store.read("works").where("year >= 2017 and year <= 2019")
    return [r.f for r in held.select(F.input_file_name().alias("f")).distinct().collect()]
