"""Readers, evidence parsers, sinks and streams."""

import json
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from signalweave.sources import evidence, publications
from signalweave.streaming import windows


def test_json_and_xml_readers(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps({"results": [{"id": "https://x.org/W1", "doi": "https://doi.org/10.48550/arXiv.2401.00001", "title": "A", "publication_date": "2024-01-02", "type": "article", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "N"}}]}, {"id": None, "title": "no"}]}))
    r = publications.openalex_works(publications.openalex_pages(spark, str(tmp_path / "page.json"))).collect()
    assert len(r) == 1 and (r[0].source_id, r[0].arxiv_id, r[0].abstract, r[0].day, r[0].authors) == ("W1", "2401.00001", "a b", date(2024, 1, 2), ["N"])
    entry = "<entry><id>http://x/abs/2401.1v1</id><title>T</title><summary>S</summary><published>2024-01-02T00:00:00Z</published><updated>2024-02-02T00:00:00Z</updated>{}<category term='cs.AI'/></entry>"
    (tmp_path / "a.xml").write_text("<feed>" + entry.format("<author><name>A</name></author>") + entry.format("<author><name>B</name></author><author><name>C</name></author>") + "</feed>")
    got = publications.atom_entries(spark, str(tmp_path / "a.xml")).collect()
    assert [(x.record, x.authors, x.categories) for x in got] == [("2401.1v1", ["A"], ["cs.AI"]), ("2401.1v1", ["B", "C"], ["cs.AI"])]
    rec = "<record><header><datestamp>2025-01-01</datestamp></header><metadata><arXiv><id>{}</id><created>{}</created><authors><author><keyname>K</keyname><forenames>F</forenames></author><author><keyname>L</keyname></author></authors><title>T</title><categories>{}</categories><abstract>S</abstract></arXiv></metadata></record>"
    (tmp_path / "o.xml").write_text("<r>" + rec.format("1", "2024-01-05", "cs.AI math.CO") + rec.format("2", "2023-01-05", "cs.AI") + rec.format("3", "2024-01-06", "stat.ML") + "</r>")
    got = publications.oai_records(spark, str(tmp_path / "o.xml"), "2024-01-01", "2024-12-31", ["cs.AI"]).collect()
    assert [(x.record, x.authors) for x in got] == [("1", ["F K", "L"])]


def test_snapshot_dates_history_and_meta(spark):
    t = spark.createDataFrame([("[v1] Mon, 2 Jan 2023 [v2] Tue, 3 Jan 2024", "AI (cs.AI); CO (math.CO)"), ("none", "x")], "history string, subjects string")
    got = publications.legacy_snapshot(t, "2023-01-02", "2023-12-31").collect()
    assert [(r.day, r.revised, r.subject_codes) for r in got] == [(date(2023, 1, 2), date(2024, 1, 3), ["cs.AI", "math.CO"])]
    v = spark.createDataFrame([([("v1", datetime(2020, 1, 1)), ("v2", datetime(2020, 1, 2))],), ([("v1", datetime(2020, 1, 3)), ("v2", datetime(2020, 1, 2))],), ([("v2", datetime(2020, 1, 1))],)], "v array<struct<version:string,created:timestamp>>")
    assert [r.k for r in v.select(publications.valid_history(F.col("v")).alias("k")).collect()] == [True, False, False]
    html = '<meta content="Ann" name="citation_author"><META NAME=\'citation_author\' CONTENT=\'Bo\'><meta name="citation_date" content="2024/01/02"><title>T</title>'
    r = publications.html_records(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").first()
    assert (r.title, r.authors, r.day, r.revised) == ("T", ["Ann", "Bo"], date(2024, 1, 2), None)


def test_sinks_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "content_sha256 string, n int")
    assert publications.append_new(spark, rows, path) == 2 and publications.append_new(spark, rows, path) == 0
    assert publications.append_new(spark, spark.createDataFrame([("c", 3)], rows.schema), path) == 1 and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        publications.append_new(spark, spark.createDataFrame([("a", 9)], rows.schema), path)
    with pytest.raises(ValueError):
        publications.check_inventory(spark.createDataFrame([("f", 1)], "name string, rows long"), {"f": 2})


def test_providers_differ(spark):
    def run(name, key, items, **more):
        p = evidence.PROVIDERS[name]
        return [r.key for r in evidence.parse(spark.createDataFrame([(json.dumps({key: items}),)], "payload string"), p, "2024-01-01", "2025-01-01", **more).collect()]

    studies = [{"nct_id": f"NCT{i:08d}", "title": "Solar cells", "first_posted": f"2024-0{i}-01"} for i in (1, 3, 2)] + [{"nct_id": "bad", "title": "solar cells", "first_posted": "2024-01-01"}, {"nct_id": "NCT00000009", "title": "other", "first_posted": "2024-01-01"}, {"nct_id": "NCT00000008", "title": "solar cells", "first_posted": "2023-01-01"}, {"nct_id": "NCT00000001", "title": "solar cells", "first_posted": "2024-09-01"}]
    assert run("clinical_trials", "studies", studies, query="solar cells") == ["NCT00000001", "NCT00000003", "NCT00000002"]
    osti = [{"osti_id": str(i), "title": "solar cells", "publication_date": f"2024-0{i}-01"} for i in (1, 3, 2)]
    assert run("osti", "records", osti, query="solar") == ["3", "2", "1"]
    with pytest.raises(PySparkException, match="outside the period"):
        run("nih_reporter", "results", [{"appl_id": "1", "project_title": "x", "project_start_date": "2020-01-01"}])


def test_streams(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 1)), ("a", datetime(2024, 1, 1, 2)), ("b", datetime(2024, 1, 2, 1)), ("a", datetime(2024, 1, 5)), ("a", datetime(2024, 3, 1))]
    spark.createDataFrame(rows, "topic string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("topic string, ts timestamp").parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    counts = windows.windowed_counts(source, "ts", "topic", "1 day", "1 hour")
    got = {(r.topic, r.start.date(), r.works) for r in drain(counts, "w")}
    assert {("a", date(2024, 1, 1), 2), ("b", date(2024, 1, 2), 1), ("a", date(2024, 1, 5), 1)} <= got
    assert {r.works for r in drain(windows.session_counts(source, "ts", "topic", "2 hours", "1 hour"), "s")} >= {1, 2}
    live = drain(windows.live_popularity(source, "ts", "topic", "1 hour", 10.0, 20), "p")
    a = max((r for r in live if r.topic == "a" and r.alive), key=lambda r: r.works)
    ages = [(datetime(2024, 3, 1) - t).total_seconds() / 86_400 for k, t in rows if k == "a"]
    assert a.works == 4 and a.popularity == pytest.approx(sum(0.5 ** (x / 10) for x in ages))
