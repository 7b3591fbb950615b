"""Cursor pages: what ends a month, how often a page is asked for, and what a restarted stream reads."""

import json
from datetime import date

import pytest

from signalweave.sources import collectors

JANUARY = (date(2024, 1, 1), date(2024, 1, 31))


def page(ids, after, count, day="2024-01-05"):
    return json.dumps({"meta": {"count": count, "next_cursor": after}, "results": [{"id": f"https://s.example/W{i}", "title": f"t{i}", "publication_date": day, "doi": None} for i in ids]}).encode()


class Fake:
    """Answers by cursor: a body, or a list of (status, Retry-After, body) for its tries."""

    def __init__(self, answers):
        self.answers, self.asked = answers, []

    def get(self, month, cursor, attempt):
        self.asked.append((cursor, attempt))
        found = self.answers.get(cursor, [(404, None, b"")])
        found = [(200, None, found)] if isinstance(found, bytes) else found
        return found[min(attempt, len(found) - 1)]


@pytest.mark.parametrize(
    ("answers", "problem", "works"),
    [
        ({"*": page([1, 2], "b", 3), "b": page([3], None, 3)}, None, 3),
        ({"*": page([], None, 0)}, None, 0),
        ({"*": page([1], "*", 2)}, "cursor_repeated", 1),
        ({"*": page([1], "b", 2), "b": page([2], None, 3)}, "count_changed", 2),
        ({"*": page([1, 1], None, 2)}, "ids_repeated", 2),
        ({"*": page([1], "b", 2), "b": page([1], None, 2)}, "ids_repeated", 2),
        ({"*": page([1, 2], None, 1)}, "more_than_counted", 2),
        ({"*": page([], "b", 2)}, "empty_page_goes_on", 0),
        ({"*": page([1], None, 2)}, "fewer_than_counted", 1),
        ({"*": page([1], None, 1, "2024-02-01")}, "outside_month", 1),
        ({"*": page([1], "b", 2)}, "page_missing", 1),
        ({"*": page([1], "b", 9), "b": page([2], "c", 9), "c": page([3], "d", 9), "d": page([4], "e", 9)}, "page_limit", 3),
    ],
)
def test_what_ends_a_month(answers, problem, works):
    found = list(collectors.walk(Fake(answers), JANUARY, max_pages=3, sleep=None))
    assert sum(len(r) for _, r in found) == works
    assert found[-1][0]["problem"] == problem and found[-1][0]["complete"] == (problem is None)
    assert not any(r["complete"] for r, _ in found[:-1])


@pytest.mark.parametrize("body", [b"{", b'{"results": []}', b'{"meta": {"count": true, "next_cursor": null}, "results": []}', b'{"meta": {"count": 1, "next_cursor": ""}, "results": []}', b'{"meta": {"count": 1, "next_cursor": null}, "results": [{"id": "W1"}]}'])
def test_unknown_shapes(body):
    (record, results), = collectors.walk(Fake({"*": body}), JANUARY)
    assert record["problem"].startswith("unusable") and not results


def test_tries_and_waits():
    waits = []
    busy = (429, "4", b"")
    pages = Fake({"*": [busy, (429, "1e9", b""), (200, None, page([1], None, 1))]})
    (record, _), = collectors.walk(pages, JANUARY, sleep=waits.append)
    assert record["complete"] and record["attempts"] == 3 and waits == [4.0, collectors.LONGEST_WAIT]
    assert [collectors.wait_for(x, 0) for x in (None, "x", "-1", "nan", "inf", "2")] == [1.5] * 5 + [2.0]
    (record, _), = collectors.walk(Fake({"*": [busy]}), JANUARY, sleep=waits.append)
    assert "429" in record["problem"]
    asked = Fake({"*": [(500, None, b"")]})
    (record, _), = collectors.walk(asked, JANUARY, sleep=waits.append)
    assert "500" in record["problem"] and len(asked.asked) == 1


def test_months():
    assert collectors.months("2023-12-30", "2024-02-02") == [(date(2023, 12, 30), date(2023, 12, 31)), JANUARY, (date(2024, 2, 1), date(2024, 2, 2))]
    with pytest.raises(ValueError):
        collectors.months("2024-01-02", "2024-01-01")


def test_source(spark, tmp_path):
    """Months are partitions, a filter on them leaves pages unread, and a broken month is told by its audit."""
    rows = [("2024-01", "*", 0, 429, "0", ""), ("2024-01", "*", 1, 200, None, page([1, 2], "b", 3).decode()), ("2024-01", "b", 0, 200, None, page([3], None, 3).decode()), ("2024-02", "*", 0, 500, None, "")]
    spark.createDataFrame(rows, "month string, cursor string, attempt int, status int, retry_after string, body string").write.partitionBy("month").parquet(f"{tmp_path}/pages")
    collectors.register(spark)
    read = lambda **o: spark.read.format("collected_works").options(path=f"{tmp_path}/pages", since="2024-01-01", before="2024-04-01", **o).load()
    works = read()
    assert works.rdd.getNumPartitions() == 3
    assert sorted((r.month, r.page, r.place, r.id[-1]) for r in works.collect()) == [("2024-01", 1, 0, "1"), ("2024-01", 1, 1, "2"), ("2024-01", 2, 0, "3")]
    audit = {(r.month, r.page): (r.attempts, r.complete, (r.problem or "")[:12]) for r in read(audit="true").collect()}
    assert audit == {("2024-01", 1): (2, False, ""), ("2024-01", 2): (1, True, ""), ("2024-02", 1): (0, False, "unusable: 20"), ("2024-03", 1): (1, False, "page_missing")}
    assert works.where("month = '2024-03'").rdd.getNumPartitions() == 1


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    collectors.register(spark)
    schema = "month string, cursor string, attempt int, status int, retry_after string, body string"
    first = [("2024-01", "*", 0, 200, None, page([1, 2], "b", 5).decode()), ("2024-01", "b", 0, 200, None, page([3], "c", 5).decode())]
    then = [("2024-01", "c", 0, 429, "0", ""), ("2024-01", "c", 1, 200, None, page([4], "d", 5).decode()), ("2024-01", "d", 0, 200, None, page([5], None, 5).decode()), ("2024-02", "*", 0, 200, None, page([6], None, 1, "2024-02-03").decode())]
    for k, rows in enumerate((first, [], then)):
        spark.createDataFrame(rows, schema).write.mode("append").partitionBy("month").parquet(f"{tmp_path}/pages")
        stream = spark.readStream.format("collected_works").options(path=f"{tmp_path}/pages", since="2024-01-01", until="2024-02-28", pagesPerBatch="1").load()
        run = stream.select("id").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
        got = sorted(int(r.id[-1]) for r in spark.read.schema("id string").parquet(f"{tmp_path}/out").collect())
        assert got == [[1, 2, 3], [1, 2, 3], [1, 2, 3, 4, 5, 6]][k]
