"""Lives of topics: decay, death by timer or by a gap inside a batch, a new life afterwards, and a restart between batches."""

from datetime import datetime, timedelta

import pytest

from signalweave.streaming import lives

START = datetime(2024, 1, 1)
SCHEMA = "topic string, ts timestamp"


def days(topic, *at):
    return [(topic, START + timedelta(days=d)) for d in at]


def told(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        run = lives.topic_lives(stream, "ts", "topic", "1 day", 2.0, 3, keep_days=3).writeStream.outputMode("update").foreachBatch(write)
        run.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(lives.LIVES + ", batch int").parquet(f"{tmp_path}/out")
    return {(r.topic, (r.started - START).days): r for r in lives.last_told(changes).collect()}, changes


def test_lives(spark, tmp_path):
    got, changes = told(spark, tmp_path, [days("a", 0, 1, 1) + days("b", 0) + [("a", None)], days("a", 2) + days("b", 5) + days("c", 4) + days(None, 4), days("c", 9), days("a", 10)])
    a = got["a", 0]
    assert (a.works, a.alive, (a.latest - START).days, a.recent_days[-1] - a.recent_days[0]) == (4, False, 2, 2)
    assert a.popularity == pytest.approx(0.5**1 + 2 * 0.5**0.5 + 1)
    assert (got["a", 10].works, got["a", 10].alive, got["a", 10].popularity) == (1, True, 1.0)
    # A gap between rows ends a life as the timer does.
    assert not got["b", 0].alive and not got["b", 5].alive
    assert not got["c", 4].alive and got["c", 9].alive and not got[None, 4].alive
    assert changes.where("topic = 'a' and not alive").count() == 1


def test_batches_do_not_matter(spark, tmp_path):
    rows = days("a", 0, 1, 2, 8, 9) + days("b", 3, 4, 8.5) + days("z", 20)
    one, _ = told(spark, tmp_path / "one", [rows])
    two, _ = told(spark, tmp_path / "two", [sorted(rows, key=lambda r: r[1])[:4], sorted(rows, key=lambda r: r[1])[4:]])
    plain = lambda got: {k: (r.works, r.alive, round(r.popularity, 9), r.latest) for k, r in got.items()}
    assert plain(one) == plain(two) and len(one) == 5
