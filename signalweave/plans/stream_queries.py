"""Queries over streams with keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.plans.registry import query
from signalweave.storage import Scratch, table
from signalweave.streaming import lives, windows


@query("""WITH e AS (SELECT user_id::VARCHAR AS topic, ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY topic ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY topic ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
l AS (SELECT *, max(ts) OVER (PARTITION BY topic, k) AS latest FROM s)
SELECT topic, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(latest), '%Y-%m-%d %H:%M:%S') AS latest, count(*) AS works, round(sum(pow(0.5, (epoch_us(latest) // 1000 - epoch_us(ts) // 1000)::DOUBLE / 86400000 / 3)), 6) AS popularity,
  max(latest) + INTERVAL 2 DAY > (SELECT max(ts) - INTERVAL 6 HOUR FROM events) AS alive FROM l GROUP BY topic, k""")
def topic_lives(spark, folder):
    """Lives of users as topics: they arrive in four steps, the stream is stopped and started again half way, and the last numbers of each life are told."""
    scratch = Scratch(spark, "lives")
    e = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    part = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * 4 / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1))
    for k in range(4):
        e.where(part == k).write.mode("append").parquet(f"{scratch.path}/events")
        if k % 2:
            stream = spark.readStream.schema(e.schema).parquet(f"{scratch.path}/events")
            told = lives.topic_lives(stream, "ts", "user_id", "6 hours", 3.0, 2)
            write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{scratch.path}/told/batch={n}")
            told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{scratch.path}/state").trigger(availableNow=True).start().awaitTermination()
    t = lives.last_told(spark.read.schema(lives.LIVES).parquet(f"{scratch.path}/told"))
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return t.select("topic", when("started"), when("latest"), "works", F.round("popularity", 6).alias("popularity"), "alive")


@query("""WITH e AS (SELECT *, event_id % 2 = 0 AS early, date_trunc('day', ts) + INTERVAL 1 DAY AS ends FROM events), w AS (SELECT max(ts) FILTER (early) - INTERVAL 2 DAY AS one, max(ts) - INTERVAL 2 DAY AS two FROM e)
SELECT event_type, strftime(ends - INTERVAL 1 DAY, '%Y-%m-%d') AS day, count(*) FILTER (early OR ends > one) AS works FROM e, w WHERE ends <= two GROUP BY event_type, ends HAVING count(*) FILTER (early OR ends > one) > 0""")
def late_rows(spark, folder):
    """Half of the rows come after the watermark has passed most of their days: closed windows stay as they were told, once."""
    scratch = Scratch(spark, "late")
    e = table(spark, folder, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{scratch.path}/events")
        counts = windows.windowed_counts(spark.readStream.schema(e.schema).parquet(f"{scratch.path}/events"), "ts", "event_type", "1 day", "2 days")
        run = counts.writeStream.format("parquet").option("path", f"{scratch.path}/told").option("checkpointLocation", f"{scratch.path}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    t = spark.read.schema(counts.schema).parquet(f"{scratch.path}/told")
    return t.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "works")
