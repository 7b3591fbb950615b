"""Queries over collectors: works by month and cursor, what their audit says, and a stream that is restarted."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.plans.registry import query
from signalweave.sources import collectors
from signalweave.storage import Scratch, table

SINCE, BEFORE = "2022-01-01", "2023-07-15"
#: The months and days that documents are given, the same in SQL.
WORKS_SQL = f"""SELECT strftime(d, '%Y-%m') AS month, 'https://works.example/W' || doc_id AS id, md5(text) AS title_md5, CAST(d AS VARCHAR) AS publication_date, doc_id // 240 AS bucket
FROM (SELECT *, CAST(DATE '2022-01-01' + to_months(CAST(doc_id % 24 AS INTEGER)) + to_days(CAST(doc_id % 28 AS INTEGER)) AS DATE) AS d FROM documents) WHERE d < DATE '{BEFORE}'"""


def _works(spark, folder):
    day = F.date_add(F.add_months(F.lit(SINCE).cast("date"), (F.col("doc_id") % 24).cast("int")), (F.col("doc_id") % 28).cast("int"))
    t = table(spark, folder, "documents").select(F.concat(F.lit("https://works.example/W"), "doc_id").alias("id"), F.col("text").alias("title"), day.alias("publication_date"), F.lit(None).cast("string").alias("doi"), F.floor(F.col("doc_id") / 240).alias("bucket"))
    return t.where(F.col("publication_date") < F.lit(BEFORE).cast("date")).withColumn("month", F.date_format("publication_date", "yyyy-MM"))


def _collected(spark, path, **options):
    collectors.register(spark)
    return spark.read.format("collected_works").options(path=path, since=SINCE, before=BEFORE, **options).load()


@query(f"SELECT month, id, title_md5, publication_date FROM ({WORKS_SQL})")
def collected_works(spark, folder):
    """All works before a cutoff, read back through cursor pages of disjoint months; a third of the pages is first refused."""
    scratch = Scratch(spark, "collected")
    collectors.record_pages(_works(spark, folder), f"{scratch.path}/pages", busy_every=3)
    return _collected(spark, f"{scratch.path}/pages").select("month", "id", F.md5("title").alias("title_md5"), F.col("publication_date").cast("string").alias("publication_date"))


@query(f"""WITH p AS (SELECT month, bucket, count(*) AS n, row_number() OVER (PARTITION BY month ORDER BY bucket) AS k FROM ({WORKS_SQL}) GROUP BY month, bucket)
SELECT month, count(*) AS pages, sum(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS attempts, sum(n)::BIGINT AS records, sum(n)::BIGINT AS expected, true AS complete FROM p GROUP BY month""")
def collection_audit(spark, folder):
    """What each month's pages say of its completeness: requests, records, the service's own count."""
    scratch = Scratch(spark, "collected")
    collectors.record_pages(_works(spark, folder), f"{scratch.path}/pages", busy_every=3)
    t = _collected(spark, f"{scratch.path}/pages", audit="true")
    return t.groupBy("month").agg(F.count("*").alias("pages"), F.sum("attempts").alias("attempts"), F.sum("records").alias("records"), F.max("expected").alias("expected"), F.max("complete").alias("complete"))


@query(f"SELECT id, count(*) AS times FROM ({WORKS_SQL}) GROUP BY id")
def streamed_collection(spark, folder):
    """The same works as a stream: half of the pages exist at first, the rest when it is restarted from its offset; none is lost or doubled."""
    scratch = Scratch(spark, "streamed")
    collectors.record_pages(_works(spark, folder), f"{scratch.path}/all", busy_every=3)
    collectors.register(spark)
    # A page is known by its cursor: those of odd buckets appear later, so the others wait behind them.
    pages = spark.read.parquet(f"{scratch.path}/all")
    later = F.coalesce(F.regexp_extract("cursor", r"^c(\d+)$", 1).try_cast("int") % 2 == 1, F.lit(False))
    for part in (~later, later):
        pages.where(part).write.mode("append").partitionBy("month").parquet(f"{scratch.path}/pages")
        stream = spark.readStream.format("collected_works").options(path=f"{scratch.path}/pages", since=SINCE, before=BEFORE, pagesPerBatch="2").load()
        run = stream.select("id").writeStream.format("parquet").option("path", f"{scratch.path}/out").option("checkpointLocation", f"{scratch.path}/state").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    return spark.read.schema("id string").parquet(f"{scratch.path}/out").groupBy("id").agg(F.count("*").alias("times"))
