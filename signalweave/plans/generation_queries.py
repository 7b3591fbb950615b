"""Queries over generations of results, ordered exports and prepared cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.plans.registry import query
from signalweave.sources import generations, prepared
from signalweave.storage import Scratch, table


def _topics(spark, folder, labels: int):
    """Tables of a clustering run: topics, members and yearly counts of embeddings under a number of labels."""
    e = table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % labels).alias("topic"), (F.col("vec_id") % 7 + 2015).alias("year"))
    return {"topic": e.groupBy("topic").agg(F.count("*").alias("works")), "membership": e.select("topic", "vec_id"), "snapshot": e.groupBy("topic", "year").agg(F.count("*").alias("works"))}


@query("""WITH e AS (SELECT vec_id, vec_id % 11 AS topic, vec_id % 7 + 2015 AS year FROM embeddings)
SELECT 'topic' AS "table", topic, count(*) AS works, NULL::BIGINT AS year FROM e GROUP BY topic UNION ALL SELECT 'membership', topic, count(DISTINCT vec_id), NULL FROM e GROUP BY topic UNION ALL SELECT 'snapshot', topic, count(*), year FROM e GROUP BY topic, year""")
def published_generation(spark, folder):
    """Three tables of a run published as one generation over an older one, while a third run died before it was sealed."""
    store = generations.Generations(spark, f"{Scratch(spark, 'generations').path}/topics")
    store.publish(_topics(spark, folder, 5), "first")
    store.publish(_topics(spark, folder, 11), "second")
    _topics(spark, folder, 3)["topic"].write.parquet(f"{store.root}/generation-third-unsealed/topic")
    null = F.lit(None).cast("long").alias("year")
    one = store.read("topic", verify=True).select(F.lit("topic").alias("table"), "topic", "works", null)
    two = store.read("membership", verify=True).groupBy("topic").agg(F.count_distinct("vec_id").alias("works")).select(F.lit("membership").alias("table"), "topic", "works", null)
    three = store.read("snapshot", verify=True).select(F.lit("snapshot").alias("table"), "topic", "works", "year")
    return one.unionByName(two).unionByName(three)


@query("""WITH l AS (SELECT doc_id || chr(9) || coalesce(md5(text), '-') || chr(10) AS line, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents),
c AS (SELECT pos // 100 AS chunk, count(*) AS lines, sha256(string_agg(line, '' ORDER BY pos)) AS sha256 FROM l GROUP BY pos // 100),
u AS (SELECT chunk // 1000 AS up, sha256(string_agg(sha256, '' ORDER BY chunk)) AS h FROM c GROUP BY chunk // 1000)
SELECT chunk, lines, sha256, CASE WHEN (SELECT count(*) FROM c) = 1 THEN sha256 WHEN (SELECT count(*) FROM u) = 1 THEN (SELECT h FROM u) ELSE (SELECT sha256(string_agg(h, '' ORDER BY up)) FROM u) END AS seal FROM c""")
def sealed_export(spark, folder):
    """All documents, longest first, exported as ordered text with a hash of each hundred lines and one over all."""
    scratch = Scratch(spark, "sealed")
    rows = table(spark, folder, "documents").select("doc_id", "n_chars", F.coalesce(F.md5("text"), F.lit("-")).alias("md5"))
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), "md5")
    chunks = generations.ordered_export(rows, [F.col("n_chars").desc(), F.col("doc_id")], line, f"{scratch.path}/lines", per_chunk=100)
    return chunks.withColumn("seal", F.lit(generations.seal(chunks)))


BRANCHES = {"germanic": (["de material", "en material"], ["hidden source"]), "romance": (["fr material", "es material"], [])}


@query("""WITH w AS (SELECT doc_id AS work, 'Joint record ' || doc_id // 3 AS family, 'Notes on ' || lang || ' material' || CASE WHEN doc_id % 10 = 0 THEN ', hidden source' ELSE '' END AS abstract,
  CAST(DATE '2017-01-01' + CAST(doc_id * 31 % 2500 AS INTEGER) AS DATE) AS day, lang, CASE WHEN doc_id % 9 = 0 THEN 'erratum' ELSE 'article' END AS kind FROM documents),
h AS (SELECT * FROM w WHERE day >= DATE '2018-03-01' AND day < DATE '2022-07-01' AND kind <> 'erratum'),
f AS (SELECT family, min(day) AS family_earliest, count(*) AS variants FROM h GROUP BY family),
m AS (SELECT 'germanic' AS branch, * FROM h WHERE lang IN ('de', 'en') AND work % 10 <> 0 UNION ALL SELECT 'romance', * FROM h WHERE lang IN ('fr', 'es')),
v AS (SELECT branch, family, min(day) AS day, arg_min(work, (day, work)) AS work FROM m GROUP BY branch, family),
t AS (SELECT *, row_number() OVER (PARTITION BY branch, year(day) ORDER BY sha256('prepared' || chr(0) || work::VARCHAR), work) AS turn, count(*) OVER (PARTITION BY branch) AS matches FROM v JOIN f USING (family)),
p AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY turn, year(day) DESC) AS place FROM t)
SELECT branch, place, work, day::VARCHAR AS day, family_earliest::VARCHAR AS family_earliest, variants, turn, matches FROM p WHERE place <= 60""")
def prepared_cohort(spark, folder):
    """Two branches over a cohort that was prepared once, sealed and laid out by year."""
    store = generations.Generations(spark, f"{Scratch(spark, 'cohort').path}/cohort")
    t = table(spark, folder, "documents")
    works = t.select(
        F.col("doc_id").alias("work"), F.concat(F.lit("Joint record "), F.floor(F.col("doc_id") / 3).cast("string")).alias("title"), F.concat(F.lit("Notes on "), "lang", F.lit(" material"), F.when(F.col("doc_id") % 10 == 0, ", hidden source").otherwise("")).alias("abstract"),
        F.date_add(F.lit("2017-01-01").cast("date"), (F.col("doc_id") * 31 % 2500).cast("int")).alias("day"), F.when(F.col("doc_id") % 9 == 0, "erratum").otherwise("article").alias("kind"), F.array(F.lit("Ann Lee"), F.lit("Bo Ng")).alias("authors"),
    )
    prepared.prepare(store, works, "documents")
    got = prepared.prepared_search(store, BRANCHES, "2018-03-01", "2022-07-01", 60)
    return got.select("branch", F.col("place").cast("long").alias("place"), "work", F.col("day").cast("string").alias("day"), F.col("family_earliest").cast("string").alias("family_earliest"), "variants", F.col("turn").cast("long").alias("turn"), "matches")


@query("""WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS n FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS near, round(list_inner_product(a.n, b.n), 12) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near) AS rank FROM p)
SELECT vec_id, near, rank, round(s, 6) AS similarity FROM r WHERE rank <= 3""")
def vector_index(spark, folder):
    """Every vector's three candidate links, from the index that was published with the vectors."""
    store = generations.Generations(spark, f"{Scratch(spark, 'index').path}/vectors")
    generations.publish_vector_index(store, table(spark, folder, "embeddings"), "vec_id", "embedding", "catalogue")
    t = store.read("links", verify=True)
    return t.select("vec_id", "near", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))
