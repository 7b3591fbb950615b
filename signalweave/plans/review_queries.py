"""Agreement, quality and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.operators import review
from signalweave.plans.registry import query
from signalweave.storage import table

ROWS_SQL = "t AS (SELECT l.doc_id, quality, toxic, n_chars, lang, source FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, folder):
    return table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")


@query(f"""WITH {ROWS_SQL}, c AS (SELECT lang, quality AS a, toxic AS b, count(*) AS n FROM t GROUP BY ALL), z AS (SELECT lang, sum(n) AS items, sum(n) FILTER (a = b) / sum(n) AS o FROM c GROUP BY lang),
x AS (SELECT lang, a AS v, sum(n) AS na FROM c GROUP BY ALL), y AS (SELECT lang, b AS v, sum(n) AS nb FROM c GROUP BY ALL), e AS (SELECT lang, sum(na * nb) AS s FROM x JOIN y USING (lang, v) GROUP BY lang)
SELECT lang, CAST(items AS BIGINT) AS items, round(coalesce(o, 0), 6) AS observed, round(coalesce(s, 0) / (items * items), 6) AS chance, CASE WHEN coalesce(s, 0) / (items * items) < 1 THEN round((coalesce(o, 0) - coalesce(s, 0) / (items * items)) / (1 - coalesce(s, 0) / (items * items)), 6) END AS kappa FROM z LEFT JOIN e USING (lang)""")
def cohen_kappa(spark, folder):
    t = review.cohen_kappa(labelled(spark, folder), "quality", "toxic", ["lang"])
    return t.select("lang", "items", F.round("observed", 6).alias("observed"), F.round("chance", 6).alias("chance"), F.round("kappa", 6).alias("kappa"))


@query(f"""WITH {ROWS_SQL}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (quality = 0 AND n_chars >= 500) AS fp, count(*) FILTER (quality = 1 AND n_chars < 500) AS fn, count(*) FILTER (quality = 0 AND n_chars < 500) AS tn FROM t GROUP BY lang)
SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c""")
def confusion_matrix(spark, folder):
    t = review.confusion(labelled(spark, folder), F.col("quality") == 1, F.col("n_chars") >= 500, ["lang"])
    return t.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "balanced_accuracy")])


@query(f"""WITH {ROWS_SQL}, v AS (SELECT DISTINCT CAST(n_chars AS DOUBLE) AS v FROM t), m AS (SELECT min(v) AS lo, max(v) AS hi, greatest(1e-12, (max(v) - min(v)) * 1e-9) AS eps FROM v),
th AS (SELECT lo - eps AS h FROM m UNION ALL SELECT hi + eps FROM m UNION ALL SELECT (v + nx) / 2 FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nx FROM v) WHERE nx IS NOT NULL),
s AS (SELECT h, count(*) FILTER (quality = 1 AND n_chars >= h) AS tp, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0 AND n_chars < h) AS tn, count(*) FILTER (quality = 0) AS n FROM th, t GROUP BY h)
SELECT round(h, 6) AS threshold, round((tp / p + tn / n) / 2, 6) AS balanced_accuracy, p - tp + n - tn AS errors FROM s ORDER BY round((tp / p + tn / n) / 2, 12) DESC, errors, abs(h) LIMIT 1""")
def threshold_fit(spark, folder):
    t = review.threshold_fit(labelled(spark, folder), "n_chars", F.col("quality") == 1)
    return t.select(F.round("threshold", 6).alias("threshold"), "balanced_accuracy", "errors")


@query(f"WITH {ROWS_SQL} SELECT lang, quality, toxic, count(*) AS n FROM t GROUP BY ALL")
def answer_matrix(spark, folder):
    return review.answer_matrix(labelled(spark, folder), "quality", "toxic", ["lang"])


@query(f"""WITH {ROWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k, row_number() OVER (PARTITION BY source ORDER BY quality DESC, n_chars DESC, doc_id) AS i FROM t)
SELECT source, CASE WHEN count(DISTINCT quality) > 1 THEN round(sum((pow(2, quality) - 1) / log2(k + 1)) FILTER (k <= 10) / sum((pow(2, quality) - 1) / log2(i + 1)) FILTER (i <= 10), 6) END AS ndcg FROM r GROUP BY source""")
def ndcg_at_10(spark, folder):
    from pyspark.sql import Window as W

    t = labelled(spark, folder).withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")))
    return review.ndcg(t, ["source"], "quality", "k", 10).select("source", F.round("ndcg", 6).alias("ndcg"))


@query(f"""WITH {ROWS_SQL} SELECT a.lang, a.quality AS higher, b.quality AS lower, count(*) FILTER (a.n_chars > b.n_chars) AS correct, count(*) FILTER (a.n_chars = b.n_chars) AS tied, count(*) AS pairs FROM t a JOIN t b ON a.lang = b.lang AND a.quality > b.quality GROUP BY ALL""")
def pair_order(spark, folder):
    return review.pair_order(labelled(spark, folder), ["lang"], "quality", "n_chars")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n, min(o_orderpriority) AS f FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n, min(o_orderpriority) AS f FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS shared, count(*) FILTER (b.n IS NULL) AS missing, count(*) FILTER (a.n IS NULL) AS added, count(*) FILTER (coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1) AS ambiguous, count(*) FILTER (a.n = 1 AND b.n = 1 AND a.f <> b.f) AS o_orderpriority_changed FROM a FULL JOIN b USING (k)""")
def generation_diff(spark, folder):
    o = table(spark, folder, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return review.generation_diff(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_custkey", ["o_orderpriority"])


@query("""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS abstract, doc_id % 5 = 0 AS imprecise, doc_id % 3 = 0 AS ha, doc_id % 2 = 0 AS ho, doc_id % 29 = 0 AS withdrawn, doc_id % 31 = 0 AS tc FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS nt, trim(regexp_replace(lower(coalesce(abstract, '')), '\\s+', ' ', 'g')) AS na FROM t),
m AS (SELECT *, list_filter(['the', 'und', 'que', 'tion'], lambda x: contains(nt, x)) AS mt, list_distinct(list_concat(list_filter(['the', 'und', 'que', 'tion'], lambda x: contains(nt, x)), list_filter(['the', 'und', 'que', 'tion'], lambda x: contains(na, x)))) AS ma FROM n),
q AS (SELECT *, CASE WHEN len(mt) > 0 THEN mt[1] ELSE list_filter(['the', 'und', 'que', 'tion'], lambda x: contains(na, x))[1] END AS f, CASE WHEN ha AND ho THEN 0.95 WHEN ha THEN 0.85 WHEN coalesce(abstract, '') <> '' THEN 0.62 ELSE 0.38 END - CASE WHEN imprecise THEN 0.12 ELSE 0 END AS s FROM m)
SELECT doc_id, CASE WHEN len(ma) = 0 THEN 'exclude' WHEN withdrawn OR tc THEN 'quarantine' ELSE 'include' END AS decision, CAST(len(ma) AS BIGINT) AS matched,
  CAST(CASE WHEN len(ma) > 0 THEN round(least(1, 0.55 + 0.15 * len(ma) + CASE WHEN contains(nt, f) THEN 0.15 ELSE 0 END), 2) ELSE 0 END AS DOUBLE) AS relevance, CAST(CASE WHEN len(ma) = 0 THEN 0.2 WHEN withdrawn OR tc THEN round(least(s, 0.25), 2) ELSE round(s, 2) END AS DOUBLE) AS source_quality FROM q""")
def quality_decision(spark, folder):
    from signalweave.functions.text import first_sentence

    title, abstract = first_sentence(F.col("text"))
    k = F.col("doc_id")
    no = F.lit(False)
    d = table(spark, folder, "documents").select("doc_id", title.alias("title"), abstract.alias("abstract"), F.lit(None).cast("date").alias("day"), (k % 5 == 0).alias("imprecise"), (k % 3 == 0).alias("has_arxiv"), (k % 2 == 0).alias("has_openalex"), (k % 29 == 0).alias("withdrawn"), (k % 31 == 0).alias("title_conflict"), no.alias("revised_after_cutoff"), no.alias("late_deposit"))
    t = review.quality_decision(d, ["the", "und", "que", "tion"])
    return t.select("doc_id", "decision", F.size("matched").cast("long").alias("matched"), F.round("relevance", 2).alias("relevance"), F.round("source_quality", 2).alias("source_quality"))


@query("""WITH p AS (SELECT doc_id, role, conv_id, turn FROM (SELECT conv_id AS doc_id, role, conv_id, turn FROM conversations)), a AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1), b AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT coalesce(a.n, 0) AS users, coalesce(b.n, 0) AS assistants, count(*) AS n FROM a FULL JOIN b USING (conv_id) GROUP BY ALL""")
def reviewer_pairs(spark, folder):
    """Two answer sets joined on their item."""
    c = table(spark, folder, "conversations")
    a = c.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("u"))
    b = c.where("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("v"))
    t = a.join(b, "conv_id", "full_outer")
    return t.groupBy(F.coalesce("u", F.lit(0)).alias("users"), F.coalesce("v", F.lit(0)).alias("assistants")).agg(F.count("*").alias("n"))
