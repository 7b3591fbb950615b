"""Queries over greedy choices: independent phrases, display groups, diverse rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.operators import greedy
from signalweave.operators.ranking import numbered
from signalweave.plans.registry import query
from signalweave.storage import Scratch, table

_PHRASES = """SELECT unnest([p_name, lower(p_type), p_name || ' ' || lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'near ' || p_name || ' ' || p_brand]) AS phrase, p_partkey FROM part"""


def _phrases(spark, folder):
    p = table(spark, folder, "part")
    kind, words = F.lower("p_type"), F.split("p_name", " ")
    return p.select("p_partkey", F.explode(F.array("p_name", kind, F.concat_ws(" ", "p_name", kind), words[0], words[1], F.concat_ws(" ", F.lit("near"), "p_name", "p_brand"))).alias("phrase"))


@query(f"""WITH RECURSIVE s AS (SELECT phrase, count(*) AS support FROM ({_PHRASES}) GROUP BY phrase),
t AS (SELECT *, list_distinct(string_split(lower(phrase), ' ')) AS w, row_number() OVER (ORDER BY support DESC, lower(phrase), phrase) AS place FROM s),
r(place, chosen, took) AS (SELECT 0, [['blue', 'bolt']], true UNION ALL SELECT t.place::INTEGER, CASE WHEN ok THEN list_append(chosen, w) ELSE chosen END, ok
  FROM r JOIN t ON t.place = r.place + 1, LATERAL (SELECT len(list_filter(r.chosen, lambda c: list_has_all(c, t.w) OR list_has_all(t.w, c))) = 0 AS ok)),
n AS (SELECT place, sum(took::INTEGER) OVER (ORDER BY place) AS k, took FROM r WHERE place > 0)
SELECT phrase, support, n.place::BIGINT AS place, took AND k <= 25 AS selected, CASE WHEN NOT took THEN 'token_containment_suppressed' WHEN k <= 25 THEN 'selected_by_support' ELSE 'beyond_the_limit' END AS reason FROM n JOIN t ON t.place = n.place""")
def independent_terms(spark, folder):
    """Every phrase of part names with the decision on it: the 25 best supported that are independent of a query and of one another."""
    s = _phrases(spark, folder).groupBy("phrase").agg(F.count("*").alias("support"))
    return greedy.independent_terms(s, "blue bolt", 25)


@query(f"""WITH RECURSIVE m AS (SELECT phrase, list_sort(list(DISTINCT p_partkey)) AS m FROM (SELECT * FROM ({_PHRASES}) UNION ALL SELECT p_name || 's', p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'most ' || p_name, p_partkey FROM part WHERE p_partkey % 9 > 0) GROUP BY phrase),
k AS (SELECT *, row_number() OVER (ORDER BY len(m) DESC, phrase) AS rank, regexp_replace(phrase, 's$', '') AS inflection FROM m), l AS (SELECT *, min(rank) OVER (PARTITION BY inflection) AS lead FROM k),
d AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM l WHERE rank = lead),
r(n, reps, rank, hit) AS (SELECT 0::BIGINT, CAST([] AS STRUCT(rank BIGINT, m BIGINT[])[]), 0::BIGINT, CAST(NULL AS STRUCT(rank BIGINT, j DOUBLE))
  UNION ALL SELECT d.n, CASE WHEN h IS NULL THEN list_append(reps, {{'rank': d.rank, 'm': d.m}}) ELSE reps END, d.rank, h FROM r JOIN d ON d.n = r.n + 1, LATERAL (SELECT list_filter(list_transform(r.reps, lambda x: {{'rank': x.rank, 'j': len(list_intersect(x.m, d.m)) / len(list_distinct(list_concat(x.m, d.m)))}}), lambda y: y.j >= 0.8)[1] AS h)),
g AS (SELECT rank AS lead, coalesce(hit.rank, rank) AS "to", hit.j AS j FROM r WHERE n > 0)
SELECT l.phrase, p.phrase AS representative, CASE WHEN l.rank = g."to" THEN 'representative' WHEN l.rank = l.lead THEN 'title_cohort_overlap' ELSE 'lexical_inflection' END AS basis,
  CASE WHEN l.rank = g."to" THEN 1.0::DOUBLE WHEN l.rank = l.lead THEN round(j, 4) END AS jaccard FROM l JOIN g USING (lead) JOIN l p ON p.rank = g."to" """)
def display_groups(spark, folder):
    """All phrases of part names, with plurals and cohorts that lack a few parts, under the phrase that stands for them."""
    p = table(spark, folder, "part")
    more = p.where("p_partkey % 2 = 0").select("p_partkey", F.concat("p_name", F.lit("s")).alias("phrase")).unionByName(p.where("p_partkey % 9 > 0").select("p_partkey", F.concat(F.lit("most "), "p_name").alias("phrase")))
    m = _phrases(spark, folder).unionByName(more).groupBy("phrase").agg(F.collect_set("p_partkey").alias("members"))
    ranked = numbered(m, [F.size("members").desc(), F.col("phrase")], Scratch(spark, "phrases")).withColumnRenamed("number", "rank")
    return greedy.display_groups(ranked.withColumn("inflection", F.regexp_replace("phrase", "s$", "")))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS k, (vec_id * 37 % 101) / 100.0::DOUBLE AS s, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT k, s, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12)) AS v FROM e),
r(place, k, ks, vs) AS (SELECT 0, -1::BIGINT, CAST([] AS BIGINT[]), CAST([] AS DOUBLE[][])
  UNION ALL SELECT r.place + 1, b.k, list_append(r.ks, b.k), list_append(r.vs, b.v) FROM r, LATERAL (SELECT k, v FROM u WHERE NOT list_contains(r.ks, u.k)
    ORDER BY round(CASE WHEN r.place = 0 THEN u.s ELSE 0.7 * u.s - 0.3 * greatest(0, list_max(list_transform(r.vs, lambda w: list_inner_product(w, u.v)))) END, 12) DESC, k LIMIT 1) b WHERE r.place < 12)
SELECT k AS vec_id, place FROM r WHERE place > 0""")
def diverse_rows(spark, folder):
    """Twelve vectors of all, good and unlike one another."""
    e = table(spark, folder, "embeddings").withColumn("s", (F.col("vec_id") * 37 % 101) / 100.0)
    return greedy.diversify(e, "vec_id", "s", "embedding", 12)
