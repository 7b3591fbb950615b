"""Queries on topics' evidence: star joins, coverage, availability, examples, calibration, and set checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.vectors import unit
from signalweave.operators import evidence, previews, ranking
from signalweave.plans.registry import query
from signalweave.storage import table


def _r6(c, out=None):
    return F.round(F.col(c), 6).alias(out or c)


@query("""SELECT d.source AS topic, d.doc_id AS work, d.lang AS win, d.n_chars, l.toxic, e.vec_id IS NOT NULL AS has_vector FROM documents d JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE l.quality = 1 AND d.lang <> 'fr'""")
def topic_star(spark, folder):
    docs = table(spark, folder, "documents")
    members = docs.select(F.concat("source", F.lit("/"), "lang").alias("topic"), F.col("source").alias("name"), F.col("doc_id").alias("work"), F.col("lang").alias("win"))
    topics = members.where("win <> 'fr'").select("topic").distinct()
    works = docs.select(F.col("doc_id").alias("work"), "n_chars")
    quality = table(spark, folder, "labels").select(F.col("doc_id").alias("work"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"), "toxic")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("work"), "embedding")
    t = evidence.star(members, topics, works, quality, vectors)
    return t.select(F.col("name").alias("topic"), "work", "win", "n_chars", "toxic", F.col("embedding").isNotNull().alias("has_vector"))


LINKS_SQL = "k AS (SELECT l_orderkey AS work, l_returnflag AS topic, nullif(l_suppkey % 7, 0) AS organisation, l_linenumber - 1 AS place, l_partkey % 50 AS author, l_discount >= 0.1 AS conflict FROM lineitem)"


def _links(spark, folder):
    org = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") % 7)
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_returnflag").alias("topic"), org.alias("organisation"), (F.col("l_linenumber") - 1).alias("position"), (F.col("l_partkey") % 50).alias("author"), (F.col("l_discount") >= 0.1).alias("conflict"))


@query(f"""WITH {LINKS_SQL} SELECT topic, author % 10 AS "group", CASE WHEN count(organisation) > 0 THEN count(DISTINCT organisation) END AS organisations, count(DISTINCT CASE WHEN place = 0 THEN author END) AS first_authors, count(organisation) AS links FROM k GROUP BY topic, author % 10""")
def organisation_counts(spark, folder):
    return evidence.organisation_counts(_links(spark, folder).withColumn("group", F.col("author") % 10), ["topic", "group"])


@query(f"""WITH {LINKS_SQL} SELECT work, array_to_string(list_sort(list(DISTINCT author)), ',') AS authors, coalesce(array_to_string(list_sort(list(DISTINCT organisation) FILTER (organisation IS NOT NULL)), ','), '') AS organisations, bool_or(coalesce(conflict, FALSE)) AS conflict FROM k GROUP BY work""")
def work_people(spark, folder):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return evidence.people(_links(spark, folder), "work").select("work", join("authors").alias("authors"), join("organisations").alias("organisations"), "conflict")


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND nullif(o.o_orderpriority, '5-LOW') IS NOT NULL)""")
def works_without_affiliation(spark, folder):
    """Anti join: works none of whose links names an organisation."""
    named = table(spark, folder, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(named, "c_custkey", "left_anti")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS model, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, model, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, model) AS r FROM c) WHERE r = 1""")
def most_frequent_model(spark, folder):
    return evidence.most_frequent(table(spark, folder, "orders").select("o_custkey", F.col("o_orderpriority").alias("model")), ["o_custkey"], "model")


@query("""WITH w AS (SELECT o_orderpriority AS topic, year(o_orderdate) AS idx, count(*) AS corpus_works, count(*) FILTER (o_custkey % 3 > 0) AS embedded_works FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY idx DESC) AS b FROM w WHERE idx < 2001)
SELECT topic, CASE WHEN count(*) = 4 AND count(nullif(corpus_works, 0)) = 4 THEN round(min(embedded_works / nullif(corpus_works, 0)), 6) END AS coverage FROM r WHERE b <= 4 GROUP BY topic""")
def embedding_coverage(spark, folder):
    w = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("topic"), F.year("o_orderdate").alias("idx")).agg(F.count("*").alias("corpus_works"), F.count_if(F.col("o_custkey") % 3 > 0).alias("embedded_works"))
    return evidence.embedding_coverage(w.withColumn("complete", F.col("idx") < 2001), ["topic"], 4).select("topic", _r6("coverage"))


PARENT_SQL = """m AS (SELECT CAST(x AS DATE) AS start FROM unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) t(x)),
o AS (SELECT o_orderstatus AS field, CAST(date_trunc('month', o_orderdate) AS DATE) AS start, o_orderpriority = '1-URGENT' AS hit FROM orders WHERE o_orderkey % 50 <> 0),
c AS (SELECT field, start, count(*) AS n, count(*) FILTER (hit) AS h FROM o GROUP BY ALL), g AS (SELECT f.field, m.start, coalesce(h, 0) AS phrase_works, coalesce(n, 0) AS parent_works FROM (SELECT DISTINCT o_orderstatus AS field FROM orders) f CROSS JOIN m LEFT JOIN c ON c.field = f.field AND c.start = m.start)"""


def _parent(spark, folder):
    day = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("date"))
    o = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("field"), day.alias("day"), (F.col("o_orderpriority") == "1-URGENT").alias("hit"))
    return evidence.parent_series(o, F.col("day"), F.col("hit"), "1996-01-01", "1999-01-01", ["field"])


@query(f"WITH {PARENT_SQL} SELECT field, CAST(start AS VARCHAR) AS start, phrase_works, parent_works, round(phrase_works / nullif(parent_works, 0), 6) AS share FROM g")
def parent_monthly_series(spark, folder):
    return _parent(spark, folder).select("field", F.col("start").cast("string").alias("start"), "phrase_works", "parent_works", _r6("share"))


@query(f"""WITH {PARENT_SQL}, i AS (SELECT *, phrase_works / nullif(parent_works, 0) AS share, row_number() OVER (PARTITION BY field ORDER BY start) AS i FROM g)
SELECT field, count(*) AS months, round(regr_slope(phrase_works, i), 6) AS count_slope, CASE WHEN count(share) = count(*) THEN round(regr_slope(share, i), 6) END AS share_slope FROM i GROUP BY field""")
def parent_slopes(spark, folder):
    return evidence.full_period_slopes(_parent(spark, folder), ["field"]).select("field", "months", _r6("count_slope"), _r6("share_slope"))


@query("""SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS month, count(*) AS parent_works, count(*) FILTER (o_orderpriority = '1-URGENT') AS phrase_works, count(*) FILTER (o_orderkey % 50 = 0) AS invalid FROM orders GROUP BY 1""")
def parent_index_audit(spark, folder):
    """Month counts from the text of dates, invalid rows counted and not dropped."""
    o = table(spark, folder, "orders").groupBy(F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month"))
    return o.agg(F.count("*").alias("parent_works"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("phrase_works"), F.count_if(F.col("o_orderkey") % 50 == 0).alias("invalid"))


@query("""SELECT coalesce(x.month, y.month) AS month, coalesce(x.n, 0) AS full_works, coalesce(y.n, 0) AS index_works, coalesce(x.n, 0) = coalesce(y.n, 0) AS equal FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderkey % 11 > 0 GROUP BY 1) x FULL JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderkey % 13 > 0 GROUP BY 1) y ON x.month = y.month""")
def denominator_comparison(spark, folder):
    """Month counts of two holdings of one corpus, side by side."""
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    o = table(spark, folder, "orders")
    x = o.where("o_orderkey % 11 > 0").groupBy(month).agg(F.count("*").alias("x"))
    y = o.where("o_orderkey % 13 > 0").groupBy(month).agg(F.count("*").alias("y"))
    t = x.join(y, "month", "full_outer").select("month", F.coalesce("x", F.lit(0)).alias("full_works"), F.coalesce("y", F.lit(0)).alias("index_works"))
    return t.withColumn("equal", F.col("full_works") == F.col("index_works"))


@query("""SELECT source, term, count(*) AS works FROM (SELECT source, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) = 4))) AS term FROM documents) GROUP BY ALL""")
def label_term_counts(spark, folder):
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) == 4))
    return table(spark, folder, "documents").select("source", F.explode(terms).alias("term")).groupBy("source", "term").agg(F.count("*").alias("works"))


@query("""WITH c AS (SELECT date_trunc('month', o_orderdate) AS m, o_custkey % 40 AS topic, count(*) AS n FROM orders GROUP BY ALL) SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS win, count(*) AS topics, count(*) FILTER (n >= 10) AS active, count(*) FILTER (n BETWEEN 1 AND 3) AS weak FROM c GROUP BY m""")
def window_topic_states(spark, folder):
    c = table(spark, folder, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("m"), (F.col("o_custkey") % 40).alias("topic")).agg(F.count("*").alias("n"))
    return c.groupBy("m").agg(F.count("*").alias("topics"), F.count_if(F.col("n") >= 10).alias("active"), F.count_if(F.col("n").between(1, 3)).alias("weak")).select(F.col("m").cast("string").alias("win"), "topics", "active", "weak")


@query("""SELECT count(*) AS records, count(DISTINCT doc_id) AS ids, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (text IS NULL OR text = '') AS without_text, count(*) FILTER (contains(lower(text), 'license')) AS phrase_rows,
count(*) FILTER (contains(lower(text), 'license') AND doc_id IN (SELECT doc_id FROM labels)) AS in_scope, count(*) FILTER (contains(lower(text), 'license') AND doc_id NOT IN (SELECT doc_id FROM labels)) AS out_of_scope FROM documents""")
def sample_audit(spark, folder):
    hit = F.contains(F.lower("text"), F.lit("license"))
    t = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", F.lit(True).alias("known")).distinct(), "doc_id", "left")
    return t.agg(F.count("*").alias("records"), F.count_distinct("doc_id").alias("ids"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("without_text"), F.count_if(hit).alias("phrase_rows"), F.count_if(hit & F.col("known").isNotNull()).alias("in_scope"), F.count_if(hit & F.col("known").isNull()).alias("out_of_scope"))


@query("""WITH y AS (SELECT o_custkey % 60 AS topic, CAST(date_trunc('year', o_orderdate) AS DATE) AS s, count(*) AS works FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' AND (o_custkey % 60 <> 7 OR year(o_orderdate) <> 1997) GROUP BY ALL),
z AS (SELECT *, CAST(s + INTERVAL 1 YEAR AS DATE) AS e, lag(CAST(s + INTERVAL 1 YEAR AS DATE)) OVER (PARTITION BY topic ORDER BY s) <> s AS gap FROM y),
a AS (SELECT topic, bool_or(coalesce(gap, FALSE)) AS bad, min(s) FILTER (s >= DATE '1998-01-01') = DATE '1998-01-01' AND max(e) FILTER (s >= DATE '1998-01-01') = DATE '2001-01-01' AND count(*) FILTER (s >= DATE '1998-01-01') = 3 AS full3, sum(works) FILTER (s >= DATE '1998-01-01') AS r, sum(works) AS n FROM z GROUP BY topic)
SELECT topic, NOT bad AND coalesce(full3, FALSE) AS covered, CASE WHEN NOT bad AND full3 THEN CAST(r AS BIGINT) END AS recent_works, CASE WHEN NOT bad AND full3 THEN CAST(n AS BIGINT) END AS eligible_works, CASE WHEN NOT bad AND full3 THEN round(100 * r / n, 2) END AS recent_share FROM a""")
def publication_profile(spark, folder):
    o = table(spark, folder, "orders").where("o_orderdate < timestamp '2001-01-01' and (o_custkey % 60 <> 7 or year(o_orderdate) <> 1997)")
    y = o.groupBy((F.col("o_custkey") % 60).alias("topic"), F.trunc(F.col("o_orderdate").cast("date"), "year").alias("start")).agg(F.count("*").alias("works"))
    points = y.withColumns({"end": F.add_months("start", 12), "complete": F.lit(True)})
    return evidence.recent_profile(points, ["topic"], "2001-07-15").select("topic", "covered", "recent_works", "eligible_works", "recent_share")


PAST_SQL = """e AS (SELECT vec_id, floor(vec_id / 100)::BIGINT AS yr, CASE WHEN vec_id % 4 = 0 THEN 'title_only' ELSE 'title_abstract' END AS source, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT yr, generate_subscripts(v, 1) AS d, unnest(v) AS y FROM e), ys AS (SELECT DISTINCT yr FROM e), p AS (SELECT ys.yr, x.d, avg(x.y) AS m FROM ys JOIN x ON x.yr < ys.yr GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT yr, list(m ORDER BY d) AS z FROM p GROUP BY yr),
t AS (SELECT e.yr, e.vec_id, e.source, 1 - list_inner_product(v, z) / ((sqrt(list_inner_product(v, v)) + 1e-12) * (sqrt(list_inner_product(z, z)) + 1e-12)) AS distance FROM e JOIN c USING (yr))"""


def _past(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 100).alias("yr"), F.when(F.col("vec_id") % 4 == 0, "title_only").otherwise("title_abstract").alias("source"), "embedding")
    return evidence.distance_to_past(e, "vec_id", "yr", "embedding")


@query(f"WITH {PAST_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY round(distance, 12) DESC, vec_id) AS place FROM t) SELECT yr, vec_id, source, place, round(distance, 6) AS distance FROM r WHERE place <= 3")
def farthest_from_past(spark, folder):
    rank = F.row_number().over(W.partitionBy("yr").orderBy(F.round("distance", 12).desc(), "vec_id"))
    return _past(spark, folder).withColumn("place", rank.cast("long")).where("place <= 3").select("yr", "vec_id", "source", "place", _r6("distance"))


@query(f"WITH {PAST_SQL}, m AS (SELECT source, count(*) AS works, avg(distance) AS mean FROM t GROUP BY source) SELECT source, works, round(mean, 6) AS mean, round(max(mean) FILTER (source = 'title_only') OVER () / max(mean) FILTER (source = 'title_abstract') OVER (), 6) AS ratio FROM m")
def completeness_artefact(spark, folder):
    m = _past(spark, folder).groupBy("source").agg(F.count("*").alias("works"), F.avg("distance").alias("mean"))
    both = m.agg(F.max(F.when(F.col("source") == "title_only", F.col("mean"))).alias("a"), F.max(F.when(F.col("source") == "title_abstract", F.col("mean"))).alias("b"))
    return m.crossJoin(F.broadcast(both)).select("source", "works", _r6("mean"), F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


@query("""SELECT o_orderkey, round(100 * cume_dist() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_totalprice), 6) AS percentile FROM orders""")
def empirical_cdf(spark, folder):
    by = W.partitionBy("o_orderpriority", F.year("o_orderdate")).orderBy("o_totalprice")
    return table(spark, folder, "orders").select("o_orderkey", F.round(100 * F.cume_dist().over(by), 6).alias("percentile"))


@query("""WITH w AS (SELECT doc_id AS work, source AS topic, doc_id % 5 AS win, doc_id % 97 AS day, round(coalesce(toxic, 0.5), 2) AS quality, n_chars > 900 AS has_abstract, CASE WHEN doc_id % 3 = 0 THEN 'anchor_present_in_title' ELSE 'anchor_not_shown_in_title' END AS m, CASE WHEN doc_id % 7 = 0 THEN 'review_or_synthesis' ELSE 'unclassified' END AS f FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY (m = 'anchor_present_in_title' AND f = 'unclassified') DESC, day, work) = 1 AS lead FROM w), p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY lead DESC, (f = 'unclassified') DESC, (m = 'anchor_present_in_title') DESC, (win = 4) DESC, quality DESC, has_abstract DESC, day DESC, work) AS place FROM l)
SELECT topic, work, place, CASE WHEN lead AND m = 'anchor_present_in_title' AND f = 'unclassified' THEN 'early_with_title_match' WHEN lead THEN 'earliest_in_sample' WHEN win = 4 THEN 'latest_window_example' ELSE 'sample_publication' END AS role FROM p WHERE place <= 5""")
def evidence_examples(spark, folder):
    d = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", "left")
    works = d.select(F.col("doc_id").alias("work"), F.col("source").alias("topic"), (F.col("doc_id") % 5).alias("window"), (F.col("doc_id") % 97).alias("day"), F.coalesce(F.col("toxic").cast("double"), F.lit(0.5)).alias("quality"), (F.col("n_chars") > 900).alias("has_abstract"), F.when(F.col("doc_id") % 3 == 0, "anchor_present_in_title").otherwise("anchor_not_shown_in_title").alias("match"), F.when(F.col("doc_id") % 7 == 0, "review_or_synthesis").otherwise("unclassified").alias("format_hint"), F.lit("unclassified").alias("context_hint"))
    return evidence.evidence_roles(works, "topic", F.lit(4), 5).select("topic", "work", F.col("place").cast("long"), "role")


@query("""WITH i AS (SELECT s_suppkey AS candidate, CASE s_suppkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'unknown' ELSE 'other' END AS state, s_nationkey % 3 AS failed, CASE WHEN s_suppkey % 6 > 0 THEN s_acctbal END AS score, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS scientific_rank FROM supplier)
SELECT candidate, state, row_number() OVER (ORDER BY CASE state WHEN 'supported' THEN 0 WHEN 'contradicted' THEN 2 ELSE 1 END, failed, coalesce(score, -1) DESC, scientific_rank, candidate) AS rank FROM i""")
def multisource_rerank(spark, folder):
    k = F.col("s_suppkey") % 4
    state = F.when(k == 0, "supported").when(k == 1, "contradicted").when(k == 2, "unknown").otherwise("other")
    i = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("candidate"), state.alias("state"), (F.col("s_nationkey") % 3).alias("failed"), F.when(F.col("s_suppkey") % 6 > 0, F.col("s_acctbal")).alias("score"), F.row_number().over(W.orderBy(F.col("s_acctbal").desc(), "s_suppkey")).alias("scientific_rank"))
    return evidence.multisource_rank(i, {"supported": 0, "unknown": 1, "contradicted": 2}).select("candidate", "state", F.col("rank").cast("long"))


@query("""WITH c AS (SELECT s_suppkey AS candidate, s_nationkey % 3 AS cohort, CASE WHEN s_suppkey % 5 > 0 THEN round(s_acctbal, 2) END AS v FROM supplier), n AS (SELECT *, count(v) OVER (PARTITION BY cohort) AS n FROM c),
p AS (SELECT *, CASE WHEN v IS NOT NULL AND n >= 5 THEN round_even(100 * ((SELECT count(*) FROM c y WHERE y.cohort = n.cohort AND y.v < n.v) + 0.5 * (SELECT count(*) FROM c y WHERE y.cohort = n.cohort AND y.v = n.v)) / n, 2) END AS pct FROM n)
SELECT candidate, cohort, pct AS percentile, CASE WHEN pct IS NOT NULL THEN 'available' WHEN v IS NULL THEN 'no_prior_topic_anchor' ELSE 'insufficient_peer_topics' END AS novelty_availability,
CASE WHEN pct IS NOT NULL THEN 'available' WHEN candidate % 4 < 2 THEN 'insufficient_full_windows' WHEN candidate % 3 = 0 THEN 'coverage_unknown' WHEN candidate % 3 = 1 THEN 'coverage_not_comparable' WHEN n < 5 THEN 'insufficient_peer_topics' ELSE 'unavailable' END AS momentum_availability FROM p""")
def composition_assessment(spark, folder):
    """Peers only within the same set of channels, with the reasons why a percentile is missing."""
    c = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("candidate"), (F.col("s_nationkey") % 3).alias("cohort"), F.when(F.col("s_suppkey") % 5 > 0, F.round("s_acctbal", 2)).alias("v"))
    p = ranking.midrank_percentile(c, "v", ["cohort"]).withColumn("peers", F.count("v").over(W.partitionBy("cohort")))
    k = F.col("candidate") % 3
    comparable = F.when(k == 0, F.lit(None).cast("boolean")).otherwise(k == 2)
    return p.select("candidate", "cohort", "percentile", evidence.novelty_availability(F.col("percentile"), F.col("v")).alias("novelty_availability"), evidence.momentum_availability(F.col("percentile"), F.col("candidate") % 4, F.lit(2), comparable, F.col("peers"), 5).alias("momentum_availability"))


@query("""WITH v AS (SELECT l_partkey AS package, l_orderkey || '.' || l_linenumber AS version, CAST(l_shipdate AS DATE) AS day FROM lineitem), w AS (SELECT *, day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AS inside FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY package, inside ORDER BY day DESC, version DESC) AS n FROM w)
SELECT package, count(*) AS versions, count(*) FILTER (day <= DATE '2000-06-30') AS versions_through_as_of, CAST(min(day) FILTER (day <= DATE '2000-06-30') AS VARCHAR) AS first_release, count(*) FILTER (inside) AS in_window, bool_or(day > DATE '2000-06-30') AS has_later, coalesce(string_agg(version, ' ' ORDER BY n) FILTER (inside AND n <= 3), '') AS listed, count(*) FILTER (inside) > 3 AS cap_reached FROM r GROUP BY package""")
def package_versions(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("package"), F.concat("l_orderkey", F.lit("."), "l_linenumber").alias("version"), F.col("l_shipdate").alias("published"))
    t = evidence.package_versions(rows, "1997-01-01", "1999-12-31", "2000-06-30", 3)
    return t.withColumns({"first_release": F.col("first_release").cast("string"), "listed": F.array_join("listed", " ")})


@query("""WITH o AS (SELECT l_returnflag AS topic, l_orderkey % 5000 AS publication, min((CAST(l_shipdate AS DATE), l_suppkey))[2] AS family, min(CAST(l_shipdate AS DATE)) AS day FROM lineitem WHERE l_orderkey % 9 > 0 GROUP BY ALL) SELECT topic, count(*) AS publications, count(DISTINCT family) AS families, CAST(min(day) AS VARCHAR) AS first_day FROM o GROUP BY topic""")
def patent_observations(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("topic"), F.when(F.col("l_orderkey") % 9 > 0, F.col("l_orderkey") % 5000).alias("publication"), F.col("l_suppkey").alias("family"), F.col("l_shipdate").cast("date").alias("day"))
    return evidence.patents(rows, ["topic"]).withColumn("first_day", F.col("first_day").cast("string"))


@query("""SELECT CASE WHEN grouping(c_mktsegment) = 0 THEN 'decision' ELSE 'role' END AS kind, coalesce(c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS value, count(*) AS sources FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey))""")
def registry_tallies(spark, folder):
    """Sources by decision and by role in one pass."""
    t = table(spark, folder, "customer").groupingSets([[F.col("c_mktsegment")], [F.col("c_nationkey")]], "c_mktsegment", "c_nationkey").agg(F.grouping("c_mktsegment").alias("g"), F.count("*").alias("sources"))
    return t.select(F.when(F.col("g") == 0, "decision").otherwise("role").alias("kind"), F.coalesce("c_mktsegment", F.col("c_nationkey").cast("string")).alias("value"), "sources")


@query("""SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS works, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def status_priority_cube(spark, folder):
    t = table(spark, folder, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("works"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return t.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "works", "mean")


@query("""WITH m AS (SELECT o_custkey AS topic, count(*) AS works, avg(o_totalprice) AS score FROM orders GROUP BY 1), g(name, least, floor) AS (VALUES ('strict', 20, 160000.0), ('default', 10, 150000.0), ('wide', 3, 100000.0)) SELECT g.name AS configuration, count(*) AS topics, count(*) FILTER (works >= least AND score >= floor) AS passed, count(*) FILTER (works < least) AS failed_works, count(*) FILTER (score < floor) AS failed_score FROM m CROSS JOIN g GROUP BY g.name""")
def gate_configurations(spark, folder):
    """One corpus under each named configuration of gates; the configurations are a constant of the plan."""
    m = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("works"), F.avg("o_totalprice").alias("score"))
    configurations = [("strict", 20, 160000.0), ("default", 10, 150000.0), ("wide", 3, 100000.0)]
    each = m.select("works", "score", F.explode(F.array(*[F.struct(F.lit(n).alias("configuration"), F.lit(w).alias("least"), F.lit(f).alias("floor")) for n, w, f in configurations])).alias("g")).select("works", "score", "g.*")
    return each.groupBy("configuration").agg(F.count("*").alias("topics"), F.count_if((F.col("works") >= F.col("least")) & (F.col("score") >= F.col("floor"))).alias("passed"), F.count_if(F.col("works") < F.col("least")).alias("failed_works"), F.count_if(F.col("score") < F.col("floor")).alias("failed_score"))


CAL_SQL = "t AS (SELECT p_brand, p_partkey, p_retailprice / 1000 AS v, p_size > 25 OR p_retailprice > 1500 AS positive, p_partkey % 4 = 0 AS held FROM part)"


def _cases(spark, folder):
    return table(spark, folder, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 1000).alias("v"), ((F.col("p_size") > 25) | (F.col("p_retailprice") > 1500)).alias("positive"), (F.col("p_partkey") % 4 == 0).alias("held"))


@query(f"""WITH {CAL_SQL}, a AS (SELECT p_brand, count(*) FILTER (NOT held AND positive) AS positives, count(*) FILTER (NOT held AND NOT positive) AS negatives, max(v) FILTER (NOT held AND NOT positive) AS hi, min(v) FILTER (NOT held AND positive) AS lo, count(*) FILTER (held) AS held FROM t GROUP BY p_brand)
SELECT p_brand, positives, negatives, held, CASE WHEN positives < 4 OR negatives < 4 THEN 'refused_insufficient_development_labels' WHEN lo - hi >= 0.01 THEN 'calibrated_on_preliminary_development_only' ELSE 'refused_non_separable_development_labels' END AS decision, CASE WHEN positives >= 4 AND negatives >= 4 AND lo - hi >= 0.01 THEN round((lo + hi) / 2, 6) END AS threshold FROM a""")
def coherence_calibration(spark, folder):
    return evidence.calibrated_coherence(_cases(spark, folder), ["p_brand"], "v", F.col("positive"), F.col("held")).select("p_brand", "positives", "negatives", "held", "decision", _r6("threshold"))


@query("""WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS k, round(avg(c_acctbal), 6) AS v, n_regionkey >= 2 AS pos FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), f AS (SELECT h.k AS held, t.* FROM t h JOIN t ON t.k <> h.k),
d AS (SELECT DISTINCT held, v FROM f), m AS (SELECT held, min(v) AS lo, max(v) AS hi, greatest(1e-12, (max(v) - min(v)) * 1e-9) AS eps FROM d GROUP BY held), th AS (SELECT held, lo - eps AS h FROM m UNION ALL SELECT held, hi + eps FROM m UNION ALL SELECT held, (v + nx) / 2 FROM (SELECT held, v, lead(v) OVER (PARTITION BY held ORDER BY v) AS nx FROM d) WHERE nx IS NOT NULL),
s AS (SELECT th.held, h, count(*) FILTER (pos AND v >= h) AS tp, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos AND v < h) AS tn, count(*) FILTER (NOT pos) AS n FROM th JOIN f ON f.held = th.held GROUP BY th.held, h),
b AS (SELECT held, h FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY round((tp / p + tn / n) / 2, 12) DESC, p - tp + n - tn, abs(h), h DESC) AS r FROM s WHERE p > 0 AND n > 0) WHERE r = 1)
SELECT t.k, t.pos AS target, round(b.h, 6) AS threshold, t.v >= b.h AS predicted FROM t LEFT JOIN b ON b.held = t.k""")
def leave_one_out(spark, folder):
    """Each labelled case, a nation, judged by the threshold of all others."""
    n = table(spark, folder, "nation").join(table(spark, folder, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    t = n.groupBy(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_regionkey") >= 2).alias("pos")).agg(F.round(F.avg("c_acctbal"), 6).alias("v"))
    return evidence.leave_one_out(t, "k", "v", F.col("pos")).select("k", "target", _r6("threshold"), "predicted")


@query("""WITH s AS (SELECT doc_id AS work, split_part(text, chr(10), 1) AS title, text AS abstract, 'm' || (doc_id % 2) AS model FROM documents), k AS (SELECT s.work, title, abstract, model FROM s JOIN embeddings e ON e.vec_id = s.work WHERE s.work % 10 <> 3)
SELECT p.work, min(k.work) AS from_work FROM s p JOIN k ON k.title IS NOT DISTINCT FROM p.title AND k.abstract IS NOT DISTINCT FROM p.abstract AND k.model = p.model GROUP BY p.work""")
def vector_reuse(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("work"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"), F.concat(F.lit("m"), F.col("doc_id") % 2).alias("model"))
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("work"), F.col("embedding").alias("vector"))
    size = F.length(F.concat_ws("\n", "title", F.coalesce("abstract", F.lit(""))))
    # Wrong lengths of stored texts are never reused.
    stored = d.join(e, "work").withColumns({"dim": F.size("vector"), "char_count": F.when(F.col("work") % 10 == 3, size + 1).otherwise(size)})
    return evidence.reused_vectors(d, stored).select("work", "from_work")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12)) AS n FROM e),
f AS (SELECT label, min(vec_id) AS work, generate_subscripts(any_value(n), 1) AS d FROM u WHERE label < 5 GROUP BY label), x AS (SELECT label, vec_id, generate_subscripts(n, 1) AS d, unnest(n) AS y FROM u WHERE label < 5),
m AS (SELECT label, d, avg(y) AS m FROM x GROUP BY label, d), c AS (SELECT label, list(m ORDER BY d) AS z FROM m GROUP BY label)
SELECT f.work, round(z[1] / (sqrt(list_inner_product(z, z)) + 1e-12), 6) AS first FROM (SELECT label, min(work) AS work FROM f GROUP BY label) f JOIN c USING (label) UNION ALL SELECT vec_id, round(v[1], 6) FROM e WHERE label >= 5""")
def family_collapse(spark, folder):
    e = table(spark, folder, "embeddings")
    v = e.select(F.col("vec_id").alias("work"), F.col("embedding").cast("array<double>").alias("vector"))
    families = e.where("label < 5").select(F.col("vec_id").alias("work"), F.col("label").alias("family"))
    return evidence.family_collapse(v, families).select("work", F.round(F.col("vector")[0], 6).alias("first"))


@query("""WITH r AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part), n(needle, w) AS (SELECT p_name, list_distinct(string_split(lower(p_name), ' ')) FROM (SELECT DISTINCT p_name FROM part))
SELECT p_partkey, string_agg(needle, '|' ORDER BY needle) AS matched FROM r JOIN n ON list_has_all(t, w) WHERE NOT list_has_all(t, ['small', 'brass']) GROUP BY p_partkey""")
def token_subset(spark, folder):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    p = table(spark, folder, "part")
    needles = p.select(F.col("p_name").alias("needle")).distinct().withColumn("words", words(F.col("needle")))
    t = evidence.token_subset(p.select("p_partkey", words(F.concat_ws(" ", "p_name", "p_type")).alias("t")), needles, [["small", "brass"]], "t")
    return t.select("p_partkey", F.array_join("matched", "|").alias("matched"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderkey % 3 = 0 AS teams, o_totalprice > 150000 AS price FROM orders), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS status, o_orderkey % 4 = 0 AS teams, o_totalprice > 180000 AS price FROM orders),
x AS (SELECT 'status' AS field, b.status AS before, a.status AS after FROM b JOIN a USING (k) UNION ALL SELECT 'teams', CAST(b.teams AS VARCHAR), CAST(a.teams AS VARCHAR) FROM b JOIN a USING (k) UNION ALL SELECT 'price', CAST(b.price AS VARCHAR), CAST(a.price AS VARCHAR) FROM b JOIN a USING (k))
SELECT field, before, after, count(*) AS changes FROM x WHERE before IS DISTINCT FROM after GROUP BY ALL""")
def assessment_changes(spark, folder):
    o = table(spark, folder, "orders")
    before = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3 == 0).alias("teams"), (F.col("o_totalprice") > 150000).alias("price"))
    after = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_orderkey") % 4 == 0).alias("teams"), (F.col("o_totalprice") > 180000).alias("price"))
    return evidence.gate_changes(before, after, "k", ["status", "teams", "price"])


@query("""SELECT o_orderkey AS work, n_name AS venue, r_name AS kind FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 LEFT JOIN region ON r_regionkey = n_regionkey""")
def venue_enrichment(spark, folder):
    """Saved works with venue facts where there are any; venue tables are small and broadcast under Spark's limit."""
    saved = table(spark, folder, "orders").select(F.col("o_orderkey").alias("work"), F.col("o_custkey").alias("c_custkey")).join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    venues = table(spark, folder, "nation").where("n_regionkey < 3").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return saved.join(venues, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("work", F.col("n_name").alias("venue"), F.col("r_name").alias("kind"))


@query("""SELECT o_orderkey AS work, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS authors, array_to_string(list_sort(list(DISTINCT s_nationkey)), ',') AS organisations FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey""")
def external_identity(spark, folder):
    """Target works with the authors and organisations that an external index gives for them."""
    works = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    links = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return works.join(links, "l_orderkey").groupBy(F.col("l_orderkey").alias("work")).agg(joined("l_suppkey").alias("authors"), joined("s_nationkey").alias("organisations"))


@query("SELECT doc_id, lang FROM documents WHERE n_chars > 500")
def allowed_pack(spark, folder):
    """Current members, proved to lie in the background pack."""
    d = table(spark, folder, "documents")
    return evidence.require_subset(d.where("n_chars > 500").select("doc_id", "lang"), d.where("n_chars > 100"), "doc_id")


@query("""SELECT doc_id AS parent, doc_id + 1 AS child FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 2 = 0""")
def version_link_union(spark, folder):
    d = table(spark, folder, "documents")
    link = lambda n: d.where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("parent"), (F.col("doc_id") + 1).alias("child"))
    return link(3).union(link(2)).distinct()


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both_sides, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_first, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_second, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) = 0 AS subset""")
def membership_proofs(spark, folder):
    """Intersection and differences of two memberships in one pass over their union."""
    o = table(spark, folder, "orders")
    per = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"))
    t = per.agg(F.count_if(F.col("a") & F.col("b")).alias("both_sides"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(F.col("b") & ~F.col("a")).alias("only_second"))
    return t.withColumn("subset", F.col("only_first") == 0)


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS n FROM embeddings), p AS (SELECT q.vec_id, a.vec_id AS near, round(list_inner_product(q.n, a.n), 12) AS s FROM u q JOIN u a ON a.label = (q.label + 1) % 10 AND q.vec_id % 100 = 0)
SELECT vec_id, near, CAST(r AS BIGINT) AS rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near) AS r FROM p) WHERE r <= 3""")
def constrained_topk(spark, folder):
    """The most similar vectors of the allowed direction only; queries are the ids divisible by 100."""
    from signalweave.operators import blocks

    e = table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("direction"), F.col("vec_id").alias("k"), unit(F.col("embedding").cast("array<double>")).alias("v"))
    asked = e.where("k % 100 = 0").withColumn("direction", (F.col("direction") + 1) % 10)
    met = blocks.across(asked, e, ["direction"], "k", blocks.best_of_block(["direction"], "k", "v", 3), "direction long, k long, near long, similarity double")
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.col("similarity").desc(), "near"))
    return met.withColumn("rank", rank.cast("long")).where("rank <= 3").select(F.col("k").alias("vec_id"), "near", "rank", _r6("similarity"))


@query(None)
def preview_fold(spark, folder):
    """Previews folded in their order; tested against a plain loop."""
    d = table(spark, folder, "documents")
    n = lambda k: (F.col("doc_id") % k).cast("string")
    items = d.select(
        F.col("doc_id").alias("place"), F.concat(F.lit("title:"), n(300)).alias("key"), F.concat_ws(" ", F.md5("text"), "lang").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("10.1000/"), n(120))).alias("doi"),
        F.when(F.col("doc_id") % 7 == 0, F.array(F.concat(F.lit("a"), n(90)))).alias("arxiv"), F.array(F.concat("source", n(4))).alias("authors"), (F.lit(2000) + F.col("doc_id") % 6).cast("long").alias("year"),
    )
    return previews.folded_previews(items)
