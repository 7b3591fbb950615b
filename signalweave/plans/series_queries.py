"""Series, ranking and scoring queries over orders (dated works), lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.operators import phrases, ranking, scoring, series
from signalweave.plans.registry import query
from signalweave.storage import table

#: The day from which on nothing is known; the quarter that it lies in is incomplete.
AS_OF = "2001-07-15"

COVERAGE_SQL = "CASE topic WHEN '5-LOW' THEN NULL WHEN '3-MEDIUM' THEN FALSE ELSE TRUE END"
SERIES_SQL = f"""
o AS (SELECT o_orderpriority AS topic, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start FROM orders WHERE o_orderdate < TIMESTAMP '{AS_OF}'),
c AS (SELECT topic, start, count(*) AS n FROM o GROUP BY topic, start),
span AS (SELECT min(start) AS lo, max(start) AS hi FROM c),
w AS (SELECT CAST(q AS DATE) AS start, CAST(q + INTERVAL 3 MONTH AS DATE) AS stop, row_number() OVER (ORDER BY q) - 1 AS idx
      FROM span, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 3 MONTH)) AS t(q)),
g AS (SELECT t.topic, w.start, w.stop, w.idx, coalesce(c.n, 0) AS works FROM (SELECT DISTINCT topic FROM c) t CROSS JOIN w LEFT JOIN c ON c.topic = t.topic AND c.start = w.start),
s AS (SELECT *, CAST(sum(works) OVER (PARTITION BY start) AS BIGINT) AS total, stop <= DATE '{AS_OF}' AS complete, {COVERAGE_SQL} AS coverage FROM g),
p AS (SELECT *, CASE WHEN total > 0 THEN works / total END AS share FROM s),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY idx DESC) AS back FROM p WHERE complete) WHERE back <= 4),
rp AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY idx) - 1 AS pos FROM r)
"""


def orders_series(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly works per topic with what is known about coverage."""
    orders = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("topic"), "o_orderdate")
    dense = series.dense_counts(orders, "o_orderdate", ["topic"], "quarter", F.lit(AS_OF).cast("timestamp_ntz"))
    coverage = F.when(F.col("topic") == "5-LOW", F.lit(None).cast("boolean")).otherwise(F.col("topic") != "3-MEDIUM")
    return dense.withColumns({"complete": F.col("end") <= F.lit(AS_OF).cast("date"), "coverage_comparable": coverage})


def r6(c: str, out: str | None = None):
    return F.round(F.col(c), 6).alias(out or c)


@query(f"""WITH {SERIES_SQL},
one AS (SELECT topic, count(*) AS used, CASE WHEN bool_or(coverage = FALSE) THEN FALSE WHEN count(coverage) = count(*) THEN TRUE END AS cov,
  max(stop - start) - min(stop - start) <= 3 AS same, count(share) = count(*) AS known, regr_slope(share, pos) AS sl, arg_max(share, pos) - arg_min(share, pos) AS ch FROM rp GROUP BY topic),
v AS (SELECT *, used = 4 AND coalesce(cov, FALSE) AND same AND known AS ok FROM one)
SELECT topic, used AS used_full_windows, CAST(cov AS VARCHAR) AS coverage_comparable, CASE WHEN ok THEN round(sl, 6) END AS share_slope, CASE WHEN ok THEN round(ch, 6) END AS share_change,
  CASE WHEN NOT ok THEN 'not_established' WHEN sl > 0 AND ch > 0 THEN 'increasing' WHEN sl < 0 AND ch < 0 THEN 'decreasing' ELSE 'flat_or_mixed' END AS direction FROM v""")
def window_share_trend(spark, folder):
    t = series.share_trend(orders_series(spark, folder), ["topic"])
    return t.select("topic", "used_full_windows", F.col("coverage_comparable").cast("string").alias("coverage_comparable"), r6("share_slope"), r6("share_change"), "direction")


@query(f"""WITH {SERIES_SQL}, k AS (SELECT 1.959963984540054::DOUBLE AS z),
i AS (SELECT topic, start, works, total, share, 1 + z * z / total AS d, (share + z * z / (2 * total)) AS m, z * sqrt(share * (1 - share) / total + z * z / (4.0 * total * total)) AS h FROM p, k)
SELECT topic, CAST(start AS VARCHAR) AS start, works, total, round(share, 6) AS share, CASE WHEN total > 0 THEN round(greatest(0, m / d - h / d), 6) END AS low, CASE WHEN total > 0 THEN round(least(1, m / d + h / d), 6) END AS high FROM i""")
def wilson_share(spark, folder):
    t = orders_series(spark, folder)
    low, high = series.wilson(F.col("topic_works"), F.col("corpus_works"))
    return t.select("topic", F.col("start").cast("string").alias("start"), F.col("topic_works").alias("works"), F.col("corpus_works").alias("total"), F.round(series.share(F.col("topic_works"), F.col("corpus_works")), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {SERIES_SQL},
z AS (SELECT topic, max(idx) AS last, min(idx) AS first, max(idx) FILTER (works = 0) AS zero, max(idx) FILTER (coalesce(coverage, FALSE) = FALSE OR total = 0) AS gap FROM p WHERE complete GROUP BY topic)
SELECT topic, last - coalesce(zero, first - 1) AS observed_streak, CASE WHEN gap IS NULL OR coalesce(zero, -1) > gap THEN CAST(last - coalesce(zero, first - 1) AS DOUBLE) END AS streak FROM z""")
def trailing_streak(spark, folder):
    t = series.trailing_streaks(orders_series(spark, folder), ["topic"])
    return t.select("topic", F.col("observed_streak").cast("long"), F.col("streak").cast("double"))


@query(f"""WITH {SERIES_SQL},
one AS (SELECT topic, regr_slope(works, pos) AS cs, arg_max(works, pos) - arg_min(works, pos) AS cc, arg_min(works, pos) AS c0, regr_slope(share, pos) AS ss, arg_max(share, pos) - arg_min(share, pos) AS sc, arg_min(share, pos) AS s0 FROM rp GROUP BY topic)
SELECT topic, round(cs, 6) AS count_slope, cc AS count_change, round(cc / c0, 6) AS count_relative_change, round(ss, 6) AS share_slope, round(sc / s0, 6) AS share_relative_change,
  CASE WHEN cs > 0 AND cc > 0 THEN 'increasing' WHEN cs < 0 AND cc < 0 THEN 'decreasing' ELSE 'flat_or_mixed' END AS count_direction FROM one""")
def observed_descriptor(spark, folder):
    t = series.observed_descriptors(orders_series(spark, folder), ["topic"])
    return t.select("topic", r6("count_slope"), "count_change", r6("count_relative_change"), r6("share_slope"), r6("share_relative_change"), "count_direction")


@query(f"""WITH {SERIES_SQL},
one AS (SELECT topic, regr_slope(works, pos) AS cs, regr_slope(share, pos) AS ss, arg_max(works, pos) AS c1, arg_min(works, pos) AS c0, arg_max(share, pos) AS s1, arg_min(share, pos) AS s0,
  max(works) FILTER (pos = 2) AS cb, max(works) AS cm, max(share) AS sm, max(pos) - coalesce(max(pos) FILTER (works = 0), -1) AS streak FROM rp GROUP BY topic),
x AS (SELECT one.*, sup.support FROM one JOIN (SELECT topic, sum(works) AS support FROM p GROUP BY topic) sup USING (topic))
SELECT topic, CASE WHEN cs < 0 AND c1 < c0 AND ss < 0 AND s1 < s0 THEN 'declining_activity' WHEN s1 >= 0.199 THEN 'widespread_topic'
  WHEN cs > 0 AND c1 > c0 AND ss > 0 AND s1 > s0 THEN CASE WHEN streak >= 2 AND support >= 5 AND c1 >= 2 THEN 'publication_signal_candidate' ELSE 'growth_watch' END ELSE 'stable_or_mixed' END AS stage,
  c1 - cb AS last_count_change, cm - c1 AS count_drawdown, round(sm - s1, 6) AS share_drawdown, streak FROM x""")
def descriptive_stage(spark, folder):
    t = series.descriptive_stage(orders_series(spark, folder), ["topic"], series.StagePolicy(max_small_topic_share=0.199))
    return t.select("topic", "stage", "last_count_change", "count_drawdown", r6("share_drawdown"), F.col("streak").cast("long"))


DECAY_SQL = f"""WITH {SERIES_SQL},
b AS (SELECT topic, min(idx) FILTER (works > 0) AS born FROM p GROUP BY topic),
m AS (SELECT p.topic, p.idx, p.start, p.works, p.start + CAST(floor((p.stop - 1 - p.start) / 2) AS INTEGER) AS mid FROM p JOIN b USING (topic) WHERE p.idx >= born),
pop AS (SELECT a.topic, a.idx, a.start, sum(e.works * pow(0.5, (a.mid - e.mid) / 365.0)) AS popularity FROM m a JOIN m e ON e.topic = a.topic AND e.idx <= a.idx GROUP BY a.topic, a.idx, a.start),
sl AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY topic ORDER BY idx) > 1 THEN regr_slope(popularity, idx) OVER (PARTITION BY topic ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) ELSE 0 END AS slope FROM pop)"""


@query(DECAY_SQL + " SELECT topic, CAST(start AS VARCHAR) AS start, round(popularity, 6) AS popularity FROM pop")
def decayed_popularity(spark, folder):
    t = series.decayed_popularity(orders_series(spark, folder), ["topic"], "quarter")
    return t.select("topic", F.col("start").cast("string").alias("start"), r6("popularity"))


@query(DECAY_SQL + " SELECT topic, CAST(start AS VARCHAR) AS start, round(slope, 5) AS slope FROM sl")
def rolling_slope(spark, folder):
    t = series.decayed_popularity(orders_series(spark, folder), ["topic"], "quarter")
    return t.select("topic", F.col("start").cast("string").alias("start"), F.round(series.rolling_slope(F.col("popularity"), F.col("idx"), ["topic"]), 5).alias("slope"))


@query(DECAY_SQL + """, q AS (SELECT idx, quantile_cont(popularity, 0.1) AS lo, quantile_cont(popularity, 0.5) AS hi FROM pop GROUP BY idx)
SELECT topic, CAST(start AS VARCHAR) AS start, round(100 * cume_dist() OVER (PARTITION BY idx ORDER BY popularity), 4) AS percentile, round(lo, 5) AS low, round(hi, 5) AS high,
  CASE WHEN popularity < lo THEN 'noise' WHEN popularity > hi THEN 'strong' WHEN slope > 0 THEN 'weak' ELSE 'noise' END AS class FROM sl JOIN q USING (idx)""")
def lifecycle_class(spark, folder):
    t = series.lifecycle(series.decayed_popularity(orders_series(spark, folder), ["topic"], "quarter"), ["topic"])
    return t.select("topic", F.col("start").cast("string").alias("start"), F.round("percentile", 4).alias("percentile"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "class")


@query(f"WITH {SERIES_SQL} SELECT topic, CAST(start AS VARCHAR) AS start, round(ln((share + 0.0001) / (lag(share) OVER (PARTITION BY topic ORDER BY idx) + 0.0001)), 6) AS momentum FROM p")
def log_momentum(spark, folder):
    return series.log_momentum(orders_series(spark, folder), ["topic"]).select("topic", F.col("start").cast("string").alias("start"), r6("momentum"))


@query(f"""WITH {SERIES_SQL}, f AS (SELECT topic, idx, coalesce(share >= lag(share) OVER (PARTITION BY topic ORDER BY idx), FALSE) AS up FROM p)
SELECT topic, max(idx) - max(idx) FILTER (NOT up) AS growth_streak FROM f GROUP BY topic""")
def growth_streak(spark, folder):
    return series.growth_streak(orders_series(spark, folder), ["topic"]).select("topic", F.col("growth_streak").cast("long"))


@query(f"""WITH {SERIES_SQL}, l AS (SELECT *, CASE WHEN works > lag(works) OVER (PARTITION BY topic ORDER BY idx) THEN 1 ELSE 0 END AS rose FROM p),
f AS (SELECT topic, idx, count(*) OVER six = 6 AS ok, avg(works) OVER (PARTITION BY topic ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, avg(works) OVER (PARTITION BY topic ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS b,
  sum(rose) OVER (PARTITION BY topic ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inc FROM l WINDOW six AS (PARTITION BY topic ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT topic, idx, CASE WHEN ok THEN round(a, 6) END AS recent_mean, CASE WHEN ok THEN round(b, 6) END AS prior_mean, CASE WHEN ok THEN CAST(inc AS DOUBLE) END AS increases FROM f""")
def trailing_features(spark, folder):
    t = series.trailing_features(orders_series(spark, folder), ["topic"])
    return t.select("topic", F.col("idx").cast("long"), r6("recent_mean"), r6("prior_mean"), F.col("increases").cast("double"))


@query(f"""WITH {SERIES_SQL}
SELECT topic, idx, CASE WHEN count(*) OVER w5 = 5 AND works > 0 THEN round(avg(works) OVER w5 / works, 6) END AS mean_ratio, CASE WHEN count(*) OVER w5 = 5 AND works > 0 THEN round(last_value(works) OVER w5 / works, 6) END AS end_ratio
FROM p WINDOW w5 AS (PARTITION BY topic ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def forward_outcomes(spark, folder):
    return series.forward_outcomes(orders_series(spark, folder), ["topic"]).select("topic", F.col("idx").cast("long"), r6("mean_ratio"), r6("end_ratio"))


@query(f"""WITH {SERIES_SQL},
a AS (SELECT topic, idx, works, avg(works) OVER (PARTITION BY topic ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, avg(works) OVER (PARTITION BY topic ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS b,
  count(*) OVER (PARTITION BY topic ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS n6, avg(works) OVER (PARTITION BY topic ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS f, count(*) OVER (PARTITION BY topic ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n5 FROM p),
k AS (SELECT m > b AS guess, f > works AS truth FROM a WHERE n6 = 6 AND n5 = 5 AND works > 0),
cm AS (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (NOT truth AND NOT guess) AS tn FROM k)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM cm""")
def growth_forecast_confusion(spark, folder):
    from signalweave.operators import review

    s = orders_series(spark, folder)
    t = series.trailing_features(s, ["topic"]).join(series.forward_outcomes(s, ["topic"]).select("topic", "idx", "mean_ratio"), ["topic", "idx"]).where("recent_mean is not null and mean_ratio is not null")
    return review.confusion(t, F.col("mean_ratio") > 1, F.col("recent_mean") > F.col("prior_mean")).select("tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("balanced_accuracy"))


@query("""WITH c AS (SELECT year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END AS fy, o_orderpriority AS topic FROM orders)
SELECT fy AS fiscal_year, topic, count(*) AS works FROM c GROUP BY fy, topic""")
def fiscal_year_counts(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.groupBy(series.fiscal_year(F.col("o_orderdate")).cast("long").alias("fiscal_year"), F.col("o_orderpriority").alias("topic")).agg(F.count("*").alias("works"))


@query("""WITH n AS (SELECT l_partkey AS part, count(*) AS works, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey),
b AS (SELECT part, part % 7 AS cohort, works FROM n),
r AS (SELECT *, rank() OVER (PARTITION BY cohort ORDER BY works) - 1 AS less, count(*) OVER (PARTITION BY cohort, works) AS eq, count(*) OVER (PARTITION BY cohort) AS n FROM b)
SELECT part, cohort, works, CASE WHEN n >= 5 THEN round_even(100 * (less + 0.5 * eq) / n, 2) END AS percentile FROM r""")
def midrank_percentile(spark, folder):
    n = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("works")).withColumn("cohort", F.col("part") % 7)
    return ranking.midrank_percentile(n, "works", ["cohort"]).select("part", "cohort", "works", "percentile")


@query("""WITH n AS (SELECT o_custkey AS cust, o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS share FROM orders GROUP BY 1, 2),
a AS (SELECT *, count(*) FILTER (share > 0) OVER (PARTITION BY status) AS n, count(*) FILTER (share > 0) OVER (PARTITION BY status ORDER BY share RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le, count(*) FILTER (share > 0) OVER (PARTITION BY status, share) AS eq FROM n)
SELECT cust, status, CASE WHEN n >= 5 THEN round_even(100 * (le - eq + 0.5 * eq) / n, 2) END AS prevalence_rank FROM a""")
def prevalence_rank(spark, folder):
    n = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status")).agg((F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*")).alias("share"))
    return ranking.prevalence_rank(n, "share", ["status"]).select("cust", "status", "prevalence_rank")


@query("""WITH l AS (SELECT l_partkey AS topic, l_suppkey AS org, count(DISTINCT l_orderkey) AS works FROM lineitem GROUP BY 1, 2), t AS (SELECT l_partkey AS topic, count(DISTINCT l_orderkey) AS total FROM lineitem GROUP BY 1)
SELECT topic, round(max(works) / total, 6) AS single_org_share, count(*) AS orgs, round(1 / sum(pow(works / s, 2)), 6) AS effective_orgs
FROM (SELECT *, sum(works) OVER (PARTITION BY topic) AS s FROM l) JOIN t USING (topic) GROUP BY topic, total""")
def organisation_concentration(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("topic"), F.col("l_suppkey").alias("org"), F.col("l_orderkey").alias("work")).distinct()
    per = rows.groupBy("topic", "org").agg(F.count("*").alias("works"))
    total = rows.groupBy("topic").agg(F.count_distinct("work").alias("total"))
    s = per.groupBy("topic").agg(F.max("works").alias("m"), F.count("*").alias("orgs"), (F.sum("works") * F.sum("works") / F.sum(F.col("works") * F.col("works"))).alias("effective_orgs"))
    return s.join(total, "topic").select("topic", F.round(F.col("m") / F.col("total"), 6).alias("single_org_share"), "orgs", r6("effective_orgs"))


@query("""WITH y AS (SELECT l_orderkey AS work, year(l_shipdate) AS yr, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT o_orderkey AS work, o_orderpriority AS topic, o_orderdate AS d FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'),
e AS (SELECT topic, w.work, greatest(0.25, date_diff('day', CAST(d AS DATE), DATE '2001-01-01') / 365.25) AS exposure, coalesce(sum(n) FILTER (yr < 2001), 0) AS cites FROM w LEFT JOIN y USING (work) GROUP BY topic, w.work, d)
SELECT topic, CAST(sum(cites) AS BIGINT) AS citations, round(sum(cites) / sum(exposure), 6) AS velocity FROM e GROUP BY topic""")
def citation_velocity(spark, folder):
    """Citations before the as-of year over years of exposure, a quarter at least."""
    years = table(spark, folder, "lineitem").where(F.year("l_shipdate") < 2001).groupBy(F.col("l_orderkey").alias("work")).agg(F.count("*").alias("n"))
    works = table(spark, folder, "orders").where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("work"), F.col("o_orderpriority").alias("topic"), F.greatest(F.lit(0.25), F.datediff(F.lit("2001-01-01").cast("date"), F.col("o_orderdate").cast("date")) / 365.25).alias("exposure"))
    t = works.join(years, "work", "left")
    return t.groupBy("topic").agg(F.sum(F.coalesce("n", F.lit(0))).alias("citations"), F.round(F.sum(F.coalesce("n", F.lit(0))) / F.sum("exposure"), 6).alias("velocity"))


@query("""SELECT coalesce(o_orderpriority, 'all') AS category, coalesce(CAST(year(o_orderdate) AS VARCHAR), 'all') AS yr, count(*) AS works, count(DISTINCT o_custkey) AS authors FROM orders GROUP BY GROUPING SETS ((o_orderpriority, year(o_orderdate)), (o_orderpriority), ())""")
def background_counts(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("category"), F.year("o_orderdate").cast("long").alias("yr"), "o_custkey")
    return orders.groupingSets([[F.col("category"), F.col("yr")], [F.col("category")], []], "category", "yr").agg(F.count("*").alias("works"), F.count_distinct("o_custkey").alias("authors")).select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce(F.col("yr").cast("string"), F.lit("all")).alias("yr"), "works", "authors")


@query("""WITH f AS (SELECT c_custkey, n_regionkey AS area FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT o_orderpriority AS topic, year(o_orderdate) AS yr, area, count(*) AS n FROM orders JOIN f ON o_custkey = c_custkey GROUP BY ALL),
fst AS (SELECT topic, area, min(yr) AS yr FROM m WHERE n >= 2 GROUP BY topic, area), nw AS (SELECT topic, yr, count(*) AS k FROM fst GROUP BY ALL),
a AS (SELECT topic, yr, CAST(sum(n) AS BIGINT) AS works, count(*) FILTER (n >= 2) AS active FROM m GROUP BY ALL)
SELECT topic, yr, works, active AS active_areas, CAST(sum(coalesce(k, 0)) OVER (PARTITION BY topic ORDER BY yr) AS BIGINT) AS cumulative_areas FROM a LEFT JOIN nw USING (topic, yr)""")
def cumulative_areas(spark, folder):
    area = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("area"))
    rows = table(spark, folder, "orders").join(area, "o_custkey").select(F.col("o_orderpriority").alias("topic"), F.year("o_orderdate").cast("long").alias("yr"), "area")
    return phrases.cumulative_areas(rows, "topic", "yr", "area", 2)


@query("""SELECT event_type, user_id, event_id, CAST(ts AS VARCHAR) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_run(spark, folder):
    t = ranking.latest(table(spark, folder, "events"), ["event_type", "user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return t.select("event_type", "user_id", "event_id", F.col("ts").cast("string").alias("ts"))


@query("""WITH r AS (SELECT o_orderkey, year(o_orderdate) AS yr, sha256('spread' || chr(0) || o_orderkey::VARCHAR) AS h FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY h, o_orderkey) AS turn FROM r)
SELECT o_orderkey, yr, turn FROM n ORDER BY turn, yr DESC LIMIT 40""")
def year_spread(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("yr"))
    return ranking.year_spread(rows, "yr", "spread", "o_orderkey", 40).select("o_orderkey", "yr", F.col("turn").cast("long"))


@query("SELECT doc_id FROM documents ORDER BY sha256('pilot' || chr(0) || doc_id::VARCHAR), doc_id LIMIT 50")
def hash_sample(spark, folder):
    return ranking.hash_sample(table(spark, folder, "documents").select("doc_id"), "pilot", "doc_id", 50)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('strata' || chr(0) || doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 10")
def stratified_sample(spark, folder):
    return ranking.hash_sample(table(spark, folder, "documents").select("doc_id", "lang"), "strata", "doc_id", 10, ["lang"])


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS topic, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, topic FROM r WHERE n <= 9 OR i IN (SELECT CAST(round_even(k * (n - 1) / 8, 0) AS BIGINT) FROM range(9) AS t(k))""")
def even_sample(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("topic"), "o_orderdate")
    return ranking.even_sample(rows, ["topic"], ["o_orderdate", "o_orderkey"], 9).select("o_orderkey", "topic")


@query("""SELECT o_orderkey, topic, front, back FROM (SELECT o_orderkey, o_orderpriority AS topic, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS front, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders) WHERE front <= 3 OR back <= 3""")
def edge_sample(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("topic"), "o_orderdate")
    return ranking.edge_sample(rows, ["topic"], ["o_orderdate", "o_orderkey"], 3).select("o_orderkey", "topic", F.col("front").cast("long"), F.col("back").cast("long"))


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, CASE WHEN i = 0 THEN 'earliest' WHEN i = n - 1 THEN 'latest' ELSE 'middle' END AS landmark FROM r WHERE i = 0 OR i = n - 1 OR i = floor(n / 2)""")
def landmarks(spark, folder):
    return ranking.landmarks(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "landmark")


@query("""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS r FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS r FROM events WHERE event_type = (SELECT max(event_type) FROM events)),
u AS (SELECT event_id, 1 AS source, floor(r / 2) * 3 + r % 2 AS s FROM a UNION ALL SELECT event_id, 2, r * 3 + 2 FROM b)
SELECT event_id, source, row_number() OVER (ORDER BY s, source) AS place FROM u ORDER BY place LIMIT 60""")
def interleave_2_1(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    ends = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    t = events.crossJoin(F.broadcast(ends))
    out = ranking.interleave(t.where("event_type = lo").select("event_id", "value"), t.where("event_type = hi").select("event_id", "value"), [F.col("value").desc(), F.col("event_id")], 60)
    return out.select("event_id", "source", F.col("place").cast("long"))


@query("""WITH t AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events),
f AS (SELECT user_id, min(n) AS n, min((n, event_type)) AS first, list_sort(list(DISTINCT event_type)) AS b, min(ts) AS ts FROM t GROUP BY user_id)
SELECT user_id, first[2] AS first_branch, array_to_string(b, ',') AS branches, CAST(ts AS VARCHAR) AS ts FROM (SELECT * FROM f ORDER BY first, user_id LIMIT 100)""")
def balanced_merge(spark, folder):
    t = ranking.balanced_merge(table(spark, folder, "events"), "event_type", "user_id", "ts", [F.col("value").desc(), F.col("event_id")], 100)
    return t.select("user_id", "first_branch", F.array_join("branches", ",").alias("branches"), F.col("ts").cast("string").alias("ts"))


@query("""SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_type) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS t FROM events)""")
def source_lanes(spark, folder):
    return ranking.lanes(table(spark, folder, "events"), ["user_id"], "event_type", [F.col("ts"), F.col("event_id")]).select("event_type", "user_id", "event_id", F.col("place").cast("long"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged_works(spark, folder):
    return ranking.paged(table(spark, folder, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 50, 25).select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


METRICS_SQL = """
m AS (SELECT p_partkey AS topic, p_name AS label, CAST(p_size AS DOUBLE) AS doc_count, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 7 END::DOUBLE AS independent_orgs, (p_partkey % 100) / 100.0::DOUBLE AS single_org_share,
  (p_partkey * 37 % 101)::DOUBLE AS maturity_percentile, (p_partkey * 53 % 101)::DOUBLE AS novelty_percentile, (p_size % 4)::DOUBLE AS windows_present, (p_size % 4)::DOUBLE AS consecutive_windows, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size % 5 END::DOUBLE AS independent_teams,
  (p_partkey * 71 % 101)::DOUBLE AS momentum_percentile, ((p_partkey % 9) - 3)::DOUBLE AS share_slope, ((p_partkey % 8) - 2)::DOUBLE AS share_change, p_partkey % 3 <> 0 AS coverage_comparable, 0.95::DOUBLE AS embedding_coverage, (p_size % 10) / 10.0::DOUBLE AS coherence, TRUE AS coherence_calibrated, (p_size % 12)::DOUBLE AS age_years, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size % 6 END::DOUBLE AS primary_sources,
  (p_partkey * 53 % 101) / 100.0::DOUBLE AS novelty, (p_partkey * 71 % 101) / 100.0::DOUBLE AS momentum, (p_size % 4) / 3.0::DOUBLE AS persistence, (p_size % 5) / 4.0::DOUBLE AS diffusion, 1.0::DOUBLE AS completeness, (p_size % 10) / 9.0::DOUBLE AS identity, (p_size % 3) / 2.0::DOUBLE AS confirmation FROM part)
"""
STATUS_SQL = METRICS_SQL + """,
g AS (SELECT *, [ [0, doc_count >= 5], [1, independent_orgs >= 3], [2, single_org_share <= 0.8], [3, maturity_percentile <= 80], [4, novelty_percentile >= 65], [5, windows_present >= 2], [6, consecutive_windows >= 2], [7, independent_teams >= 2], [8, momentum_percentile >= 65], [9, share_slope > 0], [10, share_change > 0], [11, coverage_comparable], [12, embedding_coverage >= 0.9], [13, coherence >= 0.5], [14, coherence_calibrated], [15, primary_sources >= 2] ] AS gates FROM m),
f AS (SELECT *, CAST(len(list_filter(gates, lambda x: x[2] = 0)) AS BIGINT) AS failed, CAST(len(list_filter(gates, lambda x: x[2] IS NULL)) AS BIGINT) AS unknown,
  CAST(len(list_filter(gates, lambda x: x[2] = 1 AND x[1] IN (4, 5, 6, 8, 9, 10, 13))) AS BIGINT) AS core,
  round_even(greatest(0, least(1, 0.34 * completeness + 0.33 * identity + 0.33 * confirmation)) * 100, 2) AS confidence, round_even(greatest(0, least(1, 0.25 * novelty + 0.25 * momentum + 0.2 * persistence + 0.2 * diffusion + 0.1 * coherence)) * 100, 2) AS score FROM g),
st AS (SELECT *, CASE WHEN maturity_percentile > 80 THEN 'widespread' WHEN failed > 0 THEN 'candidate' WHEN unknown > 0 OR confidence < 55 THEN 'watch' ELSE 'forming' END AS status FROM f)
"""


def part_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Topic metrics derived from parts, with unknowns: gates and statuses are what is under test."""
    k, n = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    null = F.lit(None).cast("double")
    return table(spark, folder, "part").select(
        k.alias("topic"), F.col("p_name").alias("label"), d(n).alias("doc_count"), F.when(n % 5 != 0, d(n % 7)).otherwise(null).alias("independent_orgs"), (d(k % 100) / 100.0).alias("single_org_share"),
        d(k * 37 % 101).alias("maturity_percentile"), d(k * 53 % 101).alias("novelty_percentile"), d(n % 4).alias("windows_present"), d(n % 4).alias("consecutive_windows"), F.when(k % 11 != 0, d(n % 5)).otherwise(null).alias("independent_teams"),
        d(k * 71 % 101).alias("momentum_percentile"), d(k % 9 - 3).alias("share_slope"), d(k % 8 - 2).alias("share_change"), (k % 3 != 0).alias("coverage_comparable"), F.lit(0.95).alias("embedding_coverage"), (d(n % 10) / 10.0).alias("coherence"), F.lit(True).alias("coherence_calibrated"), d(n % 12).alias("age_years"), F.when(k % 13 != 0, d(n % 6)).otherwise(null).alias("primary_sources"),
        (d(k * 53 % 101) / 100.0).alias("novelty"), (d(k * 71 % 101) / 100.0).alias("momentum"), (d(n % 4) / 3.0).alias("persistence"), (d(n % 5) / 4.0).alias("diffusion"), F.lit(1.0).alias("completeness"), (d(n % 10) / 9.0).alias("identity"), (d(n % 3) / 2.0).alias("confirmation"),
    )


@query(f"WITH {STATUS_SQL} SELECT topic, failed, unknown, status, round(confidence, 1) AS confidence, CASE WHEN status = 'forming' THEN round(score, 1) END AS score FROM st")
def gates_and_status(spark, folder):
    t = scoring.assess(part_metrics(spark, folder))
    return t.select("topic", F.size("failed").cast("long").alias("failed"), F.size("unknown").cast("long").alias("unknown"), "status", F.round("evidence_confidence", 1).alias("confidence"), F.round("emergence_score", 1).alias("score"))


@query(f"""WITH {STATUS_SQL}, q AS (SELECT *, CASE WHEN coverage_comparable AND share_slope <= 0 THEN 4 WHEN failed > 0 THEN 2 WHEN coverage_comparable AND share_slope > 0 THEN 0 ELSE 1 END AS pr FROM st WHERE status <> 'widespread'),
o AS (SELECT *, row_number() OVER (ORDER BY pr, failed, -core, unknown, -least(novelty_percentile, momentum_percentile), -confidence, lower(label), topic) AS rank FROM q)
SELECT rank, topic, status, CASE WHEN failed = 0 THEN 'verify_missing_evidence' WHEN core >= 4 AND failed <= 2 THEN 'monitor_early_acceleration' WHEN unknown > 0 THEN 'resolve_and_recheck' ELSE 'lower_priority_recheck' END AS band FROM o WHERE rank <= 15""")
def triage_queue(spark, folder):
    t = scoring.triage(scoring.assess(part_metrics(spark, folder)), "label", "topic", 15)
    return t.select(F.col("rank").cast("long"), "topic", "status", "band")


@query(f"WITH {STATUS_SQL} SELECT topic, CASE WHEN status = 'forming' THEN round(score, 1) END AS score, round(confidence, 1) AS confidence FROM st ORDER BY (CASE WHEN status = 'forming' THEN score END) DESC NULLS LAST, confidence DESC, topic LIMIT 50")
def cards_order(spark, folder):
    t = scoring.assess(part_metrics(spark, folder)).orderBy(F.col("emergence_score").desc_nulls_last(), F.col("evidence_confidence").desc(), "topic").limit(50)
    return t.select("topic", F.round("emergence_score", 1).alias("score"), F.round("evidence_confidence", 1).alias("confidence"))


@query("""WITH b AS (SELECT p_partkey AS topic, (p_partkey * 37 % 101)::DOUBLE AS growth, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_partkey * 53 % 101)::DOUBLE END AS novelty, (p_size * 2)::DOUBLE AS diffusion, (p_size % 4) * 30.0::DOUBLE AS persistence, (p_size % 10) * 10.0::DOUBLE AS coherence, p_size % 9 AS v, p_size % 4 AS pub, p_size % 6 AS fr FROM part),
a AS (SELECT *, coalesce(growth * 0.4, 0) + coalesce(novelty * 0.25, 0) + diffusion * 0.15 + persistence * 0.1 + coherence * 0.1 AS base, 0.75 + CASE WHEN novelty IS NULL THEN 0 ELSE 0.25 END AS known, 60 * least(1, v / 4) + 20 * least(1, pub / 3) + 20 * least(1, fr / 4) AS ext FROM b)
SELECT topic, round(base, 5) AS science, CAST(round(known, 5) AS DOUBLE) AS known_weight, round(base + (1 - known) * 100, 5) AS upper_bound, round(ext, 5) AS external, round(base + CASE WHEN ext > 0 THEN (ext * 0.1 + 5) * least(1, greatest(0, 100 - base) / (ext * 0.1 + 5)) ELSE 5 * least(1, greatest(0, 100 - base) / 5) END, 5) AS total FROM a""")
def multisource_score(spark, folder):
    k, n = F.col("p_partkey"), F.col("p_size")
    t = table(spark, folder, "part").select(k.alias("topic"), (k * 37 % 101).cast("double").alias("growth"), F.when(n % 5 != 0, (k * 53 % 101).cast("double")).alias("novelty"), (n * 2).cast("double").alias("diffusion"), ((n % 4) * 30.0).alias("persistence"), ((n % 10) * 10.0).alias("coherence"), (n % 9).alias("v"), (n % 4).alias("pub"), (n % 6).alias("fr"))
    base, known, upper = scoring.science_axis()
    t = t.withColumns({"base": base, "known": known, "upper": upper, "ext": scoring.external_axis(F.col("v"), F.col("pub"), F.col("fr"))})
    total = scoring.capped_bonus(F.col("base"), [F.col("ext") * 0.1, F.lit(5.0)])
    return t.select("topic", F.round("base", 5).alias("science"), F.round("known", 5).alias("known_weight"), F.round("upper", 5).alias("upper_bound"), F.round("ext", 5).alias("external"), F.round(total, 5).alias("total"))


@query("""WITH d AS (SELECT CAST(d AS DATE) AS d FROM unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS t(d)), c AS (SELECT CAST(ts AS DATE) AS d, sum(value) AS v FROM events WHERE event_type = 'view' OR event_type = 'click' GROUP BY 1)
SELECT CAST(d AS VARCHAR) AS day, round(v, 4) AS value FROM d LEFT JOIN c USING (d)""")
def daily_attention(spark, folder):
    from signalweave.sources.evidence import densify_days

    rows = table(spark, folder, "events").where("event_type in ('view', 'click')").select(F.col("ts").cast("date").alias("day"), "value")
    return densify_days(rows, "day", "value", "2024-01-01", "2024-02-05").select(F.col("day").cast("string").alias("day"), F.round("value", 4).alias("value"))


@query("""WITH k AS (SELECT c_custkey AS work, c_nationkey AS org FROM customer), f AS (SELECT o_custkey, min(year(o_orderdate)) AS yr FROM orders GROUP BY 1), o AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS yr FROM orders)
SELECT o.yr, count(*) FILTER (o.yr = f.yr) AS new_signatures, count(*) FILTER (o.yr > f.yr) AS continuing FROM o JOIN f USING (o_custkey) GROUP BY o.yr""")
def signature_novelty(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("yr")).distinct()
    first = F.min("yr").over(W.partitionBy("o_custkey"))
    return o.withColumn("first", first).groupBy("yr").agg(F.count_if(F.col("yr") == F.col("first")).alias("new_signatures"), F.count_if(F.col("yr") > F.col("first")).alias("continuing"))
