"""Queries of retrieval, review and run diagnostics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.operators import diagnostics, phrases, series
from signalweave.plans.record_queries import HAS
from signalweave.plans.registry import query
from signalweave.storage import Scratch, table
from signalweave.streaming import windows

SIGNALS = [("license", r"(^|\W)license(\W|$)"), ("the", r"(^|\W)the(\W|$)"), ("und", r"(^|\W)und(\W|$)"), ("xylophone", r"(^|\W)xylophone(\W|$)")]
SIGNAL_SQL = "s AS (SELECT 'license' AS signal UNION ALL SELECT 'the' UNION ALL SELECT 'und' UNION ALL SELECT 'xylophone'), h AS (" + " UNION ALL ".join(f"SELECT '{n}' AS signal, doc_id, doc_id % 4 = 0 AS recent FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_]){n}([^a-z0-9_]|$)')" for n, _ in SIGNALS) + ")"


def _observed(spark, folder):
    docs = table(spark, folder, "documents")
    return diagnostics.observability(docs, spark.createDataFrame(SIGNALS, "signal string, pattern string"), F.lower("text"), F.col("doc_id") % 4 == 0, 50)


@query(f"WITH {SIGNAL_SQL}, c AS (SELECT s.signal, count(doc_id) AS works, count(*) FILTER (recent) AS recent_works FROM s LEFT JOIN h USING (signal) GROUP BY s.signal) SELECT *, CASE WHEN works = 0 THEN 'absent' WHEN works < 50 THEN 'low_support' ELSE 'observed' END AS state FROM c")
def signal_observability(spark, folder):
    return _observed(spark, folder)


@query(f"WITH {SIGNAL_SQL}, c AS (SELECT s.signal, count(doc_id) AS works FROM s LEFT JOIN h USING (signal) GROUP BY s.signal) SELECT count(*) FILTER (works >= 50) AS observed, count(*) FILTER (works BETWEEN 1 AND 49) AS low_support, count(*) FILTER (works = 0) AS absent FROM c")
def observability_summary(spark, folder):
    state = F.col("state")
    return _observed(spark, folder).agg(*[F.count_if(state == s).alias(s) for s in ("observed", "low_support", "absent")])


@query("""WITH t AS (SELECT p_brand, p_partkey, regexp_matches(lower(p_type), '(^| )standard +tin( |$)') AS e, regexp_matches(lower(p_type), '(^| )standard( +[a-z0-9]+){0,2} +tin( |$)') AS g FROM part) SELECT p_brand, count(*) FILTER (e) AS exact, count(*) FILTER (g) AS expanded, count(*) FILTER (g AND NOT e) AS added FROM t GROUP BY p_brand""")
def expansion_comparison(spark, folder):
    """What a gap between words adds to the exact pattern."""
    from signalweave.functions.text import ascii_title_key, gap_pattern

    key = ascii_title_key(F.col("p_type"))
    t = table(spark, folder, "part").select("p_brand", key.rlike(gap_pattern(["standard", "tin"])).alias("e"), key.rlike(gap_pattern(["standard", "tin"], 2)).alias("g"))
    return t.groupBy("p_brand").agg(F.count_if("e").alias("exact"), F.count_if("g").alias("expanded"), F.count_if(F.col("g") & ~F.col("e")).alias("added"))


@query("""SELECT CASE WHEN o.k IS NOT NULL THEN 'present_in_declared_files' WHEN c_nationkey % 5 > 2 AND c_custkey % 3 > 0 THEN 'outside_selected_categories' WHEN c_nationkey % 5 > 2 THEN 'possible_primary_partition_crosslist_gap' ELSE 'missing_despite_matching_primary_category' END AS status, count(*) AS refs FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 280000) o ON o.k = c_custkey GROUP BY 1""")
def mirror_coverage(spark, folder):
    """Wanted references by where they are in a mirror of three categories."""
    held = table(spark, folder, "orders").where("o_totalprice > 280000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("held")).distinct()
    primary = F.concat(F.lit("c"), F.col("c_nationkey") % 5)
    every = F.when(F.col("c_custkey") % 3 == 0, F.array(primary, F.lit("c1"))).otherwise(F.array(primary))
    t = table(spark, folder, "customer").join(held, "c_custkey", "left")
    return t.groupBy(diagnostics.coverage_status(F.col("held").isNotNull(), primary, every, ["c0", "c1", "c2"]).alias("status")).agg(F.count("*").alias("refs"))


FUNNEL_SQL = """t AS (SELECT c_mktsegment AS kase, c_custkey AS k FROM customer), c AS (SELECT o_custkey AS k, min(o_orderkey) AS w FROM orders WHERE o_totalprice > 200000 GROUP BY 1), q AS (SELECT o_orderkey AS w, o_orderstatus <> 'P' AS inc FROM orders),
m AS (SELECT l_orderkey AS w, max((l_shipdate, -l_suppkey))[2] * -1 AS topic FROM lineitem GROUP BY 1), f AS (SELECT kase, t.k, c.w IS NOT NULL AS found, coalesce(q.inc, FALSE) AS included, m.topic, CASE WHEN m.topic % 4 = 0 THEN 'accepted' WHEN m.topic % 4 = 1 THEN 'watch' END AS status FROM t LEFT JOIN c USING (k) LEFT JOIN q ON q.w = c.w LEFT JOIN m ON m.w = c.w)"""


def _funnel(spark, folder):
    o, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    targets = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("case"), F.col("c_custkey").alias("key"))
    collected = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("work"))
    quality = o.select(F.col("o_orderkey").alias("work"), F.when(F.col("o_orderstatus") != "P", "include").otherwise("exclude").alias("decision"))
    members = lines.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("topic"), F.col("l_shipdate").alias("window"))
    candidates = table(spark, folder, "supplier").where("s_suppkey % 4 < 2").select(F.col("s_suppkey").alias("topic"), F.when(F.col("s_suppkey") % 4 == 0, "accepted").otherwise("watch").alias("status"))
    return diagnostics.recovery_funnel(targets, collected, quality, members, candidates)


@query(f"WITH {FUNNEL_SQL} SELECT kase AS \"case\", k AS \"key\", found, included, topic, status FROM f")
def recovery_funnel(spark, folder):
    return _funnel(spark, folder)


@query(f"WITH {FUNNEL_SQL} SELECT kase AS \"case\", count(*) AS targets, count(*) FILTER (found) AS found, count(*) FILTER (included) AS included, count(topic) AS assigned, count(topic) >= 2 AND count(DISTINCT topic) = 1 AS one_topic FROM f GROUP BY kase")
def funnel_summary(spark, folder):
    return diagnostics.funnel_summary(_funnel(spark, folder))


@query("""SELECT source AS "case", lang AS label, count(*) AS items, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY source, lang""")
def review_label_shares(spark, folder):
    return diagnostics.label_shares(table(spark, folder, "documents"), "source", "lang").select(F.col("source").alias("case"), F.col("lang").alias("label"), "items", F.round("share", 6).alias("share"))


@query("""SELECT source, lang, doc_id, place, h[:16] AS item FROM (SELECT source, lang, doc_id, sha256('packet:' || doc_id) AS h, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('packet:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 3""")
def blind_packets(spark, folder):
    t = diagnostics.blind_packet(table(spark, folder, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id", "packet", 3)
    return t.select("source", "lang", "doc_id", F.col("place").cast("long"), "item")


@query("""WITH t AS (SELECT s_nationkey AS topic, CASE s_suppkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'partial' ELSE 'no' END AS label, 2 - s_suppkey % 3 AS k, round(s_acctbal / 1000) AS score FROM supplier)
SELECT a.label AS better, b.label AS worse, count(*) AS pairs, count(*) FILTER (a.score > b.score) AS correct, count(*) FILTER (a.score = b.score) AS tied FROM t a JOIN t b ON a.topic = b.topic AND a.k > b.k GROUP BY 1, 2""")
def label_pair_concordance(spark, folder):
    k = F.col("s_suppkey") % 3
    t = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("topic"), F.when(k == 0, "yes").when(k == 1, "partial").otherwise("no").alias("label"), F.round(F.col("s_acctbal") / 1000).alias("score"))
    return diagnostics.pair_concordance(t, ["topic"], "label", "score", {"yes": 2, "partial": 1, "no": 0})


@query("""SELECT p_partkey, CASE WHEN contains(' ' || lower(p_name) || ' review ', ' review ') AND p_partkey % 3 = 0 THEN 'review_or_synthesis' WHEN p_partkey % 3 = 1 THEN 'nonresearch_format' ELSE 'unclassified' END AS format_hint, CASE WHEN p_partkey % 5 = 0 THEN 'label_too_broad_for_title_check' WHEN contains(' ' || lower(p_name) || ' ', ' ' || split_part(lower(p_name), ' ', 1) || ' ') THEN 'anchor_present_in_title' END AS match FROM part""")
def title_diagnostics(spark, folder):
    k = F.col("p_partkey") % 3
    title = F.concat("p_name", F.when(k == 0, ": a Review").when(k == 1, " (Editorial)").otherwise(""))
    anchor = F.when(F.col("p_partkey") % 5 > 0, F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)))
    d = diagnostics.title_diagnostics(title, anchor)
    return table(spark, folder, "part").select("p_partkey", d["format_hint"].alias("format_hint"), d["match"].alias("match"))


@query("""SELECT lang, count(*) AS records, count(*) FILTER (trim(text) <> '') AS with_text, count(source) AS with_source, count(n_chars) AS with_n_chars FROM documents GROUP BY lang""")
def field_presence(spark, folder):
    return diagnostics.field_audit(table(spark, folder, "documents"), ["text", "source", "n_chars"], ["lang"])


@query("""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 AS k FROM orders) SELECT o_orderkey, CAST(CASE k WHEN 0 THEN d - 900 WHEN 1 THEN d - 700 ELSE d - 500 END AS VARCHAR) AS start, CAST(CASE k WHEN 0 THEN least(d, d - 9) WHEN 1 THEN d ELSE least(d, d - 29) END AS VARCHAR) AS "end", CASE k WHEN 0 THEN 'run_snapshot' WHEN 1 THEN 'pinned_query_version' ELSE 'legacy_mission_fallback' END AS origin FROM r""")
def analysis_periods(spark, folder):
    d, k = F.col("d"), F.col("o_orderkey") % 3
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    r = o.withColumns({"as_of": d, "run_from": F.when(k == 0, F.date_sub(d, 900)), "run_to": F.when(k == 0, F.date_sub(d, 10)), "query_from": F.when(k == 1, F.date_sub(d, 700)), "query_to": F.when(k == 1, F.date_add(d, 5)), "mission_from": F.date_sub(d, 500), "mission_to": F.date_sub(d, 30)})
    return diagnostics.analysis_period(r).select("o_orderkey", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "origin")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 80 AS INTEGER) AS a FROM orders), b AS (SELECT o_orderkey, CASE WHEN day(d) = 1 THEN d ELSE CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) END AS s, CAST(date_trunc('month', a) AS DATE) AS e FROM o) SELECT o_orderkey, CASE WHEN s < e THEN CAST(s AS VARCHAR) END AS start, CASE WHEN s < e THEN CAST(e AS VARCHAR) END AS "end" FROM b""")
def complete_month_profile(spark, folder):
    d = F.col("o_orderdate").cast("date")
    m = diagnostics.complete_months(d, F.date_add(d, (F.col("o_orderkey") % 80).cast("int")))
    return table(spark, folder, "orders").select("o_orderkey", m["start"].cast("string").alias("start"), m["end"].cast("string").alias("end"))


@query("""SELECT event_type, count(*) AS answers, count(*) FILTER (CASE WHEN event_type IN ('click', 'view') THEN event_id % 100000 <= 86400 ELSE event_id % 100000 <= 600 END) AS fresh FROM events GROUP BY event_type""")
def source_freshness(spark, folder):
    e = table(spark, folder, "events").select("event_type", F.when(F.col("event_type").isin("click", "view"), "complete").otherwise("failed").alias("status"), (F.col("event_id") % 100000).alias("age"))
    return e.groupBy("event_type").agg(F.count("*").alias("answers"), F.count_if(diagnostics.fresh(F.col("status"), F.col("age"))).alias("fresh"))


@query("""WITH q AS (SELECT n_nationkey, lower(n_name) AS q FROM nation), t AS (SELECT r_regionkey, lower(r_name) AS t FROM region UNION ALL SELECT 100 + n_nationkey, lower(n_name) || ' trade' FROM nation) SELECT CAST(n_nationkey AS BIGINT) AS query, CAST(r_regionkey AS BIGINT) AS theme FROM q, t WHERE (q || ' trade routes' = t) OR (len(string_split(t, ' ')) >= 2 AND contains(' ' || q || ' trade routes ', ' ' || t || ' '))""")
def theme_matches(spark, folder):
    """Queries and themes that match as whole words; both lists are short."""
    q = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("query"), F.concat("n_name", F.lit(" Trade-Routes")).alias("q"))
    t = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("theme"), F.col("r_name").alias("t")).unionAll(table(spark, folder, "nation").select((F.col("n_nationkey") + 100).cast("long"), F.concat("n_name", F.lit(" trade"))))
    return q.join(F.broadcast(t), diagnostics.theme_matches(F.col("q"), F.col("t"))).select("query", "theme")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'LLM' ELSE 'GPU,LLM' END AS missing FROM part""")
def acronym_guard(spark, folder):
    terms = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("gpu kernels"), F.col("p_name"))).otherwise(F.array("p_name"))
    return table(spark, folder, "part").select("p_partkey", F.array_join(diagnostics.missing_acronyms(F.lit("LLM on GPU, LLM"), terms), ",").alias("missing"))


CLAIMS_SQL = """d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'A survey of ' ELSE 'On ' END || source AS title, 'First words. We propose ' || lang || ' nets. ' || CASE WHEN doc_id % 2 = 0 THEN 'This paper shows ' || source || '!' ELSE 'No more.' END AS abstract FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, 'Plain ' || source, 'Nothing here.' FROM documents WHERE lang = 'fr'),
s AS (SELECT doc_id, title, unnest(string_split_regex(abstract, '(\\. |! )')) AS x, generate_subscripts(string_split_regex(abstract, '(\\. |! )'), 1) - 1 AS n FROM d), c AS (SELECT doc_id, title, n, x FROM s WHERE regexp_matches(x, '(?i)\\b(we propose|this paper shows)\\b'))"""


def _papers(spark, folder):
    plain = F.col("lang") == "fr"
    title = F.when(plain, F.concat(F.lit("Plain "), "source")).otherwise(F.concat(F.when(F.col("doc_id") % 6 == 0, "A survey of ").otherwise("On "), "source"))
    last = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("This paper shows "), "source", F.lit("!"))).otherwise("No more.")
    return table(spark, folder, "documents").select("doc_id", title.alias("title"), F.when(plain, "Nothing here.").otherwise(F.concat(F.lit("First words. We propose "), "lang", F.lit(" nets. "), last)).alias("abstract"))


@query(f"WITH {CLAIMS_SQL} SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN contains(title, 'survey') THEN 'review_or_synthesis' ELSE 'unclassified' END AS format_hint FROM c")
def claim_sentences(spark, folder):
    return diagnostics.claim_sentences(_papers(spark, folder), "doc_id", "title", "abstract").select("doc_id", "n", "format_hint")


@query(f"WITH {CLAIMS_SQL}, p AS (SELECT doc_id, bool_or(contains(x, ' en nets')) AS held FROM c GROUP BY doc_id) SELECT d.doc_id, CASE WHEN contains(title, 'survey') THEN 'no' WHEN held IS NULL THEN 'unclear' WHEN held THEN 'yes' ELSE 'no' END AS own_result, CASE WHEN contains(title, 'survey') THEN 'review_title' WHEN held IS NULL THEN 'no_explicit_own_claim_cue' WHEN held THEN 'own_claim_sentence_contains_phrase' ELSE 'own_claim_sentences_do_not_contain_phrase' END AS basis FROM d LEFT JOIN p USING (doc_id)")
def own_claims(spark, folder):
    papers = _papers(spark, folder)
    claims = diagnostics.claim_sentences(papers, "doc_id", "title", "abstract")
    return diagnostics.own_claim(papers, claims, "doc_id", "title", "en nets")


@query(f"WITH {CLAIMS_SQL} SELECT doc_id FROM (SELECT DISTINCT doc_id FROM c WHERE contains(x, 'de nets')) ORDER BY doc_id % 50 DESC, doc_id LIMIT 15")
def claim_search(spark, folder):
    """Claims that hold a phrase, latest first; the limit is what a page shows."""
    from signalweave.functions.text import has_phrase

    claims = diagnostics.claim_sentences(_papers(spark, folder), "doc_id", "title", "abstract")
    return claims.where(has_phrase(F.col("text"), "de nets")).select("doc_id").distinct().orderBy((F.col("doc_id") % 50).desc(), "doc_id").limit(15)


@query("""WITH w AS (SELECT doc_id, doc_id % 4 >= 2 AS recent, list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^a-z]+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, recent, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrase FROM w WHERE len(w) > 1)
SELECT phrase, count(*) AS works, count(*) FILTER (recent) AS recent, count(*) FILTER (NOT recent) AS prior FROM p GROUP BY phrase HAVING count(*) >= 5""")
def title_anchor_growth(spark, folder):
    """Two-word title phrases with enough works, by period."""
    words = F.filter(F.split(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))), "[^a-z]+"), lambda x: x != "")
    t = table(spark, folder, "documents").select((F.col("doc_id") % 4 >= 2).alias("recent"), F.explode(F.array_distinct(phrases.ngrams(words, 2, 2))).alias("phrase"))
    return t.groupBy("phrase").agg(F.count("*").alias("works"), F.count_if("recent").alias("recent"), F.count_if(~F.col("recent")).alias("prior")).where("works >= 5")


@query("""WITH f AS (SELECT o_custkey AS family, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1) SELECT o_orderpriority AS topic, count(*) AS works, count(*) FILTER (o_orderkey = first) AS representatives FROM orders JOIN f ON f.family = o_custkey GROUP BY 1""")
def family_sensitivity(spark, folder):
    """Works of each topic, and those left when only a family's earliest counts."""
    o = table(spark, folder, "orders")
    first = o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))
    return o.join(first, "o_custkey").groupBy(F.col("o_orderpriority").alias("topic")).agg(F.count("*").alias("works"), F.count_if(F.col("o_orderkey") == F.col("first")).alias("representatives"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate >= TIMESTAMP '2000-01-01') SELECT coalesce(a.k, b.k) AS work, CASE WHEN b.k IS NULL THEN 'old_only' ELSE 'new_only' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def nested_cohort_audit(spark, folder):
    """Works that one of two cohorts of the same query lacks, by one pass."""
    early, late = F.col("o_orderdate") < F.lit("1997-01-01"), (F.col("o_orderdate") < F.lit("1996-01-01")) | (F.col("o_orderdate") >= F.lit("2000-01-01"))
    per = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("work")).agg(F.bool_or(early).alias("a"), F.bool_or(late).alias("b"))
    return per.where("a <> b").select("work", F.when(F.col("a"), "old_only").otherwise("new_only").alias("side"))


@query(f"""WITH m AS (SELECT source, doc_id, CASE WHEN doc_id % 12 >= 8 THEN 2021 ELSE 2020 END AS fy, {HAS('license')} AS hit, {HAS('license').replace('text', "split_part(text, chr(10), 1)")} AS titled FROM documents) SELECT source, count(*) FILTER (hit) AS works, count(*) FILTER (titled) AS title_works, count(*) FILTER (hit AND fy = 2020) AS first_year, count(*) FILTER (hit AND fy = 2021) AS second_year FROM m GROUP BY source""")
def cross_source_support(spark, folder):
    """Exact mentions of a phrase in each source, in titles and in two fiscal years that begin in September."""
    from signalweave.functions.text import has_phrase

    day = F.make_date(F.lit(2021), (F.col("doc_id") % 12 + 1).cast("int"), F.lit(1))
    hit, titled = has_phrase(F.col("text"), "license"), has_phrase(F.split_part("text", F.lit("\n"), F.lit(1)), "license")
    fy = series.fiscal_year(day)
    return table(spark, folder, "documents").groupBy("source").agg(F.count_if(hit).alias("works"), F.count_if(titled).alias("title_works"), F.count_if(hit & (fy == 2020)).alias("first_year"), F.count_if(hit & (fy == 2021)).alias("second_year"))


@query("""WITH r AS (SELECT s_suppkey, s_nationkey AS family, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) SELECT CAST(n_nationkey AS BIGINT) AS family, min(rank) AS best_rank, count(rank) AS members, coalesce(min(rank) <= 15, FALSE) AS in_top_15 FROM nation LEFT JOIN r ON r.family = n_nationkey GROUP BY n_nationkey""")
def control_recovery(spark, folder):
    """Where each control family stands in a ranking."""
    ranked = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.row_number().over(W.orderBy(F.col("s_acctbal").desc(), "s_suppkey")).cast("long").alias("rank"))
    t = table(spark, folder, "nation").join(ranked, "n_nationkey", "left")
    return t.groupBy(F.col("n_nationkey").cast("long").alias("family")).agg(F.min("rank").alias("best_rank"), F.count("rank").alias("members"), F.coalesce(F.min("rank") <= 15, F.lit(False)).alias("in_top_15"))


@query("""WITH t AS (SELECT c_mktsegment AS card, c_custkey AS pair, ntile(3) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS tertile FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY card, tertile ORDER BY sha256('pairs:' || pair), pair) AS place FROM t) SELECT card, pair, tertile, place FROM r WHERE place <= 5""")
def tertile_pair_sample(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("card"), F.col("c_custkey").alias("pair"), "c_acctbal")
    return diagnostics.tertile_sample(c, "card", "c_acctbal", "pair", "pairs", 5).select("card", "pair", F.col("tertile").cast("long"), F.col("place").cast("long"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 2 AS source, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) AS rn FROM orders) SELECT k, o_orderkey AS record, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rn, source) AS n FROM s) WHERE n = 1""")
def key_only_merge(spark, folder):
    """Two sources in turns; the first record of a key stays. Ranks within a source come from its ordered ids."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("record"), (F.col("o_orderkey") % 2).alias("source"))
    placed = o.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy("record")))
    return placed.groupBy("k").agg(F.min(F.struct("rn", "source", "record")).alias("x")).select("k", "x.record", "x.source")


@query("""SELECT o_orderstatus AS before, CASE WHEN o_totalprice > 200000 THEN 'include' ELSE 'exclude' END AS after, count(*) AS topics FROM orders GROUP BY 1, 2""")
def cluster_run_comparison(spark, folder):
    o = table(spark, folder, "orders")
    before, after = o.select("o_orderkey", F.col("o_orderstatus").alias("before")), o.select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "include").otherwise("exclude").alias("after"))
    return before.join(after, "o_orderkey").groupBy("before", "after").agg(F.count("*").alias("topics"))


@query("""WITH p AS (SELECT page_id, regexp_replace(trim(url), '[./]+$', '') AS u FROM pages), h AS (SELECT page_id, u, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, lower(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')) AS path FROM p) SELECT page_id, CASE WHEN host <> '' AND path <> '' THEN 'url:' || host || path END AS key FROM h""")
def url_identity_keys(spark, folder):
    return table(spark, folder, "pages").select("page_id", diagnostics.url_key(F.col("url")).alias("key"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), l(hi, lo) AS (SELECT c_custkey, c_custkey - 1 FROM customer WHERE c_custkey > 1) SELECT count(*) AS declared, count(*) FILTER (x.n > y.n) AS held, count(*) FILTER (x.n IS NULL OR y.n IS NULL) AS unknown FROM l LEFT JOIN a x ON x.k = hi LEFT JOIN a y ON y.k = lo""")
def declared_order_checks(spark, folder):
    """Listed pairs of which the first should stand higher."""
    a = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    pairs = table(spark, folder, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("hi"), (F.col("c_custkey") - 1).alias("lo"))
    t = pairs.join(a.select(F.col("o_custkey").alias("hi"), F.col("n").alias("x")), "hi", "left").join(a.select(F.col("o_custkey").alias("lo"), F.col("n").alias("y")), "lo", "left")
    return t.agg(F.count("*").alias("declared"), F.count_if(F.col("x") > F.col("y")).alias("held"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unknown"))


@query("""WITH a AS (SELECT doc_id FROM documents WHERE contains(text, 'the')), b AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT CASE WHEN b.doc_id IS NULL THEN 'found_only' WHEN a.doc_id IS NULL THEN 'labelled_only' ELSE 'both' END AS side, count(*) AS works FROM a FULL JOIN b USING (doc_id) GROUP BY 1""")
def follow_up_coverage(spark, folder):
    """Found works against those that developers labelled."""
    a = table(spark, folder, "documents").where(F.contains("text", F.lit("the"))).select("doc_id", F.lit(1).alias("a"))
    b = table(spark, folder, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("b"))
    side = F.when(F.col("b").isNull(), "found_only").when(F.col("a").isNull(), "labelled_only").otherwise("both")
    return a.join(b, "doc_id", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("works"))


@query("""SELECT c_mktsegment AS profile, n_regionkey AS focus, count(*) AS cells, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def focus_area_matrix(spark, folder):
    """Profiles by focus areas, counted from rows instead of an empty grid."""
    t = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return t.groupBy(F.col("c_mktsegment").alias("profile"), F.col("n_regionkey").alias("focus")).agg(F.count("*").alias("cells"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("""SELECT o_custkey AS id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS missions, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey""")
def complete_cohorts(spark, folder):
    """The first work of an id stands; the missions that found it are joined."""
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("missions"), F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@query("""SELECT s_suppkey AS work FROM supplier WHERE s_suppkey % 7 = 0""")
def selected_against_index(spark, folder):
    """Works whose fields differ between a selection and the index."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("work"), "s_name", "s_nationkey")
    index = s.withColumn("s_name", F.when(F.col("work") % 7 == 0, F.upper(F.concat("s_name", F.lit("x")))).otherwise(F.col("s_name")))
    return s.exceptAll(index).select("work")


@query(None)
def complete_link_groups(spark, folder):
    """Complete-link groups of each label; tested against plain loops."""
    e = table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", "embedding")
    return diagnostics.complete_link(e, "label", "vec_id", "embedding", 0.15)


@query("""SELECT event_type, CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_daily_counts(spark, folder):
    """Daily counts of a stream of files behind a watermark, run until the files are read; every window is kept."""
    scratch = Scratch(spark, "stream")
    source = scratch.save(table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts")), "events")
    counts = windows.windowed_counts(spark.readStream.schema(source.schema).parquet(f"{scratch.path}/events"), "ts", "event_type", "1 day", "2 days")
    out = counts.select("event_type", F.date_format(F.col("window.start") if "window" in counts.columns else F.col("start"), "yyyy-MM-dd HH:mm:ss").alias("start"), F.col([c for c in counts.columns if c not in ("window", "start", "end", "event_type")][0]).alias("n"))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{scratch.path}/counts")
    out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{scratch.path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{scratch.path}/counts")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS events FROM s GROUP BY user_id""")
def session_windows(spark, folder):
    """Sessions that end after six silent hours; the same function serves streams."""
    e = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    t = windows.session_counts(e, "ts", "user_id", "6 hours", "1 day")
    n = [c for c in t.columns if c not in ("user_id", "window", "start", "end", "session_window")][0]
    return t.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum(n).alias("events"))


@query("""SELECT count(DISTINCT event_id % 1000) AS stored FROM events""")
def exactly_once_append(spark, folder):
    """A stream whose batches are replayed: each content hash is stored once."""
    scratch = Scratch(spark, "once")
    source = scratch.save(table(spark, folder, "events").select(F.sha2((F.col("event_id") % 1000).cast("string"), 256).alias("content_sha256"), F.lit("events").alias("source")), "events")
    for run in range(2):
        stream = spark.readStream.schema(source.schema).parquet(f"{scratch.path}/events")
        stream.writeStream.foreachBatch(windows.append_once(f"{scratch.path}/stored")).option("checkpointLocation", f"{scratch.path}/state_{run}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{scratch.path}/stored").agg(F.count("*").alias("stored"))
