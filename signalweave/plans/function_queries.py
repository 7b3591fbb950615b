"""Queries over functions of single rows and small groups: labels, acronyms, admission, packs, suggestions, families."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.operators import identity, phrases, scoring
from signalweave.plans.registry import query
from signalweave.sources import evidence, publications
from signalweave.storage import Scratch, table


@query("""WITH i AS (SELECT doc_id AS item, lang AS axis, doc_id % 3 AS kind, doc_id % 50 AS plant, doc_id % 11 <> 0 AS fresh, doc_id % 7 = 0 AS unsafe, doc_id % 17 = 0 AS repeated,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE DATE '2024-06-01' + CAST(doc_id % 400 AS INTEGER) END AS day FROM documents),
r AS (SELECT *, CASE WHEN NOT fresh THEN 'stale_answer' WHEN unsafe THEN 'no_safe_link' WHEN repeated THEN 'repeated_by_source' WHEN kind = 2 THEN 'too_few_topic_words' WHEN day IS NULL THEN 'no_date' WHEN day > DATE '2025-01-01' THEN 'date_ahead' END AS reason FROM i),
t AS (SELECT *, row_number() OVER (PARTITION BY axis, plant, reason IS NULL, kind = 2 ORDER BY item) AS told FROM r)
SELECT item, CASE WHEN kind = 2 THEN '' ELSE 'robot|soft' END AS matched, CASE WHEN reason IS NULL AND told > 1 THEN 'story_told_before' ELSE reason END AS reason FROM t""")
def admitted_materials(spark, folder):
    """External materials with the first rule that keeps each out: freshness, link, repeats, words, dates, stories told before."""
    n = F.col("doc_id")
    plant = (n % 50).cast("string")
    title = F.when(n % 3 == 0, F.concat(F.lit("Soft robots of plant "), plant)).when(n % 3 == 1, F.concat(F.lit("A soft ROBOT for Plant "), plant)).otherwise(F.concat(F.lit("Garden news "), plant))
    day = F.when(n % 13 != 0, F.date_add(F.lit("2024-06-01").cast("date"), (n % 400).cast("int")))
    url = F.when(n % 7 == 0, F.concat(F.lit("https://user:secret@news.example.org/"), n)).otherwise(F.concat(F.lit("https://news.example.org/"), n))
    items = table(spark, folder, "documents").select(n.alias("item"), F.col("lang").alias("axis"), title.alias("title"), url.alias("url"), day.alias("day"), (n % 11 != 0).alias("fresh"), (n % 17 == 0).alias("repeated"))
    return evidence.admitted(items, F.array(F.lit("soft"), F.lit("robot")), "2025-01-01").select("item", F.array_join("matched", "|").alias("matched"), "reason")


@query("""WITH RECURSIVE w AS (SELECT doc_id AS work, doc_id // 6 AS t, DATE '2020-01-01' + CAST(doc_id % 6 * 250 AS INTEGER) AS day, CASE WHEN doc_id % 3 = 0 THEN doc_id // 12 END AS doi, source AS abstract FROM documents),
l AS (SELECT a.work AS a, b.work AS b FROM w a JOIN w b ON a.t = b.t AND abs(a.day - b.day) <= 730 AND (a.doi = b.doi OR a.abstract = b.abstract)), r(work, other) AS (SELECT work, work FROM w UNION SELECT r.work, l.b FROM r JOIN l ON l.a = r.other)
SELECT work, min(other) AS family FROM r GROUP BY work""")
def version_families(spark, folder):
    """Documents as versions: one title, days not far apart, and a DOI or an abstract in common."""
    n = F.col("doc_id")
    works = table(spark, folder, "documents").select(n.alias("work"), F.concat(F.lit("title "), F.floor(n / 6)).alias("title_key"), F.date_add(F.lit("2020-01-01").cast("date"), (n % 6 * 250).cast("int")).alias("day"), F.when(n % 3 == 0, F.concat(F.lit("10.1/"), F.floor(n / 12))).alias("doi"), F.md5("source").alias("abstract"))
    return identity.version_families(works)


@query("""WITH p AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS full_form, upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1) || substr(p_type, 1, 1)) AS short FROM part)
SELECT p_partkey, short AS acronym, full_form AS long_form, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS definitions FROM p WHERE p_partkey % 5 <> 0""")
def defined_acronyms(spark, folder):
    """Acronyms that a text defines itself; a wrong one, every fifth, resolves nothing."""
    full = F.concat_ws(" ", "p_name", F.lower("p_type"))
    initial = lambda c: F.upper(F.substring(c, 1, 1))
    short = F.concat(initial(F.col("p_name")), initial(F.split("p_name", " ")[1]), initial(F.col("p_type")))
    says = F.concat(F.lit("We study the "), full, F.lit(" ("), F.when(F.col("p_partkey") % 5 == 0, "QQQ").otherwise(short), F.lit(") at length."))
    t = table(spark, folder, "part").select("p_partkey", says.alias("title"), F.when(F.col("p_partkey") % 4 == 0, says).otherwise(F.lit("Nothing (HERE) is defined.")).alias("abstract"))
    return phrases.acronyms(t, "p_partkey", ["title", "abstract"])


@query("""WITH c AS (SELECT p_brand, p_name AS term, count(*) AS n FROM part WHERE p_name <> 'red widget' GROUP BY p_brand, p_name)
SELECT p_brand, arg_max(term, (n, length(term), term)) AS label, max(n) AS works FROM c GROUP BY p_brand""")
def topic_labels(spark, folder):
    """The most counted name of each brand that is not the seed itself."""
    t = table(spark, folder, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    return phrases.topic_labels(t, "p_brand", "p_name", "n", ["Red  Widget"])


_C = scoring.Confirmation()


@query(f"""WITH o AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS dual, count(*) FILTER (l_returnflag <> 'N') AS total FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(CASE WHEN l_orderkey % 3 > 0 AND total > 0 THEN least(1.0, dual / total) ELSE least({_C.cap}, {_C.base} + {_C.step} * dual) END, 9) AS independence FROM o""")
def confirmation_independence(spark, folder):
    """How independent each order's confirmations are, and what is said where sources cannot be compared."""
    o = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("dual"), F.count_if(F.col("l_returnflag") != "N").alias("total"))
    return o.select("l_orderkey", F.round(scoring.confirmation_independence(F.col("dual"), F.col("total"), F.col("l_orderkey") % 3 > 0), 9).alias("independence"))


@query("""SELECT target, count(*) AS rows, count(DISTINCT doc_id) AS works, sum(length(text))::BIGINT AS letters FROM (SELECT unnest([lang, source, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END]) AS target, doc_id, text FROM documents) GROUP BY target""")
def target_packs(spark, folder):
    """Overlapping packs by language, source and length, written once and read back by folder."""
    scratch = Scratch(spark, "packs")
    d = table(spark, folder, "documents").select("doc_id", "text", F.array("lang", "source", F.when(F.col("n_chars") > 500, "long").otherwise("short")).alias("targets"))
    publications.write_targets(d, "targets", f"{scratch.path}/packs")
    t = spark.read.option("basePath", f"{scratch.path}/packs").parquet(f"{scratch.path}/packs")
    return t.groupBy(F.col("target").cast("string").alias("target")).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("works"), F.sum(F.length("text")).alias("letters"))


@query("""WITH p AS (SELECT p_partkey, unnest(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type), p_brand])) AS phrase, contains(p_name, 'widget') AS seed FROM part)
SELECT phrase, count(*) FILTER (seed) AS support, count(*) AS docs, count(*) FILTER (seed) / count(*) AS lift FROM p GROUP BY phrase HAVING count(*) FILTER (seed) >= 2 ORDER BY support DESC, phrase LIMIT 20""")
def query_suggestions(spark, folder):
    """What the parts that match a seed have in common, best supported first (a top-20 report)."""
    words = F.split("p_name", " ")
    t = table(spark, folder, "part").withColumn("phrases", F.array(words[0], words[1], F.lower("p_type"), "p_brand"))
    return phrases.suggest(t, "phrases", F.contains("p_name", F.lit("widget")), 20)
