"""Identity, link and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.operators import identity
from signalweave.operators.components import components_bounded
from signalweave.plans.registry import query
from signalweave.storage import Scratch, table


@query("""WITH c AS (SELECT l_partkey AS doi, 'title ' || (l_orderkey % 3) AS k, list_sort(list(DISTINCT l_suppkey)) AS authors, CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey % 8 END AS ax FROM lineitem GROUP BY l_partkey, l_orderkey),
ids AS (SELECT doi, count(DISTINCT ax) > 1 AS a FROM c GROUP BY doi), d AS (SELECT DISTINCT doi, k, authors FROM c), s AS (SELECT DISTINCT x.doi FROM d x JOIN d y ON x.doi = y.doi AND x.k < y.k AND NOT list_has_any(x.authors, y.authors))
SELECT CAST(doi AS VARCHAR) AS doi, a AS distinct_arxiv_ids, s.doi IS NOT NULL AS conflicting_titles FROM ids LEFT JOIN s USING (doi) WHERE a OR s.doi IS NOT NULL""")
def doi_conflicts(spark, folder):
    per = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("doi"), "l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("authors"))
    claims = per.select("doi", F.concat(F.lit("title "), F.col("l_orderkey") % 3).alias("title_key"), "authors", F.when(F.col("l_orderkey") % 4 == 0, (F.col("l_orderkey") % 8).cast("string")).alias("arxiv_id"))
    return identity.doi_conflicts(claims).select("doi", "distinct_arxiv_ids", "conflicting_titles")


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderpriority || o_orderstatus || (o_custkey % 50) AS k, o_custkey % 20 AS a1, o_orderkey % 20 AS a2, o_orderkey % 2 AS side FROM orders)
SELECT x.id AS record, min(y.id) AS work FROM t x JOIN t y ON x.k = y.k AND x.side = 1 AND y.side = 0 AND (x.a1 = y.a1 OR x.a1 = y.a2 OR x.a2 = y.a1 OR x.a2 = y.a2) GROUP BY x.id""")
def title_author_match(spark, folder):
    k = F.concat("o_orderpriority", "o_orderstatus", F.col("o_custkey") % 50)
    none = F.array().cast("array<string>")
    t = table(spark, folder, "orders").select("o_orderkey", k.alias("title_key"), F.array(F.col("o_custkey") % 20, F.col("o_orderkey") % 20).alias("authors"), none.alias("dois"), none.alias("arxiv_ids"))
    a, b = t.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "record"), t.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "work")
    return identity.title_author_matches(a, b)


@query("""SELECT o_custkey AS work, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS day, count(*) AS versions, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderpriority <> '5-LOW') AS priority FROM orders GROUP BY o_custkey""")
def earliest_date_coalesce(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("work"), F.col("o_orderdate").cast("date").alias("day"), "o_orderdate", "o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"))
    return identity.canonical_works(rows, "work", "day", ["o_orderdate", "o_orderkey"], ["priority"]).select("work", F.col("day").cast("string").alias("day"), "versions", "priority")


@query("""WITH l AS (SELECT * FROM (VALUES (1, 'url'), (2, 'doi')) t(rank, kind)), k AS (SELECT c_custkey AS work, 'doi' AS kind, c_custkey % 97 AS v FROM customer UNION ALL SELECT c_custkey, 'url', c_custkey % 89 FROM customer),
i AS (SELECT o_orderkey AS record, 'doi' AS kind, o_orderkey % 211 AS v FROM orders UNION ALL SELECT o_orderkey, 'url', o_orderkey % 311 FROM orders)
SELECT record, min((rank, work))[2] AS work FROM i JOIN k USING (kind, v) JOIN l USING (kind) GROUP BY record""")
def identifier_lookup(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    known = c.select(F.col("c_custkey").alias("work"), F.lit("doi").alias("kind"), (F.col("c_custkey") % 97).alias("value")).unionAll(c.select("c_custkey", F.lit("url"), F.col("c_custkey") % 89))
    incoming = o.select(F.col("o_orderkey").alias("record"), F.lit("doi").alias("kind"), (F.col("o_orderkey") % 211).alias("value")).unionAll(o.select("o_orderkey", F.lit("url"), F.col("o_orderkey") % 311))
    return identity.identifier_lookup(incoming, known, ["url", "doi"])


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS a, 1000000000 + o_custkey AS b FROM orders UNION ALL SELECT 1000000000 + c_custkey, 1000000000 + CAST(floor(c_custkey / 3) * 3 AS BIGINT) FROM customer), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, m) AS (SELECT a, a FROM b UNION SELECT r.n, b.b FROM r JOIN b ON b.a = r.m), c AS (SELECT n AS node, min(m) AS component FROM r GROUP BY n)
SELECT component, count(*) AS nodes FROM c GROUP BY component""")
def component_sizes(spark, folder):
    """Orders, their customers and households of three customers."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 1_000_000_000).alias("dst"))
    homes = table(spark, folder, "customer").select((F.col("c_custkey") + 1_000_000_000).alias("src"), (F.floor(F.col("c_custkey") / 3) * 3 + 1_000_000_000).alias("dst"))
    return components_bounded(orders.unionAll(homes), Scratch(spark, "components")).groupBy("component").agg(F.count("*").alias("nodes"))


@query("""WITH RECURSIVE n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey - 1 END AS up FROM nation), c(id, up, root, depth) AS (SELECT id, up, id, 0 FROM n WHERE up IS NULL UNION ALL SELECT n.id, n.up, c.root, c.depth + 1 FROM n JOIN c ON n.up = c.id)
SELECT CAST(id AS BIGINT) AS id, CAST(root AS BIGINT) AS root, CAST(depth AS BIGINT) AS depth FROM c""")
def recursive_chain(spark, folder):
    """Each run's chain to its root run, by a recursive query."""
    view = "signalweave_chain_nation"
    table(spark, folder, "nation").createOrReplaceTempView(view)
    return spark.sql(f"""WITH RECURSIVE n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey - 1 END AS up FROM {view}),
    c(id, up, root, depth) AS (SELECT id, up, id, 0 FROM n WHERE up IS NULL UNION ALL SELECT n.id, n.up, c.root, c.depth + 1 FROM n JOIN c ON n.up = c.id)
    SELECT CAST(id AS BIGINT) AS id, CAST(root AS BIGINT) AS root, CAST(depth AS BIGINT) AS depth FROM c""")


@query("""WITH RECURSIVE i AS (SELECT doc_id AS item, source || (doc_id % 40) AS k, lang FROM documents),
l AS (SELECT a.item AS a, b.item AS b FROM i a JOIN i b ON a.k = b.k UNION SELECT doc_id, doc_id + 200 FROM documents WHERE doc_id % 7 = 0 AND doc_id + 200 IN (SELECT doc_id FROM documents)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(item, other) AS (SELECT item, item FROM i UNION SELECT r.item, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT item, min(other) AS component FROM r GROUP BY item), g AS (SELECT component, count(DISTINCT lang) <= 1 AS accepted FROM c JOIN i USING (item) GROUP BY component)
SELECT item, component, accepted FROM c JOIN g USING (component)""")
def material_groups(spark, folder):
    """Documents by shared keys and by declared relations; a component of several languages is rejected whole."""
    d = table(spark, folder, "documents")
    items = d.select(F.col("doc_id").alias("item"), F.array(F.concat("source", F.col("doc_id") % 40)).alias("keys"), "lang")
    links = d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 200).alias("dst")).join(d.select(F.col("doc_id").alias("dst")), "dst", "left_semi")
    return identity.material_groups(items, links, "lang")


@query("""WITH p AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS w FROM orders GROUP BY o_custkey) SELECT sha256('[' || array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') || ']') AS composition, o_custkey, count(*) AS works FROM orders GROUP BY o_custkey""")
def composition_hashes(spark, folder):
    from signalweave.functions.text import composition_hash

    return table(spark, folder, "orders").groupBy("o_custkey").agg(composition_hash(F.collect_set("o_orderkey")).alias("composition"), F.count("*").alias("works"))


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_custkey % 300 AS t, c_nationkey AS y, c_custkey % 501 AS doi FROM customer), x AS (SELECT * FROM a WHERE id % 2 = 0), y AS (SELECT * FROM a WHERE id % 2 = 1),
m AS (SELECT x.id AS a, y.id AS b, x.doi = y.doi AS sd, x.t = y.t AS st, x.seg = y.seg AS sa, abs(x.y - y.y) AS ya FROM x JOIN y ON x.doi = y.doi OR x.t = y.t)
SELECT a, b, CASE WHEN sd AND st THEN 'confirmed' WHEN st AND sa AND ya <= 2 THEN 'probable' ELSE 'review' END AS status FROM m""")
def cross_source_links(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.array("c_mktsegment").alias("authors"), (F.col("c_custkey") % 300).alias("title_key"), F.col("c_nationkey").alias("year"), (F.col("c_custkey") % 501).alias("doi"))
    return identity.cross_links(c.where("id % 2 = 0"), c.where("id % 2 = 1")).select("a", "b", "status")


@query("""WITH RECURSIVE w AS (SELECT l_partkey AS topic, l_orderkey * 10 + l_linenumber AS work, l_suppkey AS org, l_orderkey AS author FROM lineitem),
e AS (SELECT a.topic, a.work AS a, b.work AS b FROM w a JOIN w b ON a.topic = b.topic AND (a.org = b.org OR a.author = b.author)),
r(topic, work, other) AS (SELECT topic, work, work FROM w UNION SELECT r.topic, r.work, e.b FROM r JOIN e ON e.topic = r.topic AND e.a = r.other)
SELECT topic::VARCHAR AS topic, count(DISTINCT c) AS teams FROM (SELECT topic, work, min(other) AS c FROM r GROUP BY topic, work) GROUP BY topic""")
def team_proxy(spark, folder):
    """Independent teams per part: lines that share a supplier, or the order, are one team's."""
    t = table(spark, folder, "lineitem").select(F.col("l_partkey").cast("string").alias("topic"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("work"), F.array("l_suppkey").alias("orgs"), F.array("l_orderkey").alias("people"))
    return identity.teams(t, "work", "people", "orgs")


@query("""WITH RECURSIVE r AS (SELECT o_orderkey AS k, o_custkey % 60 AS g, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_custkey % 60 ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT'),
f(k, g, d, n, ad, ak) AS (SELECT k, g, d, n, d, k FROM r WHERE n = 1 UNION ALL SELECT r.k, r.g, r.d, r.n, CASE WHEN r.d - f.ad > 365 THEN r.d ELSE f.ad END, CASE WHEN r.d - f.ad > 365 THEN r.k ELSE f.ak END FROM f JOIN r ON r.g = f.g AND r.n = f.n + 1)
SELECT k AS o_orderkey, ak AS family FROM f""")
def variant_families(spark, folder):
    from signalweave.operators import topics

    o = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_custkey") % 60).alias("g"), F.col("o_orderdate").cast("date").alias("d"))
    return topics.variant_families(o, ["g"], "d", "o_orderkey")


@query("""WITH c AS (SELECT o_orderstatus AS channel, o_orderpriority AS stage, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY sha256('quota' || chr(0) || o_orderkey::VARCHAR), o_orderkey) AS t FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t, stage) AS place, dense_rank() OVER (ORDER BY channel) - 1 AS c FROM c), k AS (SELECT count(DISTINCT channel) AS k FROM c)
SELECT o_orderkey, channel, stage FROM p, k WHERE place <= floor(50 / k) + CASE WHEN c < 50 % k THEN 1 ELSE 0 END""")
def quota_sample(spark, folder):
    from signalweave.operators import ranking, topics

    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("channel"), F.col("o_orderpriority").alias("stage"))
    return topics.quota_sample(o, "channel", "stage", F.struct(ranking.hash_order("quota", "o_orderkey"), "o_orderkey"), 50)


@query("""WITH RECURSIVE t AS (SELECT c_custkey AS k FROM customer), l AS (SELECT k AS a, k + 50 AS b FROM t WHERE k % 3 = 0 AND k + 50 IN (SELECT k FROM t) UNION SELECT k, k // 2 FROM t WHERE k % 10 = 0),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(k, other) AS (SELECT k, k FROM t UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.other)
SELECT k AS topic, min(other) AS family FROM r GROUP BY k""")
def lineage_families(spark, folder):
    """Customers as saved topics, joined by two kinds of lineage."""
    t = table(spark, folder, "customer").select(F.col("c_custkey").alias("topic"))
    onward = t.where("topic % 3 = 0").select(F.col("topic").alias("left"), (F.col("topic") + 50).alias("right")).join(t.select(F.col("topic").alias("right")), "right", "left_semi")
    back = t.where("topic % 10 = 0").select(F.col("topic").alias("left"), F.floor(F.col("topic") / 2).alias("right"))
    return identity.lineage_families(t, onward.unionByName(back))
