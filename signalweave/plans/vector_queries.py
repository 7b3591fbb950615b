"""Embedding queries; labels stand for topics and ids for days."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.functions.vectors import cosine
from signalweave.operators import vectors
from signalweave.plans.registry import query
from signalweave.storage import table

E_SQL = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, floor(vec_id / 100)::BIGINT AS win FROM embeddings), u AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12)) AS n FROM e)"
C_SQL = E_SQL + ", x AS (SELECT label, win, generate_subscripts(v, 1) AS d, unnest(v) AS y FROM e), c AS (SELECT label, list(m ORDER BY d) AS v FROM (SELECT label, d, avg(y) AS m FROM x GROUP BY label, d) GROUP BY label)"


def emb(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding", F.floor(F.col("vec_id") / 100).alias("win"))


@query(f"""WITH {E_SQL}, p AS (SELECT q.vec_id, a.vec_id AS near, round(list_inner_product(q.n, a.n), 12) AS s FROM u q JOIN u a ON q.vec_id <> a.vec_id AND q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near) AS rank FROM p)
SELECT vec_id, near AS near_vec_id, rank, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def cosine_topk(spark, folder):
    e = emb(spark, folder)
    t = vectors.nearest(e.where("vec_id % 100 = 0"), "vec_id", "embedding", e, "vec_id", "embedding", 5, exclude_self=True)
    return t.select("vec_id", "near_vec_id", F.col("rank").cast("long"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {C_SQL} SELECT label, round(v[1], 6) AS first, round(sqrt(list_inner_product(v, v)), 6) AS length, (SELECT count(*) FROM e WHERE e.label = c.label) AS works FROM c")
def label_centroids(spark, folder):
    from signalweave.functions.vectors import norm

    t = vectors.centroids(emb(spark, folder), ["label"])
    return t.select(F.col("label").cast("int").alias("label"), F.round(F.col("centroid")[0], 6).alias("first"), F.round(norm(F.col("centroid")), 6).alias("length"), "works")


@query(f"""WITH {E_SQL} SELECT a.label, count(DISTINCT a.vec_id) + 1 AS works, round(avg(list_inner_product(a.n, b.n)), 6) AS coherence FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def coherence_exact(spark, folder):
    t = vectors.coherence(emb(spark, folder), ["label"])
    return t.select(F.col("label").cast("int").alias("label"), "works", F.round("coherence", 6).alias("coherence"))


@query(f"""WITH {C_SQL}, k AS (SELECT label, (label * 7 % 10) AS born, v FROM c), p AS (SELECT a.label, a.born, max(list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-12) * (sqrt(list_inner_product(b.v, b.v)) + 1e-12))) AS s FROM k a LEFT JOIN k b ON b.born < a.born GROUP BY a.label, a.born)
SELECT label, born, round(1 - s, 6) AS novelty FROM p""")
def novelty_prior(spark, folder):
    anchors = vectors.centroids(emb(spark, folder), ["label"]).withColumn("born", F.col("label") * 7 % 10)
    t = vectors.novelty_before(anchors, "label", "born", "centroid")
    return t.select(F.col("label").cast("int").alias("label"), F.col("born").cast("int").alias("born"), F.round("novelty", 6).alias("novelty"))


@query(f"""WITH {C_SQL}, p AS (SELECT e.vec_id, c.label AS nearest, round(list_inner_product(e.v, c.v) / ((sqrt(list_inner_product(e.v, e.v)) + 1e-12) * (sqrt(list_inner_product(c.v, c.v)) + 1e-12)), 12) AS s FROM e, c)
SELECT vec_id, CAST(nearest AS BIGINT) AS nearest, round(1 - s, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nearest) AS r FROM p) WHERE r = 1""")
def nearest_anchor(spark, folder):
    e = emb(spark, folder)
    t = vectors.nearest_background(e, "vec_id", "embedding", vectors.centroids(e, ["label"]), "label", "centroid")
    return t.select("vec_id", "nearest", F.round("distance", 6).alias("distance"))


@query(f"""WITH {E_SQL}, p AS (SELECT a.vec_id, b.vec_id AS near, greatest(-1, least(1, round(list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-12) * (sqrt(list_inner_product(b.v, b.v)) + 1e-12)), 12))) AS s
  FROM e a JOIN e b ON (floor(b.vec_id / 3) < floor(a.vec_id / 3) OR (floor(b.vec_id / 3) = floor(a.vec_id / 3) AND b.vec_id < a.vec_id)) AND floor(a.vec_id / 3) - floor(b.vec_id / 3) <= 30), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near) AS rank FROM p)
SELECT vec_id, near, rank, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def temporal_knn(spark, folder):
    e = emb(spark, folder).withColumn("day", F.floor(F.col("vec_id") / 3))
    t = vectors.temporal_neighbours(e, "vec_id", "day", "embedding", 5, 30, 30)
    return t.select("vec_id", "near", F.col("rank").cast("long"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {E_SQL}, x AS (SELECT label, win, generate_subscripts(v, 1) AS d, unnest(v) AS y FROM e), c AS (SELECT label, win, list(m ORDER BY d) AS v FROM (SELECT label, win, d, avg(y) AS m FROM x GROUP BY ALL) GROUP BY ALL),
f AS (SELECT *, first_value(v) OVER (PARTITION BY label ORDER BY win) AS z FROM c)
SELECT label, win, (SELECT count(*) FROM e WHERE e.label = f.label AND e.win = f.win) AS works, round(1 - list_inner_product(v, z) / ((sqrt(list_inner_product(v, v)) + 1e-12) * (sqrt(list_inner_product(z, z)) + 1e-12)), 6) AS drift FROM f""")
def centroid_drift(spark, folder):
    t = vectors.drift(emb(spark, folder), "label", "win", "embedding")
    return t.select(F.col("label").cast("int").alias("label"), "win", "works", F.round(F.greatest("drift", F.lit(0.0)), 6).alias("drift"))


P_SQL = E_SQL + """, x AS (SELECT label, win, generate_subscripts(v, 1) AS d, unnest(v) AS y FROM e), c AS (SELECT label, win, list(m ORDER BY d) AS v FROM (SELECT label, win, d, avg(y) AS m FROM x GROUP BY ALL) GROUP BY ALL),
p AS (SELECT a.win, a.label AS child, b.label AS parent, list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-12) * (sqrt(list_inner_product(b.v, b.v)) + 1e-12)) AS s FROM c a JOIN c b ON b.win = a.win - 1)"""


def _window_pairs(spark, folder):
    c = vectors.centroids(emb(spark, folder), ["label", "win"])
    a, b = c.alias("a"), c.withColumn("win", F.col("win") + 1).alias("b")
    return a.join(b, F.col("a.win") == F.col("b.win")).select(F.col("a.win").alias("win"), F.col("a.label").alias("child"), F.col("b.label").alias("parent"), cosine(F.col("a.centroid"), F.col("b.centroid")).alias("s"))


@query(f"WITH {P_SQL}, q AS (SELECT win, quantile_cont(s, 0.5) AS m, quantile_cont(s, 0.99) AS h FROM p GROUP BY win) SELECT win, round(m, 6) AS median, round(CASE WHEN m < 0.8 THEN 0.7 ELSE greatest(0.7, h) END, 6) AS threshold FROM q")
def adaptive_threshold(spark, folder):
    t = vectors.adaptive_threshold(_window_pairs(spark, folder), "s", ["win"])
    return t.select("win", F.round("median", 6).alias("median"), F.round("threshold", 6).alias("threshold"))


@query(f"""WITH {P_SQL}, l AS (SELECT win * 100 + child AS child, (win - 1) * 100 + parent AS parent FROM p WHERE s >= 0.5), a AS (SELECT child, count(DISTINCT parent) AS n, min(parent) AS f FROM l GROUP BY child), b AS (SELECT parent, count(DISTINCT child) AS k FROM l GROUP BY parent),
t AS (SELECT DISTINCT win * 100 + label AS child FROM c)
SELECT child, coalesce(n, 0) AS parents, CASE WHEN n IS NULL THEN 'new_core' WHEN n > 1 THEN 'merge' WHEN k > 1 THEN 'split' ELSE 'continuation' END AS transition FROM t LEFT JOIN a USING (child) LEFT JOIN b ON b.parent = a.f""")
def transition_type(spark, folder):
    pairs = _window_pairs(spark, folder).where("s >= 0.5").select((F.col("win") * 100 + F.col("child")).alias("child"), ((F.col("win") - 1) * 100 + F.col("parent")).alias("parent"))
    every = emb(spark, folder).select((F.col("win") * 100 + F.col("label")).alias("child"))
    return vectors.transitions(pairs, "parent", "child", every)


@query("""WITH p AS (SELECT label % 3 AS target, label, count(*) AS n FROM embeddings GROUP BY ALL), z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label), b AS (SELECT target, sum(n) AS t, max((n, -label)) AS m FROM p GROUP BY target)
SELECT CAST(target AS BIGINT) AS target, CAST(-m[2] AS BIGINT) AS label, m[1] AS hits, round(m[1] / t, 6) AS recall, round(m[1] / size, 6) AS share FROM b JOIN z ON z.label = -m[2]""")
def dominant_topic_recovery(spark, folder):
    t = vectors.dominant(emb(spark, folder).withColumn("target", F.col("label") % 3), "target", "label")
    return t.select("target", "label", "hits", F.round("recall", 6).alias("recall"), F.round("share", 6).alias("share"))


@query("""SELECT d.doc_id FROM documents d ANTI JOIN embeddings e ON e.vec_id = d.doc_id""")
def anti_missing_vectors(spark, folder):
    return table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("""SELECT count(*) AS works, count(*) FILTER (e.vec_id IS NULL) AS missing, count(*) FILTER (len(e.embedding) <> 64) AS wrong_size, count(DISTINCT len(e.embedding)) AS sizes FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def embedding_status(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("n"))
    t = table(spark, folder, "documents").select("doc_id").join(e, "doc_id", "left")
    return t.agg(F.count("*").alias("works"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") != 64).alias("wrong_size"), F.count_distinct("n").alias("sizes"))


def density_sql(similarity: float, least: int) -> str:
    """Cores, their components by recursion, component sizes and border rows, as in ``vectors.density_clusters``."""
    return f"""WITH RECURSIVE {E_SQL}, p AS (SELECT a.win, a.vec_id AS a, b.vec_id AS b, list_inner_product(a.n, b.n) AS s FROM u a JOIN u b ON a.win = b.win),
k AS (SELECT win, a AS k FROM p WHERE s >= {similarity} GROUP BY win, a HAVING count(*) >= {least}), kk AS (SELECT x.win, p.a, p.b FROM p JOIN k x ON x.k = p.a JOIN k y ON y.k = p.b WHERE p.s >= {similarity}),
r(win, k, m) AS (SELECT win, k, k FROM k UNION SELECT r.win, r.k, kk.b FROM r JOIN kk ON kk.a = r.m), c AS (SELECT win, k, min(m) AS c FROM r GROUP BY win, k),
z AS (SELECT win, c, row_number() OVER (PARTITION BY win ORDER BY c) - 1 AS cluster FROM c GROUP BY win, c HAVING count(*) >= {least}), m AS (SELECT c.win, c.k, z.cluster FROM c JOIN z USING (win, c)),
t AS (SELECT p.a AS k, m.cluster, avg(p.s) AS mean, max(p.s) AS top FROM p JOIN m ON m.k = p.b WHERE p.a NOT IN (SELECT k FROM k) GROUP BY p.a, m.cluster HAVING max(p.s) >= {similarity}),
b AS (SELECT k, max((round(mean, 12), cluster))[2] AS cluster FROM t GROUP BY k) SELECT e.win, e.vec_id, CAST(coalesce(m.cluster, b.cluster, -1) AS BIGINT) AS cluster FROM e LEFT JOIN m ON m.k = e.vec_id LEFT JOIN b ON b.k = e.vec_id"""


@query(density_sql(0.35, 4))
def density_cluster(spark, folder):
    return vectors.density_clusters(emb(spark, folder), ["win"], "vec_id", "embedding", 0.35, 4)


@query(f"""WITH {E_SQL}, x AS (SELECT win, generate_subscripts(v, 1) AS d, unnest(v) AS y FROM e), c AS (SELECT win, list(m ORDER BY d) AS v FROM (SELECT win, d, avg(y) AS m FROM x GROUP BY ALL) GROUP BY win),
p AS (SELECT a.win, b.win AS past, round(list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-12) * (sqrt(list_inner_product(b.v, b.v)) + 1e-12)), 12) AS s FROM c a LEFT JOIN c b ON b.win < a.win)
SELECT win, (SELECT count(*) FROM e WHERE e.win = p.win) AS works, round(1 - max(s), 6) AS novelty FROM p GROUP BY win""")
def window_novelty(spark, folder):
    from signalweave.operators import topics

    return topics.window_novelty(emb(spark, folder), "win", "embedding").select("win", "works", F.round("novelty", 6).alias("novelty"))


@query(None)
def geometry_features(spark, folder):
    """Distribution of cosines per label; tested against NumPy."""
    from signalweave.operators import topics

    return topics.geometry(emb(spark, folder), "label", "vec_id", "embedding")


@query(None)
def topic_lifecycle(spark, folder):
    """Density clusters of each window linked over time; tested on a fixture."""
    from signalweave.operators import topics

    return topics.lifecycle(emb(spark, folder), "win", "vec_id", "embedding", similarity=0.3, neighbours=2)


@query(None)
def hashing_vectors(spark, folder):
    """Signed hash vectors of titles and texts; tested against Python."""
    from signalweave.operators import topics
    from signalweave.plans.text_queries import docs

    return topics.hashed_vectors(docs(spark, folder), "doc_id", "title", "abstract", 64)


@query("""WITH v AS (SELECT label AS topic, vec_id % 4 AS variant, round(avg(embedding[1]), 6) AS x FROM embeddings GROUP BY ALL), t AS (SELECT *, x = max(x) OVER (PARTITION BY variant) AS top FROM v)
SELECT topic, min(x) AS low, round(quantile_cont(x, 0.5), 6) AS median, max(x) AS high, count(*) FILTER (top) AS tops FROM t GROUP BY topic""")
def sensitivity_summary(spark, folder):
    from signalweave.operators import topics

    e = table(spark, folder, "embeddings")
    v = e.groupBy(F.col("label").alias("topic"), (F.col("vec_id") % 4).alias("variant")).agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("x"))
    return topics.sensitivity(v, "topic", "variant", "x").select("topic", "low", F.round("median", 6).alias("median"), "high", "tops")
