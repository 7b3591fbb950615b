"""Embedding operators: centroids, coherence, novelty, neighbours, links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.vectors import cosine, dot, norm, unit
from signalweave.operators import blocks
from signalweave.operators.components import components_bounded
from signalweave.storage import Scratch, broadcast_if_small

#: Anchors up to which a blocked product takes them as one constant matrix.
ANCHORS = 20_000


def centroids(df: DataFrame, by: list[str], vector: str = "embedding", normal: bool = False) -> DataFrame:
    """Element-wise mean per group and its size: one combinable sum for each dimension."""
    each = df.select(*by, F.posexplode(vector).alias("d", "x")).groupBy(*by, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    out = each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda e: e["m"]).alias("centroid"), F.max("n").alias("works"))
    return out.withColumn("centroid", unit(F.col("centroid"))) if normal else out


def coherence(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Mean pairwise cosine of a group in linear time: (|sum of units|^2 - n) / (n (n - 1)); null under two."""
    sums = df.select(*by, F.posexplode(unit(F.col(vector))).alias("d", "x")).groupBy(*by, "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    one = sums.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("works"))
    n = F.col("works")
    return one.select(*by, "works", F.when(n > 1, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("q") - n) / (n * (n - 1))))).alias("coherence"))


def _matrix(anchors: DataFrame, key: str, vector: str, extra: list[str]) -> pa.Table | None:
    """Anchors as one table, if there are at most ``ANCHORS``."""
    got = anchors.select(key, F.col(vector).cast("array<double>").alias("v"), *extra).limit(ANCHORS + 1).toArrow()
    return got.sort_by(key) if got.num_rows <= ANCHORS else None


def _unit_rows(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = np.array(rows.to_pylist(), np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12) if len(x) else x.reshape(0, 1)


def nearest(df: DataFrame, key: str, vector: str, anchors: DataFrame, anchor_key: str, anchor_vector: str, k: int, exclude_self: bool = False) -> DataFrame:
    """(key, anchor_key, similarity, rank): each row's ``k`` most similar anchors; ties by anchor key.

    Anchors up to ``ANCHORS`` are a constant matrix and every row is multiplied in
    blocks; more meet the rows block by block (a stated query set against all
    rows), and only a row's best ``k`` of each block go on to the last ranking.
    """
    mine = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    held = _matrix(anchors, anchor_key, anchor_vector, [])
    if held is None:
        own = mine.select(F.lit(0).alias("all"), "k", unit(F.col("v")).alias("v"))
        others = anchors.select(F.lit(0).alias("all"), F.col(anchor_key).cast("long").alias("k"), unit(F.col(anchor_vector).cast("array<double>")).alias("v"))
        apart = (lambda a, b: a["k"].to_numpy()[:, None] != b["k"].to_numpy()[None, :]) if exclude_self else None
        found = blocks.across(own, others, ["all"], "k", blocks.best_of_block([], "k", "v", k, apart), "k long, near long, similarity double", blocks.wide(max(df.count(), anchors.count()))).withColumnRenamed("near", "a")
    else:
        ids, matrix = held[anchor_key].to_numpy().astype(np.int64), _unit_rows(held["v"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    own = some.column(0).to_numpy()
                    similar = np.round(_unit_rows(some.column(1)) @ matrix.T, 12) if len(ids) else np.zeros((len(own), 0))
                    if exclude_self:
                        similar[own[:, None] == ids[None, :]] = -np.inf
                    top = np.argsort(-similar, axis=1, kind="stable")[:, :k]
                    values = np.take_along_axis(similar, top, axis=1)
                    keep = np.isfinite(values)
                    row = np.broadcast_to(np.arange(len(own))[:, None], top.shape)[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[top[keep]]), pa.array(values[keep])], names=["k", "a", "similarity"])

        found = mine.mapInArrow(best, "k long, a long, similarity double")
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.col("similarity").desc(), "a"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("k").alias(key), F.col("a").alias(anchor_key if anchor_key != key else f"near_{key}"), "similarity", "rank")


def novelty_before(anchors: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """1 - largest cosine with an anchor whose ``order`` is strictly earlier; null for the first.

    Anchors meet block by block, and each block gives its largest cosine alone.
    """
    best = earlier_best(anchors.select(F.col(key), F.col(order), F.col(vector)), key, order, vector)
    return anchors.select(key, order).join(best, key, "left").select(key, order, (1 - F.col("similarity")).alias("novelty"))


def earlier_best(df: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, near, similarity): each row's most similar row of a smaller ``order``; ties by the smaller key."""
    rows = df.select(F.lit(0).alias("_all"), F.col(key), F.col(order).cast("double").alias("_o"), unit(F.col(vector).cast("array<double>")).alias("_v"))
    before = lambda a, b: b["_o"].to_numpy()[None, :] < a["_o"].to_numpy()[:, None]
    kind = dict(df.dtypes)[key]
    found = blocks.across(rows, rows, ["_all"], key, blocks.best_of_block([], key, "_v", 1, before), f"{key} {kind}, near {kind}, similarity double")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("similarity").desc(), "near"))
    return found.withColumn("_r", rank).where("_r = 1").drop("_r")


def nearest_background(topics: DataFrame, key: str, vector: str, background: DataFrame, background_key: str, background_vector: str) -> DataFrame:
    """Distance to the nearest background anchor, and which it is."""
    near = nearest(topics, key, vector, background, background_key, background_vector, 1)
    other = background_key if background_key != key else f"near_{key}"
    return near.select(key, F.col(other).alias("nearest"), (1 - F.col("similarity")).alias("distance"))


def adaptive_threshold(pairs: DataFrame, similarity: str, by: list[str], base: float = 0.70, trigger: float = 0.80, quantile: float = 0.99) -> DataFrame:
    """``base``; but where the median similarity reaches ``trigger``, its ``quantile`` if larger."""
    q = pairs.groupBy(*by).agg(F.percentile(similarity, F.array(F.lit(0.5), F.lit(quantile))).alias("q"))
    return q.select(*by, F.col("q")[0].alias("median"), F.when(F.col("q")[0] < trigger, F.lit(base)).otherwise(F.greatest(F.lit(base), F.col("q")[1])).alias("threshold"))


def transitions(links: DataFrame, parent: str, child: str, children: DataFrame) -> DataFrame:
    """new_core, merge, split or continuation of each child, from its links to parents."""
    parents = links.groupBy(child).agg(F.count_distinct(parent).alias("parents"), F.min(parent).alias("first"))
    kids = links.groupBy(parent).agg(F.count_distinct(child).alias("kids"))
    t = children.select(child).distinct().join(parents, child, "left").join(kids.withColumnRenamed(parent, "first"), "first", "left")
    kind = F.when(F.col("parents").isNull(), "new_core").when(F.col("parents") > 1, "merge").when(F.col("kids") > 1, "split").otherwise("continuation")
    return t.select(child, F.coalesce("parents", F.lit(0)).alias("parents"), kind.alias("transition"))


def temporal_neighbours(df: DataFrame, key: str, day: str, vector: str, k: int = 20, max_gap: int = 1826, block_days: int = 1826) -> DataFrame:
    """Each row's ``k`` most similar earlier rows, at most ``max_gap`` days back; same-day rows by key; cosine clamped.

    An as-of band join: rows meet in buckets of ``block_days`` (their own and
    earlier ones within reach), there block by block, and only a row's best ``k``
    of each block go on to the last ranking.
    """
    d, kind = F.col(day).cast("long"), dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), d.alias("d"), unit(F.col(vector).cast("array<double>")).alias("v"))
    reach = -(-max_gap // block_days)
    bucket = F.floor(F.col("d") / block_days)
    now = rows.withColumn("b", F.explode(F.sequence(bucket - reach, bucket)))
    past = rows.withColumn("b", bucket)

    def allowed(a: pa.Table, b: pa.Table) -> np.ndarray:
        gap = a["d"].to_numpy()[:, None] - b["d"].to_numpy()[None, :]
        return ((gap > 0) | ((gap == 0) & (b["k"].to_numpy()[None, :] < a["k"].to_numpy()[:, None]))) & (gap <= max_gap)

    met = blocks.across(now, past, ["b"], "k", blocks.best_of_block([], "k", "v", k, allowed), f"k {kind}, near {kind}, similarity double")
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.col("similarity").desc(), "near"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("k").alias(key), "near", "similarity", "rank")


def drift(df: DataFrame, topic: str, window: str, vector: str) -> DataFrame:
    """Each topic window's centroid against that of the topic's first window: 1 - cosine."""
    c = centroids(df, [topic, window], vector)
    first = F.first("centroid").over(W.partitionBy(topic).orderBy(window))
    return c.withColumn("drift", 1 - cosine(F.col("centroid"), first)).select(topic, window, "works", "drift")


def density_clusters(df: DataFrame, by: list[str], key: str, vector: str, similarity: float = 0.35, neighbours: int = 2) -> DataFrame:
    """Density clusters within each group: (by, key, cluster), -1 for noise.

    Links have a cosine of at least ``similarity``; cores have ``neighbours``
    links, themselves included; clusters are components of at least ``neighbours``
    cores, numbered by their smallest key. A border row with a link to a cluster
    goes to the one whose cores it is most like on average (of equals, the higher
    number). Keys are numbers, each in one group. Rows meet block by block: counts
    of links, links that join cores and clusters touched are all that leaves a block.
    """
    scratch = Scratch(df.sparkSession, "density")
    types = dict(df.dtypes)
    rows = scratch.save(df.select(*by, F.col(key).cast("long").alias("k"), unit(F.col(vector).cast("array<double>")).alias("v")), "rows")

    def degree(a: pa.Table, b: pa.Table) -> pa.Table:
        n = (blocks.matrix(a, "v") @ blocks.matrix(b, "v").T >= similarity).sum(axis=1)
        return pa.table({"k": a["k"], "n": pa.array(n.astype(np.int64))})

    counts = blocks.across(rows, rows, by, "k", degree, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    rows = scratch.save(rows.join(counts, "k", "left").withColumn("core", F.coalesce(F.col("n") >= neighbours, F.lit(False))).drop("n"), "cores")

    def joins(a: pa.Table, b: pa.Table) -> pa.Table:
        ka, kb = a["k"].to_numpy(), b["k"].to_numpy()
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p]
            return x

        out: list[tuple[int, int]] = []
        for i, row in enumerate(blocks.matrix(a, "v") @ blocks.matrix(b, "v").T >= similarity):
            for j in np.flatnonzero(row & (kb < ka[i])).tolist():
                x, y = root(int(ka[i])), root(int(kb[j]))
                if x != y:
                    up[x] = y
                    out.append((int(ka[i]), int(kb[j])))
        return pa.table({"src": pa.array([x for x, _ in out], pa.int64()), "dst": pa.array([y for _, y in out], pa.int64())})

    cores = rows.where("core")
    parts = components_bounded(blocks.across(cores, cores, by, "k", joins, "src long, dst long"), scratch, "cores_cc").withColumnRenamed("node", "k")
    named = cores.join(parts, "k", "left").select(*by, "k", "v", F.coalesce("component", "k").alias("component"))
    kept = named.groupBy(*by, "component").agg(F.count("*").alias("n")).where(F.col("n") >= neighbours)
    numbers = kept.withColumn("cluster", F.row_number().over(W.partitionBy(*by).orderBy("component")).cast("long") - 1)
    member = scratch.save(named.join(broadcast_if_small(numbers, blocks.GROUPS), [*by, "component"]).select(*by, "k", "v", "cluster"), "member")

    def touched(a: pa.Table, b: pa.Table) -> pa.Table:
        linked = blocks.matrix(a, "v") @ blocks.matrix(b, "v").T >= similarity
        clusters, ka = b["cluster"].to_numpy(), a["k"].to_numpy()
        found = [(int(ka[i]), int(c)) for i, row in enumerate(linked) for c in np.unique(clusters[row])]
        return pa.table({"k": pa.array([k for k, _ in found], pa.int64()), "cluster": pa.array([c for _, c in found], pa.int64())})

    border = rows.where("not core").select(*by, "k", "v", F.lit(None).cast("long").alias("cluster"))
    near = blocks.across(border, member, by, "k", touched, "k long, cluster long").distinct().join(border.drop("cluster"), "k")
    means = centroids(member, [*by, "cluster"], "v").select(*by, "cluster", "centroid")
    best = near.join(means, [*by, "cluster"]).groupBy("k").agg(F.max(F.struct(F.round(dot(F.col("v"), F.col("centroid")), 12).alias("mean"), "cluster"))["cluster"].alias("cluster"))
    cluster = member.select("k", "cluster").unionByName(best)
    return rows.join(cluster, "k", "left").select(*by, F.col("k").cast(types[key]).alias(key), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def dominant(df: DataFrame, by: str, topic: str) -> DataFrame:
    """Per target group: its most frequent topic (of equals the smallest), recall and the topic's share."""
    pair = df.groupBy(by, topic).agg(F.count("*").alias("n"))
    size = df.groupBy(topic).agg(F.count("*").alias("size"))
    best = pair.groupBy(by).agg(F.sum("n").alias("targets"), F.max(F.struct("n", (-F.col(topic)).alias("t"))).alias("b"))
    out = best.select(by, (-F.col("b.t")).alias(topic), F.col("b.n").alias("hits"), "targets").join(size, topic)
    return out.select(by, topic, "hits", (F.col("hits") / F.col("targets")).alias("recall"), (F.col("hits") / F.col("size")).alias("share"))


def sort_key(value: Column, digits: int = 12) -> Column:
    return F.round(value, digits)


__all__ = ["adaptive_threshold", "centroids", "coherence", "density_clusters", "dominant", "dot", "drift", "nearest", "nearest_background", "norm", "novelty_before", "temporal_neighbours", "transitions"]
