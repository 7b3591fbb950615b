"""Connected components: by DataFrame joins alone, or with small graphs in one bounded task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.storage import Scratch, hot_join


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for each end of ``edges`` (src, dst); component: its smallest node.

    Each round takes the least label among neighbours (a combinable minimum, so
    that a node with very many links is pre-aggregated where its links lie; the
    labels of the few such nodes are broadcast to their links) and
    then jumps to the label's own label, so that paths shorten geometrically.
    Rounds end when no label changes; each is written to the shared folder.
    Self-links make single components; null ends are dropped.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    both = scratch.save(edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{name}_edges")
    labels = scratch.save(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component"), F.count("*").alias("links")), f"{name}_0")
    n = 0
    while True:
        near = hot_join(both, labels.select(F.col("node").alias("dst"), "component", "links"), ["dst"], "links").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"), "links")
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("top"))
        n += 1
        rounds = scratch.save(low.join(up, "low", "left").select("node", F.least("low", F.coalesce("top", "low")).alias("component"), "was", "links"), f"{name}_{n}")
        moved = rounds.where("component <> was").limit(1).count()
        labels = rounds.drop("was")
        if n > 1:
            scratch.drop(f"{name}_{n - 2}")
        if not moved:
            return labels.select("node", "component")


#: Links up to which one task finds all components.
TASK_LINKS = 500_000


def components_bounded(edges: DataFrame, scratch: Scratch, name: str = "cc", links: int = TASK_LINKS) -> DataFrame:
    """As ``components``; up to ``links`` links are written once, counted and joined in one task by union-find.

    The bound is on what that task holds, some tens of MB; larger graphs take the
    distributed rounds. Nodes are numbers here.
    """
    edges = scratch.save(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), f"{name}_links")
    if edges.limit(links + 1).count() > links:
        return components(edges, scratch, name)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = np.fromiter(up, np.int64, len(up))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.fromiter((root(x) for x in nodes.tolist()), np.int64, len(nodes)))], names=["node", "component"])

    return scratch.save(edges.coalesce(1).mapInArrow(join, "node long, component long"), f"{name}_found")
