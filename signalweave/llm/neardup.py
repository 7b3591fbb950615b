"""MinHash near-duplicates by an LSH forest: several sorted signature orders, longest-common-prefix neighbours, exact checks.

Every text's set of five-word shingles gets a MinHash signature, read in
``TREES`` orders of ``DEPTH`` values. Each order is sorted; a text's candidates
are the neighbours that share the longest prefixes with it, down to
``FLOOR`` values. So depth adapts to the region: where few texts lie, short
prefixes are enough; where many do, neighbours share long ones, and most texts
find their component by these. Regions that go on beyond the neighbours and still
hold several components are then compared as a whole at ``FLOOR`` values, in
blocks and on full sets, so that no pair that shares a region goes untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.operators.components import components_bounded as components

from .common import Scratch, broadcast_if_small, chunks, hot_join, table, text_hash

#: Words of a shingle, orders, values of an order, shared values of a candidate.
SHINGLE, TREES, DEPTH, FLOOR = 5, 16, 6, 2
#: Neighbours that each row is compared with at first.
NEAR = 2
#: Links need 100 * intersection >= PERCENT * union; candidates need this share of equal signature values, four
#: standard deviations under 0.75.
PERCENT, LIKELY = 75, 0.57
#: Rows and shingles of a block, at most (one text may have more shingles), where regions are compared as a whole.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
#: Ids up to which the texts that take part in candidates are found by a broadcast.
BROADCAST_IDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of hashed word shingles, for many texts at once."""

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all texts' shingles, each text's sorted and different; how many each text has)."""
        lowered = [b" ".join(t.lower().split()) for t in texts]
        words = np.array([t.count(b" ") + 1 if t else 0 for t in lowered])
        data = b" ".join(t for t in lowered if t)
        if not data:
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        self._powers(len(data))
        b = np.frombuffer(data, np.uint8)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(7)) * self.up[: len(b)], out=total[1:])
        gap = np.flatnonzero(b == 32)
        begin, end = np.r_[0, gap + 1], np.r_[gap, len(b)]
        size = np.minimum(words, self.shingle)
        n = np.where(words > 0, words - size + 1, 0)
        text = np.repeat(np.arange(len(texts)), n)
        first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(words) - words, n)
        s, e = begin[first], end[first + size[text] - 1]
        hashes = _mix(((total[e] - total[s]) * self.down[s]) ^ (e - s).astype(np.uint64))
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])]
        return hashes[new], np.bincount(text[new], minlength=len(texts))


def _multipliers(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def sketches(docs: DataFrame, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, text_hash, n_shingles, s1, s2, sig): set size, 128 bits that name the set, and the signature's values of 4 bytes."""
    made: list[Shingler] = []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Shingler(shingle))
        many = _multipliers(trees * depth)
        for batch in batches:
            for at, texts in chunks(batch):
                hashes, n = made[0].sets(texts)
                some = np.flatnonzero(n)
                starts = np.cumsum(n[some]) - n[some]
                sig = np.full((len(texts), len(many)), 0xFFFFFFFF, ">u4")
                names = np.zeros((2, len(texts)), np.uint64)
                if len(some):
                    for k, m in enumerate(many):
                        values = hashes * m
                        sig[some, k] = np.minimum.reduceat(values, starts) >> np.uint64(32)
                    names[0, some] = np.add.reduceat(_mix(hashes), starts)
                    names[1, some] = np.add.reduceat(_mix(hashes * np.uint64(_BASE)), starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in names), pa.array([row.tobytes() for row in sig], pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash(F.col("text"))).mapInArrow(read, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, sig binary")


def _shared(keys: np.ndarray, step: int, tree: np.ndarray) -> np.ndarray:
    """Values that rows ``step`` apart share at the front of their keys; 0 across orders."""
    same = (keys[step:] == keys[:-step]) & (tree[step:] == tree[:-step])[:, None]
    return np.where(same.all(axis=1), keys.shape[1], same.argmin(axis=1))


def _neighbours(rows: DataFrame, scratch: Scratch, name: str, near: int, floor: int, depth: int) -> DataFrame:
    """Pairs of neighbours in the sorted orders.

    ``rows``: (tree, key, id), sorted over the cluster; each task sees a run of the
    order. The last and first ``near`` rows of adjoining tasks are met in a second
    step by the number of the task, so no pair is lost at the seams. Returns
    (kind, a, b): pairs (kind 0), and rows (kind 1: a) whose region goes on beyond
    ``near``.
    """

    def pairs_of(tree, keys, ids, split: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, beyond = [np.zeros(0, int)], [np.zeros(0, int)], np.zeros(len(ids), bool)
        for step in range(1, min(near, len(ids) - 1) + 1):
            i = np.flatnonzero(_shared(keys, step, tree) >= floor)
            if step == near:
                beyond[i] = beyond[i + step] = True
            if split is not None:
                i = i[(i < split) & (i + step >= split)]
            i = i[ids[i] != ids[i + step]]
            a.append(i)
            b.append(i + step)
        return np.concatenate(a), np.concatenate(b), beyond

    names = ["kind", "a", "b", "part", "tree", "key"]
    schema = "kind int, a long, b long, part int, tree int, key binary"

    def arrays(t: pa.Table):
        n = t.num_rows
        keys = np.frombuffer(b"".join(t["key"].to_pylist()), ">u4").reshape(n, depth) if n else np.zeros((0, depth), ">u4")
        return t["tree"].to_numpy(), keys, t["id"].to_numpy()

    def out(kind: int, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)) if b is not None else pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)

    def seam(kind: int, t: pa.Table, part: int) -> pa.RecordBatch:
        n = t.num_rows
        col = lambda name: t[name].combine_chunks() if n else pa.array([], t.schema.field(name).type)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), col("id"), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, np.int32)), col("tree"), col("key")], names=names)

    def emit(t: pa.Table, split: int | None) -> Iterator[pa.RecordBatch]:
        tree, keys, ids = arrays(t)
        a, b, beyond = pairs_of(tree, keys, ids, split)
        lo, hi = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        if len(lo):
            once = np.unique(np.stack([lo, hi]), axis=1)
            yield out(0, once[0], once[1])
        if beyond.any():
            yield out(1, np.unique(ids[beyond]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, carried, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if first:
                yield seam(3, now.slice(0, near), part)
                first = False
            whole = now if carried is None else pa.concat_tables([carried, now])
            # Pairs within the rows carried over were given before.
            yield from emit(now, None)
            if carried is not None:
                yield from emit(pa.concat_tables([carried, now.slice(0, near)]), carried.num_rows)
            carried = whole.slice(max(0, whole.num_rows - near))
        if carried is not None:
            yield seam(2, carried, part)

    def sew(both: pa.Table) -> pa.Table:
        # One seam: the last rows of a task and the first of the next, ``near`` of each at most.
        def side(kind: int) -> pa.Table:
            t = both.filter(pc.equal(both["kind"], kind))
            return pa.table({"tree": t["tree"], "key": t["key"], "id": t["a"]}).sort_by([("tree", "ascending"), ("key", "ascending"), ("id", "ascending")])

        left, right = side(2), side(3)
        found = list(emit(pa.concat_tables([left, right]), left.num_rows)) if left.num_rows and right.num_rows else []
        return pa.Table.from_batches(found, schema=found[0].schema if found else out(0, np.zeros(0)).schema)

    met = scratch.save(rows.mapInArrow(read, schema), f"{name}_met")
    sewn = met.where("kind > 1").withColumn("seam", F.when(F.col("kind") == 2, F.col("part")).otherwise(F.col("part") - 1)).groupBy("seam").applyInArrow(sew, schema)
    found = scratch.save(met.where("kind < 2").unionByName(sewn.where("kind < 2")).select("kind", "a", "b"), name)
    scratch.drop(f"{name}_met")
    return found


def _joining(ids: np.ndarray, comps: np.ndarray, free: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between rows that ask and rows that answer, judged on full sets; only those that join components of this group."""
    ask, other = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(ask) or not len(other):
        return []
    sizes = np.array([len(sets[j]) for j in other])
    known, spot = np.unique(np.concatenate([sets[j] for j in other]), return_inverse=True)
    starts, mark, up, out = np.cumsum(sizes) - sizes, np.zeros(len(known), np.int32), {}, []

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for i in ask.tolist():
        mine = sets[i]
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        hit = at[known[at] == mine]
        if 100 * len(hit) < percent * len(mine):
            continue
        mark[hit] = 1
        both = np.add.reduceat(mark[spot], starts)
        mark[hit] = 0
        # Of two that could ask each other, one does.
        linked = (100 * both >= percent * (len(mine) + sizes - both)) & (comps[other] != comps[i]) & (free[other] | (ids[i] > ids[other]))
        for j in other[np.flatnonzero(linked)].tolist():
            a, b = root(int(comps[i])), root(int(comps[j]))
            if a != b:
                up[a] = b
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def _unmet(rows: DataFrame, sets: DataFrame, scratch: Scratch, floor: int, percent: int) -> DataFrame:
    """Links (a, b) between different components in whole regions: rows that share ``floor`` values in an order.

    ``rows``: (tree, key, id, comp, n). Only regions of several components count.
    In each, the rows of the largest component only answer; all others ask every
    row. Both are dealt in blocks of bounded rows and shingles, and each pair of
    blocks meets by itself, so that no region lies in one task. A block's sets
    are compared whole, and only links that join components leave it: there are
    fewer of them than components, however many pairs are alike.
    """
    rows = rows.withColumn("region", F.expr(f"substring(key, 1, {4 * floor})")).drop("key")
    parts = rows.groupBy("tree", "region", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    regions = parts.groupBy("tree", "region").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.count("*").alias("comps"), F.max(F.struct("rows", "comp", "shingles")).alias("host"))
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES)).cast("int")
    asking, asked = blocks(F.col("rows") - F.col("host.rows"), F.col("shingles") - F.col("host.shingles")), blocks(F.col("rows"), F.col("shingles"))
    regions = scratch.save(regions.where("comps > 1").select("tree", "region", F.col("host.comp").alias("host"), asking.alias("asking"), asked.alias("asked")), "regions")
    met = rows.join(broadcast_if_small(regions, BROADCAST_IDS), ["tree", "region"]).withColumn("free", F.col("comp") == F.col("host"))
    mine, all_of = F.xxhash64("id", F.lit(1)), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = F.xxhash64("tree", "region", "p", "q").alias("g")
    ask = met.where("not free").withColumns({"p": F.pmod(mine, F.col("asking")).cast("int"), "asks": F.lit(True)}).withColumn("q", all_of("asked"))
    answer = met.withColumns({"q": F.pmod(mine, F.col("asked")).cast("int"), "asks": F.lit(False)}).withColumn("p", all_of("asking"))
    both = ask.select(group, "asks", "free", "id", "comp").unionByName(answer.select(group, "asks", "free", "id", "comp")).join(sets, "id")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.select("g", "asks", "free", "id", "comp", "shingles").repartition(n, "g").sortWithinPartitions("g", "asks", "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a group lie together; the last group of a batch waits for the next batch.
        held: list[pa.RecordBatch] = []

        def links(some: pa.Table) -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            g, asks, free, ids, comps = (some[c].to_numpy() for c in ("g", "asks", "free", "id", "comp"))
            lists = some["shingles"].combine_chunks()
            lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                here = [values[offsets[k] : offsets[k + 1]] for k in range(lo, hi)]
                found += _joining(ids[lo:hi], comps[lo:hi], free[lo:hi], asks[lo:hi], here, percent)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            fresh = int(np.searchsorted(g, g[-1]))
            if fresh or (held and held[-1].column(0)[0].as_py() != g[0]):
                yield links(pa.Table.from_batches([*held, batch.slice(0, fresh)]))
                held = []
            held.append(batch.slice(fresh))
        if held:
            yield links(pa.Table.from_batches(held))

    return scratch.save(dealt.mapInArrow(read, "a long, b long").distinct(), "joining")


def _sorted(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")


def _ordered(sets: DataFrame, trees: int, depth: int, *columns: str) -> DataFrame:
    """A row for each order: (tree, key, id) and ``columns``."""
    key = F.expr(f"substring(sig, tree * {4 * depth} + 1, {4 * depth})")
    return sets.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select("tree", key.alias("key"), "id", *columns)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, shingles): hashed sets of the texts in ``docs`` (doc_id, text)."""
    made: list[Shingler] = []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Shingler(shingle))
        for batch in batches:
            for at, texts in chunks(batch):
                hashes, n = made[0].sets(texts)
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], names=["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "id long, shingles array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``linked``, judged on full sets."""
    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", (F.lit(100) * both >= F.lit(percent) * (F.size("sa") + F.size("sb") - both)).alias("linked"))


def _alike(pairs: DataFrame, sigs: DataFrame, values: int) -> DataFrame:
    """Pairs with the share of equal signature values, if it is likely enough; sizes must allow a link, too."""
    a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("ga"), F.col("n_shingles").alias("na"))
    b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("gb"), F.col("n_shingles").alias("nb"))
    near = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    same = F.expr(f"size(filter(sequence(0, {values - 1}), i -> substring(ga, 4 * i + 1, 4) = substring(gb, 4 * i + 1, 4)))") / values
    return near.select("a", "b", same.alias("like")).where(F.col("like") >= LIKELY)


def _ends(tested: DataFrame) -> DataFrame:
    return tested.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _crossing(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(member.select(F.col("node").alias(end), F.col("component").alias(f"{end}_comp")), end, "left").withColumn(f"{end}_comp", F.coalesce(f"{end}_comp", end))
    return pairs.where("a_comp <> b_comp").select("a", "b")


def _merged(member: DataFrame, tested: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``member`` (node, component) after the new links: only components that these join are worked on."""
    linked = tested.where("linked").select("a", "b")
    if not linked.limit(1).count():
        return member
    new = linked.select(F.col("a").alias("node")).unionAll(linked.select(F.col("b").alias("node"))).distinct().join(member, "node", "left_anti")
    every = member.unionByName(new.withColumn("component", F.col("node")))
    edges = linked
    for end in ("a", "b"):
        edges = edges.join(every.select(F.col("node").alias(end), F.col("component").alias(f"{end}_comp")), end)
    joined = components(edges.select(F.col("a_comp").alias("src"), F.col("b_comp").alias("dst")), scratch, f"cc_{name}")
    moved = every.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return scratch.save(moved.select("node", F.coalesce("to", "component").alias("component")), f"member_{name}")


class _Ids:
    """A number for each (doc_id, text): the doc_id, but for further texts of one id, and for null ids, a number far below.

    Nothing is renamed where each doc_id comes with one text, which one small
    aggregate tells.
    """

    def __init__(self, seen: DataFrame, scratch: Scratch):
        per = seen.groupBy("doc_id").agg(F.min("text_hash").alias("first_text"), F.max("text_hash").alias("last_text"))
        self.several = scratch.save(per.where("doc_id is null or first_text <> last_text").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("first_text")).alias("first_text")), "several")
        self.any = bool(self.several.limit(1).count())

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, text_hash, ...) with ``id``."""
        if not self.any:
            return rows.withColumn("id", F.col("doc_id"))
        other = broadcast_if_small(self.several.select(F.col("doc_id").alias("_doc"), "first_text", F.lit(True).alias("_some")), BROADCAST_IDS)
        far = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 61))
        changed = F.col("_some").isNotNull() & ~F.col("text_hash").eqNullSafe(F.col("first_text"))
        return rows.join(other, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("id", F.when(changed, far).otherwise(F.col("doc_id"))).drop("_doc", "_some", "first_text")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, text_hash, stays.

    A set is a text's different shingles of ``shingle`` words (A-Z lowered, words
    parted by ASCII white space), or its whole sequence if shorter. Null, empty
    and blank texts have none and are linked with nothing. Equal sets are one
    class from the start, whatever their number. Each row of ``docs`` gives a
    row; rows that share a doc_id and text share all values. Different texts of
    one doc_id are documents of their own, linked or not by what they hold; so
    are rows without an id, whose component_id is the smallest id they reach, or
    null. ``stays`` marks one text of each component: the one of the smallest
    doc_id and, of several, the smallest hash.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    sketched = scratch.save(sketches(docs.select("doc_id", "text"), shingle, trees, depth), "sketches")
    ids = _Ids(sketched.select("doc_id", "text_hash"), scratch)
    seen = scratch.save(ids.named(sketched), "seen") if ids.any else ids.named(sketched)
    classes = scratch.save(seen.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("id"), F.count("*").alias("rows")), "classes")
    sigs = hot_join(seen.where("n_shingles > 0").select("s1", "s2", "n_shingles", F.col("id").alias("row_id"), "sig"), classes, ["s1", "s2", "n_shingles"], "rows").where("row_id = id").select("id", "n_shingles", "sig")
    sigs = scratch.save(sigs.dropDuplicates(["id"]), "sigs")

    met = _neighbours(_sorted(_ordered(sigs, trees, depth)), scratch, "neighbours", NEAR, FLOOR, depth)
    likely = scratch.save(_alike(met.where("kind = 0").select("a", "b").distinct(), sigs, trees * depth), "likely")
    dense = met.where("kind = 1").select(F.col("a").alias("id")).distinct()

    # Sets are made once, for every text that takes part in a candidate or lies in a dense region.
    asked = scratch.save(likely.select(F.col("a").alias("id")).unionAll(likely.select(F.col("b").alias("id"))).unionAll(dense).distinct(), "asked")
    texts = ids.named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text")).join(broadcast_if_small(asked, BROADCAST_IDS), "id")
    sets = scratch.save(shingle_sets(texts.select(F.col("id").alias("doc_id"), "text").dropDuplicates(["doc_id"]), shingle), "sets")

    # First each text's likeliest two candidates; then those of the others that still join two components.
    ends = likely.select("a", "b", "like", F.col("a").alias("of")).unionAll(likely.select("a", "b", "like", F.col("b").alias("of")))
    best = ends.groupBy("of").agg(F.max(F.struct("like", F.col("a"), F.col("b"))).alias("x"), F.max(F.struct("like", -F.col("a"), -F.col("b"))).alias("y"))
    first = best.select(F.explode(F.array(F.struct(F.col("x.a").alias("a"), F.col("x.b").alias("b")), F.struct((-F.col("y.col2")).alias("a"), (-F.col("y.col3")).alias("b")))).alias("p")).select("p.a", "p.b").distinct()
    tested = scratch.save(_confirm(first, sets, percent), "tested_0")
    member = components(_ends(tested), scratch, "cc_0").select("node", "component")
    crossing = scratch.save(_crossing(likely.select("a", "b"), member).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "crossing")
    more = scratch.save(_confirm(crossing, sets, percent), "tested_1")
    member = _merged(member, more, scratch, "1")

    # Regions of more rows than neighbours see are compared as a whole, where they still hold several components.
    if dense.limit(1).count():
        now = sigs.join(dense, "id").join(member.withColumnRenamed("node", "id"), "id", "left").select("id", "sig", F.col("n_shingles").alias("n"), F.coalesce("component", "id").alias("comp"))
        ordered = _ordered(scratch.save(now, "dense"), trees, depth, "comp", "n")
        member = _merged(member, _unmet(ordered, sets, scratch, FLOOR, percent).withColumn("linked", F.lit(True)), scratch, "2")
    of_class = classes.join(member.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "id").alias("component_id"), F.col("rows").alias("n"))
    of_class = scratch.save(of_class, "of_class")
    rows = scratch.save(seen.select("doc_id", "text_hash", "n_shingles", "s1", "s2"), "rows")
    scratch.keep("of_class", "rows")
    alone = rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = hot_join(rows.where("n_shingles > 0"), of_class, ["s1", "s2", "n_shingles"], "n").select("doc_id", "text_hash", "n_shingles", "component_id")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if not ids.any:
        return joined.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash", kept.alias("stays"))
    # Components are known by numbers of their own: by what id, and which of its texts, do they go?
    joined = scratch.save(joined.withColumnRenamed("component_id", "component"), "joined")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    named = scratch.save(joined.groupBy("component").agg(least.alias("least"), F.count("*").alias("n")), "named")
    least = hot_join(joined, named, ["component"], "n").select("doc_id", "text_hash", "n_shingles", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("least_text"))
    whole = least.unionByName(alone.withColumn("least_text", F.col("text_hash")))
    return whole.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash", (kept & (F.col("text_hash") == F.col("least_text"))).alias("stays"))


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.to_id
), c AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
