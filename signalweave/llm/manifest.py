"""Merkle manifest of a dataset: one digest for each row, source and table, and what proves a row belongs to it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Children of a node; leaves of an indexed partition, on average; partitions merged by one task of a round.
FANOUT, ROWS, MERGED = 3, 100_000, 64
#: Columns that a leaf covers, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: What the passes over indexed partitions read: runs (kind 0: ``at`` first index, ``total`` leaves of the group, ``tail``),
#: nodes from elsewhere (1: ``level``, ``at``) and leaves (2: ``at`` place in the run).
PASS = "pid int, g string, kind int, level int, at long, total long, hash binary, doc_id long, other binary, name string, tail string"


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Lowercase hex SHA-256 of the columns' values, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def node_hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(total: int, level: int) -> int:
    """Nodes on a level above ``total`` leaves."""
    for _ in range(level):
        total = -(-total // FANOUT)
    return total


class MountainRange:
    """Completed peaks of a run of leaves, one short list a level.

    A node whose run of siblings is complete is hashed with them into the next
    level; the group's last run may be short and is hashed without padding.
    ``loose`` gets the nodes whose run began before the first leaf or goes on
    after the last one; ``top`` is the group's root, where the run holds all.
    """

    def __init__(self, total: int):
        self.widths = [total]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // FANOUT))
        self.held: list[list[tuple[int, str]]] = [[] for _ in self.widths]
        self.loose: list[tuple[int, int, str]] = []
        self.top: str | None = None

    def push(self, at: int, digest: str) -> None:
        level = 0
        while True:
            n, run = self.widths[level], self.held[level]
            if n == 1:
                self.top = digest
                return
            if not run and at % FANOUT:
                self.loose.append((level, at, digest))
                return
            run.append((at, digest))
            if len(run) < FANOUT and at < n - 1:
                return
            at, digest = at // FANOUT, node_hash(*(h for _, h in run))
            run.clear()
            level += 1

    def close(self) -> None:
        for level, run in enumerate(self.held):
            self.loose += ((level, at, digest) for at, digest in run)
            run.clear()


def indexed(rows: DataFrame, scratch: Scratch, name: str, keys: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows (g, keys, hash, doc_id, other, name) in partitions of neighbouring leaves: (leaves with pid and ``at``, runs).

    Rows are dealt by range, with their place in the written table as the last
    key, so that neither a hot group nor a hot row meets in one task. A run is
    what one partition holds of one group: (pid, g, n, first, total).
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for g in batch.column(0).to_pylist():
                at = at + 1 if g == last else 0
                last = g
                places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array([pid] * batch.num_rows, pa.int32()), batch.column(0), pa.array(places, pa.int64()), *batch.columns[1:]], names=["pid", "g", "at", "hash", "doc_id", "other", "name"])

    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = ["g", *keys, "_tie"]
    dealt = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("g", "hash", "doc_id", "other", "name")
    leaves = scratch.save(dealt.mapInArrow(number, "pid int, g string, at long, hash binary, doc_id long, other binary, name string"), f"{name}_leaves")
    runs = scratch.save(leaves.groupBy("pid", "g").agg(F.count("*").alias("n")), f"{name}_counts")
    before = "sum(n) over (partition by g order by pid)"
    return leaves, scratch.save(runs.select("pid", "g", "n", F.expr(f"{before} - n").alias("first"), F.expr("sum(n) over (partition by g)").alias("total")), f"{name}_runs")


def _pass(leaves: DataFrame, runs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The rows of each indexed partition together, ordered by group, run, nodes and leaves."""
    null = lambda t: F.lit(None).cast(t)
    tail = F.col("tail") if "tail" in runs.columns else null("string")
    a = runs.select("pid", "g", F.lit(0).alias("kind"), F.lit(0).alias("level"), F.col("first").alias("at"), "total", null("binary").alias("hash"), null("long").alias("doc_id"), null("binary").alias("other"), null("string").alias("name"), tail.alias("tail"))
    b = leaves.select("pid", "g", F.lit(2).alias("kind"), F.lit(0).alias("level"), "at", null("long").alias("total"), "hash", "doc_id", "other", "name", null("string").alias("tail"))
    both = a.unionByName(b)
    if more is not None:
        both = both.unionByName(more.select("pid", "g", F.lit(1).alias("kind"), "level", "at", null("long").alias("total"), "hash", null("long").alias("doc_id"), null("binary").alias("other"), null("string").alias("name"), null("string").alias("tail")))
    return both.repartition("pid").sortWithinPartitions("pid", "g", "kind", "level", "at")


NODES = "g string, pid int, level int, at long, total long, hash binary, kind string"


def _node_batch(found: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    columns = list(zip(*found, strict=True)) if found else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["g", "pid", "level", "at", "total", "hash", "kind"])


def _peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loose nodes of each run, and the roots of groups that one run holds whole."""
    g = pid = total = first = peaks = None

    def closed() -> list[tuple]:
        if peaks is None:
            return []
        peaks.close()
        out = [(g, pid, level, at, total, bytes.fromhex(h), "loose") for level, at, h in peaks.loose]
        return out + ([(g, pid, len(peaks.widths) - 1, 0, total, bytes.fromhex(peaks.top), "root")] if peaks.top else [])

    for batch in batches:
        found: list[tuple] = []
        names, pids, kinds, ats, totals = (batch.column(k).to_pylist() for k in (1, 0, 2, 4, 5))
        for k, digest in enumerate(batch.column(6)):
            if kinds[k] == 0:
                found += closed()
                g, pid, first, total = names[k], pids[k], ats[k], totals[k]
                peaks = MountainRange(total)
            else:
                peaks.push(first + ats[k], digest.as_py().hex())
        yield _node_batch(found)
    yield _node_batch(closed())


def _merge(rows: pa.Table) -> pa.Table:
    """Loose nodes of neighbouring runs of one group: complete runs become their node, the rest stays loose."""
    total, g, pid = (rows[c][0].as_py() for c in ("total", "g", "pid"))
    widths = MountainRange(total).widths
    levels: list[dict[int, bytes]] = [{} for _ in widths]
    for level, at, digest in zip(rows["level"].to_pylist(), rows["at"].to_pylist(), rows["hash"].to_pylist(), strict=True):
        levels[level][at] = digest
    out = []
    old = [set(x) for x in levels]
    for level, nodes in enumerate(levels[:-1]):
        for k in sorted({at // FANOUT for at in nodes}):
            run = range(FANOUT * k, min(FANOUT * k + FANOUT, widths[level]))
            if all(at in nodes for at in run):
                levels[level + 1][k] = bytes.fromhex(node_hash(*(nodes[at].hex() for at in run)))
                if level + 2 == len(widths):
                    out.append((g, pid, level + 1, 0, total, levels[level + 1][k], "root"))
                out += ((g, pid, level, at, total, nodes.pop(at), "done" if at in old[level] else "new") for at in run)
    for level, nodes in enumerate(levels[:-1]):
        out += ((g, pid, level, at, total, h, "loose" if at in old[level] else "made") for at, h in nodes.items())
    return pa.Table.from_batches([_node_batch(out)])


def forest(leaves: DataFrame, runs: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes across partitions: g, level, at, hash; roots: g, hash).

    Each indexed partition hands on a few loose nodes a level; neighbouring
    partitions merge theirs, ``MERGED`` at a time, until one task a group has the
    few that are left.
    """
    found = scratch.save(_pass(leaves, runs).mapInArrow(_peaks, NODES), f"{name}_peaks")
    nodes, roots, loose = found.where("kind = 'loose'"), found.where("kind = 'root'"), found.where("kind = 'loose'")
    parts, step = 1 + (runs.agg(F.max("pid")).first()[0] or 0), 0
    while parts > 1:
        parts, step = -(-parts // MERGED), step + 1
        near = loose.withColumn("pid", F.floor(F.col("pid") / MERGED).cast("int"))
        merged = scratch.save(near.groupBy("g", "pid").applyInArrow(_merge, NODES), f"{name}_merged_{step}")
        nodes = nodes.unionByName(merged.where("kind in ('new', 'made')"))
        roots = roots.unionByName(merged.where("kind = 'root'"))
        loose = merged.where("kind in ('loose', 'made')")
    return nodes.select("g", "level", "at", "hash"), scratch.save(roots.select("g", "hash"), f"{name}_roots")


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes from outside a run that proofs of its leaves need: at most two runs of siblings a level."""
    for batch in batches:
        found = []
        for pid, g, n, first, total in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            low, high, lo, hi, level = first, first + n, first, first + n - 1, 0
            while (w := width(total, level)) > 1:
                for k in {lo // FANOUT, hi // FANOUT}:
                    found += ((pid, g, level, at) for at in range(FANOUT * k, min(FANOUT * k + FANOUT, w)) if not low <= at < high)
                # Nodes that lie in the run as a whole: [low, high) of the next level.
                low, high = -(-low // FANOUT), -(-w // FANOUT) if high == w else high // FANOUT
                lo, hi, level = lo // FANOUT, hi // FANOUT, level + 1
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["pid", "g", "level", "at"])


class RunTree:
    """The tree above one run of leaves, with what was brought from elsewhere; gives each leaf its siblings level by level."""

    def __init__(self, first: int, total: int, leaves: list[str], brought: dict[tuple[int, int], str]):
        self.widths, self.brought = MountainRange(total).widths, brought
        self.levels, self.low = [leaves], [first]
        for w in self.widths[:-1]:
            low, nodes = self.low[-1], self.levels[-1]
            high, at = low + len(nodes), -(-low // FANOUT)
            up = []
            while FANOUT * (at + len(up)) < high and min(FANOUT * (at + len(up)) + FANOUT, w) <= high:
                s = FANOUT * (at + len(up))
                up.append(node_hash(*nodes[s - low : min(s + FANOUT, w) - low]))
            self.low.append(at)
            self.levels.append(up)
        self.last: list[tuple[int, list]] = [(-1, []) for _ in self.widths]

    def node(self, level: int, at: int) -> str:
        k = at - self.low[level]
        return self.levels[level][k] if 0 <= k < len(self.levels[level]) else self.brought[level, at]

    def path(self, level: int, at: int) -> list[tuple[str, str]]:
        """(siblings before, siblings after) on this level and those above; neighbours share what lies above them."""
        if level == len(self.widths) - 1:
            return []
        if self.last[level][0] != at:
            s = at - at % FANOUT
            run = range(s, min(s + FANOUT, self.widths[level]))
            own = "".join(self.node(level, k) for k in run if k < at), "".join(self.node(level, k) for k in run if k > at)
            self.last[level] = at, [own, *self.path(level + 1, at // FANOUT)]
        return self.last[level][1]


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root over a leaf with these siblings."""
    for before, after in path:
        digest = node_hash(before, digest, after)
    return digest


def _as_text(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in path)


def _as_path(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in text.split(";")] if text else []


PROVED = "g string, name string, doc_id long, leaf string, path string, proof_sha256 string, folded_root string, subroot string, root string"


def _proofs(want_path: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: dict = {}

        def closed() -> Iterator[pa.RecordBatch]:
            if not run:
                return
            subroot, root, tail = run["tail"].split("|") if run["tail"] else ("", "", "")
            top = _as_path(tail)
            tree = RunTree(run["first"], run["total"], run["leaves"], run["brought"])
            out = []
            for k, (leaf, other, doc_id, name) in enumerate(zip(run["leaves"], run["others"], run["ids"], run["names"], strict=True)):
                path = [*tree.path(0, run["first"] + k), *top]
                out.append((run["g"], name, doc_id, leaf, _as_text(path) if want_path else None, node_hash(*(a + b for a, b in path)), fold(other or leaf, path), subroot, root))
                if len(out) == 10_000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            types = (pa.string(), pa.string(), pa.int64(), *[pa.string()] * 6)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["g", "name", "doc_id", "leaf", "path", "proof_sha256", "folded_root", "subroot", "root"])

        for batch in batches:
            names, kinds, levels, ats, totals = (batch.column(k).to_pylist() for k in (1, 2, 3, 4, 5))
            hashes, ids, others, marks, tails = (batch.column(k).to_pylist() for k in (6, 7, 8, 9, 10))
            for k, kind in enumerate(kinds):
                if kind == 0:
                    yield from closed()
                    run = {"g": names[k], "first": ats[k], "total": totals[k], "tail": tails[k], "leaves": [], "others": [], "ids": [], "names": [], "brought": {}}
                elif kind == 1:
                    run["brought"][levels[k], ats[k]] = hashes[k].hex()
                else:
                    run["leaves"].append(hashes[k].hex())
                    run["others"].append(others[k].hex() if others[k] is not None else None)
                    run["ids"].append(ids[k])
                    run["names"].append(marks[k])
        yield from closed()

    return read


def proofs(leaves: DataFrame, runs: DataFrame, nodes: DataFrame, want_path: bool = False) -> DataFrame:
    """Each leaf with its proof and the root folded over it; ``runs`` with ``tail``: 'subroot|root|path above the group'."""
    wanted = runs.where("n < total").select("pid", "g", "n", "first", "total").mapInArrow(_wanted, "pid int, g string, level int, at long")
    return _pass(leaves, runs, wanted.join(nodes, ["g", "level", "at"])).mapInArrow(_proofs(want_path), PROVED)


def manifest(rows: DataFrame, scratch: Scratch, rows_per_part: int = ROWS) -> DataFrame:
    """``rows``: (g, doc_id, hash, other), a written table of leaves; ``other`` null or a leaf to check in place of ``hash``.

    Leaves of a group ascend by doc_id (null first) and hash; the roots of the
    groups, ordered by g, are the leaves of one tree above.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-rows.count() // rows_per_part))
    no_name = F.lit(None).cast("string").alias("name")
    leaves, runs = indexed(rows.select("*", no_name), scratch, "rows", ["doc_id", "hash"], parts)
    nodes, subroots = forest(leaves, runs, scratch, "rows")
    tops = scratch.save(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "hash", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("other")), "tops")
    top_leaves, top_runs = indexed(tops, scratch, "tops", ["name"], -(-tops.count() // rows_per_part) or 1)
    top_nodes, roots = forest(top_leaves, top_runs, scratch, "tops")
    above = proofs(top_leaves, top_runs, top_nodes, want_path=True)
    root = F.broadcast(roots.select(F.lower(F.hex("hash")).alias("root")))  # one row
    tails = above.select(F.col("name").alias("g"), F.col("leaf").alias("subroot"), "path").join(root).select("g", F.concat_ws("|", "subroot", "root", "path").alias("tail"))
    return proofs(leaves, runs.join(tails, "g"), nodes)


def dataset_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", tampered: dict[str, Column] | None = None, rows_per_part: int = ROWS) -> DataFrame:
    """Each row's leaf, its source's subroot, the root, its proof and the root folded over the leaf it has now.

    ``tampered`` replaces columns before the check (default: nothing is tampered).
    A tree has fanout 3 and no padding: a last run of fewer nodes is hashed as it
    is, also one alone, and a lone leaf is its group's subroot. Rows of a group
    ascend by doc_id, null first, then by leaf; equal rows have equal leaves and
    their places, so their proofs, are dealt among them. A null source is the
    first group. Empty tables give no rows. Only digests move: texts are hashed
    where they are read.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    now = {c: F.col(c) for c in columns}
    changed = {c: (tampered or {}).get(c, v) for c, v in now.items()}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf_hash(now)).alias("hash"), (F.unhex(leaf_hash(changed)) if tampered else F.lit(None).cast("binary")).alias("other"),
    )
    out = manifest(scratch.save(rows, "hashed"), scratch, rows_per_part)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return dataset_manifest(table(spark, sf_dir, "documents"), tampered={"text": cut})


def _levels(name: str, levels: int) -> str:
    """SQL of ``levels`` levels over the leaves ``name``0 (s, i, n, h): nodes ``name``k and their siblings ``name``_sk."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}_s{k} AS (SELECT s, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY s, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            f" coalesce(string_agg(h, '') OVER (PARTITION BY s, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),\n"
            f"{name}{k + 1} AS (SELECT s, i // 3 AS i, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY s, i // 3, n),\n"
        )
    return "".join(out)


#: Levels that the SQL spells out: up to 3 ** 11 documents of a source, and as many sources.
SQL_LEVELS = 11


def _oracle(levels: int = SQL_LEVELS) -> str:
    one = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256(concat({one('doc_id')}, {one('source')}, {one('lang')}, {one('n_chars')}, {one(text)}))"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: list_reduce(list_prepend(xor(c, d), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
    steps, joins = [], []
    for tree, key in (("d", "l.s"), ("u", "''")):
        for k in range(levels):
            at = f"({'l.i' if tree == 'd' else 'l.ui'} // {3**k})"
            joins.append(f"JOIN {tree}_s{k} {tree}{k}x ON {tree}{k}x.s = {key} AND {tree}{k}x.i = {at}")
            steps.append(f"{tree}{k}x")
    folded = "l.t"
    chain, last = [], "f_0"
    cols = ", ".join(f"{x}.n AS {x}n, {x}.l AS {x}l, {x}.r AS {x}r" for x in steps)
    chain.append(f"f_0 AS (SELECT l.doc_id, l.h AS leaf, {folded} AS f, g.h AS subroot, l.root, {cols} FROM placed l JOIN d{levels} g ON g.s = l.s {' '.join(joins)})")
    for k, x in enumerate(steps):
        chain.append(f"f_{k + 1} AS (SELECT * REPLACE (CASE WHEN {x}n = 1 THEN f ELSE sha256(concat({x}l, f, {x}r)) END AS f) FROM {last})")
        last = f"f_{k + 1}"
    proof = "sha256(concat(" + ", ".join(f"{x}l, {x}r" for x in steps) + "))"
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce('1' || source, '0') AS s, {leaf('text')} AS h,
    CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS t
  FROM documents),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM hashed),
d0 AS (SELECT s, i, n, h FROM rows_),
{_levels("d", levels)}tops AS (SELECT s AS name, h, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM d{levels}),
u0 AS (SELECT '' AS s, i, n, h FROM tops),
{_levels("u", levels)}placed AS (SELECT r.*, tops.i AS ui, (SELECT h FROM u{levels}) AS root FROM rows_ r JOIN tops ON tops.name = r.s),
{", ".join(chain)}
SELECT doc_id, leaf, subroot, root, {proof} AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}
"""


OP13_SQL = _oracle()
