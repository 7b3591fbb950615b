"""Mixing of sources to target weights: capacity is routed from membership patterns to quotas, documents follow by seed."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalweave.operators.components import components

from .common import Scratch, broadcast_if_small, table

#: Weights of sources in order, repeating; times that a document is taken at most; part of every document's place in the mix.
WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, "mix"
#: Sources ranked by one task; groups up to which their sizes and cuts are broadcast; passes that fill what a cut left open.
RANKED, BROADCAST_GROUPS, FILLS = 1_000_000, 100_000, 4
#: Hex digits by which a cut is narrowed at once.
DIGITS = 3

#: Fixed value: what parts words.
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none. Words shrink to a letter each, so that no list of them is made."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x"), BLANKS, "")).cast("long")


def ranks(rows: DataFrame, order: list[Column], scratch: Scratch, name: str, per_task: int = RANKED) -> DataFrame:
    """``rows`` with ``rank`` from 0 in ``order``; ranges are numbered apart and shifted by what lies before them."""
    parts = 1 + rows.count() // per_task
    dealt = scratch.save(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.expr("sum(_n) over (order by _part) - _n").alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("rank", F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def targets(sources: DataFrame, total: int, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, per_task: int = RANKED) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: the weights' shares of ``total``, none above ``repeats`` times its source.

    Weights go by the sources' code points, null last. What targets lose at
    their bound is shared again by weight until none is above; each round is one
    aggregate, and only its sums reach the driver.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = scratch.save(ranks(sources, [F.col("source").asc_nulls_last()], scratch, "ranked", per_task).withColumn("weight", weight).drop("rank"), "weights")
    bound = F.col("source_size") * repeats
    held, n = F.lit(False), -1
    while True:
        held_n, held_size, open_weight = ranked.agg(F.count_if(held), F.coalesce(F.sum(F.when(held, bound)), F.lit(0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0))).first()
        left = total - held_size
        if held_n == n or not open_weight:
            break
        n = held_n
        # Above its bound: weight's share of what is left, over a common denominator.
        held = held | (F.lit(left).cast("decimal(38,0)") * F.col("weight") > bound.cast("decimal(38,0)") * F.lit(open_weight))
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(open_weight or 1))
    return ranked.withColumn("target", F.when(held, bound.cast("double")).otherwise(share)).drop("weight")


class Flow:
    """Maximum flow by blocking flows over shortest paths; capacities may be raised between calls."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def push(self, source: int, sink: int) -> None:
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                x = queue.popleft()
                for e in self.out[x]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return
            tried = [0] * len(self.out)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, at = [], source
                elif tried[at] < len(self.out[at]):
                    e = self.out[at][tried[at]]
                    if self.room[e] and level.get(self.to[e]) == level[at] + 1:
                        path.append(e)
                        at = self.to[e]
                    else:
                        tried[at] += 1
                elif path:
                    at = self.to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break


def cheapest_routes(sizes: dict[str, int], members: list[tuple[str, str]], quotas: dict[str, int], repeats: int = REPEATS) -> dict[tuple[str, str], int]:
    """Words that each pattern gives each of its sources, at the least cost of repetition.

    The k-th copy of a pattern's words costs more than the one before, the same
    in all patterns, so shortest augmenting paths use first copies of all
    patterns before second ones: capacities are raised by one copy at a time.
    """
    patterns, sources = sorted(sizes), sorted(quotas)
    place = {("p", p): 2 + k for k, p in enumerate(patterns)} | {("s", s): 2 + len(patterns) + k for k, s in enumerate(sources)}
    flow = Flow(2 + len(place))
    copies = [flow.edge(0, place["p", p], 0) for p in patterns]
    for s in sources:
        flow.edge(place["s", s], 1, quotas[s])
    routes = {(p, s): flow.edge(place["p", p], place["s", s], repeats * sizes[p]) for p, s in sorted(members)}
    for _ in range(repeats):
        for e, p in zip(copies, patterns, strict=True):
            flow.room[e] += sizes[p]
        flow.push(0, 1)
    return {k: flow.room[e ^ 1] for k, e in routes.items()}


def routes(patterns: DataFrame, quotas: DataFrame, scratch: Scratch, repeats: int = REPEATS) -> DataFrame:
    """(pattern, source, words): ``patterns`` (pattern, sources, size) to ``quotas`` (source, quota); sources are never null here.

    A source that no other shares documents with takes its quota from its own
    pattern. Sources that share are solved together, a component of the graph of
    patterns and sources in a task; it holds patterns, not documents.
    """
    links = scratch.save(patterns.select("pattern", "size", F.explode("sources").alias("source"), (F.size("sources") > 1).alias("shared")).join(quotas, "source"), "links")
    alone = links.groupBy("source").agg(F.count("*").alias("n"), F.max("shared").alias("mixed")).where("n = 1 and not mixed").select("source")
    plain = links.join(alone, "source", "left_semi").select("pattern", "source", F.least(F.col("quota"), F.col("size") * repeats).alias("words"))
    if not links.where("shared").limit(1).count():
        return plain

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = cheapest_routes(dict(zip(rows["pattern"], rows["size"].tolist(), strict=True)), list(zip(rows["pattern"], rows["source"], strict=True)), dict(zip(rows["source"], rows["quota"].tolist(), strict=True)), repeats)
        return pd.DataFrame([(p, s, w) for (p, s), w in found.items()], columns=["pattern", "source", "words"])

    rest = links.join(alone, "source", "left_anti").withColumns({"src": F.xxhash64(F.lit("p"), "pattern"), "dst": F.xxhash64(F.lit("s"), "source")})
    joined = rest.join(components(rest.select("src", "dst"), scratch, "sharing").withColumnRenamed("node", "src"), "src")
    return plain.unionByName(joined.select("component", "pattern", "size", "source", "quota").groupBy("component").applyInPandas(solve, "pattern string, source string, words long"))


def cuts(units: DataFrame, limits: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Where the running sum of sizes passes a limit: ``limits`` (q, cut, low, most, room) with took, edge, edge_size, edge_copies.

    ``units``: (q, key, size, n) with keys of hex digits; those after ``low`` and of
    at most ``most`` words stand in line by key, ``n`` copies each. All before
    ``edge`` fit the room, with edge_copies of the edge itself; edge is null where
    all fit. Sums by the next digits of the keys narrow an edge to one unit, so
    that no group is sorted or met in one task.
    """
    state = limits.withColumns({"prefix": F.lit(""), "took": F.lit(0).cast("long"), "edge": F.lit(None).cast("string"), "edge_size": F.lit(None).cast("long"), "edge_n": F.lit(None).cast("long")})
    digits = 0
    while digits < 32:
        digits += DIGITS
        near = units.join(broadcast_if_small(state.select("q", "cut", "low", "most", "prefix", "room", "took"), BROADCAST_GROUPS), "q").where("key > low and size <= most and startswith(key, prefix)")
        sums = near.groupBy("q", "cut", "low", "most", "prefix", "room", "took", F.substring("key", 1, digits).alias("next")).agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.count("*").alias("units"), F.min("key").alias("edge"), F.max("size").alias("edge_size"), F.max("n").alias("edge_n"))
        line = "over (partition by q, cut order by next)"
        placed = sums.withColumn("through", F.expr(f"sum(s) {line}")).where("took + through > room")
        first = placed.withColumn("_k", F.row_number().over(Window.partitionBy("q", "cut").orderBy("next"))).where("_k = 1")
        found = scratch.save(first.select("q", "cut", "low", "most", "room", F.col("next").alias("prefix"), (F.col("took") + F.col("through") - F.col("s")).alias("took"), "edge", "edge_size", "edge_n", "units"), f"{name}_{digits}")
        whole = state.join(found.select("q", "cut"), ["q", "cut"], "left_anti") if digits == DIGITS else None
        if digits == DIGITS:
            all_fit = near.groupBy("q", "cut").agg(F.sum(F.col("size") * F.col("n")).alias("fits"))
            done = scratch.save(whole.join(all_fit, ["q", "cut"], "left").withColumn("took", F.coalesce("fits", F.lit(0).cast("long"))).drop("fits", "prefix", "edge_n"), f"{name}_whole")
        state = found.drop("units")
        if not found.where("units > 1").limit(1).count():
            break
    copies = F.least(F.floor((F.col("room") - F.col("took")) / F.col("edge_size")).cast("long"), F.col("edge_n") - 1)
    edged = state.withColumn("edge_copies", copies).withColumn("took", F.col("took") + F.col("edge_copies") * F.col("edge_size")).drop("prefix", "edge_n")
    return edged.unionByName(done.withColumn("edge_copies", F.lit(0).cast("long")))


def seeded(units: DataFrame, wanted: DataFrame, scratch: Scratch, repeats: int = REPEATS) -> DataFrame:
    """``units`` (q, key, size, n, ...) with ``every``, copies taken of each, and ``extra``, how many of the n are taken once more.

    ``wanted``: (q, words, group_size). All units of a group are taken as often as its
    words hold the group whole; the rest goes to units in the order of their keys.
    What is left open where a unit does not fit is filled by later and smaller ones,
    ``FILLS`` times, and by one of those that did not fit if that comes nearer.
    """
    every = F.when(F.col("group_size") > 0, F.least(F.floor(F.col("words") / F.col("group_size")), F.lit(repeats))).otherwise(0).cast("long")
    goals = scratch.save(wanted.withColumn("every", every).withColumn("room", F.when(F.col("every") >= repeats, 0).otherwise(F.col("words") - F.col("every") * F.col("group_size")).cast("long")), "goals")
    limits = goals.where("room > 0").select("q", F.lit(0).alias("cut"), F.lit("").alias("low"), F.lit((1 << 63) - 1).alias("most"), "room")
    steps = None
    for k in range(FILLS):
        found = scratch.save(cuts(units, limits, scratch, f"fill_{k}").withColumn("step", F.lit(k)), f"filled_{k}")
        steps = found if steps is None else steps.unionByName(found)
        gap = F.col("room") - F.col("took")
        limits = found.where("edge is not null").where(gap > 0).select("q", "cut", F.col("edge").alias("low"), gap.alias("most"), gap.alias("room"))
        if not limits.limit(1).count():
            break
    step = F.struct("low", "most", "edge", "edge_copies", "step", "edge_size")
    by_group = steps.groupBy("q").agg(F.collect_list(step).alias("steps"), F.min_by(F.col("room") - F.col("took"), -F.col("step")).alias("gap"), F.min(F.when(F.col("edge").isNotNull(), F.struct("edge_size", "edge"))).alias("small"))
    nearer = F.when(F.col("small.edge_size") < 2 * F.col("gap"), F.col("small.edge"))
    plan = scratch.save(goals.join(by_group.withColumn("bonus", nearer).select("q", "steps", "bonus"), "q", "left").select("q", "every", "steps", "bonus"), "plan")
    each = F.expr("aggregate(coalesce(steps, array()), 0L, (a, s) -> a + case when key = s.edge then s.edge_copies when key > s.low and size <= s.most and (s.edge is null or key < s.edge) then n else 0L end)")
    taken = units.join(broadcast_if_small(plan, BROADCAST_GROUPS), "q")
    return taken.withColumn("extra", each + F.when(F.col("key") == F.col("bonus"), 1).otherwise(0)).drop("steps", "bonus")


def mix(docs: DataFrame, members: Column, size: Column, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """How many words of each document a mix of all sources takes: doc_id, sources, size, source, source_size, target, taken.

    ``members``: array of the sources a document belongs to; null or empty belongs to
    the null source, as does a null in it. ``source`` is the one it is taken for, source_size all words that
    belong to that source. Whole documents are taken, up to ``repeats`` times; their
    order is a hash of seed, id, text and sources, so that reruns agree. Equal rows
    are counted once and dealt out again at the end: so many of them are taken
    once more than the others. Null texts and texts without words are never taken.
    Empty tables give no rows.
    """
    # Sources as keys without nulls that keep the order, null last.
    keyed = F.transform(F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None).cast("string"))), lambda s: F.coalesce(F.concat(F.lit("0"), s), F.lit("1")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_sort(F.array_distinct(keyed)).alias("sources"), size.alias("size"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_md5"))
    pattern = F.md5(F.to_json("sources").cast("binary"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_md5").cast("binary"))
    units = scratch.save(rows.select("doc_id", "sources", "size", pattern.alias("pattern"), key.alias("key")).groupBy("doc_id", "sources", "pattern", "size", "key").agg(F.count("*").alias("n")), "units")
    words = F.sum(F.col("size") * F.col("n"))
    patterns = scratch.save(units.groupBy("pattern", "sources").agg(words.alias("size")), "patterns")
    sizes = patterns.select("size", F.explode("sources").alias("source")).groupBy("source").agg(F.sum("size").alias("source_size"))
    # A source's share is of all words once, whatever number of sources a document belongs to.
    goals = scratch.save(targets(sizes, patterns.agg(F.sum("size")).first()[0] or 0, scratch, weights, repeats), "goals_of_sources")
    given = scratch.save(routes(patterns, goals.select("source", F.round("target").cast("long").alias("quota")), scratch, repeats), "given")
    # Documents of a shared pattern are dealt to its sources by another part of their keys, in proportion to what these get.
    shares = given.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("source", "words"))).alias("to"), F.sum("words").alias("all"))
    dealt = units.join(broadcast_if_small(shares, BROADCAST_GROUPS), "pattern")
    point = F.conv(F.substring(F.md5(F.concat(F.lit("deal|"), "key").cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)
    ends = F.expr("transform(to, (t, k) -> aggregate(slice(to, 1, k + 1), 0L, (a, x) -> a + x.words))")
    chosen = F.when(F.size("to") == 1, F.lit(0)).otherwise(F.size(F.filter("ends", lambda e: e <= F.col("point") * F.col("all"))))
    dealt = dealt.withColumns({"point": point, "ends": ends}).withColumn("_to", F.least(chosen, F.size("to") - 1)).withColumn("source", F.expr("to[_to].source"))
    dealt = scratch.save(dealt.select("doc_id", "sources", "size", "key", "n", "source", F.concat_ws("|", "pattern", F.md5(F.col("source").cast("binary"))).alias("q"), F.col("pattern")), "dealt")
    groups = dealt.groupBy("q", "pattern", "source").agg(words.alias("group_size"))
    wanted = groups.join(given, ["pattern", "source"]).select("q", "words", "group_size")
    taken = seeded(dealt.drop("pattern"), wanted, scratch, repeats).join(broadcast_if_small(goals, BROADCAST_GROUPS), "source")
    copies = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    amount = F.col("size") * (F.col("every") + F.when(F.col("_copy") <= F.col("extra"), 1).otherwise(0))
    named = lambda c: F.when(F.startswith(c, F.lit("0")), F.substr(c, F.lit(2)))
    return copies.select("doc_id", F.transform("sources", named).alias("sources"), "size", named(F.col("source")).alias("source"), "source_size", "target", amount.alias("taken"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, F.array(F.col("source").cast("string")), word_count(F.col("text").cast("string")), Scratch(spark, "mixing"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _oracle(fills: int = FILLS) -> str:
    steps = []
    for k in range(fills):
        steps.append(
            f"""c{k} AS (SELECT r.row, r.q, key, size, sum(size) OVER (PARTITION BY r.q ORDER BY key, row) AS cum, room, low, most FROM r JOIN g{k} ON g{k}.q = r.q AND key > low AND size <= most),
e{k} AS (SELECT g{k}.q, {k} AS step, min_by(key, cum) FILTER (cum > g{k}.room) AS edge, min_by(size, cum) FILTER (cum > g{k}.room) AS edge_size, g{k}.room - coalesce(max(cum) FILTER (cum <= g{k}.room), 0) AS gap
  FROM g{k} LEFT JOIN (SELECT * EXCLUDE (room) FROM c{k}) c ON c.q = g{k}.q GROUP BY g{k}.q, g{k}.room),
g{k + 1} AS (SELECT q, edge AS low, gap AS most, gap AS room FROM e{k} WHERE edge IS NOT NULL AND gap > 0)"""
        )
    union = lambda what: " UNION ALL ".join(what.format(k=k) for k in range(fills))
    return rf"""
WITH r AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('0' || source, '1') AS q, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT q, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY q) - 1) % 3] AS w FROM r GROUP BY q),
f AS (
  SELECT *, row_number() OVER o AS p, {REPEATS} * source_size AS cap, sum({REPEATS} * source_size) OVER o - {REPEATS} * source_size AS cap_before, sum(w) OVER () - (sum(w) OVER o - w) AS open,
    sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY {REPEATS} * source_size / w, q ROWS UNBOUNDED PRECEDING)),
m AS (SELECT coalesce(min(p) FILTER (NOT (total - cap_before) * w > cap * open), max(p) + 1) AS p FROM f),
t AS (
  SELECT f.q, source_size, CASE WHEN f.p < m.p THEN cap::DOUBLE ELSE ((total - (SELECT cap_before FROM f WHERE p = m.p))::DOUBLE * w::DOUBLE) / (SELECT open FROM f WHERE p = m.p)::DOUBLE END AS target FROM f, m),
goals AS (SELECT *, CASE WHEN source_size > 0 THEN least({REPEATS}, least(round(target)::BIGINT, {REPEATS} * source_size) // source_size) ELSE 0 END AS every FROM t),
g0 AS (SELECT q, '' AS low, 9223372036854775807 AS most, round(target)::BIGINT - every * source_size AS room FROM goals WHERE every < {REPEATS} AND round(target)::BIGINT > every * source_size),
{", ".join(steps)},
e AS ({union("SELECT q, step, edge, edge_size, gap FROM e{k}")}),
b AS (SELECT q, CASE WHEN min(edge_size) < 2 * min_by(gap, -step) THEN (min({{'s': edge_size, 'e': edge}}) FILTER (edge IS NOT NULL)).e END AS bonus FROM e GROUP BY q),
taken AS ({union("SELECT row FROM c{k} WHERE cum <= room")}),
x AS (
  SELECT r.*, row IN (SELECT row FROM taken) AS more, bonus IS NOT NULL AND key = bonus AS near FROM r LEFT JOIN b USING (q)),
y AS (SELECT *, near AND NOT more AND row_number() OVER (PARTITION BY q, key, more ORDER BY row) = 1 AS one FROM x)
SELECT doc_id, size, source_size, target, CAST(size * (every + more::INT + one::INT) AS BIGINT) AS taken FROM y JOIN goals USING (q)
"""


OP11_SQL = _oracle()
