"""Search plans: validation, compilation to columns, trigram index, caches that provably cover a plan, branch scans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions import text
from signalweave.operators.ranking import hash_order
from signalweave.storage import broadcast_if_small

#: Phrases, groups and bytes that a plan may hold.
MOST_PHRASES, MOST_GROUPS, MOST_GROUP_PHRASES, MOST_EXCLUDED, MOST_BYTES = 64, 5, 3, 10, 2_000
#: Trigrams that a search broadcasts to the index.
BROADCAST_GRAMS = 100_000


@dataclass(frozen=True)
class Plan:
    """Any literal, or one phrase of every group; no excluded phrase; whole words within one field."""

    include: tuple[str, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()
    exclude: tuple[str, ...] = ()
    orthographic: bool = False
    fields: tuple[str, ...] = field(default=("title", "abstract"))

    def __post_init__(self):
        phrases = [*self.include, *(p for g in self.groups for p in g), *self.exclude]
        if not self.include and not self.groups:
            raise ValueError("a plan needs a phrase or a group")
        if any(not p.strip() for p in phrases):
            raise ValueError("blank phrase")
        if len(self.include) > MOST_PHRASES or len(self.groups) > MOST_GROUPS or any(not 1 <= len(g) <= MOST_GROUP_PHRASES for g in self.groups) or len(self.exclude) > MOST_EXCLUDED:
            raise ValueError("too many phrases")

    def column(self) -> Column:
        """The exact predicate."""
        fields = [F.col(f) for f in self.fields]
        each = lambda ps: text.any_of([text.has_phrase(f, p, self.orthographic) for p in ps for f in fields])
        whole = text.all_of([each(g) for g in self.groups]) if self.groups else F.lit(False)
        return (each(self.include) | whole) & ~each(self.exclude)

    def coarse(self) -> Column:
        """A cheap superset: substrings only, no patterns; exclusions are left to the exact predicate."""
        norm = [text.normalise(F.col(f), self.orthographic) for f in self.fields]
        fold = lambda p: " ".join((re.sub(text.SEPARATORS, " ", p.lower()) if self.orthographic else p.lower()).split())
        each = lambda ps: text.any_of([n.contains(fold(p)) for p in ps for n in norm])
        whole = text.all_of([each(g) for g in self.groups]) if self.groups else F.lit(False)
        return each(self.include) | whole

    def indexable(self) -> bool:
        """May a trigram index serve the plan? Only plain literals of three characters and more."""
        return not self.groups and all(re.fullmatch(r"[a-z0-9][a-z0-9 \-]{1,}[a-z0-9]", p.lower()) for p in self.include)

    def expression(self) -> str:
        """Boolean text: groups and literals of quoted phrases."""
        quote = lambda p: '"' + re.sub(r'[\\"]', "", p).strip() + '"'
        any_of = lambda ps: "(" + " OR ".join(map(quote, ps)) + ")"
        parts = [any_of(self.include)] if self.include else []
        if self.groups:
            parts.append("(" + " AND ".join(map(any_of, self.groups)) + ")")
        out = " OR ".join(parts) + (" NOT " + any_of(self.exclude) if self.exclude else "")
        if len(out.encode()) > MOST_BYTES:
            raise ValueError("the expression is too long")
        return out

    def implied_by(self, anchors: list[str]) -> bool:
        """Does every match of this plan hold one of ``anchors`` as whole words? Then a cache of those covers it."""
        inside = lambda p: any(re.search(r"(?<!\w)" + re.escape(a.lower()) + r"(?!\w)", p.lower()) for a in anchors)
        return all(map(inside, self.include)) and (not self.groups or any(all(map(inside, g)) for g in self.groups))


def compiled(plans: DataFrame) -> DataFrame:
    """A table of plans compiled row by row: plan, admissible, indexable, expression, implied.

    ``plans``: plan, include, groups (array of arrays), exclude, anchors; nulls count as
    empty. What ``Plan`` says of one plan is said here of all, as columns; a plan
    that ``Plan`` would refuse is not admissible and has nulls otherwise.
    """
    some = lambda c, kind="array<string>": F.coalesce(F.col(c), F.array().cast(kind))
    t = plans.select("plan", some("include").alias("include"), some("groups", "array<array<string>>").alias("groups"), some("exclude").alias("exclude"), some("anchors").alias("anchors"))
    blank = lambda ps: F.exists(ps, lambda p: F.coalesce(F.trim(p), F.lit("")) == "")
    quoted = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(F.lit('"'), F.trim(F.regexp_replace(p, r'[\\"]', "")), F.lit('"'))), " OR ")
    any_of = lambda ps: F.concat(F.lit("("), quoted(ps), F.lit(")"))
    every = F.concat(F.lit("("), F.array_join(F.transform("groups", any_of), " AND "), F.lit(")"))
    literals, grouped = F.when(F.size("include") > 0, any_of(F.col("include"))), F.when(F.size("groups") > 0, every)
    text_of = F.concat(F.concat_ws(" OR ", literals, grouped), F.when(F.size("exclude") > 0, F.concat(F.lit(" NOT "), any_of(F.col("exclude")))).otherwise(""))
    held = (F.size("include") + F.size("groups") > 0) & (F.size("include") <= MOST_PHRASES) & (F.size("groups") <= MOST_GROUPS) & (F.size("exclude") <= MOST_EXCLUDED)
    right = F.forall("groups", lambda g: F.size(g).between(1, MOST_GROUP_PHRASES) & ~blank(g))
    admissible = held & right & ~blank(F.col("include")) & ~blank(F.col("exclude")) & (F.octet_length(text_of) <= MOST_BYTES)
    within = lambda p: F.exists("anchors", lambda a: F.rlike(F.lower(p), F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(a), F.lit(r"\E(?!\w)"))))
    implied = F.forall("include", within) & ((F.size("groups") == 0) | F.exists("groups", lambda g: F.forall(g, within)))
    indexable = (F.size("groups") == 0) & F.forall("include", lambda p: F.rlike(F.lower(p), F.lit(r"^[a-z0-9][a-z0-9 \-]{1,}[a-z0-9]$")))
    t = t.withColumn("admissible", F.coalesce(admissible, F.lit(False)))
    return t.select("plan", "admissible", *(F.when(F.col("admissible"), c).alias(n) for n, c in (("indexable", indexable), ("expression", text_of), ("implied", implied))))


def select(df: DataFrame, plan: Plan) -> DataFrame:
    """Rows that match; the coarse test runs first and spares most patterns."""
    return df.where(plan.coarse()).where(plan.column())


def build_index(df: DataFrame, key: str, fields: list[str], path: str) -> None:
    """Inverted trigram index (gram, ids per row) as Parquet, sorted by gram so that readers skip row groups."""
    norm = F.concat_ws(" \n ", *[text.normalise(F.col(f), True) for f in fields])
    grams = df.select(key, norm.alias("_t")).select(key, F.explode(text.trigrams(F.col("_t"))).alias("gram"))
    grams.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write.mode("errorifexists").parquet(path)


def index_candidates(index: DataFrame, key: str, phrase: str) -> DataFrame:
    """Keys that hold all trigrams of a phrase: counts of met postings, never pairs."""
    folded = " ".join(re.sub(text.SEPARATORS, " ", phrase.lower()).split())
    grams = sorted({folded[i : i + 3] for i in range(len(folded) - 2)})
    if not grams:
        raise ValueError("a phrase needs three characters")
    return index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(grams)).select(key)


def search(df: DataFrame, index: DataFrame, key: str, plan: Plan) -> DataFrame:
    """Matches by way of the index; plans that it may not serve, and keys that repeat in ``df``, go by the full scan."""
    if not plan.indexable() or df.groupBy(key).count().where("count > 1").limit(1).count():
        return select(df, plan)
    found = None
    for p in plan.include:
        one = index_candidates(index, key, p)
        found = one if found is None else found.unionAll(one)
    return df.join(broadcast_if_small(found.distinct(), BROADCAST_GRAMS), key, "left_semi").where(plan.column())


def thematic_cache(df: DataFrame, anchors: list[str], fields: list[str], path: str) -> DataFrame:
    """Rows that hold any anchor, with the anchors they hold, written once; returns the counts per anchor."""
    held = F.array_compact(F.array(*[F.when(text.any_of([text.has_phrase(F.col(f), a) for f in fields]), F.lit(a)) for a in anchors]))
    df.withColumn("anchors", held).where("size(anchors) > 0").write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path).select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("rows"))


def cached_or_full(full: DataFrame, cache: DataFrame, anchors: list[str], plan: Plan) -> DataFrame:
    """The plan's matches from the cache where that provably covers it, else from the full table."""
    return select(cache.drop("anchors") if plan.implied_by(anchors) else full, plan)


def branches(df: DataFrame, plans: dict[str, Plan], key: str, day: str, n: int, balanced: bool = True) -> DataFrame:
    """(branch, key, day, turn): one scan for all branches; per branch ``n`` rows, in turns over the years or the latest."""
    hits = F.array_compact(F.array(*[F.when(p.coarse() & p.column(), F.lit(b)) for b, p in plans.items()]))
    t = df.withColumn("branch", F.explode(hits)).select("branch", key, day)
    if not balanced:
        turn = F.row_number().over(W.partitionBy("branch").orderBy(F.col(day).desc(), F.col(key).desc()))
        return t.withColumn("turn", turn).where(F.col("turn") <= n)
    within = F.row_number().over(W.partitionBy("branch", F.year(day)).orderBy(hash_order("branch", key), key))
    few = t.withColumn("_t", within).where(F.col("_t") <= n)
    return few.withColumn("turn", F.row_number().over(W.partitionBy("branch").orderBy("_t", F.year(day).desc()))).where(F.col("turn") <= n).drop("_t")
