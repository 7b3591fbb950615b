"""Compositions found by several generators: merging, overlap, projection to a portfolio map, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.text import composition_hash


def merge_compositions(found: DataFrame) -> DataFrame:
    """Candidates (channel, label, works array) with one row for each set of works: its channels and names."""
    return found.withColumn("composition", composition_hash(F.col("works"))).groupBy("composition").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.array_sort(F.collect_set("label")).alias("labels"), F.first("works").alias("works"), F.first(F.size(F.array_distinct("works"))).alias("size"))


def overlap_join(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """Each left candidate's ``k`` right ones by shared works (candidate, works): counts, fractions, Jaccard.

    Works meet on their id; sizes come from the arrays, so nothing is counted
    twice. Rows that meet carry keys alone; sizes join what was counted.
    """
    one = lambda d, c: d.select(F.col("candidate").alias(c), F.explode(F.array_distinct("works")).alias("w"))
    size = lambda d, c: d.select(F.col("candidate").alias(c), F.size(F.array_distinct("works")).alias(f"n_{c}"))
    shared = one(left, "a").join(one(right, "b"), "w").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = shared.join(size(left, "a"), "a").join(size(right, "b"), "b")
    t = both.withColumns({"of_a": F.col("shared") / F.col("n_a"), "of_b": F.col("shared") / F.col("n_b"), "jaccard": F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))})
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.col("shared").desc(), F.col("jaccard").desc(), "b"))
    return t.withColumn("rank", rank).where(F.col("rank") <= k)


def best_recovery(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each target's best candidate by shared works, then the smaller one, then id; recall; targets without any stay."""
    met = overlap_join(targets.withColumnRenamed("target", "candidate"), candidates, 1_000_000)
    best = F.row_number().over(W.partitionBy("a").orderBy(F.col("shared").desc(), "n_b", "b"))
    top = met.withColumn("_n", best).where("_n = 1").select(F.col("a").alias("target"), F.col("b").alias("candidate"), "shared", F.col("of_a").alias("recall"))
    return targets.select("target").join(top, "target", "left")


def portfolio(topics: DataFrame, share: Column, slope: Column, comparable: Column) -> DataFrame:
    """``topics`` with x (share), y (slope) and the reasons why a point is missing."""
    reasons = F.array_compact(F.array(F.when(share.isNull(), "share_unknown"), F.when(slope.isNull(), "slope_unknown"), F.when(~F.coalesce(comparable, F.lit(False)), "coverage_not_comparable")))
    placed = share.isNotNull() & slope.isNotNull()
    return topics.withColumns({"x": F.when(placed, share), "y": F.when(placed, slope), "missing": reasons})


def transitions(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Counts of (before, after) of a decision by key; rows on one side only count with null on the other."""
    a, b = before.select(key, F.col(column).alias("before"), F.lit(1).alias("_a")), after.select(key, F.col(column).alias("after"), F.lit(1).alias("_b"))
    return a.join(b, key, "full_outer").groupBy("before", "after", F.col("_a").isNotNull().alias("was_there"), F.col("_b").isNotNull().alias("is_there")).agg(F.count("*").alias("n"))


def exact_terms(terms: list[str], text: Column) -> Column:
    """Terms that stand in a normalised text, in their own order."""
    return F.array_compact(F.array(*[F.when(text.contains(t.lower()), F.lit(t)) for t in terms]))
