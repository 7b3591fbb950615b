"""Ranks, orders, samples and merges with full tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.storage import Scratch

MIN_PEERS = 5


def midrank_percentile(df: DataFrame, value: str, by: list[str], out: str = "percentile", peers: int = MIN_PEERS) -> DataFrame:
    """100 (less + half of the equal) / n among known values; null under ``peers`` or for unknown values; two decimals."""
    known = F.col(value).isNotNull()
    w = W.partitionBy(*by, known)
    n = F.count(value).over(w)
    less, equal = F.rank().over(w.orderBy(value)) - 1, F.count(value).over(W.partitionBy(*by, value))
    return df.withColumn(out, F.when(known & (n >= peers), F.bround(100 * (less + 0.5 * equal) / n, 2)))


def prevalence_rank(df: DataFrame, share: str, by: list[str], out: str = "prevalence_rank", peers: int = MIN_PEERS) -> DataFrame:
    """Mid-rank of a share among the topics that have any; topics without are ranked against those."""
    v = F.col(share)
    active = F.when(v > 0, v)
    n = F.count(active).over(W.partitionBy(*by))
    order = W.partitionBy(*by).orderBy(v)
    less = F.count(active).over(order.rangeBetween(W.unboundedPreceding, W.currentRow)) - F.count(active).over(W.partitionBy(*by, v))
    equal = F.count(active).over(W.partitionBy(*by, v))
    return df.withColumn(out, F.when(v.isNotNull() & (n >= peers), F.bround(100 * (less + 0.5 * equal) / n, 2)))


def duplicate_rank(df: DataFrame, key: str, order: list[str], out: str = "duplicate_rank") -> DataFrame:
    """Occurrences before this one of a repeated key, in order; null where the key is unique or null."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn(out, F.when(F.col(key).isNotNull() & (F.count("*").over(W.partitionBy(key)) > 1), rank))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def hash_order(salt: str, key: str) -> Column:
    """SHA-256 of a salt, a zero byte and a key: an order that is the same everywhere."""
    return F.sha2(F.concat(F.lit(salt), F.lit("\0"), F.col(key).cast("string")), 256)


def hash_sample(df: DataFrame, salt: str, key: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, of each stratum where ``by`` is given, in hash order."""
    if not by:
        return df.orderBy(hash_order(salt, key), key).limit(n)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(hash_order(salt, key), key))).where(F.col("_n") <= n).drop("_n")


def year_spread(df: DataFrame, year: str, salt: str, key: str, n: int) -> DataFrame:
    """``n`` rows in turns over the years, newest first, in hash order within a year; with ``turn``.

    No year can give more than ``n`` rows, so each is cut to that before the last sort.
    """
    per = df.withColumn("turn", F.row_number().over(W.partitionBy(year).orderBy(hash_order(salt, key), key))).where(F.col("turn") <= n)
    return per.orderBy("turn", F.col(year).desc()).limit(n)


def even_sample(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Rows at places round(i (n - 1) / (k - 1)), halves to even, of each group in order."""
    w = W.partitionBy(*by)
    placed = df.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(*order)) - 1})
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)).cast("int")) if k > 1 else F.array(F.lit(0))
    return placed.where((F.col("_n") <= k) | F.array_contains(spots, F.col("_i"))).drop("_n", "_i")


def edge_sample(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """First and last ``n`` rows of each group, with their place from the front and from the back."""
    back = [F.col(c).desc() for c in order]
    w = W.partitionBy(*by)
    return df.withColumns({"front": F.row_number().over(w.orderBy(*order)), "back": F.row_number().over(w.orderBy(*back))}).where((F.col("front") <= n) | (F.col("back") <= n))


def landmarks(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Earliest, middle and latest row of each group."""
    w = W.partitionBy(*by)
    t = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    role = F.when(F.col("_i") == 0, "earliest").when(F.col("_i") == F.col("_n") - 1, "latest").when(F.col("_i") == F.floor(F.col("_n") / 2), "middle")
    return t.withColumn("landmark", role).where("landmark is not null").drop("_i", "_n")


def interleave(first: DataFrame, second: DataFrame, order: list[Column], n: int | None = None, a: int = 2, b: int = 1) -> DataFrame:
    """The first ``n`` rows (default: all) of ``a`` rows of the first list, then ``b`` of the second, and so on; the rest follows.

    Adds ``source`` and ``place``. Only the first ``n`` of each list, which a top-n
    finds without sorting the list, can be among them; ranks are given to those.
    """
    rank = F.row_number().over(W.orderBy(*order)) - 1
    top = lambda df, *by: df.orderBy(*by) if n is None else df.orderBy(*by).limit(n)
    one = top(first, *order).withColumns({"source": F.lit(1), "_r": rank}).withColumn("_s", F.floor(F.col("_r") / a) * (a + b) + F.col("_r") % a)
    two = top(second, *order).withColumns({"source": F.lit(2), "_r": rank}).withColumn("_s", F.floor(F.col("_r") / b) * (a + b) + a + F.col("_r") % b)
    return top(one.unionByName(two), "_s", "source").withColumn("place", F.row_number().over(W.orderBy("_s", "source"))).drop("_r", "_s")


def lanes(df: DataFrame, by: list[str], lane: str, order: list[Column]) -> DataFrame:
    """Turns between the lanes (sources) of a group: ``place`` within the group."""
    turn = F.row_number().over(W.partitionBy(*by, lane).orderBy(*order))
    return df.withColumn("_t", turn).withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("_t", lane))).drop("_t")


def balanced_merge(df: DataFrame, branch: str, key: str, day: str, order: list[Column], limit: int = 300) -> DataFrame:
    """Branches in turns; rows of one key fold into the first, keeping all branches and the earliest day."""
    turn = F.row_number().over(W.partitionBy(branch).orderBy(*order))
    dealt = df.withColumn("_t", turn)
    folded = dealt.groupBy(key).agg(F.min(F.struct(F.col("_t"), F.col(branch))).alias("_first"), F.array_sort(F.collect_set(branch)).alias("branches"), F.min(day).alias(day))
    return folded.orderBy("_first", key).limit(limit).select(key, F.col(f"_first.{branch}").alias("first_branch"), "branches", day)


def paged(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, per_task: int = 1_000_000) -> DataFrame:
    """``df`` with ``number`` from 0 in ``order``; ranges of about ``per_task`` rows are numbered apart and shifted by those before."""
    parts = 1 + df.count() // per_task
    dealt = scratch.save(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.expr("sum(_n) over (order by _part) - _n").alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("number", F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")
