"""Cohorts of works prepared for search: laid out by year, sealed as a generation, scanned only where a question looks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.text import plan_matches, title_key
from signalweave.operators.ranking import hash_order
from signalweave.sources.generations import Generations
from signalweave.storage import Scratch

#: Types of records about other records.
ADMINISTRATIVE = ("paratext", "editorial", "erratum", "retraction", "peer-review", "supplementary-materials")


def prepare(store: Generations, works: DataFrame, run: str) -> str:
    """Publish works (work, title, abstract, day, kind, authors) as a cohort by year, with a family for its conservative variants.

    Variants share title key and all authors; works without a title or authors
    are families of their own. One row a work: of repeated ones the earliest,
    then the smallest by content. Rows without work or day are left out.
    """
    order = [F.col("day"), F.xxhash64("title", "abstract", "kind")]
    once = works.where("work is not null and day is not null").withColumn("_n", F.row_number().over(W.partitionBy("work").orderBy(*order))).where("_n = 1").drop("_n")
    keyed = once.withColumn("_t", title_key(F.col("title")))
    people = F.array_sort(F.transform("authors", lambda a: F.lower(F.trim(a))))
    known = (F.length("_t") > 0) & (F.size("authors") > 0)
    family = F.sha2(F.when(known, F.to_json(F.struct("_t", people.alias("people")))).otherwise(F.concat(F.lit("work "), F.col("work").cast("string"))), 256)
    cohort = keyed.withColumn("family", family).drop("_t").withColumn("year", F.year("day"))
    return store.publish({"works": cohort.repartition("year", "family").sortWithinPartitions("day")}, run, partition_by={"works": ["year"]})


def prepared_search(store: Generations, branches: dict[str, tuple[list[str], list[str]]], since: str, before: str, per_branch: int, salt: str = "prepared", verify: bool = True) -> DataFrame:
    """Per branch (phrases, exclusions) up to ``per_branch`` families in turns over the years, newest year first.

    Only the years of the period are read. Administrative kinds are left out. A
    family matches by its first version, by day, that does, and is dated by that
    version; ``family_earliest`` keeps the earliest of all. Within a year
    families stand in hash order, and no year keeps more than ``per_branch`` of
    them on any task. ``matches`` counts the branch's families before the cut.
    """
    if not since < before or per_branch < 1:
        raise ValueError("a search has a period and a limit")
    works = store.read("works", verify=verify)
    years = (F.col("year") >= int(since[:4])) & (F.col("year") <= int(before[:4]))
    held = works.where(years & (F.col("day") >= F.lit(since).cast("date")) & (F.col("day") < F.lit(before).cast("date")) & ~F.coalesce(F.col("kind").isin(*ADMINISTRATIVE), F.lit(False)))
    fields = [F.col("title"), F.col("abstract")]
    named = F.array_compact(F.array(*(F.when(plan_matches(fields, include, exclude), F.lit(name)) for name, (include, exclude) in sorted(branches.items()))))
    told = held.select("family", "work", "day", F.coalesce(named, F.array().cast("array<string>")).alias("of"))
    earliest = told.groupBy("family").agg(F.min("day").alias("family_earliest"), F.count("*").alias("variants"))
    version = told.select("family", "work", "day", F.explode("of").alias("branch")).groupBy("branch", "family").agg(F.min(F.struct("day", "work")).alias("v"))
    scratch = Scratch(works.sparkSession, "prepared")
    matched = scratch.save(version.join(earliest, "family").select("branch", "v.work", "v.day", F.year("v.day").alias("year"), "family_earliest", "variants"), "matched")
    turn = F.row_number().over(W.partitionBy("branch", "year").orderBy(hash_order(salt, "work"), "work"))
    cut = matched.withColumn("turn", turn).where(F.col("turn") <= per_branch)
    place = F.row_number().over(W.partitionBy("branch").orderBy("turn", F.desc("year")))
    counts = matched.groupBy("branch").agg(F.count("*").alias("matches"))
    return cut.withColumn("place", place).where(F.col("place") <= per_branch).join(F.broadcast(counts), "branch")
