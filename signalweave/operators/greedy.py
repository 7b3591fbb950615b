"""Greedy choices by rank without a loop over rows: rounds of local minima over what conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.vectors import dot, unit
from signalweave.operators.ranking import numbered
from signalweave.storage import Scratch

#: Jaccard overlap from which two cohorts are shown as one.
OVERLAP = 0.8


def first_independent(items: DataFrame, conflicts: DataFrame, scratch: Scratch, name: str = "greedy") -> DataFrame:
    """(rank, chosen) of each item: taken in order of rank, an item is chosen if none chosen before conflicts with it.

    ``items``: rank (unique); ``conflicts``: early, late ranks of pairs. All items
    whose earlier conflicts are settled are settled in one round, which gives
    what a loop over the ranks gives; rounds are as many as conflicts in a line.
    """
    edges = scratch.save(conflicts.where("early < late").select("early", "late").distinct(), f"{name}_edges")
    state = scratch.save(items.select("rank").join(edges.select(F.col("late").alias("rank")).distinct().withColumn("_open", F.lit(True)), "rank", "left").select("rank", F.when(F.col("_open").isNull(), True).alias("chosen")), f"{name}_0")
    n = 0
    while state.where("chosen is null").limit(1).count():
        n += 1
        waiting = state.where("chosen is null").select(F.col("rank").alias("late"))
        met = edges.join(waiting, "late").join(state.select(F.col("rank").alias("early"), "chosen"), "early").groupBy(F.col("late").alias("rank")).agg(F.max(F.coalesce("chosen", F.lit(False))).alias("beaten"), F.max(F.col("chosen").isNull()).alias("unclear"))
        told = met.select("rank", F.when(F.col("beaten"), False).when(~F.col("unclear"), True).alias("now"))
        state = scratch.save(state.join(told, "rank", "left").select("rank", F.coalesce("chosen", "now").alias("chosen")), f"{name}_{n}")
    return state


def contained(terms: DataFrame, scratch: Scratch, name: str = "terms") -> DataFrame:
    """(early, late) ranks of terms of which one's words are all among the other's: ``terms`` (rank, words array).

    Each term is looked for under its rarest word only, so common words bring
    no candidates that a rarer one would not.
    """
    listed = scratch.save(terms.select("rank", F.array_distinct("words").alias("words")).where("size(words) > 0"), f"{name}_listed")
    each = listed.select("rank", F.explode("words").alias("word"))
    common = each.groupBy("word").agg(F.count("*").alias("n"))
    rarest = each.join(common, "word").groupBy("rank").agg(F.min(F.struct("n", "word")).alias("x")).select("rank", F.col("x.word").alias("word"))
    small = rarest.join(listed, "rank").select(F.col("rank").alias("a"), "word", F.col("words").alias("inner"))
    large = each.join(listed, "rank").select(F.col("rank").alias("b"), "word", F.col("words").alias("outer"))
    met = small.join(large, "word").where((F.col("a") != F.col("b")) & (F.size(F.array_except("inner", "outer")) == 0))
    return met.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).distinct()


def overlapping(cohorts: DataFrame, overlap: float, scratch: Scratch, name: str = "cohorts") -> DataFrame:
    """(early, late, jaccard) of cohorts (rank, members array) that share by ``overlap`` or more.

    Members are ordered by how many cohorts hold them; two sets that overlap
    enough share one among the first few of each, so only these are joined.
    Rows hold one member each; what a candidate pair shares is counted.
    """
    listed = scratch.save(cohorts.select("rank", F.explode(F.array_distinct("members")).alias("m")).where("m is not null"), f"{name}_each")
    common = listed.groupBy("m").agg(F.count("*").alias("n"))
    sizes = scratch.save(listed.groupBy("rank").agg(F.count("*").alias("size")), f"{name}_sizes")
    # A member that only one cohort has joins nothing.
    place = F.row_number().over(W.partitionBy("rank").orderBy("n", "m"))
    placed = listed.join(common, "m").withColumn("place", place).join(sizes, "rank")
    first = scratch.save(placed.where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * overlap) + 1) & (F.col("n") > 1)).select("rank", "m", "size"), f"{name}_first")
    a, b = first.alias("a"), first.alias("b")
    na, nb = F.col("a.size"), F.col("b.size")
    met = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.rank") < F.col("b.rank")) & (F.least(na, nb) >= F.greatest(na, nb) * overlap))
    pairs = scratch.save(met.select(F.col("a.rank").alias("early"), F.col("b.rank").alias("late"), na.alias("na"), nb.alias("nb")).distinct(), f"{name}_met")
    mine, theirs = listed.select(F.col("rank").alias("early"), "m"), listed.select(F.col("rank").alias("late"), "m")
    both = pairs.join(mine, "early").join(theirs, ["late", "m"]).groupBy("early", "late", "na", "nb").agg(F.count("*").alias("both"))
    return both.select("early", "late", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= overlap)


def independent_terms(suggestions: DataFrame, query: str, n: int) -> DataFrame:
    """Suggestions by support: phrase, support, place, selected, reason; the first ``n`` that neither hold nor lie within a chosen term's words.

    ``suggestions``: phrase, support. The query is chosen before all of them. Of
    phrases with the same words the best supported, then the first by name,
    counts; phrases without words or support are left out.
    """
    scratch = Scratch(suggestions.sparkSession, "terms")
    words = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    clean = suggestions.where("support > 0").select("phrase", "support", words(F.col("phrase")).alias("words")).where("size(words) > 0")
    # Ranks that order as support and phrase do, from one number a distinct pair; ties of both are one phrase.
    ranked = numbered(clean.groupBy("phrase").agg(F.max("support").alias("support"), F.first("words").alias("words")), [F.col("support").desc(), F.lower("phrase"), F.col("phrase")], scratch).select("phrase", "support", "words", (F.col("number") + 1).alias("rank"))
    ranked = scratch.save(ranked, "ranked")
    first = suggestions.sparkSession.range(1).select(F.lit(query).alias("phrase"), F.lit(None).cast("long").alias("support"), words(F.lit(query)).alias("words"), F.lit(0).cast("long").alias("rank"))
    every = scratch.save(ranked.select("phrase", F.col("support").cast("long").alias("support"), "words", F.col("rank").cast("long").alias("rank")).unionByName(first), "every")
    state = first_independent(every, contained(every, scratch), scratch)
    taken = every.join(state, "rank").where("rank > 0")
    # Chosen phrases are counted only as far as they are wanted.
    cut = taken.where("chosen").orderBy("rank").limit(n).select("rank").withColumn("selected", F.lit(True))
    reason = F.when(~F.col("chosen"), "token_containment_suppressed").when(F.col("selected"), "selected_by_support").otherwise("beyond_the_limit")
    return taken.join(F.broadcast(cut), "rank", "left").select("phrase", "support", F.col("rank").alias("place"), F.coalesce("selected", F.lit(False)).alias("selected"), reason.alias("reason"))


def display_groups(phrases: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """(phrase, representative, basis, jaccard): ranked phrases shown under one that stands for them.

    ``phrases``: rank (unique), phrase, inflection, members (array). A phrase goes to
    the group of the first one with its inflection; such a first one goes to the
    earliest representative whose members overlap its own by ``overlap``, or is one
    itself. Overlap is with representatives only and never chains.
    """
    scratch = Scratch(phrases.sparkSession, "display")
    held = scratch.save(phrases.select("rank", "phrase", "inflection", "members"), "phrases")
    leads = held.groupBy("inflection").agg(F.min("rank").alias("lead"))
    joined = scratch.save(held.join(leads, held.inflection.eqNullSafe(leads.inflection)).select("rank", "phrase", "lead"), "joined")
    leaders = scratch.save(held.join(joined.where("rank = lead").select("rank"), "rank", "left_semi"), "leaders")
    near = scratch.save(overlapping(leaders, overlap, scratch), "near")
    state = first_independent(leaders, near, scratch)
    chosen = state.where("chosen").select(F.col("rank").alias("early"))
    under = near.join(chosen, "early").groupBy(F.col("late").alias("lead")).agg(F.min(F.struct("early", "jaccard")).alias("x"))
    groups = state.select(F.col("rank").alias("lead"), "chosen").join(under, "lead", "left").select("lead", F.when(F.col("chosen"), F.col("lead")).otherwise(F.col("x.early")).alias("to"), F.when(~F.col("chosen"), F.col("x.jaccard")).alias("jaccard"))
    names = held.select(F.col("rank").alias("to"), F.col("phrase").alias("representative"))
    own = F.col("rank") == F.col("lead")
    basis = F.when(F.col("rank") == F.col("to"), "representative").when(own, "title_cohort_overlap").otherwise("lexical_inflection")
    value = F.when(F.col("rank") == F.col("to"), 1.0).when(own, F.round("jaccard", 4))
    return joined.join(groups, "lead").join(names, "to").select("phrase", "representative", basis.alias("basis"), value.alias("jaccard"))


def diversify(df: DataFrame, key: str, score: str, vector: str, n: int, trade: float = 0.7) -> DataFrame:
    """(key, place): ``n`` rows in greedy order of ``trade`` x score - (1 - trade) x similarity to what is chosen; ties by key.

    Each place is one aggregate over all rows; only the chosen rows' vectors,
    at most ``n``, are carried into the next. The first place goes by score alone.
    """
    scratch = Scratch(df.sparkSession, "diverse")
    rows = scratch.save(df.where(F.col(key).isNotNull() & F.col(score).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(score).cast("double").alias("s"), unit(F.col(vector).cast("array<double>")).alias("v")), "rows")
    kind = dict(rows.dtypes)["k"]
    chosen: list = []
    while len(chosen) < n:
        left = rows
        worth = F.col("s")
        if chosen:
            near = F.greatest(F.lit(0.0), *(dot(F.col("v"), F.array(*map(F.lit, v))) for _, v in chosen))
            worth = trade * F.col("s") - (1 - trade) * near
            left = rows.where(~F.col("k").isin([k for k, _ in chosen]))
        best = left.select(F.round(worth, 12).alias("w"), "k", "v").orderBy(F.desc("w"), "k").limit(1).collect()
        if not best:
            break
        chosen.append((best[0].k, list(best[0].v)))
    return df.sparkSession.createDataFrame([(k, i + 1) for i, (k, _) in enumerate(chosen)], f"{key} {kind}, place int")
