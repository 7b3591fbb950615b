"""Agreement, accuracy and recovery statistics, threshold fits, quality decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: Column, predicted: Column, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and the ratios made of them; null on a zero denominator."""
    t, p = truth, predicted
    one = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    r = lambda a, b: F.when(b > 0, a / b)
    recall, special = r(tp, tp + fn), r(tn, tn + fp)
    return one.withColumns({"precision": r(tp, tp + fp), "recall": recall, "f1": r(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (recall + special) / 2, "lift": r(tp, tp + fp) / r(tp + fn, tp + fp + fn + tn)})


def cohen_kappa(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Observed and chance agreement and kappa; null where chance is 1 or nothing was answered."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cell = rows.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    total = cell.groupBy(*by).agg(F.sum("n").alias("items"), (F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")).alias("observed"))
    left = cell.groupBy(*by, F.col(a).alias("answer")).agg(F.sum("n").alias("na"))
    right = cell.groupBy(*by, F.col(b).alias("answer")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*by, "answer"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    t = (total.join(chance, list(by), "left") if by else total.crossJoin(chance)).withColumn("chance", F.coalesce("both", F.lit(0)) / (F.col("items") * F.col("items")))
    return t.select(*by, "items", "observed", "chance", F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


def answer_matrix(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, a, b).agg(F.count("*").alias("n"))


def threshold_fit(df: DataFrame, value: str, target: Column, by: list[str] = (), minimum: int = 1) -> DataFrame:
    """The midpoint between neighbouring values with the best balanced accuracy (value >= threshold is positive).

    Ties: fewer errors, then the smaller size of the threshold. No row where a
    class has under ``minimum`` rows. Values are first counted, so that running sums go
    over different values only.
    """
    rows = df.where(F.col(value).isNotNull())
    per = rows.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count_if(target).alias("p"), F.count_if(~target).alias("n"))
    over, every = W.partitionBy(*by).orderBy("v"), W.partitionBy(*by)
    t = per.withColumns({"P": F.sum("p").over(every), "N": F.sum("n").over(every), "pb": F.sum("p").over(over), "nb": F.sum("n").over(over), "next": F.lead("v").over(over), "low": F.min("v").over(every), "high": F.max("v").over(every)})
    eps = F.greatest(F.lit(1e-12), (F.col("high") - F.col("low")) * 1e-9)
    above = t.select(*by, "P", "N", F.coalesce((F.col("v") + F.col("next")) / 2, F.col("high") + eps).alias("threshold"), F.col("pb").alias("fn"), (F.col("N") - F.col("nb")).alias("fp"))
    first = t.where("v = low").select(*by, "P", "N", (F.col("low") - eps).alias("threshold"), F.lit(0).cast("long").alias("fn"), F.col("N").alias("fp"))
    scored = above.unionByName(first).where((F.col("P") >= minimum) & (F.col("N") >= minimum))
    scored = scored.withColumns({"accuracy": F.round(((F.col("P") - F.col("fn")) / F.col("P") + (F.col("N") - F.col("fp")) / F.col("N")) / 2, 12), "errors": F.col("fn") + F.col("fp")})
    best = scored.groupBy(*by).agg(F.max(F.struct("accuracy", (-F.col("errors")).alias("e"), (-F.abs("threshold")).alias("t"), "threshold")).alias("b")).where("b is not null")
    return best.select(*by, "b.threshold", F.round("b.accuracy", 6).alias("balanced_accuracy"), (-F.col("b.e")).alias("errors"))


def ndcg(df: DataFrame, by: list[str], label: str, rank: str, k: int) -> DataFrame:
    """Discounted gain (2^label - 1) of the first ``k`` against the best order; null where all labels are equal."""
    ideal = F.row_number().over(W.partitionBy(*by).orderBy(F.col(label).desc(), rank))
    gain = F.pow(F.lit(2.0), label) - 1
    t = df.withColumn("ideal", ideal)
    part = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1)))
    return t.groupBy(*by).agg(F.when(F.count_distinct(label) > 1, part(rank) / part("ideal")).alias("ndcg"))


def pair_order(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Pairs of different labels inside a group whose scores agree, tie or disagree, from counts of (label, score)."""
    cell = df.groupBy(*by, label, score).agg(F.count("*").alias("n"))
    a, b = cell.alias("a"), cell.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    cond = F.col(f"a.{label}") > F.col(f"b.{label}")
    for s in same:
        cond = cond & s
    pairs = a.join(b, cond)
    n, x, y = F.col("a.n") * F.col("b.n"), F.col(f"a.{score}"), F.col(f"b.{score}")
    return pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in by], F.col(f"a.{label}").alias("higher"), F.col(f"b.{label}").alias("lower")).agg(F.sum(F.when(x > y, n).otherwise(0)).alias("correct"), F.sum(F.when(x == y, n).otherwise(0)).alias("tied"), F.sum(n).alias("pairs"))


def generation_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Counts of shared, missing and added keys, ambiguous ones (repeated in a generation) and changed fields."""
    one = lambda d: d.groupBy(key).agg(F.count("*").alias("n"), *[F.first(f).alias(f) for f in fields])
    a, b = one(old).alias("a"), one(new).alias("b")
    t = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    both = F.col("a.n").isNotNull() & F.col("b.n").isNotNull()
    changed = [F.count_if(both & (F.col("a.n") == 1) & (F.col("b.n") == 1) & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"{f}_changed") for f in fields]
    return t.agg(F.count_if(both).alias("shared"), F.count_if(F.col("b.n").isNull()).alias("missing"), F.count_if(F.col("a.n").isNull()).alias("added"), F.count_if((F.coalesce("a.n", F.lit(0)) > 1) | (F.coalesce("b.n", F.lit(0)) > 1)).alias("ambiguous"), *changed)


#: Phrases that tell of a withdrawn deposit.
WITHDRAWN = r"(?i)\b(?:has been|is|was) withdrawn\b|\bwithdrawn by\b|\bthis (?:paper|submission|article) (?:is|has been) (?:withdrawn|retracted)\b"
#: Source quality by origin; what is taken off for an imprecise date; cap in quarantine.
QUALITY = {"both": 0.95, "arxiv": 0.85, "abstract": 0.62, "title": 0.38}
IMPRECISE, QUARANTINE = 0.12, 0.25


def quality_decision(df: DataFrame, terms: list[str], as_of: Column | None = None) -> DataFrame:
    """include, exclude or quarantine with relevance, source quality, matched terms and reasons.

    Columns: title, abstract, day, imprecise, has_arxiv, has_openalex, withdrawn,
    title_conflict, revised_after_cutoff, late_deposit. Rules apply in order: the
    cutoff, then the query, then what quarantines; terms are matched as plain
    substrings of normalised text, in their own order.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    hits = lambda text: F.array_compact(F.array(*[F.when(text.contains(t.lower()), F.lit(t)) for t in terms]))
    late = (F.col("day") >= as_of) if as_of is not None else F.lit(False)
    t = df.withColumns({"in_title": hits(norm("title")), "in_abstract": hits(norm("abstract"))})
    matched = F.array_distinct(F.concat("in_title", "in_abstract"))
    relevance = F.least(F.lit(1.0), 0.55 + 0.15 * F.size(matched) + F.when(norm("title").contains(F.lower(matched[0])), 0.15).otherwise(0.0))
    base = F.when(F.col("has_arxiv") & F.col("has_openalex"), QUALITY["both"]).when(F.col("has_arxiv"), QUALITY["arxiv"]).when(F.coalesce("abstract", F.lit("")) != "", QUALITY["abstract"]).otherwise(QUALITY["title"])
    source = base - F.when(F.coalesce("imprecise", F.lit(False)), IMPRECISE).otherwise(0.0)
    flags = {f: F.coalesce(F.col(f), F.lit(False)) for f in ("title_conflict", "revised_after_cutoff", "withdrawn", "late_deposit")}
    bad = F.lit(False)
    for f in flags.values():
        bad = bad | f
    out_of = F.coalesce(late, F.lit(False))
    off = F.size(matched) == 0
    decision = F.when(out_of | off, "exclude").when(bad, "quarantine").otherwise("include")
    reasons = F.array_compact(F.array(F.when(out_of, "outside_analysis_cutoff"), F.when(~out_of & off, "off_query"), F.when(~out_of & ~off & (F.size("in_title") == 0), "abstract_only"), *[F.when(~out_of & ~off & v, F.lit(k)) for k, v in flags.items()]))
    ok = ~out_of & ~off
    return t.withColumns({
        "decision": decision,
        "relevance": F.when(ok, F.bround(relevance, 3)).otherwise(0.0),
        "source_quality": F.when(ok, F.bround(F.greatest(F.lit(0.0), F.when(bad, F.least(source, F.lit(QUARANTINE))).otherwise(source)), 3)).otherwise(0.2),
        "matched": F.when(ok, matched).otherwise(F.array().cast("array<string>")),
        "reasons": reasons,
    }).drop("in_title", "in_abstract")


def withdrawal_status(comment: Column, summary: Column, retracted: Column) -> Column:
    """withdrawn by a comment or the first 200 characters of a summary, retracted by the flag, else not_reported."""
    said = F.coalesce(comment, F.lit("")).rlike(WITHDRAWN) | F.substring(F.coalesce(summary, F.lit("")), 1, 200).rlike(WITHDRAWN)
    return F.when(said, "withdrawn").when(F.coalesce(retracted, F.lit(False)), "retracted").otherwise("not_reported")
