"""What is known about each topic: works with their text, people and vectors, chosen examples, and why a value is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def star(members: DataFrame, topics: DataFrame, works: DataFrame, quality: DataFrame, vectors: DataFrame) -> DataFrame:
    """Included works of a run's topics, each with its vector where there is one.

    ``members`` (topic, work, ...), ``topics`` (topic) of the run, ``works`` and
    ``quality`` (work, decision, ...) keyed by work, ``vectors`` (work, vector).
    Topics are few beside works, and Spark broadcasts them under its size limit.
    """
    kept = quality.where("decision = 'include'").drop("decision")
    return members.join(topics, "topic").join(works, "work").join(kept, "work").join(vectors, "work", "left")


def organisation_counts(links: DataFrame, by: list[str]) -> DataFrame:
    """Different organisations (unknown where no link names any), first authors, and links that name one."""
    n = F.count("organisation")
    return links.groupBy(*by).agg(F.when(n > 0, F.count_distinct("organisation")).alias("organisations"), F.count_distinct(F.when(F.col("position") == 0, F.col("author"))).alias("first_authors"), n.alias("links"))


def people(links: DataFrame, work: str) -> DataFrame:
    """Per work: different known authors and organisations, sorted, and whether any row tells of an identity conflict."""
    return links.groupBy(work).agg(F.array_sort(F.collect_set("author")).alias("authors"), F.array_sort(F.collect_set("organisation")).alias("organisations"), F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"))


def most_frequent(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value that most rows have; of equals the smallest; nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col("n").desc(), value))
    return counts.withColumn("_r", rank).where("_r = 1").drop("_r")


def embedding_coverage(windows: DataFrame, by: list[str], last: int) -> DataFrame:
    """The least embedded share of the last ``last`` full windows; unknown if one is missing or has no works."""
    back = F.row_number().over(W.partitionBy(*by).orderBy(F.col("idx").desc()))
    recent = windows.where("complete").withColumn("_b", back).where(F.col("_b") <= last)
    share = F.when(F.col("corpus_works") > 0, F.col("embedded_works") / F.col("corpus_works"))
    return recent.groupBy(*by).agg(F.when((F.count("*") == last) & (F.count(share) == last), F.min(share)).alias("coverage"))


def parent_series(rows: DataFrame, month: Column, hit: Column, since: str, until: str, by: list[str] = ()) -> DataFrame:
    """Works of a parent corpus and of a phrase for each month, zeros included: (by, start, end, phrase_works, parent_works, share).

    Rows outside the period, or without a month, count nowhere here.
    """
    counts = rows.withColumn("start", F.trunc(month, "month")).where(F.col("start").between(F.lit(since).cast("date"), F.add_months(F.lit(until).cast("date"), -1))).groupBy(*by, "start").agg(F.count("*").alias("parent_works"), F.count_if(hit).alias("phrase_works"))
    months = F.explode(F.sequence(F.lit(since).cast("date"), F.add_months(F.lit(until).cast("date"), -1), F.expr("interval 1 month"))).alias("start")
    grid = rows.select(*by).distinct().select(*by, months) if by else rows.sparkSession.range(1).select(months)
    out = grid.join(counts, [*by, "start"], "left").select(*by, "start", F.add_months("start", 1).alias("end"), F.coalesce("phrase_works", F.lit(0)).alias("phrase_works"), F.coalesce("parent_works", F.lit(0)).alias("parent_works"))
    return out.withColumn("share", F.when(F.col("parent_works") > 0, F.col("phrase_works") / F.col("parent_works")))


def full_period_slopes(points: DataFrame, by: list[str]) -> DataFrame:
    """Slopes of counts and shares over every month of the period; no share slope where a month has no parent works."""
    placed = points.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("start")))
    n = F.count("*")
    return placed.groupBy(*by).agg(n.alias("months"), F.when(n > 1, F.regr_slope(F.col("phrase_works").cast("double"), F.col("_i").cast("double"))).alias("count_slope"), F.when((n > 1) & (F.count("share") == n), F.regr_slope("share", F.col("_i").cast("double"))).alias("share_slope"))


def recent_profile(points: DataFrame, by: list[str], cutoff: str) -> DataFrame:
    """Share of the last three complete calendar years among all works up to their end, within the retrieved sample.

    ``points`` (by, start, end, works, complete). Unknown where points overlap or
    leave gaps, end after the cutoff, or do not cover the three years exactly.
    """
    last = F.year(F.lit(cutoff).cast("date")) - 1
    low, high = F.make_date(last - 2, F.lit(1), F.lit(1)), F.make_date(last + 1, F.lit(1), F.lit(1))
    order = W.partitionBy(*by).orderBy("start")
    broken = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") >= F.col("end")) | (F.col("end") > F.lit(cutoff).cast("date")) | F.col("works").isNull() | (F.lag("end").over(order) != F.col("start"))
    t = points.withColumns({"_bad": broken, "_ok": F.col("complete") & (F.col("end") <= high), "_cross": F.col("complete") & (F.col("end") <= high) & (F.col("start") < low) & (F.col("end") > low)})
    recent = F.col("_ok") & (F.col("start") >= low)
    agg = t.groupBy(*by).agg(F.bool_or("_bad").alias("bad"), F.bool_or("_cross").alias("cross"), F.min(F.when(recent, F.col("start"))).alias("lo"), F.max(F.when(recent, F.col("end"))).alias("hi"), F.sum(F.when(recent, F.datediff("end", "start"))).alias("days"), F.sum(F.when(recent, F.col("works"))).alias("recent_works"), F.sum(F.when(F.col("_ok"), F.col("works"))).alias("eligible_works"))
    covered = F.coalesce(~F.col("bad") & ~F.col("cross") & (F.col("lo") == low) & (F.col("hi") == high) & (F.col("days") == F.datediff(high, low)), F.lit(False))
    out = agg.select(*by, covered.alias("covered"), F.when(covered, F.col("recent_works")).alias("recent_works"), F.when(covered, F.col("eligible_works")).alias("eligible_works"))
    return out.withColumn("recent_share", F.when(F.col("eligible_works") > 0, F.round(100 * F.col("recent_works") / F.col("eligible_works"), 2))).withColumn("small_sample", F.col("eligible_works") < 10)


def distance_to_past(df: DataFrame, key: str, year: str, vector: str, least: int = 3) -> DataFrame:
    """Each work's 1 - cosine to the mean of all works of earlier years, where these are ``least`` or more.

    Sums of a year's vectors are combinable; the running sums go over years, not works.
    """
    from signalweave.functions.vectors import cosine

    sums = df.select(year, F.posexplode(vector).alias("d", "x")).groupBy(year, "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    before = W.partitionBy("d").orderBy(year).rowsBetween(W.unboundedPreceding, -1)
    past = sums.withColumns({"s": F.sum("s").over(before), "n": F.sum("n").over(before)}).where(F.col("n") >= least)
    means = past.groupBy(year).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", (F.col("s") / F.col("n")).alias("m")))), lambda e: e["m"]).alias("_past"))
    return df.join(F.broadcast(means), year).withColumn("distance", 1 - cosine(F.col(vector), F.col("_past"))).drop("_past")


def evidence_roles(works: DataFrame, topic: str, latest: Column, most: int) -> DataFrame:
    """At most ``most`` examples of each topic with their roles: (..., place, role).

    ``works``: work, day, window, quality, has_abstract, match, format_hint,
    context_hint. The first is the earliest work whose title shows the topic and
    hints at nothing else (else the earliest of all); the others follow by how well
    they show it, the latest window, quality, abstract, day and id.
    """
    plain, research = F.col("context_hint") == "unclassified", F.col("format_hint") == "unclassified"
    shown = F.col("match") == "anchor_present_in_title"
    lead = F.row_number().over(W.partitionBy(topic).orderBy((shown & research & plain).desc(), "day", "work"))
    order = [c.desc() for c in (research, plain, shown, F.col("window") == latest, F.col("quality"), F.col("has_abstract"), F.col("day"))]
    led = works.withColumn("_lead", lead == 1)
    place = F.row_number().over(W.partitionBy(topic).orderBy(F.col("_lead").desc(), *order, "work"))
    role = F.when(F.col("_lead") & shown & research & plain, "early_with_title_match").when(F.col("_lead"), "earliest_in_sample").when(F.col("window") == latest, "latest_window_example").otherwise("sample_publication")
    return led.withColumn("place", place).where(F.col("place") <= most).withColumn("role", role).drop("_lead")


def multisource_rank(items: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """``rank`` by screening group, fewer failed checks, higher overall score (unknown last), scientific rank and id.

    The queue is the short list that a reader gets, so one order over it is its purpose.
    """
    group = F.coalesce(F.create_map(*[x for k, v in priorities.items() for x in (F.lit(k), F.lit(v))])[F.col("state")], F.lit(1))
    order = [group, F.coalesce("failed", F.lit(0)), F.coalesce("score", F.lit(-1.0)).desc(), F.coalesce("scientific_rank", F.lit(0)), F.col("candidate")]
    return items.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def novelty_availability(percentile: Column, raw: Column, historical: Column | None = None) -> Column:
    """Why a novelty percentile is known or not."""
    own = F.when(percentile.isNotNull(), "available").when(raw.isNull(), "no_prior_topic_anchor").otherwise("insufficient_peer_topics")
    return own if historical is None else F.coalesce(historical, own)


def momentum_availability(percentile: Column, used: Column, needed: Column, comparable: Column, peers: Column, least: int) -> Column:
    """Why a momentum percentile is known or not, first reason first."""
    return (
        F.when(percentile.isNotNull(), "available").when(used < needed, "insufficient_full_windows").when(comparable.isNull(), "coverage_unknown")
        .when(~comparable, "coverage_not_comparable").when(peers < least, "insufficient_peer_topics").otherwise("unavailable")
    )


def package_versions(rows: DataFrame, since: str, until: str, as_of: str, most: int) -> DataFrame:
    """Per package: first release and versions up to ``as_of``, versions in the window (newest first, at most ``most`` listed), later ones.

    ``rows`` (package, version, published). Rows without a version raise nothing and count nowhere.
    """
    day = F.col("published").cast("date")
    known, inside = day <= F.lit(as_of).cast("date"), day.between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    t = rows.where("trim(version) <> ''").withColumn("_in", inside)
    rank = F.row_number().over(W.partitionBy("package", "_in").orderBy(day.desc(), F.col("version").desc()))
    per = t.withColumn("_r", rank).groupBy("package").agg(
        F.count("*").alias("versions"), F.count_if(known).alias("versions_through_as_of"), F.min(F.when(known, day)).alias("first_release"), F.count_if("_in").alias("in_window"),
        F.bool_or(day > F.lit(as_of).cast("date")).alias("has_later"), F.sort_array(F.collect_list(F.when(F.col("_in") & (F.col("_r") <= most), F.struct("_r", "version")))).alias("_listed"),
    )
    return per.withColumn("listed", F.transform("_listed", lambda x: x["version"])).withColumn("cap_reached", F.col("in_window") > most).drop("_listed")


def patents(rows: DataFrame, by: list[str]) -> DataFrame:
    """Different publications and families; of repeated publications the earliest counts. ``rows``: publication, family, day."""
    once = rows.where("publication is not null").groupBy(*by, "publication").agg(F.min_by("family", F.struct("day", "family")).alias("family"), F.min("day").alias("day"))
    return once.groupBy(*by).agg(F.count("*").alias("publications"), F.count_distinct("family").alias("families"), F.min("day").alias("first_day"))


def reused_vectors(pending: DataFrame, stored: DataFrame) -> DataFrame:
    """Vectors of stored works whose title, abstract, source, length and size all equal a pending work's: (work, from_work, vector).

    A hash of the text narrows the join; the texts themselves decide. Of several
    stored works the smallest id serves.
    """
    text = lambda p: F.concat_ws("\n", F.col(f"{p}.title"), F.coalesce(F.col(f"{p}.abstract"), F.lit("")))
    whole = stored.alias("s").where((F.length(text("s")) == F.col("s.char_count")) & (F.size("s.vector") == F.col("s.dim")))
    a = pending.alias("p").withColumn("_h", F.xxhash64(text("p")))
    b = whole.withColumn("_h", F.xxhash64(text("s")))
    same = F.col("p.title").eqNullSafe(F.col("s.title")) & F.col("p.abstract").eqNullSafe(F.col("s.abstract")) & (F.col("p.model") == F.col("s.model"))
    met = a.join(b, "_h").where(same)
    return met.groupBy(F.col("p.work").alias("work")).agg(F.min_by(F.struct(F.col("s.work").alias("from_work"), F.col("s.vector").alias("vector")), "s.work").alias("x")).select("work", "x.from_work", "x.vector")


def family_collapse(vectors: DataFrame, families: DataFrame) -> DataFrame:
    """Members of a family become one row, its smallest work and the direction of their mean; others stay: (work, vector)."""
    from signalweave.functions.vectors import unit
    from signalweave.operators.vectors import centroids

    joined = vectors.join(families, "work", "left")
    inside = joined.where("family is not null").withColumn("vector", unit(F.col("vector")))
    means = centroids(inside, ["family"], "vector", normal=True).join(inside.groupBy("family").agg(F.min("work").alias("work")), "family")
    return means.select("work", F.col("centroid").alias("vector")).unionByName(joined.where("family is null").select("work", "vector"))


def token_subset(records: DataFrame, needles: DataFrame, exclusions: list[list[str]], tokens: str) -> DataFrame:
    """Records whose tokens hold all words of a needle (needle, words) and no exclusion: (record columns, matched).

    A needle meets records by its first word, so that only records with that word
    are tested; needles are a query's phrases.
    """
    ready = needles.where("size(words) > 0").withColumn("_word", F.col("words")[0])
    met = records.withColumn("_word", F.explode(F.array_distinct(tokens))).join(F.broadcast(ready), "_word").where(F.size(F.array_except("words", tokens)) == 0)
    for words in exclusions:
        met = met.where(F.size(F.array_except(F.array(*map(F.lit, words)), F.col(tokens))) > 0)
    return met.groupBy(*records.columns).agg(F.array_sort(F.collect_set("needle")).alias("matched"))


def gate_changes(before: DataFrame, after: DataFrame, key: str, gates: list[str]) -> DataFrame:
    """How often each gate (and the status) went from one value to another between two assessments of the same compositions."""
    pair = lambda g: F.struct(F.lit(g).alias("field"), F.col(f"b.{g}").cast("string").alias("before"), F.col(f"a.{g}").cast("string").alias("after"))
    met = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    each = met.select(F.explode(F.array(*[pair(g) for g in gates])).alias("x")).select("x.*")
    return each.where(~F.col("before").eqNullSafe(F.col("after"))).groupBy("field", "before", "after").agg(F.count("*").alias("changes"))


def require_subset(current: DataFrame, pack: DataFrame, key: str) -> DataFrame:
    """``current``, if every key of it is in ``pack``; else an error that tells how many are not."""
    missing = current.join(pack.select(key), key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} rows are outside the allowed pack")
    return current


def calibrated_coherence(rows: DataFrame, by: list[str], value: str, target: Column, holdout: Column, least: int = 4, margin: float = 0.01) -> DataFrame:
    """A cut between classes only where development rows are parted by it with a margin; else why not.

    Returns decision, threshold and, where there is one, the accuracy on the rows held out.
    """
    dev = ~holdout
    t = rows.groupBy(*by).agg(F.count_if(dev & target).alias("positives"), F.count_if(dev & ~target).alias("negatives"), F.max(F.when(dev & ~target, F.col(value))).alias("high"), F.min(F.when(dev & target, F.col(value))).alias("low"), F.count_if(holdout).alias("held"))
    few = (F.col("positives") < least) | (F.col("negatives") < least)
    apart = F.col("low") - F.col("high") >= margin
    t = t.withColumn("decision", F.when(few, "refused_insufficient_development_labels").when(apart, "calibrated_on_preliminary_development_only").otherwise("refused_non_separable_development_labels"))
    t = t.withColumn("threshold", F.when(~few & apart, (F.col("low") + F.col("high")) / 2)).drop("low", "high")
    right = rows.where(holdout).select(*by, F.col(value).alias("_v"), target.alias("_t")).join(t.where("threshold is not null").select(*by, "threshold"), by)
    scored = right.groupBy(*by).agg(F.avg(((F.col("_v") >= F.col("threshold")) == F.col("_t")).cast("double")).alias("holdout_accuracy"))
    return t.join(scored, by, "left")


def leave_one_out(rows: DataFrame, key: str, value: str, target: Column) -> DataFrame:
    """(key, target, threshold, predicted): each row judged by the threshold that fits all others; rows are few labelled cases."""
    from signalweave.operators import review

    t = rows.select(F.col(key), F.col(value).alias("_v"), target.alias("_t"))
    folds = t.select(F.col(key).alias("_held"))
    train = folds.join(t, F.col("_held") != F.col(key))
    fitted = review.threshold_fit(train, "_v", F.col("_t"), ["_held"])
    return t.join(fitted.withColumnRenamed("_held", key), key, "left").select(key, F.col("_t").alias("target"), "threshold", (F.col("_v") >= F.col("threshold")).alias("predicted"))
