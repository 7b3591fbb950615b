"""Phrase mining: document frequency, diffusion over areas, growth, emergence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.text import composition_hash


#: Short English function words that a phrase does not hold.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "we", "with"]

_TOKEN = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)*")


#: Spans that leave a task at once.
AT_ONCE = 50_000


def _spans(text: str, least: int, most: int, stop: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    run = []
    for m in _TOKEN.finditer(text):
        word, start, end = m.group().casefold(), m.start(), m.end()
        if run and text[run[-1][2] : start].strip(" \t\r\n"):
            run = []
        if word in stop or len(word) < 2:
            run = []
            continue
        run = [*run, (word, start, end)][-most:]
        for size in range(least, most + 1):
            if size <= len(run):
                part = run[-size:]
                yield " ".join(w for w, _, _ in part), part[0][1], end


def _span_batches(batches: Iterator[pa.RecordBatch], key: str, fields: list[str], least: int, most: int, stop: frozenset[str], at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Spans of each row's fields, at most ``at_once`` in a batch."""
    for batch in batches:
        row, field, phrase, start, end = [], [], [], [], []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(field, pa.string()), pa.array(phrase, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[key, "field", "phrase", "start", "end"])

        for k, name in enumerate(fields):
            for i, value in enumerate(batch.column(k + 1)):
                for p, s, e in _spans(value.as_py() or "", least, most, stop):
                    if len(row) == at_once:
                        yield told()
                        row, field, phrase, start, end = [], [], [], [], []
                    row.append(i)
                    field.append(name)
                    phrase.append(p)
                    start.append(s)
                    end.append(e)
        if row:
            yield told()


def phrase_spans(df: DataFrame, key: str, fields: list[str], least: int = 1, most: int = 3, stop: list[str] = STOP) -> DataFrame:
    """(key, field, phrase, start, end): phrases of ``least`` to ``most`` words with their places.

    No phrase crosses a stop word, a number, or anything but white space. Spark
    has no expression that returns offsets, so a text's spans are one Arrow step,
    which holds a bounded number of them.
    """
    known = frozenset(stop)
    return df.select(key, *fields).mapInArrow(lambda batches: _span_batches(batches, key, fields, least, most, known), f"{key} {dict(df.dtypes)[key]}, field string, phrase string, start int, end int")


def ngrams(words: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` words, joined by spaces, inside the JVM."""
    each = [F.when(F.size(words) >= n, _runs(words, n)) for n in range(least, most + 1)]
    return F.flatten(F.array_compact(F.array(*each)))


def _runs(words: Column, n: int) -> Column:
    """Runs of ``n`` words by joining shifted arrays, so that ``words`` is made a few times, not once for each run."""
    size = F.size(words) - n + 1
    out = F.slice(words, F.lit(1), size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(k), size), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def document_frequency(df: DataFrame, key: str, title_phrases: str | None, phrases: str, day: str | None = None) -> DataFrame:
    """Per phrase: documents, documents with it in the title (where titles are given), first and last day.

    ``phrases`` (array) are those of the whole text, ``title_phrases`` those of the
    title. Each document counts once: its phrases are made distinct in its own
    row, so only one shuffle, of partial counts, is needed.
    """
    more = [F.min("day").alias("first_day"), F.max("day").alias("last_day")] if day else []
    if title_phrases:
        more.insert(0, F.count_if(F.array_contains("t", F.col("phrase"))).alias("title_docs"))
    each = df.select(F.explode(F.array_distinct(phrases)).alias("phrase"), *([F.col(title_phrases).alias("t")] if title_phrases else []), *([F.col(day).alias("day")] if day else []))
    return each.groupBy("phrase").agg(F.count("*").alias("docs"), *more)


def top_phrases(counts: DataFrame, k: int, least: int = 1) -> DataFrame:
    """The ``k`` best supported phrases; ties by phrase."""
    return counts.where(F.col("docs") >= least).orderBy(F.col("docs").desc(), "phrase").limit(k)


def cumulative_areas(df: DataFrame, topic: str, window: str, area: str, least: int = 1) -> DataFrame:
    """Per topic and window: works, areas with at least ``least`` works, and areas reached so far."""
    active = df.groupBy(topic, window, area).agg(F.count("*").alias("n"))
    first = active.where(F.col("n") >= least).groupBy(topic, area).agg(F.min(window).alias(window)).groupBy(topic, window).agg(F.count("*").alias("new_areas"))
    per = active.groupBy(topic, window).agg(F.sum("n").alias("works"), F.count_if(F.col("n") >= least).alias("active_areas"))
    by = W.partitionBy(topic).orderBy(window).rowsBetween(W.unboundedPreceding, 0)
    return per.join(first, [topic, window], "left").withColumn("cumulative_areas", F.sum(F.coalesce("new_areas", F.lit(0))).over(by)).select(topic, window, "works", "active_areas", "cumulative_areas")


@dataclass(frozen=True)
class DiffusionPolicy:
    """Which phrases count as spreading."""

    min_recent_works: int = 3
    max_recent_share: float = 0.05
    min_share_ratio: float = 1.5
    min_docs_per_area: int = 1
    min_recent_areas: int = 2
    min_area_gain: int = 1
    top_limit: int = 200


def _same_works() -> Column:
    """A name for the works of a phrase that partial aggregates can make: their number and two 64-bit sums of hashes.

    A stop word's works never meet in one row; different sets of works share a
    name with a chance of 2^-128.
    """
    hashed = lambda salt: F.sum(F.xxhash64(F.lit(salt), "work").cast("decimal(38,0)"))
    return F.struct(F.count("*").alias("n"), hashed(1).alias("x"), hashed(2).alias("y")).alias("composition")


def diffusion_candidates(mentions: DataFrame, works: DataFrame, recent: Column, prior: Column, policy: DiffusionPolicy = DiffusionPolicy()) -> DataFrame:
    """Phrases that are rare, grow and reach new areas, ranked by priority.

    ``mentions``: work, phrase, in_title, window, areas (array). ``works``: all works
    with window; ``recent`` and ``prior`` are conditions on the window column.
    Phrases with the same works are one composition: the one with most title
    hits, then most words, then first by name stands for it.
    """
    total = works.agg(F.count_if(recent).alias("recent_n"), F.count_if(prior).alias("prior_n"))
    per = mentions.groupBy("phrase").agg(F.count_if(recent).alias("recent_works"), F.count_if(prior).alias("prior_works"), F.count_if("in_title").alias("title_works"), F.min("window").alias("first_window"), _same_works())
    areas = mentions.withColumn("area", F.explode("areas")).groupBy("phrase", "area").agg(F.count_if(recent).alias("r"), F.count_if(prior).alias("p"))
    reach = areas.groupBy("phrase").agg(F.count_if(F.col("r") >= policy.min_docs_per_area).alias("recent_areas"), F.count_if(F.col("p") >= policy.min_docs_per_area).alias("prior_areas"))
    t = per.join(reach, "phrase").crossJoin(F.broadcast(total))
    t = t.withColumns({"recent_share": F.col("recent_works") / F.col("recent_n"), "prior_share": F.col("prior_works") / F.col("prior_n"), "area_gain": F.col("recent_areas") - F.col("prior_areas")})
    ratio = F.when(F.col("prior_share") > 0, F.col("recent_share") / F.col("prior_share"))
    keep = (
        (F.col("recent_works") >= policy.min_recent_works) & (F.col("recent_share") <= policy.max_recent_share) & (F.col("recent_share") > F.col("prior_share")) & (ratio.isNull() | (ratio >= policy.min_share_ratio))
        & (F.col("recent_areas") >= policy.min_recent_areas) & (F.col("area_gain") >= policy.min_area_gain) & (F.col("title_works") > 0)
    )
    priority = F.round((F.col("recent_share") - F.col("prior_share")) * F.log1p(F.col("recent_works").cast("double")) * F.log1p(F.col("area_gain").cast("double")), 12)
    found = t.where(keep).select("phrase", "first_window", "recent_works", "prior_works", "recent_share", "prior_share", ratio.alias("share_ratio"), "recent_areas", "prior_areas", "area_gain", "title_works", priority.alias("priority"), "composition")
    first = F.row_number().over(W.partitionBy("composition").orderBy(F.col("title_works").desc(), F.size(F.split("phrase", " ")).desc(), "phrase"))
    alike = F.count("*").over(W.partitionBy("composition")) - 1
    best = found.withColumns({"same_works": alike, "_n": first}).where("_n = 1").drop("_n", "composition").orderBy(F.col("priority").desc(), "phrase").limit(policy.top_limit)
    # Only the reported phrases, rare by the policy, have their works listed and hashed.
    listed = mentions.join(F.broadcast(best.select("phrase")), "phrase").groupBy("phrase").agg(composition_hash(F.collect_set("work")).alias("composition"))
    return best.join(listed, "phrase").orderBy(F.col("priority").desc(), "phrase")


def emergence_rerank(candidates: DataFrame, windows: int, place: Column, support_cap: int = 20, gain_cap: int = 5, power: int = 2) -> DataFrame:
    """Relative gain times damped, capped support and area gain, times the recency of the first window; all rows stay."""
    gain = (F.col("recent_share") - F.col("prior_share")) / F.col("recent_share")
    recency = F.pow((place + 1) / F.lit(windows), F.lit(power))
    score = F.round(gain * F.log1p(F.least("recent_works", F.lit(support_cap)).cast("double")) * F.log1p(F.least("area_gain", F.lit(gain_cap)).cast("double")) * recency, 12)
    return candidates.withColumn("emergence", score).orderBy(F.col("emergence").desc(), "phrase")


def title_growth(mentions: DataFrame, works: DataFrame, recent: Column, prior: Column, least: int, most_share: float, k: int) -> DataFrame:
    """Title phrases by smoothed growth of their share: (n + 0.5) / (N + 1) recent against prior; score ln(1 + n) log2(1 + lift)."""
    total = works.agg(F.count_if(recent).alias("rn"), F.count_if(prior).alias("pn"), F.count("*").alias("all"))
    per = mentions.groupBy("phrase").agg(F.count("*").alias("works"), F.count_if(recent).alias("recent"), F.count_if(prior).alias("prior")).crossJoin(F.broadcast(total))
    lift = ((F.col("recent") + 0.5) / (F.col("rn") + 1)) / ((F.col("prior") + 0.5) / (F.col("pn") + 1))
    kept = per.where((F.col("works") >= least) & (F.col("works") / F.col("all") <= most_share) & (F.col("recent") >= 2))
    score = F.log1p(F.col("recent").cast("double")) * F.log2(1 + lift)
    out = kept.select("phrase", "works", "recent", "prior", F.round(lift, 3).alias("lift"), F.round(score, 3).alias("score"))
    return out.orderBy(F.col("score").desc(), F.col("recent").desc(), "phrase").limit(k)


_DEFINED = re.compile(r"\s\(([A-Z][A-Z0-9]{1,9})\)")


def acronyms(df: DataFrame, key: str, fields: list[str], stop: list[str] = STOP) -> DataFrame:
    """(key, acronym, long_form, definitions): acronyms that a work itself defines as ``long form (LF)``, and in one way only.

    The shortest run of words before the brackets whose initials, stop words
    aside, spell the acronym is its long form; definitions in other works, or two
    different ones in a work, resolve nothing. Places need Python's matcher, so
    this is one Arrow step.
    """
    known = frozenset(stop)

    def long_form(before: str, short: str) -> str | None:
        words = [(m.group().casefold(), m.start(), m.end()) for m in _TOKEN.finditer(before)][-10:]
        for k in range(len(words) - 2, -1, -1):
            part = words[k:]
            gaps = [before[a[2] : b[1]] for a, b in zip(part, part[1:])] + [before[part[-1][2] :]]
            if any(g.strip(" \t\n-") for g in gaps):
                return None
            if part[0][0] not in known and "".join(w[0] for w, _, _ in part if w not in known).upper() == short:
                return " ".join(w for w, _, _ in part)
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, short, full, n = [], [], [], []
            for i in range(batch.num_rows):
                found: dict[str, list[str]] = {}
                for c in range(1, batch.num_columns):
                    text = batch.column(c)[i].as_py() or ""
                    for m in _DEFINED.finditer(text):
                        if (form := long_form(text[: m.start()], m.group(1))) is not None:
                            found.setdefault(m.group(1), []).append(form)
                for k, forms in found.items():
                    if len(set(forms)) == 1:
                        row.append(i)
                        short.append(k)
                        full.append(forms[0])
                        n.append(len(forms))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(short, pa.string()), pa.array(full, pa.string()), pa.array(n, pa.int64())], names=[key, "acronym", "long_form", "definitions"])

    return df.select(key, *fields).mapInArrow(read, f"{key} {dict(df.dtypes)[key]}, acronym string, long_form string, definitions long")


def topic_labels(terms: DataFrame, topic: str, term: str, count: str, seeds: list[str]) -> DataFrame:
    """Each topic's most counted term that is not a seed; of equals the one with most words, then the longest, then the last by name."""
    own = F.trim(F.regexp_replace(F.lower(term), r"\s+", " "))
    named = terms.where(~own.isin([" ".join(s.lower().split()) for s in seeds]))
    size = F.struct(F.col(count).alias("n"), F.size(F.split(own, " ")).alias("words"), F.length(term).alias("length"), F.col(term).alias("term"))
    return named.groupBy(topic).agg(F.max(size).alias("best")).select(topic, F.col("best.term").alias("label"), F.col("best.n").alias("works"))


def suggest(df: DataFrame, phrases: str, seeds: Column, k: int, least: int = 2) -> DataFrame:
    """Phrases of the documents that match the seeds, by how many of those hold them and how much oftener than others."""
    t = df.select(F.explode(F.array_distinct(phrases)).alias("phrase"), seeds.alias("seed"))
    per = t.groupBy("phrase").agg(F.count_if("seed").alias("support"), F.count("*").alias("docs")).where(F.col("support") >= least)
    return per.withColumn("lift", F.col("support") / F.col("docs")).orderBy(F.col("support").desc(), "phrase").limit(k)
