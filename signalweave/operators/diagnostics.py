"""Diagnostics of retrieval, review and runs: funnels, coverage, observability, packets, agreement and claims."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.functions.text import any_of, collapse, has_phrase
from signalweave.functions.vectors import unit
from signalweave.operators import blocks
from signalweave.storage import Scratch, broadcast_if_small

#: Words of titles that tell of overviews, and of papers that are no research reports.
SYNTHESIS = ["survey", "review", "overview", "tutorial", "meta-analysis"]
NONRESEARCH = ["editorial", "erratum", "corrigendum", "book review", "proceedings"]
#: What begins a sentence on the authors' own result.
OWN_CLAIM = r"(?i)\b(we (propose|present|introduce|show|develop|demonstrate)|this (paper|work) (proposes|presents|introduces|shows))\b"


def observability(docs: DataFrame, signals: DataFrame, text: Column, recent: Column, low: int) -> DataFrame:
    """Per signal (signal, pattern): matching and recent documents, and observed, low_support or absent.

    The signals are a short list and are broadcast; every document's normalised
    text is tested once for each.
    """
    t = docs.select(text.alias("_t"), recent.alias("_r"))
    hit = t.join(F.broadcast(signals), F.rlike(F.col("_t"), F.col("pattern"))).groupBy("signal").agg(F.count("*").alias("works"), F.count_if("_r").alias("recent_works"))
    out = signals.select("signal").join(hit, "signal", "left").select("signal", F.coalesce("works", F.lit(0)).alias("works"), F.coalesce("recent_works", F.lit(0)).alias("recent_works"))
    return out.withColumn("state", F.when(F.col("works") == 0, "absent").when(F.col("works") < low, "low_support").otherwise("observed"))


def coverage_status(present: Column, primary: Column, categories: Column, selected: list[str]) -> Column:
    """Where a wanted reference is: in the files, outside the selected categories, in a possible gap of cross-lists, or missing."""
    wanted = F.array(*map(F.lit, selected))
    return F.when(present, "present_in_declared_files").when(~F.arrays_overlap(categories, wanted), "outside_selected_categories").when(~primary.isin(selected), "possible_primary_partition_crosslist_gap").otherwise("missing_despite_matching_primary_category")


def recovery_funnel(targets: DataFrame, collected: DataFrame, quality: DataFrame, memberships: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each target's way: collected, included, assigned to its latest topic, and the state of that topic's candidate.

    ``targets`` (case, key), ``collected`` (key, work), ``quality`` (work, decision),
    ``memberships`` (work, topic, window), ``candidates`` (topic, status).
    """
    latest = memberships.groupBy("work").agg(F.max_by("topic", F.struct("window", -F.col("topic"))).alias("topic"))
    t = targets.join(collected.groupBy("key").agg(F.min("work").alias("work")), "key", "left").join(quality, "work", "left").join(latest, "work", "left").join(candidates, "topic", "left")
    return t.select("case", "key", F.col("work").isNotNull().alias("found"), (F.coalesce("decision", F.lit("")) == "include").alias("included"), "topic", "status")


def funnel_summary(funnel: DataFrame) -> DataFrame:
    """Per case: targets, found, included, assigned, and whether the targets that were assigned share one topic."""
    return funnel.groupBy("case").agg(F.count("*").alias("targets"), F.count_if("found").alias("found"), F.count_if("included").alias("included"), F.count("topic").alias("assigned"), ((F.count("topic") >= 2) & (F.count_distinct("topic") == 1)).alias("one_topic"))


def label_shares(items: DataFrame, case: str, label: str) -> DataFrame:
    """Counts and shares of labels within each case; shares of a packet, not a precision."""
    n = items.groupBy(case, label).agg(F.count("*").alias("items"))
    return n.withColumn("share", F.col("items") / F.sum("items").over(W.partitionBy(case)))


def blind_packet(items: DataFrame, by: list[str], key: str, salt: str, n: int) -> DataFrame:
    """``n`` items of each group in the order of a salted hash, under ids that tell neither group nor label."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    place = F.row_number().over(W.partitionBy(*by).orderBy(h, key))
    return items.withColumns({"_h": h, "place": place}).where(F.col("place") <= n).withColumn("item", F.substring("_h", 1, 16)).drop("_h")


def pair_concordance(items: DataFrame, by: list[str], label: str, score: str, order: dict[str, int]) -> DataFrame:
    """Per pair of labels: pairs, and how many the score puts right or ties, within each group.

    Counts of lower and equal scores run over sorted groups, so that no pair is made.
    """
    rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])[F.col(label)]
    t = items.withColumn("_k", rank).where(F.col("_k").isNotNull() & F.col(score).isNotNull())
    whole, below = W.partitionBy(*by), W.partitionBy(*by).orderBy(score).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy(*by, score)
    for worse, k in order.items():
        one = F.when(F.col("_k") == k, 1).otherwise(0)
        t = t.withColumns({f"_n{k}": F.sum(one).over(whole), f"_l{k}": F.sum(one).over(below), f"_e{k}": F.sum(one).over(same)})
    each = [F.when(F.col("_k") > k, F.struct(F.lit(worse).alias("worse"), F.col(f"_n{k}").alias("pairs"), (F.col(f"_l{k}") - F.col(f"_e{k}")).alias("correct"), F.col(f"_e{k}").alias("tied"))) for worse, k in order.items()]
    made = t.select(F.col(label).alias("better"), F.explode(F.array_compact(F.array(*each))).alias("p")).select("better", "p.*")
    return made.groupBy("better", "worse").agg(F.sum("pairs").alias("pairs"), F.sum("correct").alias("correct"), F.sum("tied").alias("tied")).where("pairs > 0")


def title_diagnostics(title: Column, anchor: Column) -> Column:
    """struct(format_hint, match): what a title hints at; never a checked label."""
    padded = F.concat(F.lit(" "), collapse(F.regexp_replace(F.lower(title), r"(?U)[^\w]+", " ")), F.lit(" "))
    has = lambda words: any_of([F.contains(padded, F.lit(f" {w} ".replace("-", " "))) for w in words])
    hint = F.when(has(NONRESEARCH), "nonresearch_format").when(has(SYNTHESIS), "review_or_synthesis").otherwise("unclassified")
    match = F.when(anchor.isNull(), "label_too_broad_for_title_check").when(F.contains(padded, F.concat(F.lit(" "), anchor, F.lit(" "))), "anchor_present_in_title").otherwise("anchor_not_shown_in_title")
    return F.struct(hint.alias("format_hint"), match.alias("match"))


def field_audit(df: DataFrame, fields: list[str], by: list[str] = ()) -> DataFrame:
    """How many rows have each field: not null and, for text, not blank."""
    kinds = dict(df.dtypes)
    there = {f: F.col(f).isNotNull() & ((F.trim(f) != "") if kinds[f] == "string" else F.lit(True)) for f in fields}
    return df.groupBy(*by).agg(F.count("*").alias("records"), *[F.count_if(c).alias(f"with_{f}") for f, c in there.items()])


def analysis_period(runs: DataFrame) -> DataFrame:
    """start, end (exclusive) and where they come from: the run's own period, else its query's, else the mission's.

    Columns: as_of, run_from, run_to, query_from, query_to, mission_from, mission_to (days, inclusive).
    """
    pinned, queried = F.col("run_to").isNotNull() | F.col("run_from").isNotNull(), F.col("query_to").isNotNull() | F.col("query_from").isNotNull()
    pick = lambda e: F.when(pinned, F.col(f"run_{e}")).when(queried, F.col(f"query_{e}")).otherwise(F.col(f"mission_{e}"))
    origin = F.when(pinned, "run_snapshot").when(queried, "pinned_query_version").otherwise("legacy_mission_fallback")
    return runs.withColumns({"start": pick("from"), "end": F.least(F.col("as_of"), F.date_add(pick("to"), 1)), "origin": origin})


def complete_months(start: Column, as_of: Column) -> Column:
    """struct(start, end) of the whole months from ``start`` on that were over at ``as_of``; null if none was."""
    low = F.when(F.day(start) == 1, start).otherwise(F.add_months(F.trunc(start, "month"), 1))
    high = F.trunc(as_of, "month")
    return F.when(low < high, F.struct(low.cast("date").alias("start"), high.cast("date").alias("end")))


def fresh(status: Column, age_seconds: Column, hours: int = 24, minutes: int = 10) -> Column:
    """Is a cached answer usable? Complete and empty ones for hours, errors for minutes, never from the future."""
    ttl = F.when(status.isin("complete", "empty_observed_response"), hours * 3600).otherwise(minutes * 60)
    return F.coalesce((age_seconds >= 0) & (age_seconds <= ttl), F.lit(False))


def theme_matches(query: Column, term: Column) -> Column:
    """Equal after folding; or one holds the other as whole words, if the held one has two words or more."""
    fold = lambda c: collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))
    q, t = fold(query), fold(term)
    inside = lambda a, b: F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))
    words = lambda c: F.size(F.split(c, " "))
    return (q != "") & (t != "") & ((q == t) | ((words(t) >= 2) & inside(t, q)) | ((words(q) >= 2) & (F.length(q) >= 7) & inside(q, t)))


def missing_acronyms(query: Column, terms: Column) -> Column:
    """Acronyms of a query in capitals that no term holds as a word."""
    named = F.array_distinct(F.regexp_extract_all(query, F.lit(r"\b([A-Z][A-Z0-9]{1,9})\b"), F.lit(1)))
    words = F.flatten(F.transform(terms, lambda t: F.split(F.lower(t), "[^a-z0-9]+")))
    return F.array_sort(F.filter(named, lambda a: ~F.array_contains(words, F.lower(a))))


def claim_sentences(docs: DataFrame, key: str, title: str, abstract: str) -> DataFrame:
    """(key, sentence number, text, sha256, format_hint): sentences that tell of the authors' own result."""
    sentences = F.split(collapse(F.col(abstract)), r"(?<=[.!?]) ")
    hint = F.when(F.lower(title).rlike(r"\b(" + "|".join(SYNTHESIS) + r")\b"), "review_or_synthesis").otherwise("unclassified")
    each = docs.where((F.trim(title) != "") & (F.trim(abstract) != "")).select(key, hint.alias("format_hint"), F.posexplode(sentences).alias("n", "text"))
    return each.where(F.col("text").rlike(OWN_CLAIM)).withColumn("text_sha256", F.sha2("text", 256))


def own_claim(docs: DataFrame, claims: DataFrame, key: str, title: str, phrase: str) -> DataFrame:
    """(key, own_result, basis) of a phrase: no for reviews, unclear without a claim, else whether a claim holds it."""
    per = claims.groupBy(key).agg(F.bool_or(has_phrase(F.col("text"), phrase, True)).alias("held"))
    review = F.lower(title).rlike(r"\b(" + "|".join(SYNTHESIS) + r")\b")
    t = docs.select(key, review.alias("_r")).join(per, key, "left")
    basis = F.when(F.col("_r"), "review_title").when(F.col("held").isNull(), "no_explicit_own_claim_cue").when(F.col("held"), "own_claim_sentence_contains_phrase").otherwise("own_claim_sentences_do_not_contain_phrase")
    result = F.when(F.col("_r"), "no").when(F.col("held").isNull(), "unclear").when(F.col("held"), "yes").otherwise("no")
    return t.select(key, result.alias("own_result"), basis.alias("basis"))


def url_key(url: Column) -> Column:
    """A source's identity: arXiv id or DOI, else host and path without ``www.``, query and last slash."""
    bare = F.regexp_replace(F.trim(url), r"[./]+$", "")
    arxiv = F.regexp_extract(bare, r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1)
    host = F.regexp_replace(F.lower(F.try_parse_url(bare, F.lit("HOST"))), r"^www\.", "")
    path = F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(bare, F.lit("PATH")), F.lit("")), r"/+$", ""))
    return F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).when(host.isin("doi.org", "dx.doi.org"), F.concat(F.lit("doi:"), F.regexp_replace(path, "^/+", ""))).when((host != "") & (path != ""), F.concat(F.lit("url:"), host, path))


def _starts(rows: pa.Table) -> np.ndarray:
    """Where clusters begin in rows sorted by cluster."""
    c = np.array(rows["c"].to_pylist())
    return np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)


def _worst(a: np.ndarray, b: np.ndarray, first: np.ndarray, other: np.ndarray, slab: int = 256) -> np.ndarray:
    """Least cosine of each cluster of ``a`` with each of ``b``; ``first`` and ``other`` are their starts."""
    out = np.empty((len(first), len(other)))
    ends = np.r_[first, len(a)]
    for at in range(0, len(first), slab):
        upto = min(at + slab, len(first))
        s = np.minimum.reduceat(np.round(a[ends[at] : ends[upto]] @ b.T, 12), other, axis=1)
        out[at:upto] = np.minimum.reduceat(s, first[at:upto] - ends[at], axis=0)
    return out


def complete_link(df: DataFrame, by: str, key: str, vector: str, least: float, most: int | None = None, clusters: int = 2_000) -> DataFrame:
    """(by, key, group): clusters of each list whose members are all at least ``least`` alike, best pair of clusters first.

    ``group`` is a cluster's smallest key. Of equally good pairs the one with the
    smaller first members merges. A list of up to ``clusters`` rows is merged in one
    task. In a longer one, clusters that are each other's best merge in rounds
    until it has so few: a merge never brings a cluster nearer to others, so this
    gives what one merge at a time gives. Rounds meet block by block, no cluster
    parted, and only look again at clusters whose best has changed; clusters
    without any partner left are done. A list of over ``most`` rows raises.
    """
    scratch = Scratch(df.sparkSession, "complete")
    kind = dict(df.dtypes)[key]
    start = df.select(F.to_json(F.struct(by)).alias("g"), F.col(by).alias("b"), F.col(key).alias("k"), unit(F.col(vector).cast("array<double>")).alias("v"), F.col(key).alias("c"))
    live = scratch.save(start, "live_0")

    def merge(rows: pa.Table) -> pa.Table:
        if most is not None and rows.num_rows > most:
            raise ValueError(f"a list of {rows.num_rows} rows; at most {most}")
        rows = rows.sort_by([("c", "ascending"), ("k", "ascending")])
        x, first = blocks.matrix(rows, "v"), _starts(rows)
        worst = _worst(x, x, first, first)
        np.fill_diagonal(worst, -np.inf)
        owner, every = np.arange(len(first)), np.arange(len(first))
        near = worst.argmax(axis=1) if len(first) else every
        top = worst[every, near]
        while len(first):
            # Rows of merged clusters are out; the first of the best stands in the smallest places.
            at = int(top.argmax())
            a, b = sorted((at, int(near[at])))
            if worst[a, b] < least:
                break
            owner[owner == b] = a
            worst[a] = worst[:, a] = np.minimum(worst[a], worst[b])
            worst[b] = worst[:, b] = -np.inf
            worst[a, a] = -np.inf
            # Values only fall, so only rows whose best was one of the two look again.
            again = np.flatnonzero((near == a) | (near == b) | (every == a) | (every == b))
            near[again] = worst[again].argmax(axis=1)
            top[again] = worst[again, near[again]]
        each = np.repeat(owner, np.diff(np.r_[first, len(x)]))
        return pa.table({"g": rows["g"], "b": rows["b"], "k": rows["k"], "c": rows["c"].take(pa.array(first[each]))})

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("c"), right.sort_by("c")
        a, b = _starts(left), _starts(right)
        own, near = left["c"].take(pa.array(a)), right["c"].take(pa.array(b))
        if not len(a) or not len(b):
            return pa.table({"g": left["g"].slice(0, 0), "c": own.slice(0, 0), "near": near.slice(0, 0), "similarity": pa.array([], pa.float64())})
        s = _worst(blocks.matrix(left, "v"), blocks.matrix(right, "v"), a, b)
        s[np.array(own.to_pylist())[:, None] == np.array(near.to_pylist())[None, :]] = -np.inf
        top = s.argmax(axis=1)
        similar = s[np.arange(len(a)), top]
        row = np.flatnonzero(similar >= least)
        return pa.table({"g": left["g"].take(pa.array(a[row])), "c": own.take(pa.array(row)), "near": near.take(pa.array(top[row])), "similarity": pa.array(similar[row])})

    done, n, known = [], 0, None
    while True:
        size = live.groupBy("g").agg(F.count("*").alias("rows"), F.count_distinct("c").alias("m"))
        few = (F.col("m") <= clusters) & (F.col("rows") <= 20 * clusters)
        ready = scratch.save(size.where(few | (F.col("rows") > most) if most is not None else few).select("g"), f"ready_{n}")
        last = live.join(broadcast_if_small(ready, blocks.GROUPS), "g", "left_semi")
        done.append(last.groupBy("g").applyInArrow(merge, f"g string, b {dict(df.dtypes)[by]}, k {kind}, c {kind}"))
        live = live.join(broadcast_if_small(ready, blocks.GROUPS), "g", "left_anti")
        if not live.limit(1).count():
            break
        asked = live if known is None else live.join(known.select("g", "c"), ["g", "c"], "left_anti")
        met = blocks.across(asked, live, ["g"], "c", best, f"g string, c {kind}, near {kind}, similarity double")
        found = met.groupBy("g", "c").agg(F.min(F.struct((-F.col("similarity")).alias("apart"), "near")).alias("x")).select("g", "c", "x.near", "x.apart")
        found = scratch.save(found if known is None else found.unionByName(known.join(live.select("g").distinct(), "g", "left_semi")), f"best_{n}")
        done.append(live.join(found, ["g", "c"], "left_anti").select("g", "b", "k", "c"))
        pairs = found.groupBy("g", F.least("c", "near").alias("a"), F.greatest("c", "near").alias("b")).agg(F.count("*").alias("votes"), F.min("apart").alias("apart"))
        mutual = pairs.where("votes = 2")
        # Where rounding hides all mutual pairs of a list, its best pair is merged.
        forced = pairs.join(mutual.select("g").distinct(), "g", "left_anti").groupBy("g").agg(F.min(F.struct("apart", "a", "b")).alias("x")).select("g", "x.a", "x.b")
        merged = scratch.save(mutual.select("g", "a", "b").unionByName(forced), f"merged_{n}")
        n += 1
        into = merged.select("g", F.col("b").alias("c"), F.col("a").alias("into"))
        live = scratch.save(live.join(found.select("g", "c"), ["g", "c"], "left_semi").join(into, ["g", "c"], "left").select("g", "b", "k", "v", F.coalesce("into", "c").alias("c")), f"live_{n}")
        moved = merged.select("g", F.explode(F.array("a", "b")).alias("c"))
        known = scratch.save(found.join(moved, ["g", "c"], "left_anti").join(moved.withColumnRenamed("c", "near"), ["g", "near"], "left_anti").select("g", "c", "near", "apart"), f"known_{n}")
    out = done[0]
    for some in done[1:]:
        out = out.unionByName(some)
    return out.select(F.col("b").alias(by), F.col("k").alias(key), F.col("c").alias("group"))


def tertile_sample(pairs: DataFrame, by: str, score: str, key: str, salt: str, n: int) -> DataFrame:
    """``n`` pairs of each third by score of each group, in the order of a salted hash."""
    third = F.ntile(3).over(W.partitionBy(by).orderBy(score, key))
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    t = pairs.withColumn("tertile", third)
    return t.withColumn("place", F.row_number().over(W.partitionBy(by, "tertile").orderBy(h, key))).where(F.col("place") <= n)
