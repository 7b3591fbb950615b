"""Removal of repeated byte strings by distributed bucket-pointer refinement.

A suffix array of all texts is sorted only as far as is needed to tell which
strings of ``length`` bytes occur twice. Suffixes start in buckets of equal
q-grams; a bucket is refined by the identifiers of the q-gram bucket it came
from and of the blocks at later (and, as runs of starts share one bucket,
earlier) offsets; each round's identifiers are the next round's pointers.

Three things keep this in proportion to the input:

* Starts go in runs. A start's bucket is that of the least-hashed q-gram inside
  its string (first of equals), so equal strings pick the same q-gram at the
  same distance, and on average some 170 starts share one row.
* A run whose whole surroundings occur twice is settled at once, in any number
  of copies, by a combinable count; one whose bucket holds nothing else is
  settled too. Only runs at the rims of repeats are refined.
* A refined row carries no text but the bytes around its bucket that are still
  undecided; they halve and more with each round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch, broadcast_if_small, hot_join, table, text_bytes

#: Bytes of a repeated string; the least of a q-gram that first buckets are made of; parts of a run of starts in each round.
LENGTH, LEAST_GRAM, FAN = 400, 50, 7

#: Texts up to which those with repeated q-grams are found by a broadcast of their hashes.
BROADCAST_TEXTS = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Anchors:
    """The least-hashed q-gram of each string of ``length`` bytes, for texts laid end to end."""

    def __init__(self, length: int, gram: int, limit: int = CHUNK_BYTES):
        self.length, self.gram, self.most = length, gram, limit + length
        self.up, self.down = _powers(self.most + 1)

    def runs(self, data: bytes, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of starts with one anchor: (text, anchor, lowest start, highest start, bucket id), positions in ``data``.

        ``first`` and ``count``: where each text begins and how many starts it has here.
        """
        b = np.frombuffer(data, np.uint8)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], out=total[1:])
        bucket = _mix((total[self.gram :] - total[: -self.gram]) * self.down[: len(b) - self.gram + 1])
        # The place in the low bits: of equal hashes the first is least, and the least tells its place.
        bits = np.uint64(self.most.bit_length())
        least = ((_mix(bucket) >> bits) << bits) | np.arange(len(bucket), dtype=np.uint64)
        width, have = self.length - self.gram + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        text = np.repeat(np.arange(len(first)), count)
        start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        anchor = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        last = np.r_[new[1:], len(start)] - 1
        return text[new], anchor[new], start[new], start[last], bucket[anchor[new]].view(np.int64)


def _texts(batch: pa.RecordBatch, length: int, limit: int) -> Iterator[tuple[bytes, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of many texts, or of a part of a long one: (data, rows, first, count, what to add to positions)."""
    held: list[bytes] = []
    rows: list[int] = []
    size = 0

    def out():
        sizes = np.array([len(x) for x in held])
        first = np.cumsum(sizes) - sizes
        return b"".join(held), rows, first, sizes - length + 1, -first

    for i, value in enumerate(batch.column(1)):
        raw = text_bytes(value.as_py())
        if len(raw) < length:
            continue
        if size and size + len(raw) > limit:
            yield out()
            held, rows, size = [], [], 0
        if len(raw) > limit:
            for at in range(0, len(raw) - length + 1, limit):
                part = raw[at : at + limit + length - 1]
                yield part, [i], np.array([0]), np.array([len(part) - length + 1]), np.array([at])
            continue
        held.append(raw)
        rows.append(i)
        size += len(raw)
    if held:
        yield out()


def anchor_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, tx, at, times, spans, near, far, bucket, around): runs of starts ``at - far`` to ``at - near`` and ids of their bucket and surroundings.

    Equal runs of a text are one row, with their number; ``spans`` (null for a
    single run) are the first and last starts of the stretches that they cover
    together, so that a line repeated without end is one span and not one a place.
    Texts longer than a chunk are cut where starts end, so that no start is lost.
    """
    made: list[Anchors] = []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        if not made:
            made.append(Anchors(length, gram))
        names = ["doc_id", "tx", "at", "times", "spans", "near", "far", "bucket", "around"]
        span = pa.struct([("low", pa.int64()), ("high", pa.int64())])
        for batch in batches:
            for data, rows, first, count, add in _texts(batch, length, CHUNK_BYTES):
                text, anchor, low, high, bucket = made[0].runs(data, first, count)
                around = np.fromiter((xxh3_64_intdigest(data[i : j + length]) for i, j in zip(low.tolist(), high.tolist(), strict=True)), np.uint64, len(low)).view(np.int64)
                order = np.lexsort((anchor, around, anchor - low, anchor - high, bucket, text))
                text, anchor, low, high, bucket, around = (x[order] for x in (text, anchor, low, high, bucket, around))
                near, far = anchor - high, anchor - low
                new = np.r_[True, (np.diff(text) != 0) | (np.diff(bucket) != 0) | (np.diff(near) != 0) | (np.diff(far) != 0) | (np.diff(around) != 0)]
                first_of = np.flatnonzero(new)
                times = np.diff(np.r_[first_of, len(new)])
                # Starts of equal runs rise; those whose strings touch make one stretch.
                low, high = anchor - far + add[text], anchor - near + add[text]
                apart = new | np.r_[True, low[1:] > high[:-1] + length]
                begin = np.flatnonzero(apart)
                end = np.r_[begin[1:], len(apart)] - 1
                group = np.cumsum(new)[begin] - 1
                many = times[group] > 1
                per = np.bincount(group[many], minlength=len(times))
                stretches = pa.StructArray.from_arrays([pa.array(low[begin[many]]), pa.array(high[end[many]])], fields=list(span))
                spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), stretches, mask=pa.array(times == 1))
                text, anchor = text[first_of], anchor[first_of]
                row = pa.array(np.array(rows)[text])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(anchor + add[text]), pa.array(times.astype(np.int32)), spans, pa.array(near[first_of].astype(np.int32)), pa.array(far[first_of].astype(np.int32)), pa.array(bucket[first_of]), pa.array(around[first_of])], names=names)

    return docs.select("doc_id", "text", "tx").mapInArrow(read, "doc_id long, tx long, at long, times int, spans array<struct<low:long,high:long>>, near int, far int, bucket long, around long")


def _fringes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """For each run listed in ``runs`` of a text, the undecided bytes left and right of its bucket's."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tx", "at", "near", "far", "bucket", "settled", "lb", "rb"]
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                raw, runs = text_bytes(value.as_py()), batch.column(3)[i].as_py()
                for k in range(0, len(runs), 4096):
                    some = runs[k : k + 4096]
                    take = pa.array([i] * len(some))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(2).take(take), pa.array([r["at"] for r in some], pa.int64()), pa.array([r["near"] for r in some], pa.int32()), pa.array([r["far"] for r in some], pa.int32()), pa.array([r["bucket"] for r in some], pa.int64()), pa.array([r["settled"] for r in some], pa.bool_())]
                        + [pa.array([raw[r["at"] - r["far"] : r["at"]] for r in some], pa.binary()), pa.array([raw[r["at"] + gram : r["at"] - r["near"] + length] for r in some], pa.binary())],
                        names=names,
                    )

    return docs.select("doc_id", "text", "tx", "runs").mapInArrow(read, "doc_id long, tx long, at long, near int, far int, bucket long, settled boolean, lb binary, rb binary")


def _whole_words(raw: bytes, low: int, high: int) -> int:
    """Words of ``raw`` that lie in ``low`` to ``high`` as a whole."""
    part = raw[low:high]
    cut = [low > 0 and not raw[low - 1 : low].isspace() and not part[:1].isspace(), high < len(raw) and not raw[high : high + 1].isspace() and not part[-1:].isspace()]
    return max(0, len(part.split()) - sum(cut))


def short_passages(docs: DataFrame, words: int, length: int) -> DataFrame:
    """(doc_id, tx, h1, h2, spans): passages of ``words`` words under ``length`` bytes, one row for all places in a text.

    ``spans`` are as those of runs of starts: ``high`` + ``length`` is the passage's end.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        names, spans = ["doc_id", "tx", "h1", "h2", "spans"], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                raw = text_bytes(value.as_py())
                at = np.array([m.span() for m in re.finditer(rb"\S+", raw)], np.int64).reshape(-1, 2)
                if len(at) < words:
                    continue
                low, end = at[: len(at) - words + 1, 0], at[words - 1 :, 1]
                short = np.flatnonzero(end - low < length)
                found: dict[bytes, list[dict[str, int]]] = {}
                for a, b in zip(low[short].tolist(), end[short].tolist(), strict=True):
                    found.setdefault(xxh3_128_digest(raw[a:b]), []).append({"low": a, "high": b - length})
                keys = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                take = pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(found.values()), spans)], names=names)

    return docs.select("doc_id", "text", "tx").mapInArrow(read, "doc_id long, tx long, h1 long, h2 long, spans array<struct<low:long,high:long>>")


def _kept(docs: DataFrame, length: int, want_text: bool, words: int | None = None) -> DataFrame:
    """Texts without the bytes of their repeated strings; ``spans``: first and last start of each run of them.

    With ``words``, a stretch of them goes only if it has that many whole words or ``LENGTH`` bytes.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n, sha, texts = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                raw, spans = text_bytes(value.as_py()), []
                for low, high in sorted((s["low"], s["high"]) for s in batch.column(3)[i].as_py()):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high + length)
                    else:
                        spans.append([low, high + length])
                if words:
                    spans = [s for s in spans if s[1] - s[0] >= LENGTH or _whole_words(raw, *s) >= words]
                ends = [0, *(x for s in spans for x in s), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                removed.append(len(raw) - len(left))
                n.append(len(spans))
                sha.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "ignore") if want_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "tx", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return docs.select("doc_id", "text", "tx", "spans").mapInArrow(read, "doc_id long, tx long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def _shared(rows: DataFrame, key: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows whose bucket holds another one: a narrow combinable count first, then the rows that it leaves."""
    counts = rows.groupBy(*key).agg(F.sum("times").alias("n")).where("n > 1")
    return hot_join(rows, scratch.save(counts, f"{name}_counts"), key, "n").drop("n")


def _settle(rows: DataFrame, key: list[str], around: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` (of shared buckets) with ``repeated`` (settled now) and ``open`` (to be refined).

    Of rows with equal surroundings one stays, settled, for others to meet.
    """
    each = rows.groupBy(*key, *around).agg(F.sum("times").alias("same"), F.min(F.xxhash64("doc_id", "tx", "at")).alias("one"))
    each = scratch.save(each, f"{name}_each")
    kinds = each.groupBy(*key).agg(F.count("*").alias("kinds"))
    counted = scratch.save(hot_join(each, kinds, key, "kinds"), f"{name}_kinds")
    met = hot_join(rows, counted, [*key, *around], "same")
    repeated = F.col("same") > 1
    one = F.xxhash64("doc_id", "tx", "at") == F.col("one")
    return met.withColumn("repeated", repeated & ~F.col("settled")).withColumn("open", (F.col("kinds") > 1) & (~repeated | one)).withColumn("settled", F.col("settled") | repeated).drop("same", "kinds", "one")


def gram_size(length: int, least: int, fan: int) -> int:
    """The least q-gram from ``least`` on that leaves a power of ``fan`` starts to a run."""
    width = 1
    while width * fan <= length - least + 1:
        width *= fan
    return length - width + 1


def _refine(rows: DataFrame, width: int, fan: int) -> tuple[DataFrame, int]:
    """Each row's run cut in ``fan`` parts on a fixed grid of distances, with refined buckets.

    A part's strings share more bytes: the bucket's, a block of the bytes before
    it and a block of those after it. The new pointer is made of the old one and
    of these blocks.
    """
    step = width // fan
    cut = rows.withColumn("low", F.explode(F.expr(f"transform(sequence(0, {fan - 1}), k -> band + k * {step})"))).withColumn("high", F.col("low") + step - 1).where("near <= high and low <= far")
    # ``lb`` ends at distance ``band``; ``rb`` begins where the string of the widest distance ends.
    before = F.expr("substring(lb, length(lb) - (low - band) + 1, low - band)")
    after = F.expr(f"substring(rb, 1, band + {width} - 1 - high)")
    left = F.expr("substring(lb, length(lb) - (least(far, high) - band) + 1, least(far, high) - low)")
    right = F.expr(f"substring(rb, band + {width} - high, high - greatest(near, low))")
    pointers = F.xxhash64("b1", before, F.lit(1), after).alias("b1"), F.xxhash64(after, "b2", F.lit(2), before).alias("b2")
    return cut.select("doc_id", "tx", "at", F.greatest("near", "low").alias("near"), F.least("far", "high").alias("far"), "settled", F.col("low").alias("band"), *pointers, left.alias("lb"), right.alias("rb")), step


def repeated_starts(docs: DataFrame, scratch: Scratch, length: int, gram: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(texts with repeated q-gram buckets, stretches of repeated starts (doc_id, tx, spans: low and high of each))."""
    runs = scratch.save(anchor_runs(docs, length, gram), "runs")
    shared = scratch.save(_shared(runs, ["bucket"], scratch, "first").withColumn("settled", F.lit(False)), "shared")
    scratch.drop("runs")
    settled = _settle(shared, ["bucket"], ["near", "far", "around"], scratch, "first").where("repeated or open")
    listed = settled.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("at", "spans", "near", "far", "bucket", "settled", "repeated", "open")).alias("runs"))
    listed = scratch.save(listed, "listed")
    scratch.drop("shared")
    # Texts without any such run stay where they are, if the hashes of the others are few.
    some = docs.join(broadcast_if_small(listed.select("tx").distinct(), BROADCAST_TEXTS), "tx", "left_semi")
    met = some.alias("d").join(listed.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.tx") == F.col("r.tx")))
    pending = scratch.save(met.select("d.doc_id", "d.text", "d.tx", "r.runs"), "pending")
    scratch.drop("listed")
    span = lambda r: F.struct((r["at"] - r["far"]).alias("low"), (r["at"] - r["near"]).alias("high"))
    found = pending.select("doc_id", "tx", F.flatten(F.transform(F.filter("runs", lambda r: r["repeated"]), lambda r: F.coalesce(r["spans"], F.array(span(r))))).alias("spans")).where("size(spans) > 0")
    todo = _fringes(pending.withColumn("runs", F.filter("runs", lambda r: r["open"])).where("size(runs) > 0"), length, gram)
    rows = scratch.save(todo.withColumns({"band": F.lit(0), "b1": F.col("bucket"), "b2": F.col("bucket")}).drop("bucket"), "rims_0")
    width, n, all_found = length - gram + 1, 0, [found]
    while width > 1 and rows.where("not settled").limit(1).count():
        cut, step = _refine(rows, width, fan)
        cut = scratch.save(cut, f"cut_{n}")
        n += 1
        cut = cut.withColumns({"around": F.xxhash64("lb", F.lit(3), "rb"), "size": F.length("lb"), "times": F.lit(1)})
        met = _settle(_shared(cut, ["b1", "b2", "band"], scratch, f"cut_{n}"), ["b1", "b2", "band"], ["near", "far", "size", "around"], scratch, f"cut_{n}")
        met = scratch.save(met.where("repeated or open").drop("size", "around", "times"), f"rims_{n}")
        scratch.drop(f"cut_{n - 1}")
        all_found.append(met.where("repeated").groupBy("doc_id", "tx").agg(F.collect_list(F.struct((F.col("at") - F.col("far")).alias("low"), (F.col("at") - F.col("near")).alias("high"))).alias("spans")))
        rows, width = met.where("open").drop("repeated", "open"), step
    out = all_found[0]
    for more in all_found[1:]:
        out = out.unionAll(more)
    return pending, out


def repeated_text(docs: DataFrame, length: int = LENGTH, least_gram: int = LEAST_GRAM, fan: int = FAN, want_text: bool = False, words: int | None = None) -> DataFrame:
    """Each document without the bytes that any string of ``length`` bytes repeated elsewhere covers.

    Returns the input's columns and n_bytes, n_removed, n_spans, kept_sha256 and,
    if wanted, kept_text (bytes of characters cut in half are left out). Strings
    are judged on the input; one may repeat in its own text; none crosses texts.
    Null and short texts keep all. Repeated rows remove each other's bytes and
    each stay as a row. Input columns with the names of results are replaced.

    With ``words``, every repeated passage of that many words goes, however few its
    bytes, and so does what is repeated over ``LENGTH`` bytes; shorter stretches of
    fewer words stay. Passages under ``length`` bytes, which are rare, are met by
    their hashes, all others by their strings of ``length`` bytes.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    docs = docs.drop(*results).withColumn("_sw_tx", F.xxhash64("text"))
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("_sw_tx").alias("tx"))
    pending, spans = repeated_starts(slim, scratch, length, gram_size(length, least_gram, fan), fan)
    if words:
        short = scratch.save(short_passages(slim, words, length), "short")
        often = short.groupBy("h1", "h2").agg(F.sum(F.size("spans")).alias("places")).where("places > 1").select("h1", "h2")
        again = short.join(broadcast_if_small(often, BROADCAST_TEXTS), ["h1", "h2"]).select("doc_id", "tx", "spans")
        spans = scratch.save(spans.unionAll(again), "spans")
        pending = slim.join(broadcast_if_small(spans.select("tx").distinct(), BROADCAST_TEXTS), "tx", "left_semi")
    per = spans.groupBy("doc_id", "tx").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    with_spans = pending.alias("p").join(per.alias("s"), F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("p.tx") == F.col("s.tx"))).select("p.doc_id", "p.text", "p.tx", "s.spans")
    done = scratch.save(_kept(with_spans, length, want_text, words), "kept").dropDuplicates(["doc_id", "tx"])
    scratch.keep("kept")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.withColumns({"n_bytes": F.length(raw).cast("long"), "_sw_sha": F.sha2(raw, 256)})
    columns = [c for c in whole.columns if c not in ("_sw_tx", "_sw_sha", "n_bytes")]

    def result(rows: DataFrame, removed, spans, sha, text) -> DataFrame:
        out = [F.col("n_bytes"), removed.cast("long").alias("n_removed"), spans.cast("long").alias("n_spans"), sha.alias("kept_sha256")]
        return rows.select(*[F.col(f"`{c}`") for c in columns], *out, *([text.alias("kept_text")] if want_text else []))

    # Rows whose text lost nothing need no join on ids; the others meet their result.
    hashes = broadcast_if_small(done.where("n_removed > 0").select(F.col("tx").alias("_sw_tx")).distinct(), BROADCAST_TEXTS)
    zero = F.lit(0)
    same = result(whole.join(hashes, "_sw_tx", "left_anti"), zero, zero, F.col("_sw_sha"), F.coalesce("text", F.lit("")))
    rest = whole.join(hashes, "_sw_tx", "left_semi").withColumn("_sw_id", F.col("doc_id").cast("long"))
    lost = done.select(F.col("doc_id").alias("_sw_k_id"), F.col("tx").alias("_sw_k_tx"), F.col("n_removed").alias("_sw_k_removed"), F.col("n_spans").alias("_sw_k_spans"), F.col("kept_sha256").alias("_sw_k_sha"), F.col("kept_text").alias("_sw_k_text"))
    met = rest.join(lost, F.col("_sw_id").eqNullSafe(F.col("_sw_k_id")) & (F.col("_sw_tx") == F.col("_sw_k_tx")), "left")
    changed = result(met, F.coalesce("_sw_k_removed", zero), F.coalesce("_sw_k_spans", zero), F.coalesce("_sw_k_sha", "_sw_sha"), F.when(F.col("_sw_k_removed") > 0, F.col("_sw_k_text")).otherwise(F.coalesce("text", F.lit(""))))
    return same.unionAll(changed)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_text(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS h FROM d, unnest(range(1, n - 398)) AS t(i) WHERE n >= 400
), s AS (SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)
), g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM s
), sp AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k
), pc AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM sp
  UNION ALL SELECT doc_id, 9000000000, max(z) + 1, NULL FROM sp GROUP BY doc_id
), kept AS (SELECT doc_id, sha256(unhex(coalesce(string_agg(CASE WHEN f <= coalesce(t, n) THEN hex(array_slice(b, f, coalesce(t, n))) ELSE '' END, '' ORDER BY a), ''))) AS sha FROM pc JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha, sha256(b)) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
