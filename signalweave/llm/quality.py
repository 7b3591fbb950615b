"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes

#: Labelled rows of each class that are learned from, at most; latent dimensions; voters; texts scored at once.
PER_CLASS, DIMENSIONS, VOTERS, BLOCK = 600, 64, 15, 256
#: Weight of a vote: similarity to this power.
SHARPNESS = 8
#: Bytes of a text that are turned to terms at once; all of a text is read.
SLICE = 1 << 20
#: Bits of the numbers that words and character trigrams are hashed to.
BITS = 12
#: Terms beside words and trigrams: words, words that repeat the last one, words in capitals, different words.
SHAPES = 4
#: A shape stands beside many hashed terms and counts as several of them.
SHAPE_WEIGHT = 3
TERMS = 2 * (1 << BITS) + SHAPES

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _word_hashes(part: bytes) -> np.ndarray:
    """A number for each word of ``part``, the same for the same bytes: their sum of powers, up to its place."""
    b = np.frombuffer(part, np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[b], True].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    place = np.arange(len(b), dtype=np.uint64) - np.repeat(begin, np.diff(np.r_[begin, len(b)])).astype(np.uint64) if begin[0] == 0 else None
    if place is None:
        return _word_hashes(part[begin[0] :])
    # Each byte is mixed with its place in its word; a word's sum is then its hash.
    mixed = (b.astype(np.uint64) + np.uint64(1)) * ((place * np.uint64(2) + np.uint64(1)) * _BASE)
    mixed ^= mixed >> np.uint64(29)
    mixed[_SPACE[b]] = 0
    return np.add.reduceat(mixed, begin)


def terms(raw: bytes) -> np.ndarray:
    """Damped counts of a whole text's terms: hashed words, hashed character trigrams and shapes; empty texts have none."""
    counts = np.zeros(TERMS, np.float64)
    size, half = 1 << BITS, 2 << BITS
    low, n, at = raw.lower(), 0, 0
    while at < len(low):
        # Slices end where words do; a word that is longer stays whole.
        end = at + SLICE
        while end < len(low) and not _SPACE[low[end]]:
            end += 1
        hashed = _word_hashes(low[at:end])
        n += len(hashed)
        counts[:size] += np.bincount(_bucket(hashed), minlength=size)
        at = end
    for at in range(0, len(raw) - 2, SLICE):
        k = np.frombuffer(raw, np.uint8, min(SLICE + 2, len(raw) - at), at).astype(np.uint64)
        counts[size:half] += np.bincount(_bucket((k[:-2] * np.uint64(65536) + k[1:-1] * np.uint64(256) + k[2:]) * _BASE), minlength=size)
    words = raw.split()
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    shouted = sum(1 for w in words if len(w) > 1 and w.isupper())
    n = max(1, n)
    # Shares of the text, on one scale, whatever its length.
    counts[:size] *= 100 / n
    counts[size:half] *= 1000 / max(1, len(raw))
    counts[half:] = 1000 * len(words) / max(1, len(raw)), 1000 * repeats / n, 1000 * shouted / n, 1000 * len(set(words)) / n / max(1.0, np.log2(n))
    damped = np.log1p(counts)
    damped[half:] *= SHAPE_WEIGHT
    return damped


class LatentSpace:
    """Term weights and a projection learned from labelled texts, and their vectors with labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        n = len(counts)
        self.prior = float(labels.mean()) if n else 0.5
        self.labels = labels.astype(np.float64)
        if not n:
            return
        self.weight = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
        x = counts * self.weight
        # In place and by rows: the driver holds the matrix once more, not three times.
        for at in range(0, n, BLOCK):
            x[at : at + BLOCK] = self._unit(x[at : at + BLOCK])
        # Right singular vectors from the Gram matrix; signs do not matter for cosines.
        values, vectors = np.linalg.eigh((x @ x.T).astype(np.float64))
        top = [i for i in np.argsort(-values, kind="stable")[:dimensions] if values[i] > 1e-9 * values[-1]]
        self.project = x.T @ (vectors[:, top] / np.sqrt(values[top])).astype(np.float32)
        self.vectors = self._unit(x @ self.project)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, voters: int = VOTERS) -> np.ndarray:
        """Share of label 1 among the nearest labelled texts, weighted by similarity; the prior where no text is near.

        Of equally similar voters those that come first count, so equal texts get equal scores.
        """
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        x = self._unit(self._unit(counts.astype(np.float32) * self.weight) @ self.project)
        similar = np.round((x @ self.vectors.T).astype(np.float64), 5)
        k = min(voters, similar.shape[1])
        near = np.argsort(-similar, axis=1, kind="stable")[:, :k] if similar.shape[1] <= 64 else self._nearest(similar, k)
        votes = np.maximum(np.take_along_axis(similar, near, axis=1), 0) ** SHARPNESS
        total = votes.sum(axis=1)
        return np.where(total > 0, (votes * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), self.prior)

    @staticmethod
    def _nearest(similar: np.ndarray, k: int) -> np.ndarray:
        """Places of the k largest of each row, earlier ones first among equals."""
        key = similar - np.arange(similar.shape[1]) * 1e-10
        return np.argpartition(-key, k - 1, axis=1)[:, :k]


def training_terms(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """Terms and labels of at most ``per_class`` labelled texts of each class, chosen by a hash of their ids.

    Only ids outside the held-out fold are used. Labels that are null, or that
    contradict each other for one id, are left out. What reaches the driver is
    bounded by the parameter: the term counts that are not zero, never texts.
    """
    clean = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality").where(~held_out(F.col("doc_id")))
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    some = None
    for value in (0, 1):
        one = clean.where(F.col("quality") == value).orderBy(order).limit(per_class).select("doc_id", "quality")
        some = one if some is None else some.unionAll(one)
    # At most 2 * per_class rows.
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("quality").cast("int"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for text in batch.column(1):
                row = terms(text_bytes(text.as_py())).astype(np.float32)
                at = np.flatnonzero(row).astype(np.uint16)
                places.append(at.tobytes())
                values.append(row[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "quality", "places", "values"])

    got = chosen.mapInArrow(read, "doc_id long, quality int, places binary, values binary").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    counts = np.zeros((got.num_rows, TERMS), np.float32)
    for k, (at, value) in enumerate(zip(got["places"], got["values"], strict=True)):
        counts[k, np.frombuffer(at.as_py(), np.uint16)] = np.frombuffer(value.as_py(), np.float32)
    return counts, np.array(got["quality"].to_pylist(), np.float64)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with held_out, score and predicted.

    Texts become damped term shares (words and character trigrams, hashed to
    ``BITS`` bits each, and four word shapes), weighted by rarity among the labelled
    ones, and points of a latent space. The labelled vectors, at most 2 * ``per_class``, are broadcast; every
    document's cosine with each of them is computed in blocks, and the nearest
    vote. Null and empty texts stand at the origin, near nothing, and get the
    share of label 1 among the learned rows. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    kept = docs.drop("held_out", "score", "predicted")
    space = LatentSpace(*training_terms(train_docs if train_docs is not None else docs, labels, per_class))
    shared = spark.sparkContext.broadcast(space)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            out = np.zeros(len(texts))
            for at in range(0, len(texts), BLOCK):
                block = [terms(text_bytes(t.as_py())) for t in texts.slice(at, BLOCK)]
                out[at : at + BLOCK] = shared.value.scores(np.stack(block))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    scored = kept.mapInArrow(read, f"{fields}, score double")
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= 0.5).cast("int")})


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
