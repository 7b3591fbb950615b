"""Packing of token sequences by best-fit decreasing."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes
from .wordpiece import byte_vocabulary

#: White-space characters in a row from which a run is cut apart; white space as the expression below knows it.
LONG_BLANK = 10_000
LONG_BLANK_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_BLANK)

#: Fixed value: how the vocabulary's makers cut a text before merging pairs.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class CapacityTree:
    """Open windows by remaining capacity, under a segment tree over the capacities.

    A node tells whether any capacity in its range has an open window, so the
    tightest window that takes ``need`` is found in log(capacity) steps.
    """

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.open = [0] * (2 * self.base)
        self.held: list[list[int]] = [[] for _ in range(self.base)]

    def _add(self, capacity: int, step: int) -> None:
        node = capacity + self.base
        while node:
            self.open[node] += step
            node >>= 1

    def put(self, capacity: int, which: int) -> None:
        if capacity:
            self.held[capacity].append(which)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) with the least capacity of at least ``need``."""
        node = need + self.base
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        capacity = node - self.base
        which = self.held[capacity].pop()
        self._add(capacity, -1)
        return capacity, which


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window, offset) of each of ``lengths``, longest first into the tightest open window."""
    tree, out, n = CapacityTree(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (found := tree.take(lengths[i])) is None:
            found, n = (window, n), n + 1
        capacity, which = found
        out[i] = which, window - capacity
        tree.put(capacity - lengths[i], which)
    return out


class ByteTokenizer:
    """The byte-level BPE of a tokenizer file, for texts of any kind.

    Added tokens in texts are their own ids with ``added``, else ordinary text. A
    run of white space from ``LONG_BLANK`` characters on is taken out of the text
    before the expression that cuts pieces sees it, which would go back over it
    character by character: by ``PIECES`` the run, less a last character that
    something else follows, is one piece.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])} if added else {}
        ranks = {k: v for k, v in byte_vocabulary(path).items() if k != b"<|endoftext|>"}
        self.special = special
        self.parts = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.plain = tiktoken.Encoding("corpus", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def _ordinary(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for run in LONG_BLANK_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.plain.encode_ordinary(text[at : run.start()])
            ids += self.plain._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.plain.encode_ordinary(text[at:])

    def encode(self, text: str) -> list[int]:
        if self.parts is None:
            return self._ordinary(text)
        ids: list[int] = []
        at = 0
        for token in self.parts.finditer(text):
            ids += self._ordinary(text[at : token.start()])
            ids.append(self.special[token.group()])
            at = token.end()
        return ids + self._ordinary(text[at:])


def token_pieces(docs: DataFrame, path: str, window: int, end_id: int, added: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut in full windows and a rest: doc_id, start, length, ids_crc32, doc_tokens.

    Map-only: ids never leave the worker, only lengths and check sums do.
    """
    made: list = []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(ByteTokenizer(path, added))
        for batch in batches:
            docs_at, start, length, crc, total = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.array([*made[0].encode(text_bytes(value.as_py()).decode("utf-8", "replace")), end_id], "<u4")
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    docs_at.append(i)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs_at, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


#: Pieces packed together in a worker's memory.
BLOCK = 200_000


def pack(pieces: DataFrame, window: int = 2048, parts: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset: each sequence gapless from 0 and at most ``window`` long.

    Pieces are dealt and ordered by a hash of (doc_id, start, check sum), so that
    no source is hot and a repeated task gives the same sequences; only lengths
    and ids move. Each run of ``BLOCK`` pieces is packed best-fit decreasing in
    bounded memory; its few half-empty windows weigh little.
    """
    parts = parts or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        rows, first = 0, TaskContext.get().partitionId() << 40

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            mine = pa.Table.from_batches(held)
            placed = best_fit(mine["length"].to_pylist(), window)
            ids = np.array([w for w, _ in placed], np.int64) + first
            first = int(ids.max()) + 1
            out = mine.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array([o for _, o in placed], pa.int64()))
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                yield from packed()
                held, rows = [], 0
        if rows:
            yield from packed()

    dealt = pieces.select(*names, F.xxhash64("doc_id", "start", "ids_crc32").alias("h")).repartition(parts, "h").sortWithinPartitions("h", "doc_id", "start", "ids_crc32")
    return dealt.select(*names).mapInArrow(fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, added: bool = False) -> DataFrame:
    """Documents as pieces of packed sequences.

    Null and empty texts are one piece holding the end id alone. Repeated rows
    each get pieces of their own. With ``added``, added tokens in a text are their
    own ids, as ``tokenizers`` gives it by default.
    """
    return pack(token_pieces(docs, path, window, end_id, added), window)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)
