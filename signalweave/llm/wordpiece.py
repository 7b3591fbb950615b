"""Token counts by a linear longest-match automaton: a vocabulary trie with failure links and popped-token counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import _slices
from .common import table


def byte_alphabet() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: visible bytes stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in out.values())}


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to id from a tokenizer file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    return {bytes(map(alphabet.__getitem__, k)): v for k, v in vocab.items() if all(c in alphabet for c in k)}


class LongestMatch:
    """Greedy word-piece counts in time linear in the word.

    Two roots share one trie: pieces that begin a word, and pieces that go on.
    A node's failure link leads to where matching resumes once the pieces that
    its string certainly begins with are popped; ``popped`` is their number, so
    that counting adds integers and builds no piece.
    """

    def __init__(self, initial: set[bytes], inner: set[bytes]):
        children: list[dict[int, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, words in ((0, initial), (1, inner)):
            for word in words:
                node = root
                for c in word:
                    if (to := children[node].get(c)) is None:
                        to = children[node][c] = len(children)
                        children.append({})
                        ends.append(False)
                    node = to
                if word:
                    ends[node] = True
        self.children, self.link, self.popped = children, [-1] * len(children), [0] * len(children)
        level = [(u, c, v) for u in (0, 1) for c, v in children[u].items()]
        while level:
            below = []
            for u, c, v in level:
                below += [(v, k, w) for k, w in children[v].items()]
                if ends[v]:
                    self.link[v], self.popped[v] = 1, 1
                    continue
                z, popped = self.link[u], self.popped[u]
                while z >= 0 and c not in children[z]:
                    popped += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = children[z][c], popped
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of one word; -1 if some part has no piece."""
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for c in word:
            while (to := children[node].get(c)) is None:
                total += popped[node]
                if (node := link[node]) < 0:
                    return -1
            node = to
        while node > 1:
            total += popped[node]
            if (node := link[node]) < 0:
                return -1
        return total


#: Words kept with their counts in each Python worker; then the memory starts anew.
MEMORY_WORDS = 400_000


def token_counts(docs: DataFrame, vocabulary: str, marker: bytes = b" ") -> DataFrame:
    """Greedy word-piece lengths of whole texts: doc_id, n_words, n_tokens, n_unknown, max_word_tokens.

    ``vocabulary`` is the path of a byte-level tokenizer file; pieces that begin
    with ``marker`` begin words, all others go on. Words are runs of bytes other
    than ASCII white space. A word without pieces counts as one unknown token.
    Null and empty texts count 0. Map-only; texts are read in slices, equal words
    are matched once a worker.
    """
    made: list[LongestMatch] = []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            tokens = byte_vocabulary(vocabulary)
            made.append(LongestMatch({t[len(marker) :] for t in tokens if t.startswith(marker)} | {t for t in tokens if len(t) == 1}, {t for t in tokens if not t.startswith(marker)}))
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for value in batch.column(1):
                words = tokens = unknown = longest = 0
                # Slices end between words, so that no list of a whole text's words is made.
                for part in _slices(value.as_buffer()) if value.is_valid else ():
                    counts = []
                    for word in part.split():
                        if (n := known.get(word)) is None:
                            n = made[0].count(word)
                            if len(word) <= 64:
                                if len(known) >= MEMORY_WORDS:
                                    known.clear()
                                known[word] = n
                        counts.append(n)
                    missed = counts.count(-1)
                    words, tokens, unknown = words + len(counts), tokens + sum(counts) + 2 * missed, unknown + missed
                    longest = max(longest, max(map(abs, counts), default=0))
                rows.append((words, tokens, unknown, longest))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_tokens", "n_unknown", "max_word_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(read, "doc_id long, n_words long, n_tokens long, n_unknown long, max_word_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
