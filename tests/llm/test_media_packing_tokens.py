"""Round trips of media, packing and token counts."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalweave.llm import media, packing, wordpiece

SCHEMA = "doc_id long, text string"
P = pytest.importorskip("public_tokenizers")
TEXTS = [(1, "hello world, the quick brown fox"), (2, None), (3, ""), (4, "é" * 5000), (5, "a b " * 3000), (6, "hello world, the quick brown fox"), (None, "x\ty\nz 123 <|endoftext|>")]


@given(st.binary(max_size=4000))
@settings(max_examples=60, deadline=None)
def test_payload_round_trip(raw):
    padded = raw + media.PAD * (max(1, -(-len(raw) // media.UNIT)) * media.UNIT - len(raw))
    assert media.decode(media.store(padded)).tobytes() == padded


def test_formats():
    r = np.random.default_rng(1)
    grey, colour = r.integers(0, 256, (5, 7), np.uint8), r.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_netpbm(grey)) == grey).all()
    assert (media.decode(media.encode_netpbm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert media.decode(b"P1 # note\n3 2\n1 0 1\n0 1 0").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P2\n2 1\n255\n7 250\n").tolist() == [[7, 250]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]
    assert media.decode(b"P5 2 1 65535\n\x01\x00\x00\x02").tolist() == [[256, 2]]
    with pytest.raises(ValueError):
        media.decode(b"P9 nothing")


def test_area_resize_is_the_exact_mean():
    image = np.random.default_rng(2).random((12, 10))
    small = media.area_resize(image, 4, 5)
    assert np.allclose(small, image.reshape(4, 3, 5, 2).mean(axis=(1, 3)))
    # Fractional cells: every source pixel is spread over 9 x 8 subpixels.
    fine = np.kron(image, np.ones((8, 9)))
    assert np.allclose(media.area_resize(image, 8, 9), fine.reshape(8, 12, 9, 10).mean(axis=(1, 3)))


def test_media_rows(spark):
    df = spark.createDataFrame([(*t, 0) for t in TEXTS], SCHEMA + ", feature int")
    got = {r.doc_id: r for r in media.media_payloads(df).collect()}
    for i, t in TEXTS:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert got[1][1:] == got[6][1:] and got[2][1:] == got[3][1:]
    images = spark.createDataFrame([(1, media.encode_bmp(np.zeros((4, 4, 3), np.uint8))), (2, b"junk"), (3, None)], "id int, media binary")
    tiles = {r.id: r for r in media.media_tiles(images).collect()}
    assert tiles[2].tiles is None and tiles[3].dhash is None and np.load(io.BytesIO(tiles[1].tiles[0].npy)).shape == (16, 16)
    assert media.media_payloads(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_fit_finds_the_tightest_window():
    r = random.Random(3)
    lengths = [r.randrange(1, 65) for _ in range(500)]
    placed = packing.best_fit(lengths, 64)
    free, want = {}, [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(c, w) for w, c in free.items() if c >= lengths[i]]
        best = min(fits)[0] if fits else None
        want[i] = best
        w, offset = placed[i]
        assert (free.get(w, 64) if best is None else free[w]) == (64 if best is None else best)
        assert offset == 64 - free.get(w, 64)
        free[w] = free.get(w, 64) - lengths[i]


def test_packed_documents_hold_each_id_once(spark):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = packing.packed_documents(spark.createDataFrame(TEXTS, SCHEMA), P.path("byte_bpe_50k.json"), 256).collect()
    for i, t in TEXTS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in mine) and sum(r.length for r in mine) == len(ids)
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_the_query_gives_the_added_token_its_id(spark, tmp_path):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*TEXTS, (7, "x <|endoftext|> y"), (8, "<|endoftext|><|endoftext|>"), (9, "a<|endoftext|>\n b <|endoftext| >")]
    spark.createDataFrame(texts, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in packing.op3_packing(spark, str(tmp_path)).collect() if r.start == 0}
    assert tok.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].doc_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids[:2048], "<u4").tobytes()))


def greedy(word, initial, inner):
    n = at = 0
    while at < len(word):
        known = inner if at else initial
        for end in range(len(word), at, -1):
            if word[at:end] in known:
                break
        else:
            return -1
        at, n = end, n + 1
    return n


@given(st.sets(st.text("ab", min_size=1, max_size=5).map(str.encode)), st.sets(st.text("ab", min_size=1, max_size=5).map(str.encode)), st.lists(st.text("abc", max_size=14).map(str.encode)))
@settings(max_examples=200, deadline=None)
def test_longest_match_is_greedy(initial, inner, words):
    automaton = wordpiece.LongestMatch(initial, inner)
    for w in words:
        assert automaton.count(w) == greedy(w, initial, inner)


def test_token_counts(spark):
    got = {r.doc_id: r for r in wordpiece.token_counts(spark.createDataFrame(TEXTS, SCHEMA), P.path("byte_bpe_50k.json")).collect()}
    tokens = wordpiece.byte_vocabulary(P.path("byte_bpe_50k.json"))
    initial = {t[1:] for t in tokens if t.startswith(b" ")} | {t for t in tokens if len(t) == 1}
    inner = {t for t in tokens if not t.startswith(b" ")}
    for i, t in TEXTS:
        words = (t or "").encode().split()
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(greedy(w, initial, inner) for w in words))


@pytest.mark.parametrize("text", ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x y" + "\t" * 2_000_000 + "<|endoftext|>" + " " * 300_000, "\t " * 600_000 + "1", "\x1c" + "　" * 20_000 + "\x1c \x00", "word" * 300_000])
def test_long_runs_have_the_tokenizer_s_ids(text):
    import tokenizers

    path = P.path("byte_bpe_50k.json")
    assert packing.ByteTokenizer(path, added=True).encode(text) == tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_token_counts_of_sliced_texts(spark):
    from signalweave.llm import audit

    rows = [(1, "one two  three\n" * 40), (2, "x" * 500 + " y"), (3, None), (4, " " * 300), (5, "é日 " * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = lambda: sorted(map(tuple, wordpiece.token_counts(docs, P.path("byte_bpe_50k.json")).collect()))
    whole = count()
    assert [r[1] for r in whole] == [len((t or "").split()) for _, t in rows]
    long = "slice of words " * 200_000
    (_, words, tokens, _, _), = map(tuple, wordpiece.token_counts(spark.createDataFrame([(9, long)], "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect())
    (_, few, some, _, _), = map(tuple, wordpiece.token_counts(spark.createDataFrame([(9, "slice of words")], "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect())
    assert len(long) > 2 * audit.SLICE and (words, tokens) == (200_000 * few, 200_000 * some)
