"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, table, text_hash

#: Words of a benchmark window; words that one row of the index spans.
WINDOW, BLOCK = 10, 2048
#: Benchmark words up to which the vocabulary is written into the plan; beyond, it is joined.
PLAN_WORDS = 50_000
#: Window starts and words up to which benchmark tables are broadcast; beyond, their joins shuffle.
BROADCAST_ROWS = 500_000

#: Fixed value: what parts words. Digits, letters and everything outside ASCII belong to words.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text after A-Z are lowered; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), PARTS), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, version, first, size, terms): each window of ``window`` words, or the whole of a shorter item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    cut = items.withColumn("size", F.least(F.size("w"), F.lit(window))).withColumn("first", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
    return cut.select("item_id", F.xxhash64("w").alias("version"), "first", "size", F.slice("w", F.col("first") + 1, F.col("size")).alias("terms"))


def _blocks(docs: DataFrame, window: int, block: int) -> DataFrame:
    """Documents' words in blocks that overlap by a window less one: (doc_id, n_words, base, w)."""
    whole = docs.select("doc_id", words(F.col("text")).alias("all")).withColumn("n_words", F.size("all"))
    base = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_words") - 1), F.lit(block)))
    return whole.withColumn("base", base).select("doc_id", "n_words", "base", F.slice("all", F.col("base") + 1, F.lit(block + window - 1)).alias("w"))


#: Bits of a place in a block; the other 52 of a posting's 64 are the word's code.
PLACE_BITS = 12


def _code(word: Column, salt: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), word), PLACE_BITS)


def postings(docs: DataFrame, vocabulary: DataFrame, salt: int, window: int = WINDOW, block: int = BLOCK, plan_words: int = PLAN_WORDS) -> DataFrame:
    """The index, partitioned by document: (doc_id, n_words, base, pos, code), one row a block.

    ``pos`` and ``code`` hold the places in the block and the codes of the words
    that are in ``vocabulary`` (word). A vocabulary of up to ``plan_words`` is a
    hash set in the plan; a larger one is joined with the words instead, by
    broadcast up to ``BROADCAST_ROWS`` words.
    """
    blocks = _blocks(docs, window, block)
    known = [r[0] for r in vocabulary.limit(plan_words + 1).collect()]
    if len(known) <= plan_words:
        hit = F.filter(F.transform("w", lambda w, i: F.when(w.isin(known), F.struct(i.alias("i"), _code(w, salt).alias("c")))), lambda x: x.isNotNull()) if known else F.array().cast("array<struct<i:int,c:bigint>>")
        found = blocks.select("doc_id", "n_words", "base", hit.alias("hit"))
        return found.select("doc_id", "n_words", "base", F.col("hit.i").alias("pos"), F.col("hit.c").alias("code"))
    each = blocks.select("doc_id", "base", F.posexplode("w").alias("i", "word"))
    kept = each.join(_spread(vocabulary), "word").select("doc_id", "base", F.struct("i", _code(F.col("word"), salt).alias("c")).alias("x"))
    per = kept.groupBy("doc_id", "base").agg(F.sort_array(F.collect_list("x")).alias("hit"))
    no_place, no_code = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    joined = blocks.drop("w").alias("b").join(per.alias("p"), F.col("b.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("b.base") == F.col("p.base")), "left")
    return joined.select("b.doc_id", "b.n_words", "b.base", F.coalesce("hit.i", no_place).alias("pos"), F.coalesce("hit.c", no_code).alias("code"))


def _spread(of_benchmark: DataFrame) -> DataFrame:
    """The benchmark's side of a join: broadcast if its count allows, else sort-merged, where adaptive execution splits a very common word's rows."""
    return F.broadcast(of_benchmark) if of_benchmark.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else of_benchmark.hint("merge")


def _salt(vocabulary: DataFrame) -> int:
    """A salt under which no two vocabulary words share a code: with 52 bits the first one, but for a chance of 1 in 90 at ten million words."""
    n, salt = vocabulary.count(), 0
    while vocabulary.select(_code(F.col("word"), salt).alias("c")).distinct().count() < n:
        salt += 1
    return salt


def _place(pos: Column, code: Column) -> Column:
    """A posting as one number: code, then place; no posting has a place outside the block."""
    inside = pos.between(0, (1 << PLACE_BITS) - 1)
    return F.when(inside, F.shiftleft(code, PLACE_BITS).bitwiseOR(pos.cast("long"))).otherwise(F.lit(-1).cast("long"))


def matches(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, block: int = BLOCK, gap: int = 0, plan_words: int = PLAN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words of each document; doc_id, at, size, item_id, first, exact of each match).

    A window's postings lists are met from its rarest word on: places of the
    rarest word give where the window would start; each next list, shifted by
    its word's offset, must hold that start. With ``gap`` 0 all lists must meet
    at one start (exact phrases); otherwise each word may stand up to ``gap``
    places off (proximity), and ``exact`` tells the two apart. Words' numbers in
    the corpus are counted over the whole index.
    """
    if block + window + gap >= 1 << PLACE_BITS:
        raise ValueError("a block and a window must fit the bits of a place")
    wins = scratch.save(benchmark_windows(benchmark, window), "windows")
    vocabulary = scratch.save(wins.select(F.explode("terms").alias("word")).distinct(), "vocabulary")
    salt = _salt(vocabulary)
    index = scratch.save(postings(docs, vocabulary, salt, window + gap, block, plan_words), "index")
    many = index.select(F.explode("code").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    coded = vocabulary.select(_code(F.col("word"), salt).alias("code"))
    rarity = scratch.save(coded.join(many, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n")), "rarity")
    places = wins.select("item_id", "version", "first", "size", F.posexplode("terms").alias("off", "word")).select("item_id", "version", "first", "size", "off", _code(F.col("word"), salt).alias("code")).join(rarity, "code")
    ordered = places.groupBy("item_id", "version", "first", "size").agg(F.sort_array(F.collect_list(F.struct("n", "code", "off"))).alias("t")).where("t[0].n > 0")
    # Windows that share their rarest word's place in the item share its postings.
    seed = F.struct("first", "size", F.transform(F.slice("t", 2, window), lambda x: F.struct((F.col("first") + x["off"]).alias("off"), x["code"].alias("code"))).alias("rest"))
    seeds = ordered.groupBy("item_id", "version", F.col("t")[0]["code"].alias("code"), (F.col("first") + F.col("t")[0]["off"]).alias("item_at")).agg(F.collect_list(seed).alias("wins"))
    seeds = scratch.save(seeds, "seeds")
    rare_codes = seeds.select("code").distinct()
    rare = [r[0] for r in rare_codes.limit(plan_words + 1).collect()]
    held = index.withColumn("p", F.zip_with("pos", "code", _place))
    first = F.filter(F.arrays_zip("pos", "code"), lambda x: x["code"].isin(rare)) if 0 < len(rare) <= plan_words else F.arrays_zip("pos", "code")
    each = held.withColumn("at", F.explode(first)).select("doc_id", "base", "p", F.col("at.pos").alias("pos"), F.col("at.code").alias("code"))
    met = each.join(_spread(seeds), "code").withColumn("diag", F.col("pos") - F.col("item_at"))

    def near(off: Column, code: Column, within: int) -> Column:
        there = F.array_contains("p", _place(F.col("diag") + off, code))
        for g in range(1, within + 1):
            there = there | F.array_contains("p", _place(F.col("diag") + off + g, code)) | F.array_contains("p", _place(F.col("diag") + off - g, code))
        return there

    def fits(within: int):
        return lambda w: F.forall(w["rest"], lambda r: near(r["off"], r["code"], within))

    hit = met.withColumn("w", F.explode(F.filter("wins", fits(gap))))
    exact = F.lit(True) if not gap else fits(0)(F.col("w"))
    start = F.col("base") + F.col("diag") + F.col("w.first")
    found = hit.select("doc_id", start.alias("at"), F.col("w.size").alias("size"), "item_id", F.col("w.first").alias("first"), exact.alias("exact"))
    return index.where("base = 0").select("doc_id", "n_words"), found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, plan_words: int = PLAN_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    A word inside any occurrence of a window is hit. Null and empty texts have
    no words; an empty benchmark hits nothing; benchmark items without words, or
    repeated ones, add nothing. A row comes for each row of ``docs``; different
    texts of one doc_id are judged apart and told by ``text_hash``.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    sizes, found = matches(docs.select(F.struct(F.col("doc_id").alias("doc_id"), text_hash(F.col("text")).alias("text_hash")).alias("doc_id"), "text"), benchmark.select("item_id", "text"), scratch, window, block, plan_words=plan_words)
    found = scratch.save(found.select("doc_id", "at", "size", "item_id").distinct(), "found")
    sizes = scratch.save(sizes, "sizes")
    scratch.keep("found", "sizes")
    covered = found.select("doc_id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("place")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    items = found.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    per = covered.alias("c").join(items.alias("i"), F.col("c.doc_id").eqNullSafe(F.col("i.doc_id"))).select("c.doc_id", "n_hit", "items")
    joined = sizes.alias("s").join(per.alias("p"), F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")), "left")
    return joined.select(
        F.col("s.doc_id.doc_id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.col("s.doc_id.text_hash").alias("text_hash"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win
), occ AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), hit AS (
  SELECT o.doc_id, o.i, o.n, win.item_id FROM occ o JOIN win USING (n, k)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
