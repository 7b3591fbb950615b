"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept and returns the columns of
``documents``; the last returns pieces of sequences. Between stages rows are
written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.llm import decontaminate, neardup, packing, quality, suffix
from signalweave.llm.common import Scratch, broadcast_if_small, table, text_hash

#: Ids up to which the documents to leave out are broadcast.
BROADCAST_IDS = 1_000_000
#: Words of a repeated passage that goes ("over 50"); bytes under which such a passage is met by its hash (about one in
#: a hundred has fewer, in any of the four languages); parts of a run, so that two rounds settle the rest.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_FAN = 51, 245, 14


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less those whose id and text are in ``gone`` (doc_id, text_hash); another text of the same id stays."""
    out = broadcast_if_small(gone.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")).distinct(), BROADCAST_IDS)
    return docs.join(out, docs.doc_id.eqNullSafe(out["_doc"]) & (text_hash(docs.text) == out["_text"]), "left_anti").select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates; of equal rows, one.

    Texts of one id that are no near-duplicates all stay; of several that are, one.
    """
    scratch = Scratch(spark, "pipeline")
    kept = _without(docs, scratch.save(neardup.near_duplicates(docs).where("not stays").select("doc_id", "text_hash"), "copies"))
    again = scratch.save(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return kept
    twice = broadcast_if_small(again, BROADCAST_IDS)
    same = kept.doc_id.eqNullSafe(twice.doc_id)
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of over 50 words (or op7's 400 bytes); those of which nothing is left go."""
    cut = suffix.repeated_text(docs, PASSAGE_BYTES, fan=PASSAGE_FAN, want_text=True, words=PASSAGE_WORDS)
    out = cut.where("n_removed = 0 or trim(kept_text) <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return out.withColumn("n_chars", size).withColumn("text", text).select(*docs.columns)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    scratch = Scratch(spark, "pipeline")
    return _without(docs, scratch.save(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_hash"), "leaks"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", different),
    ("suffix-array dedup", unrepeated),
    ("benchmark decontamination", unleaked),
    ("packing", packed),
]

#: The classifier learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage_{k}")
    return docs
