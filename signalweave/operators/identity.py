"""Publication identity: keys, conflicts, links, earliest versions, families."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalweave.operators.components import components
from signalweave.storage import Scratch, hot_join


def effective_date(day: Column, precision: Column, imprecise: Column) -> Column:
    """Year-only dates and placeholders stand for that year's last day."""
    return F.when((precision == "year") | F.coalesce(imprecise, F.lit(False)), F.make_date(F.year(day), F.lit(12), F.lit(31))).otherwise(day)


def imprecise_date(day: Column, source: Column, declared: list[str]) -> Column:
    """1 January is a placeholder only for sources declared so."""
    return (F.date_format(day, "MM-dd") == "01-01") & source.isin(declared)


def identifier_lookup(incoming: DataFrame, known: DataFrame, priority: list[str]) -> DataFrame:
    """(record, work): each incoming record's work by its best identifier kind; of equals the smallest work.

    Both sides have kind and value; incoming has record, known has work. An
    identifier that several works have brings its smallest one only, so records
    are never multiplied.
    """
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("kind"))
    smallest = known.where(rank > 0).groupBy("kind", "value").agg(F.min("work").alias("work"))
    met = incoming.where(rank > 0).join(smallest, ["kind", "value"])
    return met.groupBy("record").agg(F.min(F.struct(rank.alias("rank"), F.col("work"))).alias("best")).select("record", "best.work")


def title_author_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(record, work): the smallest work with the same title key and a shared author key.

    Blocked where both have publisher DOIs, or both have arXiv ids, and none is
    shared. Columns: record or work, title_key, authors, dois, arxiv_ids.
    """
    # Records with the same title, authors' key and identifiers fare alike: the smallest work of each such kind stands for it.
    ids = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array()))).alias(c)
    kinds = ["title_key", "author", "dois", "arxiv_ids"]
    each = lambda d, c: d.where("title_key is not null").select(c, "title_key", F.explode(F.array_distinct("authors")).alias("author"), ids("dois"), ids("arxiv_ids")).where("author is not null")
    mine = each(left, "record")
    b = each(right, "work").groupBy(*kinds).agg(F.min("work").alias("work")).alias("b")
    a = mine.select(*kinds).distinct().alias("a")
    apart = lambda c: (F.size(f"a.{c}") > 0) & (F.size(f"b.{c}") > 0) & ~F.arrays_overlap(f"a.{c}", f"b.{c}")
    met = a.join(b, (F.col("a.title_key") == F.col("b.title_key")) & (F.col("a.author") == F.col("b.author"))).where(~apart("dois") & ~apart("arxiv_ids"))
    best = met.groupBy(*(F.col(f"a.{c}").alias(c) for c in kinds)).agg(F.min("b.work").alias("work"))
    return mine.join(best, kinds).groupBy("record").agg(F.min("work").alias("work"))


def doi_conflicts(claims: DataFrame) -> DataFrame:
    """DOIs claimed in conflict: (doi, distinct_arxiv_ids, conflicting_titles, inconsistent_arxiv_doi).

    ``claims``: doi, title_key, authors (array), arxiv_id (nullable). Titles conflict
    if two different ones have author sets without a common name. A title's
    author sets are kept distinct, so a much-claimed DOI stays small.
    """
    claims = claims.where("doi is not null")
    ids = claims.groupBy("doi").agg(F.array_sort(F.collect_set("arxiv_id")).alias("ids"))
    named = claims.where("title_key <> '' and size(authors) > 0").select("doi", "title_key", F.array_sort(F.array_distinct("authors")).alias("authors")).distinct()
    a, b = named.alias("a"), named.alias("b")
    split = a.join(b, (F.col("a.doi") == F.col("b.doi")) & (F.col("a.title_key") < F.col("b.title_key"))).where(~F.arrays_overlap("a.authors", "b.authors")).select(F.col("a.doi").alias("doi")).distinct().withColumn("conflicting_titles", F.lit(True))
    t = ids.join(split, "doi", "left").withColumn("own", F.regexp_extract("doi", r"^10\.48550/arxiv\.(.+)$", 1))
    out = t.select("doi", (F.size("ids") > 1).alias("distinct_arxiv_ids"), F.coalesce("conflicting_titles", F.lit(False)).alias("conflicting_titles"), ((F.col("own") != "") & (F.size("ids") > 0) & ~F.array_contains("ids", F.col("own"))).alias("inconsistent_arxiv_doi"))
    return out.where("distinct_arxiv_ids or conflicting_titles or inconsistent_arxiv_doi")


def canonical_works(versions: DataFrame, work: str, day: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row a work: earliest day, and each field's first known value in order. All are combinable."""
    place = F.struct(*order)
    filled = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields]
    return versions.groupBy(work).agg(F.min(day).alias(day), F.count("*").alias("versions"), *filled)


def canonical_text(records: DataFrame, work: str, eligible: Column, day: str, record: str) -> DataFrame:
    """The text row that stands for a work: eligible ones first, latest revision, lowest record."""
    order = W.partitionBy(work).orderBy(F.when(eligible, 0).otherwise(1), F.when(eligible, F.col(day)).desc_nulls_last(), record)
    return records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def teams(works: DataFrame, work: str, authors: str, organisations: str, jaccard: float = 0.5, coverage: float = 0.8) -> DataFrame:
    """(topic, teams): groups of a topic's works that share an organisation or half of their authors.

    Null under ``coverage`` of works with known authors. Works meet on authors and
    organisations, never in all pairs: each shared organisation links its works
    to the smallest of them; author pairs come from shared names.
    """
    scratch = Scratch(works.sparkSession, "teams")
    t = works.withColumn("node", F.concat_ws(":", F.col("topic").cast("string"), F.col(work).cast("string")))
    shared = scratch.save(t.select("topic", "node", F.explode(organisations).alias("o")), "shared")
    least = scratch.save(shared.groupBy("topic", "o").agg(F.min("node").alias("dst"), F.count("*").alias("n")), "least")
    org = hot_join(shared, least, ["topic", "o"], "n").select(F.col("node").alias("src"), "dst")
    name = t.select("topic", "node", F.size(F.array_distinct(authors)).alias("n"), F.explode(F.array_distinct(authors)).alias("a")).distinct()
    a, b = name.alias("a"), name.alias("b")
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.a") == F.col("b.a")) & (F.col("a.node") < F.col("b.node"))).groupBy(F.col("a.node").alias("src"), F.col("b.node").alias("dst"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("both"))
    alike = pairs.where(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) >= jaccard).select("src", "dst")
    alone = t.where(F.size(authors) > 0).select(F.col("node").alias("src"), F.col("node").alias("dst"))
    parts = components(org.unionByName(alike).unionByName(alone), scratch)
    known = t.groupBy("topic").agg((F.count_if(F.size(authors) > 0) / F.count("*")).alias("coverage"))
    n = t.join(parts, "node").groupBy("topic").agg(F.count_distinct("component").alias("n"))
    return known.join(n, "topic", "left").select("topic", F.when(F.col("coverage") >= coverage, F.coalesce("n", F.lit(0))).alias("teams"))


def sequence_ratio(pairs: DataFrame, left: str, right: str, out: str = "ratio") -> DataFrame:
    """Ratcliff-Obershelp similarity of two columns; Spark's Levenshtein is another measure, so this is one Arrow step."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (left, right))
            ratio = [None if a is None or b is None else SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio, pa.float64())], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(read, f"{fields}, {out} double")


def version_families(works: DataFrame, ratio: float = 0.97, days: int = 730) -> DataFrame:
    """(work, family): works of one title key, at most ``days`` apart, with a common DOI or nearly equal abstracts.

    Columns: work, title_key, day, doi, abstract. Equal abstracts are linked
    without comparing; only different ones inside a title are measured.
    """
    scratch = Scratch(works.sparkSession, "families")
    a, b = works.alias("a"), works.alias("b")
    near = (F.col("a.title_key") == F.col("b.title_key")) & (F.col("a.work") < F.col("b.work")) & (F.abs(F.datediff("a.day", "b.day")) <= days)
    met = a.join(b, near).select(F.col("a.work").alias("src"), F.col("b.work").alias("dst"), F.col("a.doi").eqNullSafe(F.col("b.doi")).alias("same_doi"), F.col("a.doi").alias("doi"), F.col("a.abstract").alias("x"), F.col("b.abstract").alias("y"))
    sure = (F.col("same_doi") & F.col("doi").isNotNull()) | (F.col("x") == F.col("y"))
    measured = sequence_ratio(met.where(~F.coalesce(sure, F.lit(False))).select("src", "dst", "x", "y"), "x", "y").where(F.col("ratio") >= ratio)
    edges = met.where(sure).select("src", "dst").unionByName(measured.select("src", "dst"))
    own = works.select(F.col("work").alias("src"), F.col("work").alias("dst"))
    return components(edges.unionByName(own), scratch).select(F.col("node").alias("work"), F.col("component").alias("family"))


def lineage_families(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic, family): saved topics that lineage joins, directly or over others, named by the smallest; nothing is claimed of their subject.

    ``topics``: topic; ``edges``: left, right. An edge that leaves the frozen set
    raises. Nulls are no topics and no ends.
    """
    scratch = Scratch(topics.sparkSession, "lineage")
    frozen = scratch.save(topics.where("topic is not null").select("topic").distinct(), "frozen")
    ends = scratch.save(edges.where("left is not null and right is not null").select("left", "right").distinct(), "ends")
    named = ends.select(F.explode(F.array("left", "right")).alias("topic")).distinct()
    if outside := named.join(frozen, "topic", "left_anti").count():
        raise ValueError(f"lineage names {outside} topics outside the frozen set")
    own = frozen.select(F.col("topic").alias("src"), F.col("topic").alias("dst"))
    return components(ends.select(F.col("left").alias("src"), F.col("right").alias("dst")).unionByName(own), scratch).select(F.col("node").alias("topic"), F.col("component").alias("family"))


def material_groups(items: DataFrame, links: DataFrame, conflict: str) -> DataFrame:
    """(item, component, accepted): components over keys and declared relations; any conflicting value rejects a whole component.

    ``items``: item, keys (array) and the column ``conflict``; ``links``: src, dst items.
    """
    scratch = Scratch(items.sparkSession, "materials")
    each = scratch.save(items.select("item", F.explode("keys").alias("key")).where("key is not null"), "each")
    least = scratch.save(each.groupBy("key").agg(F.min("item").alias("dst"), F.count("*").alias("n")), "least")
    keyed = hot_join(each, least, ["key"], "n").select(F.col("item").alias("src"), "dst")
    own = items.select(F.col("item").alias("src"), F.col("item").alias("dst"))
    parts = components(keyed.unionByName(links.select("src", "dst")).unionByName(own), scratch).withColumnRenamed("node", "item")
    bad = items.join(parts, "item").groupBy("component").agg((F.count_distinct(conflict) <= 1).alias("accepted"))
    return parts.join(bad, "component").select("item", "component", "accepted")


def cross_links(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidate links by DOI or title key with their evidence: confirmed, probable or review.

    Columns of both: id, doi, title_key, authors, year.
    """
    x, y = a.alias("x"), b.alias("y")
    columns = [F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.coalesce(F.col("x.doi") == F.col("y.doi"), F.lit(False)).alias("same_doi"), (F.col("x.title_key") == F.col("y.title_key")).alias("same_title"), F.arrays_overlap("x.authors", "y.authors").alias("shared_author"), F.abs(F.col("x.year") - F.col("y.year")).alias("years_apart")]
    same_doi, same_title = F.col("x.doi") == F.col("y.doi"), F.col("x.title_key") == F.col("y.title_key")
    # A pair that both keys join comes from the DOI alone, so pairs of unique ids need no shuffle to be distinct.
    met = x.join(y, same_doi).select(*columns).union(x.join(y, same_title & ~F.coalesce(same_doi, F.lit(False))).select(*columns))
    if any(d.groupBy("id").count().where("count > 1").limit(1).count() for d in (a, b)):
        met = met.distinct()
    status = F.when(F.col("same_doi") & F.col("same_title"), "confirmed").when(F.col("same_title") & F.coalesce("shared_author", F.lit(False)) & (F.col("years_apart") <= 2), "probable").otherwise("review")
    return met.withColumn("status", status)


def arxiv_identity(doi: Column, links: Column) -> Column:
    """struct(id, linked, conflict): the DOI's arXiv id wins, else the only one that links name; others are a conflict, not a choice."""
    primary = F.nullif(F.regexp_extract(F.lower(F.coalesce(doi, F.lit(""))), r"^(?:https?://(?:dx\.)?doi\.org/)?10\.48550/arxiv\.(\d{4}\.\d{4,5})$", 1), F.lit(""))
    named = F.transform(F.coalesce(links, F.array().cast("array<string>")), lambda u: F.regexp_extract(F.lower(u), r"^https?://(?:www\.|export\.)?arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?/?$", 1))
    linked = F.array_sort(F.array_distinct(F.filter(named, lambda x: x != "")))
    chosen = F.coalesce(primary, F.when(F.size(linked) == 1, linked[0]))
    conflict = F.when(primary.isNotNull(), F.size(F.array_except(linked, F.array(primary))) > 0).otherwise(F.size(linked) > 1)
    return F.struct(chosen.alias("id"), linked.alias("linked"), conflict.alias("conflict"))
