"""Metadata mirrors and their checks: projections, frozen subsets, inventories, sealed outputs, validators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.functions.text import bare_arxiv_id, clean_doi, collapse
from signalweave.sources import publications

#: Columns that a metadata mirror must have.
MIRROR = ["id", "title", "abstract", "categories", "doi", "versions", "authors_parsed"]
#: Forms of DOIs and of grant numbers by scheme, and the scheme of a funder.
DOI_FORM = r"(?i)^10\.\d{4,9}/[^\s]+$"
GRANTS = {"grant:US:NSF": r"^\d{6,10}$", "grant:GB:UKRI": r"^[A-Za-z]{1,5}/[A-Za-z0-9]{3,20}/\d{1,3}$", "grant:EU:EC": r"^\d{5,9}$"}
FUNDERS = {("NSF", "US"): "grant:US:NSF", ("UKRI", "GB"): "grant:GB:UKRI", ("EC", "EU"): "grant:EU:EC"}


def checked_mirror(rows: DataFrame) -> DataFrame:
    """The mirror's columns, if it has them all."""
    if missing := [c for c in MIRROR if c not in rows.columns]:
        raise ValueError(f"the mirror lacks {missing}")
    return rows.select(*MIRROR)


def mirror_records(rows: DataFrame) -> DataFrame:
    """Records of a metadata mirror: bare id, first and latest version's day, assembled author names, categories.

    Rows without an id or with a broken version history have ``valid`` false and
    no days: a first submission is never inferred.
    """
    bare, ok = bare_arxiv_id(F.col("id")), F.coalesce(publications.valid_history(F.col("versions")), F.lit(False))
    ordered = F.array_sort(F.transform("versions", lambda v: F.struct(F.regexp_extract(v["version"], r"v(\d+)", 1).cast("int").alias("n"), v["created"].alias("c"))))
    name = lambda a: F.concat_ws(" ", F.filter(F.transform(F.concat(F.slice(a, 2, 1), F.slice(a, 1, 1), F.slice(a, 3, 10)), F.trim), lambda p: p != ""))
    authors = F.transform(F.filter("authors_parsed", lambda a: F.trim(a[0]) != ""), name)
    valid = bare.isNotNull() & ok
    return rows.select(
        bare.alias("record"), valid.alias("valid"), F.when(valid, F.to_date(ordered[0]["c"])).alias("day"), F.when(valid, F.to_date(F.element_at(ordered, -1)["c"])).alias("revised"),
        "title", "abstract", F.split("categories", " +").alias("categories"), clean_doi(F.col("doi")).alias("doi"), authors.alias("authors"),
        F.when(F.size(authors) > 0, "parsed_names_only").otherwise("unresolved").alias("author_status"),
    )


def preprint_works(records: DataFrame) -> DataFrame:
    """Works from preprint records: collapsed texts, identifiers by kind, authors without organisations, kind preprint."""
    ids = F.array_compact(F.array(F.when(F.col("record").isNotNull(), F.struct(F.lit("arxiv").alias("kind"), F.col("record").alias("value"))), F.when(F.col("doi").isNotNull(), F.struct(F.lit("doi").alias("kind"), F.col("doi").alias("value")))))
    return records.select(collapse(F.coalesce("title", F.lit(""))).alias("title"), F.nullif(collapse(F.coalesce("abstract", F.lit(""))), F.lit("")).alias("abstract"), "day", F.year("day").alias("year"), ids.alias("identifiers"), "authors", F.lit("preprint").alias("version_kind"))


def selected(records: DataFrame, categories: list[str], plan: Column, since: str | None, until: str | None) -> DataFrame:
    """Valid records of any wanted category that match the plan and were first submitted in the inclusive period."""
    out = records.where("valid").where(plan)
    if categories:
        out = out.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    return out.where(f"day >= date'{since or '0001-01-01'}' and day <= date'{until or '9999-12-31'}'")


def reader(source: str, path: str) -> Callable[[SparkSession], DataFrame]:
    """The reader that a source's name and a file's ending choose."""
    known = {
        ("openalex", "json"): lambda s: publications.openalex_works(publications.openalex_pages(s, path)), ("arxiv", "xml"): lambda s: publications.atom_entries(s, path),
        ("arxiv", "parquet"): lambda s: mirror_records(checked_mirror(s.read.parquet(path))), ("html", "parquet"): lambda s: publications.html_records(s.read.parquet(path), "page_id", "html"),
    }
    key = (source, path.rstrip("/").rsplit(".", 1)[-1])
    if key not in known:
        raise ValueError(f"no reader for {key}")
    return known[key]


def id_inventory(listed: DataFrame, held: DataFrame) -> DataFrame:
    """One row: listed lines, different bare ids, repeated lines, ids that the shards hold, and those they lack."""
    ids = listed.select(bare_arxiv_id(F.col("id")).alias("id"))
    per = ids.groupBy("id").agg(F.count("*").alias("n")).where("id is not null").join(held.select(bare_arxiv_id(F.col("id")).alias("id"), F.lit(True).alias("held")).distinct(), "id", "left")
    lines = ids.agg(F.count("*").alias("lines"), F.count_if(F.col("id").isNull()).alias("invalid"))
    return per.agg(F.count("*").alias("ids"), F.sum(F.col("n") - 1).alias("repeated"), F.count("held").alias("held"), F.count_if(F.col("held").isNull()).alias("lacking")).crossJoin(F.broadcast(lines))


def freeze(spark: SparkSession, rows: DataFrame, path: str, key: str, quarantine: Column) -> DataFrame:
    """Write rows that are not quarantined once, and a manifest beside them: rows, quarantined, and a hash of the keys.

    The folder must not exist. The hash is a sum over rows, so that it does not
    depend on files or order; ``verified`` recomputes it. Returns the manifest.
    """
    rows.where(~quarantine).write.mode("errorifexists").parquet(f"{path}/rows")
    manifest = _seal(spark.read.parquet(f"{path}/rows"), key).crossJoin(F.broadcast(rows.agg(F.count_if(quarantine).alias("quarantined"))))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def _seal(rows: DataFrame, key: str) -> DataFrame:
    every = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.sum(every).cast("string").alias("seal"))


def verified(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The frozen rows, if they are those that the manifest seals."""
    rows, want = spark.read.parquet(f"{path}/rows"), spark.read.json(f"{path}/manifest").first()
    got = _seal(rows, key).first()
    if (got["rows"], got["keys"], got["seal"]) != (want["rows"], want["keys"], want["seal"]):
        raise ValueError("the rows differ from their manifest")
    return rows


def import_vectors(stored: DataFrame, expected: DataFrame, size: int) -> DataFrame:
    """Vectors (work, text_hash, vector) whose works and texts are exactly the expected ones (work, text_hash), each of ``size`` finite numbers."""
    both = stored.select("work", F.col("text_hash").alias("a")).join(expected.select("work", F.col("text_hash").alias("b")), "work", "full_outer")
    bad = both.where(~F.col("a").eqNullSafe(F.col("b"))).limit(1).count() + stored.where((F.size("vector") != size) | F.exists("vector", lambda x: F.isnan(x) | x.isNull())).limit(1).count()
    if bad:
        raise ValueError("vectors do not belong to the expected works and texts")
    return stored


def checked_catalogue(records: DataFrame, edition: str) -> DataFrame:
    """Catalogue records of one edition with different ids and titles; else an error."""
    wrong = records.agg((F.count("*") - F.count_distinct("id")).alias("ids"), (F.count("*") - F.count_distinct(F.lower("title"))).alias("titles"), F.count_if(F.col("edition") != edition).alias("editions")).first()
    if any(wrong):
        raise ValueError(f"the catalogue has repeated ids, titles or other editions: {wrong.asDict()}")
    return records


def batch_coverage(files: DataFrame) -> DataFrame:
    """(source, mode, status): a batch is partial if any of its files is marked incomplete or failed."""
    marked = F.coalesce("incomplete", F.lit(False)) | F.col("error").isNotNull()
    return files.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("mode"), F.when(F.bool_or(marked), "partial").otherwise("complete").alias("status"), F.count_if(marked).alias("marked"))


def valid_doi(value: Column) -> Column:
    """The DOI in lower case; null if it is none, is over 500 characters or holds control characters."""
    return F.when(value.rlike(DOI_FORM) & (F.length(value) <= 500) & ~value.rlike(r"[\x00-\x1F]"), F.lower(value))


def grant_key(funder: Column, country: Column, number: Column) -> Column:
    """struct(scheme, value) of a grant number that has the form of its funder's scheme; else null."""
    clean = F.trim(number)
    out = F.lit(None).cast("struct<scheme:string,value:string>")
    for (name, place), scheme in FUNDERS.items():
        fits = (funder == name) & (country == place) & clean.rlike(GRANTS[scheme]) & (F.length(number) <= 300)
        out = F.when(fits, F.struct(F.lit(scheme).alias("scheme"), F.upper(clean).alias("value"))).otherwise(out)
    return out


def source_links(kind: Column, value: Column) -> Column:
    """The address of an identifier; null for kinds that have none."""
    return F.when(kind == "doi", F.concat(F.lit("https://doi.org/"), value)).when(kind == "arxiv", F.concat(F.lit("https://arxiv.org/abs/"), value)).when(kind == "openalex", F.concat(F.lit("https://openalex.org/"), value))


def matched_fields(query: Column, fields: dict[str, Column]) -> Column:
    """Which fields visibly hold the query, in their order; list fields count if any entry does."""
    fold = lambda c: collapse(F.lower(c))
    return F.array_compact(F.array(*[F.when(F.contains(fold(c), fold(query)), F.lit(name)) for name, c in fields.items()]))


def publisher_url(url: Column, domain: Column) -> Column:
    """Is the address an http(s) one on the publisher's domain, without credentials, on a usual port?"""
    host, port = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    return F.coalesce(url.rlike(r"(?i)^https?://") & (F.length(url) <= 2000) & ~url.rlike(r"^[a-zA-Z]+://[^/?#]*@") & port.isin("", "80", "443") & ((host == domain) | host.endswith(F.concat(F.lit("."), domain))), F.lit(False))


#: Kinds of sources by their domains, first match first.
SOURCE_TYPES = [
    ("preprint", r"arxiv\.org$"), ("bibliographic_index", r"openalex\.org"), ("scholarly_publication", r"nature\.com|science\.org|ieee\.org|acm\.org|springer\.com"),
    ("official_or_standard", r"gov|europa\.eu|oecd\.org|iso\.org"), ("industry_media", r"techcrunch\.com|siliconangle\.com|venturebeat\.com"),
]


def source_type(domain: Column) -> Column:
    out = F.lit("web")
    for name, form in reversed(SOURCE_TYPES):
        out = F.when(F.lower(domain).rlike(form), name).otherwise(out)
    return out


def redirect_resolution(pages: DataFrame) -> DataFrame:
    """(requested, resolved, status, redirected) of a lookup's answer: one page, which may be missing; invalid titles raise."""
    missing = F.coalesce("missing", F.lit(False))
    checked = F.when(F.coalesce("invalid", F.lit(False)), F.raise_error("the requested title is not valid").cast("string")).otherwise(F.col("title"))
    return pages.select("requested", F.when(~missing, checked).alias("resolved"), F.when(missing, "not_found").otherwise("resolved").alias("status"), (F.size(F.coalesce("redirects", F.array().cast("array<string>"))) > 0).alias("redirected"))


def aggregator_records(rows: DataFrame, since: str, until: str, cap: int, most: int = 1000) -> DataFrame:
    """Usable rows of an aggregator's answer, one for each identity, the first ``cap`` in the source's order.

    ``rows``: place, record_id, url, title, day. A longer answer than ``most`` raises.
    """
    rows = rows.withColumn("place", F.when(F.col("place") >= most, F.raise_error(f"more than {most} rows in an answer").cast("long")).otherwise(F.col("place")))
    good = F.col("url").rlike("(?i)^https?://") & (F.trim("title") != "") & F.col("day").between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    identity = F.coalesce("record_id", "url")
    first = rows.where(good).groupBy(identity.alias("identity")).agg(F.min(F.struct("place", "url", "title", "day")).alias("r")).select("identity", "r.*")
    return first.orderBy("place").limit(cap)
