"""Readers of publication metadata: JSON pages, Atom and OAI XML, Parquet mirrors, HTML meta tags; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.functions.text import bare_arxiv_id, clean_doi, inverted_abstract


def openalex_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON pages {results: [...]} as one row a work; rows without id are left out."""
    pages = spark.read.option("multiLine", True).json(path)
    return pages.select(F.explode("results").alias("r")).select("r.*").where("id is not null")


def openalex_works(works: DataFrame) -> DataFrame:
    """Identifiers, title, abstract, day, authors with organisations."""
    has = set(works.columns)
    col = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    abstract = inverted_abstract(F.from_json(F.to_json("abstract_inverted_index"), "map<string,array<int>>")) if "abstract_inverted_index" in has else F.lit(None).cast("string")
    return works.select(
        F.substring_index("id", "/", -1).alias("source_id"),
        clean_doi(col("doi", "string")).alias("doi"),
        bare_arxiv_id(F.when(F.lower(col("doi", "string")).contains("10.48550/arxiv."), F.substring_index(F.lower(col("doi", "string")), "arxiv.", -1))).alias("arxiv_id"),
        F.coalesce(col("title", "string"), col("display_name", "string")).alias("title"),
        abstract.alias("abstract"),
        F.to_date(col("publication_date", "string")).alias("day"),
        col("type", "string").alias("kind"),
        (F.transform("authorships", lambda a: a["author"]["display_name"]) if "authorships" in has else F.array().cast("array<string>")).alias("authors"),
    )


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries; key is the last segment of the id; authors, categories and links stay lists."""
    t = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).load(path)
    kinds = dict(t.dtypes)
    many = lambda c: (F.col(c) if kinds.get(c, "").startswith("array") else F.array(c)) if c in kinds else F.array()
    return t.select(F.substring_index("id", "/", -1).alias("record"), "title", "summary", F.to_date(F.col("published").cast("string").substr(1, 10)).alias("day"), F.to_date(F.col("updated").cast("string").substr(1, 10)).alias("revised"), F.transform(many("author"), lambda a: a["name"]).alias("authors"), F.transform(many("category"), lambda c: c["_term"]).alias("categories"))


def oai_records(spark: SparkSession, path: str, since: str, until: str, categories: list[str]) -> DataFrame:
    """OAI records created in the period (not their datestamp) in one of the categories; author: forenames and keyname."""
    t = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", True).load(path).select("metadata.arXiv.*")
    kind = dict(t.dtypes)["authors"]
    authors = F.col("authors.author") if "author:array" in kind else F.array("authors.author")
    day = F.to_date(F.col("created").cast("string"))
    held = t.where((day >= F.lit(since)) & (day <= F.lit(until)) & F.arrays_overlap(F.split("categories", " "), F.array(*map(F.lit, categories))))
    return held.select(F.col("id").cast("string").alias("record"), "title", "abstract", day.alias("day"), F.split("categories", " ").alias("categories"), F.transform(authors, lambda a: F.trim(F.concat_ws(" ", a["forenames"], a["keyname"]))).alias("authors"))


def submission_dates(history: Column) -> tuple[Column, Column]:
    """First and last day named in a history such as "[v1] Mon, 2 Jan 2023 ...": null if none."""
    days = F.transform(F.regexp_extract_all(history, F.lit(r"(\d{1,2} [A-Z][a-z]{2} \d{4})"), F.lit(1)), lambda d: F.try_to_date(d, "d MMM yyyy"))
    return F.try_element_at(days, F.lit(1)), F.try_element_at(days, F.lit(-1))


def legacy_snapshot(rows: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Rows with first and last submission day, inclusive period; unknown days go if the period is bounded."""
    first, last = submission_dates(F.col("history"))
    t = rows.withColumns({"day": first, "revised": last, "subject_codes": F.regexp_extract_all("subjects", F.lit(r"\(([a-z\-]+\.[A-Z]{2}|[a-z\-]+)\)"), F.lit(1))})
    return t.where(f"day >= date'{since or '0001-01-01'}' and day <= date'{until or '9999-12-31'}'") if since or until else t


def valid_history(versions: Column) -> Column:
    """Exactly one v1, different numbers, days that do not fall (array of struct version, created)."""
    numbers = F.transform(versions, lambda v: v["version"])
    ordered = F.array_sort(F.transform(versions, lambda v: F.struct(F.regexp_extract(v["version"], r"v(\d+)", 1).cast("int").alias("n"), v["created"].alias("c"))))
    rising = F.forall(F.sequence(F.lit(1), F.size(versions)), lambda i: (i == 1) | (F.element_at(ordered, i)["c"] >= F.element_at(ordered, F.greatest(i - 1, F.lit(1)))["c"]))
    return (F.size(F.filter(numbers, lambda n: n == "v1")) == 1) & (F.size(F.array_distinct(numbers)) == F.size(numbers)) & rising


def html_meta(html: Column) -> Column:
    """map name -> values of citation_* meta tags, names in lower case; either attribute order."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*>"""), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, r"""(?i)\bname\s*=\s*["'](citation_[^"']+)["']""", 1))
    value = lambda t: F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1)
    pairs = F.filter(F.transform(tags, lambda t: F.struct(name(t).alias("n"), value(t).alias("v"))), lambda p: p["n"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["n"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["n"] == k), lambda p: p["v"])))


def html_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title, authors and days from HTML: citation_date is the first submission, citation_online_date a revision."""
    one = lambda k: F.try_element_at(F.try_element_at("meta", F.lit(k)), F.lit(1))
    t = pages.select(key, html_meta(F.col(html)).alias("meta"), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("page_title"))
    return t.select(key, F.coalesce(one("citation_title"), F.nullif("page_title", F.lit(""))).alias("title"), F.coalesce(F.try_element_at("meta", F.lit("citation_author")), F.array().cast("array<string>")).alias("authors"), F.try_to_date(one("citation_date"), "yyyy/MM/dd").alias("day"), F.try_to_date(one("citation_online_date"), "yyyy/MM/dd").alias("revised"))


def content_hash(rows: DataFrame, source: str, file: str, sha: str) -> DataFrame:
    """One hash over sorted (source, file, sha), free of times and addresses."""
    return rows.agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct(source, file, sha)))), 256).alias("collection_sha256"))


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str = "content_sha256") -> int:
    """Append rows whose content hash is not stored yet; the same hash with other metadata is an error. Returns how many were new."""
    from pyspark.errors import AnalysisException

    rows = rows.dropDuplicates([key])
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        rows.write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path).count()
    same = rows.alias("n").join(stored.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"))
    differ = F.lit(False)
    for c in rows.columns:
        differ = differ | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    if same.where(differ).limit(1).count():
        raise ValueError("a stored content hash has other metadata")
    fresh = rows.join(stored.select(key), key, "left_anti").select(*stored.columns)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def check_inventory(files: DataFrame, expected: dict[str, int]) -> None:
    """Raise unless the files (name, rows) are exactly the expected ones; what is compared is one row a file."""
    found = {r["name"]: r["rows"] for r in files.select("name", "rows").limit(len(expected) + 1).collect()}
    if found != expected:
        raise ValueError(f"inventory differs: {sorted(set(found.items()) ^ set(expected.items()))[:5]}")


def write_targets(rows: DataFrame, targets: str, path: str) -> None:
    """Overlapping packs: a row lies in each of its targets' folders."""
    rows.withColumn("target", F.explode(targets)).drop(targets).write.mode("errorifexists").partitionBy("target").parquet(path)
