"""Parsers of external evidence: one declarative spec for each provider's differences.

Providers differ in whether rows outside the period are skipped or are an error,
whether the cap comes before or after sorting, and whether all query words must
match. Fetching is left to the caller; payloads come as rows of JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provider:
    """How a provider's payload becomes rows."""

    name: str
    schema: str
    items: str
    key: str
    title: str
    day: str
    day_format: str = "yyyy-MM-dd"
    link: str | None = None
    outside_raises: bool = False
    cap_first: bool = False
    all_words: bool = True
    id_pattern: str | None = None
    cap: int = 200


#: Field names of public interfaces, and how each treats its rows.
PROVIDERS = {
    p.name: p
    for p in [
        Provider("gdelt", "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>>", "articles", "url", "title", "seendate", "yyyyMMdd", "url", all_words=False),
        Provider("clinical_trials", "struct<studies:array<struct<nct_id:string,title:string,first_posted:string>>>", "studies", "nct_id", "title", "first_posted", cap_first=True, id_pattern=r"^NCT\d{8}$"),
        Provider("europe_pmc", "struct<resultList:struct<result:array<struct<id:string,doi:string,title:string,firstPublicationDate:string>>>>", "resultList.result", "id", "title", "firstPublicationDate", cap_first=True),
        Provider("nasa_ntrs", "struct<results:array<struct<id:string,title:string,distributionDate:string>>>", "results", "id", "title", "distributionDate"),
        Provider("osti", "struct<records:array<struct<osti_id:string,title:string,publication_date:string>>>", "records", "osti_id", "title", "publication_date"),
        Provider("datacite", "struct<data:array<struct<id:string,title:string,created:string>>>", "data", "id", "title", "created"),
        Provider("huggingface", "struct<items:array<struct<id:string,type:string,createdAt:string>>>", "items", "id", "id", "createdAt", all_words=False),
        Provider("semantic_scholar", "struct<data:array<struct<paperId:string,title:string,publicationDate:string>>>", "data", "paperId", "title", "publicationDate", outside_raises=True, all_words=False),
        Provider("nih_reporter", "struct<results:array<struct<appl_id:string,project_title:string,project_start_date:string>>>", "results", "appl_id", "project_title", "project_start_date", outside_raises=True),
        Provider("nsf_awards", "struct<response:struct<award:array<struct<id:string,title:string,startDate:string>>>>", "response.award", "id", "title", "startDate", "MM/dd/yyyy", id_pattern=r"^\d{7}$"),
        Provider("openaire", "struct<results:array<struct<id:string,title:string,startDate:string>>>", "results", "id", "title", "startDate"),
        Provider("ukri", "struct<project:array<struct<id:string,title:string,start:string>>>", "project", "id", "title", "start", cap_first=True),
        Provider("eu_programmes", "struct<results:array<struct<identifier:string,title:string,startDate:string>>>", "results", "identifier", "title", "startDate", cap_first=True),
        Provider("usaspending", "struct<results:array<struct<award_id:string,description:string,start_date:string>>>", "results", "award_id", "description", "start_date", cap_first=True),
        Provider("rss", "struct<items:array<struct<link:string,title:string,published:string>>>", "items", "link", "title", "published", link="link"),
    ]
}


def words_in(text: Column, query: str) -> Column:
    """Every word of the query is in the text."""
    found = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", " "), " ")
    out = F.lit(True)
    for w in query.lower().split():
        out = out & F.array_contains(found, w)
    return out


def parse(payloads: DataFrame, provider: Provider, since: str, until: str, query: str = "") -> DataFrame:
    """(key, title, day, link, place): usable rows of JSON ``payload`` texts, one for each key, capped in the provider's way.

    Unknown days are not usable; they are not zero. ``place`` is the order in the
    source: the column ``page`` of ``payloads`` where there is one (else a hash of
    the payload), then the place in the payload. Where the provider's rule says so,
    a row outside the period raises.
    """
    page = F.col("page") if "page" in payloads.columns else F.xxhash64("payload")
    item = payloads.select(F.from_json("payload", provider.schema).alias("p"), page.cast("long").alias("page")).select("page", F.posexplode(f"p.{provider.items}").alias("i", "r"))
    day = F.try_to_date(F.substring(F.col(f"r.{provider.day}"), 1, 8 if provider.day_format == "yyyyMMdd" else 10), provider.day_format)
    t = item.select(F.col(f"r.{provider.key}").alias("key"), F.col(f"r.{provider.title}").alias("title"), day.alias("day"), (F.col(f"r.{provider.link}") if provider.link else F.lit(None).cast("string")).alias("link"), "page", "i")
    inside = (F.col("day") >= F.lit(since).cast("date")) & (F.col("day") < F.lit(until).cast("date"))
    if provider.outside_raises:
        t = t.withColumn("day", F.when(F.coalesce(inside, F.lit(False)), F.col("day")).otherwise(F.raise_error(F.concat(F.lit(f"{provider.name}: a row outside the period: "), F.coalesce("key", F.lit("?")))).cast("date")))
    good = F.col("key").isNotNull() & inside
    if provider.id_pattern:
        good = good & F.col("key").rlike(provider.id_pattern)
    if provider.all_words and query:
        good = good & words_in(F.col("title"), query)
    kept = t.where(good).withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("page", "i"))).where("_n = 1").drop("_n")
    order = [F.col("page"), F.col("i")] if provider.cap_first else [F.col("day").desc(), F.col("key")]
    return kept.orderBy(*order).limit(provider.cap).withColumn("place", F.struct("page", "i")).drop("page", "i")


def densify_days(views: DataFrame, day: str, value: str, since: str, until: str) -> DataFrame:
    """Expected days left-joined to what was seen; a missing day stays null."""
    days = views.sparkSession.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.date_sub(F.lit(until).cast("date"), 1))).alias(day))
    return days.join(views.groupBy(day).agg(F.sum(value).alias(value)), day, "left")


def syndication(articles: DataFrame, url: str, domain: str, fingerprint: str) -> DataFrame:
    """Stories: articles of one fingerprint once a URL, with how many and from which domains."""
    return articles.dropDuplicates([url]).groupBy(fingerprint).agg(F.count("*").alias("articles"), F.count_distinct(domain).alias("domains"), F.array_sort(F.collect_set(domain)).alias("domain_list"))


#: Words that do not tell what a title is about.
COMMON = ["a", "an", "and", "for", "from", "in", "new", "of", "on", "or", "the", "to", "with"]


def relevance_words(text: Column) -> Column:
    """Different words of a text without common ones, plural -s folded on words over three letters."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", " "), " "), lambda w: (w != "") & ~w.isin(COMMON))
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)))


def admitted(items: DataFrame, topic_words: Column, as_of: str, required: int = 2) -> DataFrame:
    """``items`` with ``reason`` (null if taken up) and ``matched``: the first rule that excludes decides.

    Columns: item, axis, title, url, day, fresh, repeated. Rules in order: a stale
    answer, no safe link, a repeat that the source names, too few words of the
    topic in the title, no date, a date ahead, and a story that an earlier item
    already told (the same words of a title count once).
    """
    from signalweave.functions.text import url_host

    t = items.withColumn("matched", F.array_sort(F.array_intersect(relevance_words(F.col("title")), topic_words)))
    day = F.col("day")
    reason = (
        F.when(~F.coalesce("fresh", F.lit(False)), "stale_answer").when(url_host(F.col("url")).isNull(), "no_safe_link").when(F.coalesce("repeated", F.lit(False)), "repeated_by_source")
        .when(F.size("matched") < required, "too_few_topic_words").when(day.isNull(), "no_date").when(day > F.lit(as_of).cast("date"), "date_ahead")
    )
    story = F.array_join(F.array_sort(relevance_words(F.col("title"))), " ")
    t = t.withColumns({"reason": reason, "_story": story})
    told = F.row_number().over(W.partitionBy("axis", "_story", F.col("reason").isNull()).orderBy("item"))
    return t.withColumn("reason", F.when(F.col("reason").isNull() & (told > 1), "story_told_before").otherwise(F.col("reason"))).drop("_story")
