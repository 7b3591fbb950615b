"""One query for each evidence provider: pages of its JSON are built from documents and parsed by its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.plans.registry import query
from signalweave.sources import evidence
from signalweave.storage import table

#: Forms of identifiers by provider; all others are plain.
KEYS = {"clinical_trials": ("NCT", 8), "nsf_awards": ("", 7), "gdelt": ("http://x.org/", 1), "rss": ("http://x.org/", 1)}
#: DuckDB's name of a day format.
FORMATS = {"yyyy-MM-dd": "%Y-%m-%d", "yyyyMMdd": "%Y%m%d", "MM/dd/yyyy": "%m/%d/%Y"}


def _period(p: evidence.Provider) -> tuple[str, str]:
    """Providers for which a row outside the period is an error are asked for all of it."""
    return ("2020-01-01", "2021-01-01") if p.outside_raises else ("2020-02-01", "2020-06-01")


def payloads(docs: DataFrame, p: evidence.Provider) -> DataFrame:
    """(page, payload): answers of fifty items each, with repeated identifiers and titles of two kinds."""
    head, digits = KEYS.get(p.name, ("k", 1))
    n = F.col("doc_id") % 300
    number = F.lpad(n.cast("string"), digits, "0") if digits > 1 else n.cast("string")
    made = {p.key: F.concat(F.lit(head), number), p.day: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (n % 200).cast("int")), p.day_format)}
    made.setdefault(p.title, F.concat(F.when(n % 5 > 0, "Deep nets ").otherwise("Other "), n))
    item = F.struct(*[c.alias(name) for name, c in made.items()])
    pages = docs.groupBy(F.floor(F.col("doc_id") / 50).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    body = F.col("items")
    for step in reversed(p.items.split(".")):
        body = F.struct(body.alias(step))
    return pages.select("page", F.to_json(body).alias("payload"))


def sql(p: evidence.Provider) -> str:
    head, digits = KEYS.get(p.name, ("k", 1))
    since, until = _period(p)
    title = "key" if p.title == p.key else "CASE WHEN n % 5 > 0 THEN 'Deep nets ' ELSE 'Other ' END || n"
    words = " AND n % 5 > 0" if p.all_words else ""
    order = "doc_id" if p.cap_first else "day DESC, key"
    link = "key" if p.link else "CAST(NULL AS VARCHAR)"
    return f"""WITH d AS (SELECT doc_id, doc_id % 300 AS n FROM documents), t AS (SELECT doc_id, n, '{head}' || {f"lpad(CAST(n AS VARCHAR), {digits}, '0')" if digits > 1 else "n"} AS key, DATE '2020-01-01' + CAST(n % 200 AS INTEGER) AS day FROM d),
f AS (SELECT min(doc_id) AS doc_id, n, key, day FROM t WHERE day >= DATE '{since}' AND day < DATE '{until}'{words} GROUP BY n, key, day) SELECT key, {title} AS title, CAST(day AS VARCHAR) AS day, {link} AS link FROM f ORDER BY {order} LIMIT {p.cap}"""


def _register(p: evidence.Provider) -> None:
    def run(spark, folder):
        t = evidence.parse(payloads(table(spark, folder, "documents"), p), p, *_period(p), "nets deep")
        return t.select("key", "title", F.col("day").cast("string").alias("day"), "link")

    run.__doc__ = f"Records of {p.name} by its own rules."
    run.__module__ = __name__
    query(sql(p), f"evidence_{p.name}")(run)


for _provider in evidence.PROVIDERS.values():
    _register(_provider)
