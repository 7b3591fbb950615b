"""URL filters: host and path rules, and block decisions that aliases share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.operators.components import components

from .common import Scratch, lower_ascii, table

#: The rules of the query: (verdict, host, path). A rule fits its host and all subdomains.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Rules that are written into the plan; longer lists come as a table and are joined.
PLAN_RULES = 1_000


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for URLs that name the same page.

    The scheme, a leading ``www.`` or ``m.``, the fragment, tracking parameters
    (``utm_``...), a last ``/`` and ``.html`` go; other parameters stay. Null for
    what is no URL.
    """
    bare = F.regexp_replace(host(url), r"^(www|m)\.", "")
    stem = F.regexp_replace(path(url), r"(/|\.html?|/index\.html?)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(host(url) != "", F.concat(bare, stem, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def undotted(path_at: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; ``..`` does not go above the root."""
    parts = F.split(path_at, "/")
    # A last dot segment names a folder.
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    parts = F.slice(parts, 2, F.size(parts))
    step = lambda held, x: F.when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(x == ".", held).otherwise(F.concat(held, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs: canonical links and refresh redirects in ``html``; relative targets are taken on the page's URL."""
    tag = r"(?is)<(?:link|meta)\b[^>]*>"
    tags = pages.select("url", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(tag), F.lit(0))).alias("tag"))
    canon = F.when(F.col("tag").rlike(r"""(?i)\brel\s*=\s*["']?canonical\b"""), F.regexp_extract("tag", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    moved = F.when(F.col("tag").rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    found = tags.select(F.col("url").alias("src"), F.explode(F.array_compact(F.array(canon, moved))).alias("dst")).where("dst <> ''")
    src, dst = F.col("src"), F.col("dst")
    scheme = F.regexp_extract(src, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host(src))
    folder = F.concat(F.lit("/"), F.regexp_extract(path(src), r"(?s)^/(.*/)?", 1))
    stem = F.regexp_extract(dst, r"(?s)^[^?#]*", 0)
    page = F.regexp_extract(src, r"(?s)^[^?#]*", 0)
    target = (
        F.when(dst.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), dst)
        .when(dst.startswith("//"), F.concat(scheme, F.lit(":"), dst))
        .when(host(src) == "", None)
        .when(dst.startswith("/"), F.concat(site, dst))
        .when(dst.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(dst.startswith("?"), F.concat(page, dst))
        .when(dst.startswith("#"), None)
        .otherwise(F.concat(site, undotted(F.concat(folder, stem)), F.expr("substring(dst, length(regexp_extract(dst, '(?s)^[^?#]*', 0)) + 1)")))
    )
    return found.select("src", target.alias("dst")).where("dst is not null")


def best_rule(host_at: Column, path_at: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, allow, rule) of the longest fitting rule; of equals, allow."""
    if not rules:
        return F.lit(None).cast("struct<size:int,allow:boolean,rule:string>")
    each = [F.when(((host_at == h) | host_at.endswith("." + h)) & path_at.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule"))) for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*each)))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``pages`` with host, path and rule (null or struct(size, allow, rule)).

    A list of up to ``PLAN_RULES`` becomes an expression. A table (verdict, host,
    path) is joined on every suffix of the host, so that its size does not matter.
    """
    sited = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    if isinstance(rules, list) and len(rules) <= PLAN_RULES:
        return sited.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    if isinstance(rules, list):
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), (F.col("verdict") == "allow").alias("allow")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sites = sited.select("host", "path").distinct()
    met = sites.withColumn("rule_host", F.explode(suffixes)).join(listed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = met.groupBy("host", "path").agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), "allow", F.concat("rule_host", "rule_path").alias("rule"))).alias("rule"))
    return sited.join(best, ["host", "path"], "left")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url, html).

    A rule that fits decides. Pages without one share the decisions of their
    aliases: the pages reached over canonical forms, canonical links and
    redirects (in ``html``, and in ``edges`` (src, dst) where given). If one of
    these is allowed by a rule they are allowed; else if one is blocked they are
    blocked; else they are allowed. Null or broken URLs have no aliases and are
    allowed. Returns page_id, url, host, path, rule, verdict, component.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(*[F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("page_id", "url", "html")])
    found = links(rows).unionAll(edges.select("src", "dst")) if edges is not None else links(rows)
    # URLs that only links name are aliases too: rules that fit them count.
    seen = rows.select("url").unionAll(found.select("src")).unionAll(found.select("dst")).where("url is not null").distinct()
    known = scratch.save(ruled(seen, rules).withColumns({"node": F.md5("url"), "form": F.md5(F.concat(F.lit("="), canonical(F.col("url"))))}), "urls")
    alias = known.select(F.col("node").alias("src"), F.col("form").alias("dst")).unionAll(found.select(F.md5("src").alias("src"), F.md5("dst").alias("dst")))
    parts = components(alias, scratch)
    noted = known.join(parts, "node", "left").select("url", "host", "path", "rule", F.coalesce("component", "node").alias("component"))
    noted = scratch.save(noted, "noted")
    shared = noted.groupBy("component").agg(F.max("rule.allow").alias("any_allow"), F.min("rule.allow").alias("all_allow"))
    verdict = F.when(F.coalesce(F.col("rule.allow"), F.col("any_allow"), F.lit(True)), "allow").otherwise("block")
    decided = noted.join(shared, "component").select("url", "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "component")
    out = rows.select("page_id", "url").join(decided, "url", "left")
    return out.select("page_id", "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "component")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
), form AS (
  SELECT p.page_id, rule, verdict, host, path,
    CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html?|/index\.html?)$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&'), ''), '') END AS alias
  FROM p LEFT JOIN best USING (page_id)
), shared AS (
  SELECT alias, bool_or(verdict = 'allow') AS any_allow FROM form GROUP BY alias
)
SELECT page_id, host, path, rule,
  CASE WHEN verdict IS NOT NULL THEN verdict WHEN coalesce(any_allow, TRUE) THEN 'allow' ELSE 'block' END AS verdict
FROM form LEFT JOIN shared USING (alias)
"""
