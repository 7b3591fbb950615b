"""Queries over readers, identifiers, predicates and sinks; fixtures are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.functions import text
from signalweave.operators import hybrid, identity, phrases, review
from signalweave.plans import retrieval
from signalweave.plans.registry import query
from signalweave.sources import evidence, metadata, publications
from signalweave.storage import Scratch, table

DAY = "CAST(DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER) AS DATE)"


def _docs(spark, folder):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int"))
    return table(spark, folder, "documents").withColumn("day", day)


def _paged(rows, one, head: str, between: str, tail: str, path: str) -> None:
    """Write each hundred rows as one text file: a page of a source's answer."""
    pages = rows.groupBy(F.floor(F.col("doc_id") / 100).alias("p")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(one), between), F.lit(tail)).alias("value"))
    pages.repartition(4).select("value").write.option("maxRecordsPerFile", 1).text(path)


def _s(c):
    return F.col(c).cast("string").alias(c)


@query(f"""SELECT 'W' || doc_id AS source_id, '10.1/x' || doc_id AS doi, source || ' ' || doc_id AS title, 'deep nets ' || source AS abstract, CAST({DAY} AS VARCHAR) AS day, 'article' AS kind, lang || ' A|B ' || source AS authors FROM documents WHERE doc_id % 10 <> 0""")
def openalex_pages(spark, folder):
    """Works in JSON pages of a hundred, read back; rows without an id are left out."""
    scratch = Scratch(spark, "pages")
    work = F.to_json(F.struct(
        F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("https://openalex.org/W"), "doc_id")).alias("id"), F.concat(F.lit("https://doi.org/10.1/X"), "doc_id").alias("doi"), F.concat_ws(" ", "source", "doc_id").alias("title"),
        F.create_map(F.lit("nets"), F.array(F.lit(1)), F.col("source"), F.array(F.lit(2)), F.lit("deep"), F.array(F.lit(0))).alias("abstract_inverted_index"), F.col("day").cast("string").alias("publication_date"), F.lit("article").alias("type"),
        F.array(*[F.struct(F.struct(n.alias("display_name")).alias("author")) for n in (F.concat_ws(" ", "lang", F.lit("A")), F.concat_ws(" ", F.lit("B"), "source"))]).alias("authorships"),
    ))
    _paged(_docs(spark, folder), work, '{"results": [', ",", "]}", f"{scratch.path}/openalex")
    t = publications.openalex_works(publications.openalex_pages(spark, f"{scratch.path}/openalex"))
    return t.select("source_id", "doi", "title", "abstract", _s("day"), "kind", F.array_join("authors", "|").alias("authors"))


@query(f"""SELECT doc_id || 'v2' AS record, source AS title, CAST({DAY} AS VARCHAR) AS day, CAST({DAY} + 3 AS VARCHAR) AS revised, 'A ' || lang || '|B' AS authors, 'cs.AI|' || lang AS categories FROM documents""")
def atom_entries(spark, folder):
    scratch = Scratch(spark, "atom")
    stamp = lambda n: F.concat(F.date_add("day", n).cast("string"), F.lit("T00:00:00Z"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    entry = F.concat(tag("id", F.concat(F.lit("http://arxiv.org/abs/"), "doc_id", F.lit("v2"))), tag("title", F.col("source")), tag("summary", F.col("lang")), tag("published", stamp(0)), tag("updated", stamp(3)), tag("author", tag("name", F.concat(F.lit("A "), "lang"))), tag("author", tag("name", F.lit("B"))), F.lit('<category term="cs.AI"/><category term="'), F.col("lang"), F.lit('"/>'))
    _paged(_docs(spark, folder), tag("entry", entry), "<feed>", "", "</feed>", f"{scratch.path}/atom")
    t = publications.atom_entries(spark, f"{scratch.path}/atom")
    return t.select(_s("record"), "title", _s("day"), _s("revised"), F.array_join("authors", "|").alias("authors"), F.array_join("categories", "|").alias("categories"))


@query(f"""SELECT '2001.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'x' AS record, source AS title, CAST({DAY} AS VARCHAR) AS day, 'Ann ' || lang || '|Bo Li' AS authors FROM documents WHERE {DAY} BETWEEN DATE '2020-03-01' AND DATE '2021-06-30' AND lang IN ('en', 'de')""")
def oai_records(spark, folder):
    scratch = Scratch(spark, "oai")
    tag = lambda name, *c: F.concat(F.lit(f"<{name}>"), *c, F.lit(f"</{name}>"))
    author = lambda k, f: tag("author", tag("keyname", k), tag("forenames", F.lit(f)))
    body = tag("arXiv", tag("id", F.concat(F.lit("2001."), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("x"))), tag("created", F.col("day").cast("string")), tag("authors", author(F.col("lang"), "Ann"), author(F.lit("Li"), "Bo")), tag("title", F.col("source")), tag("abstract", F.lit("a")), tag("categories", F.concat(F.lit("x-"), "lang", F.lit(" "), "lang")))
    _paged(_docs(spark, folder), tag("record", tag("header", tag("datestamp", F.lit("1999-01-01"))), tag("metadata", body)), "<ListRecords>", "", "</ListRecords>", f"{scratch.path}/oai")
    t = publications.oai_records(spark, f"{scratch.path}/oai", "2020-03-01", "2021-06-30", ["en", "de"])
    return t.select("record", "title", _s("day"), F.array_join("authors", "|").alias("authors"))


@query(f"""SELECT doc_id, strftime({DAY}, '%Y-%m-%d') AS day, strftime({DAY} + 40, '%Y-%m-%d') AS revised, 'cs.AI,hep-th' AS subjects FROM documents WHERE {DAY} BETWEEN DATE '2020-02-01' AND DATE '2021-01-31'""")
def legacy_snapshot(spark, folder):
    d = _docs(spark, folder)
    shown = lambda n: F.date_format(F.date_add("day", n), "d MMM yyyy")
    rows = d.select("doc_id", F.concat(F.lit("[v1] Mon, "), shown(0), F.lit(" 10:00:00 GMT; [v2] Tue, "), shown(40), F.lit(" 11:00:00 GMT")).alias("history"), F.lit("Artificial (cs.AI); Theory (hep-th)").alias("subjects"))
    return publications.legacy_snapshot(rows, "2020-02-01", "2021-01-31").select("doc_id", _s("day"), _s("revised"), F.array_join("subject_codes", ",").alias("subjects"))


MIRROR_SQL = f"m AS (SELECT doc_id, '2003.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS record, doc_id % 9 > 0 AS valid, {DAY} AS day, {DAY} + 5 AS revised, source AS title, lang, doc_id FROM documents)"


def _mirror(spark, folder):
    version = lambda n, d: F.struct(F.lit(n).alias("version"), F.date_add("day", d).cast("string").alias("created"))
    versions = F.when(F.col("doc_id") % 9 > 0, F.array(version("v2", 5), version("v1", 0))).otherwise(F.array(version("v2", 5)))
    return _docs(spark, folder).select(F.concat(F.lit("arXiv:2003."), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("id"), F.col("source").alias("title"), F.lit(" an  abstract ").alias("abstract"), F.concat(F.lit("cs.AI "), "lang").alias("categories"), F.concat(F.lit("10.5/D"), "doc_id").alias("doi"), versions.alias("versions"), F.array(F.array("lang", F.lit("Ann"), F.lit("Jr")), F.array(F.lit(" "), F.lit("x"))).alias("authors_parsed"))


@query(f"""WITH {MIRROR_SQL} SELECT record, valid, CASE WHEN valid THEN CAST(day AS VARCHAR) END AS day, CASE WHEN valid THEN CAST(revised AS VARCHAR) END AS revised, '10.5/d' || doc_id AS doi, 'Ann ' || lang || ' Jr' AS authors, 'parsed_names_only' AS author_status FROM m""")
def mirror_records(spark, folder):
    """A metadata mirror written as Parquet and read through the dispatch."""
    scratch = Scratch(spark, "mirror")
    _mirror(spark, folder).write.parquet(f"{scratch.path}/mirror.parquet")
    t = metadata.reader("arxiv", f"{scratch.path}/mirror.parquet")(spark)
    return t.select("record", "valid", _s("day"), _s("revised"), "doi", F.array_join("authors", "|").alias("authors"), "author_status")


@query(f"""WITH {MIRROR_SQL} SELECT title, 'an abstract' AS abstract, CASE WHEN valid THEN year(day) END AS year, 'arxiv:' || record || '|doi:10.5/d' || doc_id AS identifiers, 'preprint' AS version_kind FROM m""")
def preprint_works(spark, folder):
    t = metadata.preprint_works(metadata.mirror_records(_mirror(spark, folder)))
    return t.select("title", "abstract", F.col("year").cast("long"), F.array_join(F.transform("identifiers", lambda x: F.concat_ws(":", x["kind"], x["value"])), "|").alias("identifiers"), "version_kind")


@query(f"""WITH {MIRROR_SQL} SELECT record FROM m WHERE valid AND day BETWEEN DATE '2020-05-01' AND DATE '2021-02-28' AND lang IN ('en', 'fr') AND title LIKE '%1%'""")
def mirror_selection(spark, folder):
    return metadata.selected(metadata.mirror_records(_mirror(spark, folder)), ["en", "fr"], F.col("title").contains("1"), "2020-05-01", "2021-02-28").select("record")


@query("""SELECT count(*) AS lines, count(DISTINCT doc_id % 400) AS ids, count(*) - count(DISTINCT doc_id % 400) AS repeated, count(DISTINCT CASE WHEN doc_id % 400 < 250 THEN doc_id % 400 END) AS held, count(DISTINCT CASE WHEN doc_id % 400 >= 250 THEN doc_id % 400 END) AS lacking, CAST(0 AS BIGINT) AS invalid FROM documents""")
def id_inventory(spark, folder):
    """Ids listed as JSON lines against those of Parquet shards."""
    scratch = Scratch(spark, "inventory")
    ids = table(spark, folder, "documents").select((F.col("doc_id") % 400).alias("n"), F.concat(F.lit("arXiv:2004."), F.lpad((F.col("doc_id") % 400).cast("string"), 5, "0"), F.lit("v1")).alias("id"))
    ids.select("id").write.json(f"{scratch.path}/listed")
    ids.where("n < 250").select("id").write.parquet(f"{scratch.path}/held")
    return metadata.id_inventory(spark.read.schema("id string").json(f"{scratch.path}/listed"), spark.read.parquet(f"{scratch.path}/held"))


@query("""SELECT count(*) FILTER (n_chars > 200) AS rows, count(DISTINCT doc_id) FILTER (n_chars > 200) AS keys, count(*) FILTER (NOT n_chars > 200) AS quarantined, TRUE AS verified FROM documents""")
def frozen_subset(spark, folder):
    scratch = Scratch(spark, "frozen")
    d = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    manifest = metadata.freeze(spark, d, f"{scratch.path}/subset", "doc_id", ~(F.col("n_chars") > 200))
    n = metadata.verified(spark, f"{scratch.path}/subset", "doc_id").count()
    return manifest.select("rows", "keys", "quarantined", (F.col("rows") == n).alias("verified"))


@query("""SELECT vec_id AS work, len(embedding) AS size FROM embeddings""")
def vector_generation(spark, folder):
    """Vectors written with hashes of their texts, verified and imported."""
    scratch = Scratch(spark, "vectors")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("work"), F.md5(F.col("vec_id").cast("string")).alias("text_hash"), F.col("embedding").alias("vector"))
    stored = scratch.save(e, "generation")
    return metadata.import_vectors(stored, e.select("work", "text_hash"), 64).select("work", F.size("vector").cast("long").alias("size"))


@query("""SELECT p_partkey AS id, p_name || ' ' || p_partkey AS title FROM part""")
def checked_catalogue(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("title"), F.lit("2024").alias("edition"))
    return metadata.checked_catalogue(p, "2024").select("id", "title")


@query("""SELECT c_mktsegment AS source, array_to_string(list_sort(list(DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'bulk' ELSE 'page' END)), ',') AS mode, CASE WHEN bool_or(c_acctbal < -990) THEN 'partial' ELSE 'complete' END AS status, count(*) FILTER (c_acctbal < -990) AS marked FROM customer GROUP BY c_mktsegment""")
def batch_coverage(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("source"), F.when(F.col("c_nationkey") % 2 == 0, "bulk").otherwise("page").alias("mode"), F.when(F.col("c_acctbal") < -995, True).alias("incomplete"), F.when((F.col("c_acctbal") >= -995) & (F.col("c_acctbal") < -990), "timeout").alias("error"))
    return metadata.batch_coverage(c)


@query("""SELECT count(DISTINCT o_custkey) AS first, CAST(0 AS BIGINT) AS again, count(DISTINCT o_custkey) AS stored FROM orders""")
def idempotent_append(spark, folder):
    """The same batch twice: the second time nothing is new."""
    scratch = Scratch(spark, "ingest")
    rows = table(spark, folder, "orders").select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("content_sha256"), F.lit("orders").alias("source"))
    n = [publications.append_new(spark, rows, f"{scratch.path}/raw") for _ in range(2)]
    return spark.read.parquet(f"{scratch.path}/raw").agg(F.lit(n[0]).cast("long").alias("first"), F.lit(n[1]).cast("long").alias("again"), F.count("*").alias("stored"))


@query("""SELECT sha256('[' || string_agg('{"source":"' || c_mktsegment || '","file":"f' || c_custkey || '","sha":"' || md5(CAST(c_custkey AS VARCHAR)) || '"}', ',' ORDER BY c_mktsegment, 'f' || c_custkey) || ']') AS collection_sha256 FROM customer""")
def collection_hash(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("source"), F.concat(F.lit("f"), "c_custkey").alias("file"), F.md5(F.col("c_custkey").cast("string")).alias("sha"))
    return publications.content_hash(rows, "source", "file", "sha")


HAS = lambda p: f"regexp_matches(lower(text), '(^|[^[:alnum:]_]){p}([^[:alnum:]_]|$)')"


@query(f"""SELECT a AS anchor, count(*) AS rows FROM (SELECT unnest(list_filter(['the', 'der', 'license'], lambda a: (a = 'the' AND {HAS('the')}) OR (a = 'der' AND {HAS('der')}) OR (a = 'license' AND {HAS('license')}))) AS a FROM documents) GROUP BY a""")
def thematic_cache(spark, folder):
    scratch = Scratch(spark, "cache")
    return retrieval.thematic_cache(table(spark, folder, "documents"), ["the", "der", "license"], ["text"], f"{scratch.path}/cache")


@query(f"""SELECT doc_id FROM documents WHERE {HAS('the license')} OR {HAS('mit license')}""")
def cached_search(spark, folder):
    """A plan whose matches a cache provably covers is answered from the cache."""
    scratch, docs = Scratch(spark, "cached"), table(spark, folder, "documents")
    retrieval.thematic_cache(docs, ["license"], ["text"], f"{scratch.path}/cache")
    plan = retrieval.Plan(("the license", "MIT license"), fields=("text",))
    return retrieval.cached_or_full(docs, spark.read.parquet(f"{scratch.path}/cache"), ["license"], plan).select("doc_id")


@query(f"""WITH h AS (SELECT 'lic' AS branch, doc_id, {DAY} AS day FROM documents WHERE {HAS('license')} UNION ALL SELECT 'der', doc_id, {DAY} FROM documents WHERE {HAS('der')}), r AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY day DESC, doc_id DESC) AS turn FROM h) SELECT branch, doc_id, turn FROM r WHERE turn <= 20""")
def latest_branch_matches(spark, folder):
    plans = {"lic": retrieval.Plan(("license",), fields=("text",)), "der": retrieval.Plan(("der",), fields=("text",))}
    return retrieval.branches(_docs(spark, folder), plans, "doc_id", "day", 20, balanced=False).select("branch", "doc_id", F.col("turn").cast("long"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '_' || p_type || '!'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key, '10.9/' || p_partkey AS doi, split_part(lower(p_name), ' ', -1) || ' ' || lower(p_name)[1] AS author FROM part""")
def identity_keys(spark, folder):
    """Title, author and DOI keys."""
    p = table(spark, folder, "part")
    return p.select("p_partkey", text.title_key(F.concat("p_name", F.lit("_"), "p_type", F.lit("!"))).alias("key"), text.clean_doi(F.concat(F.lit(" https://DX.doi.org/10.9/"), "p_partkey", F.lit(" "))).alias("doi"), text.author_key(F.col("p_name")).alias("author"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 0 OR (strftime(o_orderdate, '%m-%d') = '01-01' AND o_orderstatus = 'F') THEN make_date(year(o_orderdate), 12, 31) ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS day, strftime(o_orderdate, '%m-%d') = '01-01' AND o_orderstatus = 'F' AS imprecise FROM orders""")
def effective_dates(spark, folder):
    day = F.col("o_orderdate").cast("date")
    vague = identity.imprecise_date(day, F.col("o_orderstatus"), ["F"])
    return table(spark, folder, "orders").select("o_orderkey", identity.effective_date(day, F.when(F.col("o_orderkey") % 7 == 0, "year").otherwise("day"), vague).cast("string").alias("day"), vague.alias("imprecise"))


@query("""SELECT doc_id, CASE WHEN contains(text, 'the') THEN 'withdrawn' WHEN doc_id % 5 = 0 THEN 'retracted' ELSE 'not_reported' END AS status FROM documents""")
def withdrawal_states(spark, folder):
    comment = F.when(F.contains("text", F.lit("the")), "This paper has been withdrawn by the author")
    return table(spark, folder, "documents").select("doc_id", review.withdrawal_status(comment, F.lit("a summary"), F.col("doc_id") % 5 == 0).alias("status"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2101.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') WHEN doc_id % 3 = 1 THEN '2102.00001' END AS id, CASE WHEN doc_id % 3 = 0 THEN TRUE WHEN doc_id % 3 = 1 THEN FALSE ELSE TRUE END AS conflict FROM documents""")
def arxiv_identities(spark, folder):
    k = F.col("doc_id") % 3
    doi = F.when(k == 0, F.concat(F.lit("https://doi.org/10.48550/arXiv.2101."), F.lpad(F.col("doc_id").cast("string"), 5, "0"))).otherwise(F.lit("10.1/other"))
    links = F.when(k == 2, F.array(F.lit("https://arxiv.org/abs/2102.00001"), F.lit("http://arxiv.org/pdf/2102.00002v3.pdf"))).otherwise(F.array(F.lit("https://arxiv.org/abs/2102.00001v2")))
    t = table(spark, folder, "documents").select("doc_id", identity.arxiv_identity(doi, links).alias("x"))
    return t.select("doc_id", F.col("x.id").alias("id"), F.col("x.conflict").alias("conflict"))


@query("""SELECT o_custkey AS work, arg_min(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, CASE WHEN o_orderstatus = 'F' THEN -epoch(o_orderdate) ELSE 0 END, o_orderkey)) AS record FROM orders GROUP BY o_custkey""")
def canonical_text_choice(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("record"), "o_orderdate", "o_orderstatus")
    return identity.canonical_text(o, "work", F.col("o_orderstatus") == "F", "o_orderdate", "record").select("work", "record")


@query("""SELECT p_partkey, array_to_string(list_filter(['steel', 'tin', 'brass'], lambda t: contains(lower(p_type), t)), ',') AS found FROM part""")
def exact_term_hits(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.array_join(hybrid.exact_terms(["steel", "tin", "brass"], F.lower("p_type")), ",").alias("found"))


@query("""SELECT doc_id, replace('a ' || source || ' \\n b', ' \\n', '   ') AS view FROM documents""")
def source_text_views(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.source_view(F.concat(F.lit("a "), "source", F.lit(" \\n b"))).alias("view"))


@query(r"""WITH p AS (SELECT p_partkey AS plan, p_partkey % 11 = 0 AS blank, p_partkey % 3 = 0 AS grouped, p_partkey % 4 = 0 AS excluding, p_name, lower(p_type) AS kind, p_brand, CASE WHEN p_partkey % 5 = 0 THEN 'widget' ELSE split_part(p_name, ' ', 1) END AS anchor FROM part),
h AS (SELECT *, regexp_matches(' ' || p_name || ' ', '[^\w]' || anchor || '[^\w]') AS name_holds, regexp_matches(' ' || kind || ' ', '[^\w]' || anchor || '[^\w]') AS kind_holds FROM p)
SELECT plan, NOT blank AS admissible, CASE WHEN NOT blank THEN NOT grouped AND regexp_full_match(p_name, '[a-z0-9][a-z0-9 \-]{1,}[a-z0-9]') END AS indexable,
  CASE WHEN NOT blank THEN '("' || p_name || '")' || CASE WHEN grouped THEN ' OR (("' || kind || '" OR "' || p_name || ' ' || kind || '") AND ("' || p_brand || '"))' ELSE '' END || CASE WHEN excluding THEN ' NOT ("' || kind || ' toy")' ELSE '' END END AS expression,
  CASE WHEN NOT blank THEN name_holds AND (NOT grouped OR (kind_holds AND name_holds)) END AS implied FROM h""")
def plan_compilation(spark, folder):
    """A search plan for each part, some of them blank, grouped or excluding: may it run, what does it say, does an anchor's cache cover it?"""
    p, n, kind = table(spark, folder, "part"), F.col("p_partkey"), F.lower("p_type")
    groups = F.when(n % 3 == 0, F.array(F.array(kind, F.concat_ws(" ", "p_name", kind)), F.array("p_brand")))
    include = F.array(F.when(n % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(""), "p_name")))
    plans = p.select(n.alias("plan"), include.alias("include"), groups.alias("groups"), F.when(n % 4 == 0, F.array(F.concat(kind, F.lit(' "toy')))).alias("exclude"), F.array(F.when(n % 5 == 0, "widget").otherwise(F.split("p_name", " ")[0])).alias("anchors"))
    return retrieval.compiled(plans)


@query("""SELECT p_partkey, regexp_matches(lower(p_type), '(^| )standard( +[a-z0-9]+){0,1} +(tin|brass)( |$)') AS gap, regexp_matches(lower(p_type), '(^| )standard +(tin|brass)( |$)') AS exact FROM part""")
def gap_patterns(spark, folder):
    key = text.ascii_title_key(F.col("p_type"))
    hit = lambda n: key.rlike(text.gap_pattern(["standard", "tin"], n)) | key.rlike(text.gap_pattern(["standard", "brass"], n))
    return table(spark, folder, "part").select("p_partkey", hit(1).alias("gap"), hit(0).alias("exact"))


@query(f"""SELECT doc_id, {HAS('license')} AS parent, {HAS('license')} AND {HAS('the')} AS in_context FROM documents""")
def parent_topic(spark, folder):
    """A parent topic's terms as whole words, alone and with a context term."""
    from signalweave.functions.text import any_of, has_phrase

    parent, context = any_of([has_phrase(F.col("text"), t) for t in ("license",)]), any_of([has_phrase(F.col("text"), t) for t in ("the",)])
    return table(spark, folder, "documents").select("doc_id", parent.alias("parent"), (parent & context).alias("in_context"))


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '10.1234/ABC' || c_custkey WHEN 1 THEN '10.12/x' WHEN 2 THEN '10.1234/a b' ELSE 'doi:10.1234/x' END AS doi, CASE c_custkey % 3 WHEN 0 THEN 'NSF' WHEN 1 THEN 'EC' ELSE 'UKRI' END AS f, CASE c_custkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'EU' ELSE 'GB' END AS c FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN lower(doi) END AS doi, CASE WHEN f = 'NSF' AND length(CAST(c_custkey AS VARCHAR)) >= 1 THEN 'grant:US:NSF' WHEN f = 'EC' THEN 'grant:EU:EC' END AS scheme, CASE WHEN f IN ('NSF', 'EC') THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS value FROM v""")
def doi_and_grants(spark, folder):
    k = F.col("c_custkey") % 4
    doi = F.when(k == 0, F.concat(F.lit("10.1234/ABC"), "c_custkey")).when(k == 1, "10.12/x").when(k == 2, "10.1234/a b").otherwise("doi:10.1234/x")
    m = F.col("c_custkey") % 3
    funder, place = F.when(m == 0, "NSF").when(m == 1, "EC").otherwise("UKRI"), F.when(m == 0, "US").when(m == 1, "EU").otherwise("GB")
    g = metadata.grant_key(funder, place, F.concat(F.lit(" "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")))
    return table(spark, folder, "customer").select("c_custkey", metadata.valid_doi(doi).alias("doi"), g["scheme"].alias("scheme"), g["value"].alias("value"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'https://arxiv.org/abs/' WHEN 2 THEN 'https://openalex.org/' END || c_custkey AS link FROM customer""")
def source_links(spark, folder):
    k = F.col("c_custkey") % 4
    kind = F.when(k == 0, "doi").when(k == 1, "arxiv").when(k == 2, "openalex").otherwise("isbn")
    return table(spark, folder, "customer").select("c_custkey", metadata.source_links(kind, F.col("c_custkey").cast("string")).alias("link"))


@query("""SELECT p_partkey, array_to_string(list_filter(['title', 'intervention'], lambda f: (f = 'title' AND contains(lower(p_name), 'e')) OR (f = 'intervention' AND contains(lower(p_type), 'e'))), ',') AS fields FROM part""")
def registry_match_fields(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.array_join(metadata.matched_fields(F.lit(" E "), {"title": F.col("p_name"), "intervention": F.col("p_type")}), ",").alias("fields"))


@query("""SELECT source AS topic, CAST(NULL AS BIGINT) AS verified_primary_sources, count(*) FILTER (NOT regexp_matches(lower(split_part(text, chr(10), 1)), '\\b(survey|review|the)\\b')) AS non_review_titles FROM documents GROUP BY source""")
def primary_source_observation(spark, folder):
    """Titles that do not look like reviews are counted; what is verified stays unknown."""
    title = F.lower(F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(spark, folder, "documents").groupBy(F.col("source").alias("topic")).agg(F.lit(None).cast("long").alias("verified_primary_sources"), F.count_if(~title.rlike(r"\b(survey|review|the)\b")).alias("non_review_titles"))


@query("""SELECT page_id, regexp_matches(url, '(?i)^https?://') AND (h = 'example.com' OR ends_with(h, '.example.com')) AS publisher, CASE WHEN ends_with(h, 'org') THEN 'preprint' WHEN contains(h, 'net') THEN 'web' ELSE 'web' END AS kind FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS h FROM pages)""")
def publisher_urls(spark, folder):
    """Addresses on a publisher's domain, and kinds of sources by domain."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    domain = F.when(host.endswith("org"), "arxiv.org").otherwise(host)
    return table(spark, folder, "pages").select("page_id", metadata.publisher_url(F.col("url"), F.lit("example.com")).alias("publisher"), metadata.source_type(domain).alias("kind"))


@query("""SELECT p_partkey AS requested, CASE WHEN p_size % 5 > 0 THEN p_name END AS resolved, CASE WHEN p_size % 5 > 0 THEN 'resolved' ELSE 'not_found' END AS status, p_size % 2 = 0 AS redirected FROM part""")
def redirect_resolution(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("requested"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 == 0, True).alias("missing"), F.lit(None).cast("boolean").alias("invalid"), F.when(F.col("p_size") % 2 == 0, F.array("p_name")).alias("redirects"))
    return metadata.redirect_resolution(p)


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS place, CASE WHEN page_id % 3 > 0 THEN 'r' || (page_id % 40) END AS record_id, url, DATE '2020-01-01' + CAST(page_id % 90 AS INTEGER) AS day FROM (SELECT * FROM pages ORDER BY page_id LIMIT 1000)), g AS (SELECT coalesce(record_id, url) AS identity, min(place) AS place FROM r WHERE regexp_matches(url, '(?i)^https?://') AND day <= DATE '2020-02-29' GROUP BY 1) SELECT identity, place FROM g ORDER BY place LIMIT 50""")
def aggregator_records(spark, folder):
    """An aggregator's bounded answer: usable rows, one an identity, capped in the source's order."""
    from pyspark.sql import Window as W

    answer = table(spark, folder, "pages").orderBy("page_id").limit(1000)
    rows = answer.select((F.row_number().over(W.orderBy("page_id")) - 1).cast("long").alias("place"), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("r"), F.col("page_id") % 40)).alias("record_id"), "url", F.lit("t").alias("title"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 90).cast("int")).alias("day"))
    return metadata.aggregator_records(rows, "2020-01-01", "2020-02-29", 50).select("identity", "place")


@query("""SELECT n_nationkey AS id, sha256('{"id":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS digest FROM nation""")
def canonical_json_hash(spark, folder):
    """SHA-256 of compact JSON with keys in order."""
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.sha2(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))), 256).alias("digest"))


OVERLAP_SQL = "a AS (SELECT DISTINCT o_custkey % 40 AS c, o_custkey AS w FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey % 37 AS c, o_custkey AS w FROM orders WHERE o_orderstatus = 'O'), na AS (SELECT c, count(*) AS n FROM a GROUP BY c), nb AS (SELECT c, count(*) AS n FROM b GROUP BY c), m AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM a JOIN b USING (w) GROUP BY ALL)"


@query(f"WITH {OVERLAP_SQL}, j AS (SELECT m.a, m.b, shared, shared / (na.n + nb.n - shared) AS jac FROM m JOIN na ON na.c = m.a JOIN nb ON nb.c = m.b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, jac DESC, b) AS rank FROM j) SELECT a, b, shared, round(jac, 6) AS jaccard, rank FROM r WHERE rank <= 3")
def composition_overlap(spark, folder):
    o = table(spark, folder, "orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy((F.col("o_custkey") % n).alias("candidate")).agg(F.collect_set("o_custkey").alias("works"))
    return hybrid.overlap_join(side("F", 40), side("O", 37)).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"), F.col("rank").cast("long"))


@query(f"WITH {OVERLAP_SQL}, r AS (SELECT m.*, row_number() OVER (PARTITION BY a ORDER BY shared DESC, nb.n, b) AS k FROM m JOIN nb ON nb.c = m.b) SELECT na.c AS target, r.b AS candidate, r.shared, round(r.shared / na.n, 6) AS recall FROM na LEFT JOIN r ON r.a = na.c AND r.k = 1")
def candidate_recovery(spark, folder):
    o = table(spark, folder, "orders")
    side = lambda s, n, name: o.where(F.col("o_orderstatus") == s).groupBy((F.col("o_custkey") % n).alias(name)).agg(F.collect_set("o_custkey").alias("works"))
    return hybrid.best_recovery(side("F", 40, "target"), side("O", 37, "candidate")).select("target", "candidate", "shared", F.round("recall", 6).alias("recall"))


@query("""SELECT b.o_orderstatus AS before, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE b.o_orderstatus END AS after, TRUE AS was_there, TRUE AS is_there, count(*) AS n FROM orders b GROUP BY 1, 2""")
def policy_transitions(spark, folder):
    o = table(spark, folder, "orders")
    after = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "P").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return hybrid.transitions(o, after, "o_orderkey", "o_orderstatus")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey > 3 AND s_acctbal > 0 THEN s_nationkey / 100 END AS x, CASE WHEN s_nationkey > 3 AND s_acctbal > 0 THEN s_acctbal END AS y, array_to_string(list_filter([CASE WHEN s_nationkey <= 3 THEN 'share_unknown' END, CASE WHEN s_acctbal <= 0 THEN 'slope_unknown' END, CASE WHEN s_suppkey % 3 = 0 THEN 'coverage_not_comparable' END], lambda v: v IS NOT NULL), ',') AS missing FROM supplier""")
def portfolio_map(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") > 3, F.col("s_nationkey") / 100).alias("share"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("slope"))
    return hybrid.portfolio(s, F.col("share"), F.col("slope"), F.col("s_suppkey") % 3 != 0).select("s_suppkey", "x", "y", F.array_join("missing", ",").alias("missing"))


@query("""WITH c AS (SELECT o_orderpriority AS label, o_orderstatus AS channel, list_sort(list(DISTINCT o_custkey % 7)) AS w FROM orders GROUP BY ALL) SELECT array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, CAST(any_value(len(w)) AS BIGINT) AS size, sha256('[' || array_to_string(w, ',') || ']') AS composition FROM c GROUP BY w""")
def merged_compositions(spark, folder):
    c = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("channel")).agg(F.collect_set(F.col("o_custkey") % 7).alias("works"))
    return hybrid.merge_compositions(c).select(F.array_join("channels", ",").alias("channels"), F.array_join("labels", ",").alias("labels"), F.col("size").cast("long").alias("size"), "composition")


@query("""SELECT p_partkey, CASE WHEN len(l) >= 5 AND ends_with(l, 's') AND NOT regexp_matches(l, '(ss|is|us|ics|as|xes)$') THEN l[:-2] ELSE l END AS key FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) || 's' AS l FROM part)""")
def plural_keys(spark, folder):
    return table(spark, folder, "part").select("p_partkey", text.plural_key(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("s"))).alias("key"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(source || ' model for the ' || lang), '[^a-z0-9_]+'), lambda w: w NOT IN ('', 'for', 'the', 'a', 'an', 'and', 'from', 'in', 'new', 'of', 'on', 'or', 'to', 'with')))), ',') AS words FROM documents""")
def relevance_tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(F.array_sort(evidence.relevance_words(F.concat_ws(" ", "source", F.lit("models for the"), "lang"))), ",").alias("words"))


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 6)) AS w FROM documents), m AS (SELECT unnest(w) AS phrase FROM w WHERE list_contains(w, 'license')) SELECT phrase, count(*) AS docs FROM m WHERE phrase <> 'license' GROUP BY phrase HAVING count(*) >= 2 ORDER BY docs DESC, phrase LIMIT 25""")
def companion_phrases(spark, folder):
    """Phrases that stand beside a seed in most documents."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 6))
    d = table(spark, folder, "documents").select("doc_id", words.alias("w")).where(F.array_contains("w", "license"))
    counts = phrases.document_frequency(d, "doc_id", None, "w").where("phrase <> 'license'")
    return phrases.top_phrases(counts, 25, 2).select("phrase", "docs")
