"""Text, phrase and source queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.functions import text
from signalweave.operators import phrases, ranking
from signalweave.plans.registry import query
from signalweave.sources import publications
from signalweave.storage import table

#: ASCII words on both sides, so that both engines agree on what a word is.
WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"


def ascii_words(c):
    return F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0))


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as works: the first line is the title, the rest the abstract; doc_id gives the window."""
    title, rest = text.first_sentence(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source", title.alias("title"), rest.alias("abstract"), F.floor(F.col("doc_id") % 12).alias("window"))


def has_sql(field: str, phrase: str) -> str:
    return rf"regexp_matches(lower(regexp_replace(coalesce({field}, ''), '\s+', ' ', 'g')), '(^|[^\p{{L}}\p{{N}}_])' || '{phrase}' || '([^\p{{L}}\p{{N}}_]|$)')"


@query(f"""WITH t AS (SELECT doc_id, doc_id % 12 AS win, list_distinct({WORDS_SQL}) AS w, list_distinct({WORDS_SQL.replace('text', "split_part(text, chr(10), 1)", 1)}) AS tw FROM documents)
SELECT phrase, count(*) AS docs, count(*) FILTER (list_contains(tw, phrase)) AS title_docs, min(win) AS first_day, max(win) AS last_day FROM (SELECT tw, win, unnest(w) AS phrase FROM t) GROUP BY phrase""")
def phrase_df(spark, folder):
    t = docs(spark, folder).select("doc_id", "window", ascii_words(F.col("text")).alias("w"), ascii_words(F.col("title")).alias("tw"))
    return phrases.document_frequency(t, "doc_id", "tw", "w", "window")


@query(f"""WITH t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), n AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrase FROM t WHERE len(w) > 1)
SELECT phrase, count(*) AS docs FROM n GROUP BY phrase ORDER BY docs DESC, phrase LIMIT 100""")
def top_phrases(spark, folder):
    w = ascii_words(F.col("text"))
    t = table(spark, folder, "documents").select("doc_id", phrases.ngrams(w, 2, 2).alias("p"))
    return phrases.top_phrases(phrases.document_frequency(t, "doc_id", None, "p"), 100).select("phrase", "docs")


@query(f"SELECT doc_id, {has_sql('text', 'of the')} AS literal, ({has_sql('text', 'of the')} OR {has_sql('text', 'de la')}) AND NOT {has_sql('text', 'und der')} AS planned FROM documents")
def literal_match(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", text.has_phrase(t, "of the").alias("literal"), text.plan_matches([t], ["of the", "de la"], ["und der"]).alias("planned"))


@query(f"SELECT doc_id, ({has_sql('text', 'released')} OR (({has_sql('text', 'the')} OR {has_sql('text', 'der')}) AND ({has_sql('text', 'with')} OR {has_sql('text', 'und')}))) AND NOT {has_sql('text', 'stupid')} AS matched FROM documents")
def cnf_match(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.concept_matches([F.col("text")], ["released"], [["the", "der"], ["with", "und"]], ["stupid"]).alias("matched"))


_GROUPS = {"english": ["the", "with"], "german": ["der", "und"], "spanish": ["los", "que"]}


@query(f"""SELECT doc_id, CAST({' + '.join(f"CAST({has_sql('text', p)} AS INTEGER)" for p in _GROUPS['english'])} AS BIGINT) AS english, CAST({' + '.join(f"CAST({has_sql('text', p)} AS INTEGER)" for p in _GROUPS['german'])} AS BIGINT) AS german, CAST({' + '.join(f"CAST({has_sql('text', p)} AS INTEGER)" for p in _GROUPS['spanish'])} AS BIGINT) AS spanish FROM documents""")
def concept_coverage(spark, folder):
    hits = text.group_hits({"text": F.col("text")}, _GROUPS)
    t = table(spark, folder, "documents").select("doc_id", hits.alias("h"))
    return t.select("doc_id", *[F.size(F.col("h")[i]["hits"]).cast("long").alias(g) for i, g in enumerate(_GROUPS)])


@query(f"""WITH g AS (SELECT doc_id, CAST({has_sql('text', 'the')} AS INTEGER) + CAST({has_sql('text', 'und')} AS INTEGER) + CAST({has_sql('text', 'que')} AS INTEGER) AS n FROM documents)
SELECT count(*) FILTER (n >= 1) AS any_group, count(*) FILTER (n >= 2) AS two_groups, count(*) FILTER (n = 3) AS all_groups FROM g""")
def group_overlap(spark, folder):
    t = F.col("text")
    n = sum((text.has_phrase(t, p).cast("int") for p in ("the", "und", "que")), F.lit(0))
    return table(spark, folder, "documents").select(n.alias("n")).agg(F.count_if(F.col("n") >= 1).alias("any_group"), F.count_if(F.col("n") >= 2).alias("two_groups"), F.count_if(F.col("n") == 3).alias("all_groups"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'license, version')""")
def trigram_prefilter_equivalence(spark, folder):
    """Rows that hold all trigrams of a phrase, then the phrase itself: the index path gives what a scan gives."""
    phrase = "license, version"
    grams = sorted({phrase[i : i + 3] for i in range(len(phrase) - 2)})
    low = table(spark, folder, "documents").select("doc_id", F.lower("text").alias("t"))
    coarse = low.where(text.all_of([F.col("t").contains(g) for g in grams]))
    return coarse.where(F.col("t").contains(phrase)).select("doc_id")


@query("""WITH t AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS s FROM documents), g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, length(s) - 1)), lambda i: substr(s, i, 3)))) AS gram FROM t WHERE length(s) >= 3)
SELECT gram, count(*) AS docs FROM g GROUP BY gram""")
def trigram_index(spark, folder):
    t = docs(spark, folder).select("doc_id", F.explode(text.trigrams(F.lower("title"))).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("docs"))


@query(f"""WITH t AS (SELECT doc_id, doc_id % 12 AS win, list_distinct({WORDS_SQL.replace('text', "split_part(text, chr(10), 1)", 1)}) AS w FROM documents), m AS (SELECT win, unnest(w) AS phrase FROM t),
tot AS (SELECT count(*) FILTER (win >= 9) AS rn, count(*) FILTER (win >= 3 AND win < 9) AS pn, count(*) AS al FROM t),
p AS (SELECT phrase, count(*) AS works, count(*) FILTER (win >= 9) AS recent, count(*) FILTER (win >= 3 AND win < 9) AS prior FROM m GROUP BY phrase),
l AS (SELECT *, ((recent + 0.5::DOUBLE) / (rn + 1)) / ((prior + 0.5::DOUBLE) / (pn + 1)) AS x FROM p, tot WHERE works >= 3 AND works / al <= 0.2 AND recent >= 2)
SELECT phrase, works, recent, prior, round(x, 3) AS lift, round(ln(1 + recent) * log2(1 + x), 3) AS score FROM l ORDER BY round(ln(1 + recent) * log2(1 + x), 3) DESC, recent DESC, phrase LIMIT 60""")
def title_growth(spark, folder):
    d = docs(spark, folder)
    mentions = d.select("window", F.explode(F.array_distinct(ascii_words(F.col("title")))).alias("phrase"))
    w = F.col("window")
    return phrases.title_growth(mentions, d, w >= 9, (w >= 3) & (w < 9), 3, 0.2, 60)


DIFFUSION_SQL = f"""
t AS (SELECT doc_id AS work, doc_id % 12 AS win, source AS area, list_distinct({WORDS_SQL}) AS w, {WORDS_SQL.replace('text', "split_part(text, chr(10), 1)", 1)} AS tw FROM documents),
m AS (SELECT work, win, area, unnest(w) AS phrase, tw FROM t), tot AS (SELECT count(*) FILTER (win >= 6) AS rn, count(*) FILTER (win < 6) AS pn FROM t),
p AS (SELECT phrase, count(*) FILTER (win >= 6) AS recent_works, count(*) FILTER (win < 6) AS prior_works, count(*) FILTER (list_contains(tw, phrase)) AS title_works, min(win) AS first_window, list_sort(list(DISTINCT work)) AS ids FROM m GROUP BY phrase),
a AS (SELECT phrase, count(*) FILTER (r >= 1) AS recent_areas, count(*) FILTER (q >= 1) AS prior_areas FROM (SELECT phrase, area, count(*) FILTER (win >= 6) AS r, count(*) FILTER (win < 6) AS q FROM m GROUP BY phrase, area) GROUP BY phrase),
j AS (SELECT *, recent_works / rn AS rs, prior_works / pn AS ps, recent_areas - prior_areas AS gain FROM p JOIN a USING (phrase), tot),
k AS (SELECT *, round((rs - ps) * ln(1 + recent_works) * ln(1 + gain), 12) AS priority, sha256('[' || array_to_string(ids, ',') || ']') AS composition FROM j
  WHERE recent_works >= 3 AND rs <= 0.05 AND rs > ps AND (ps = 0 OR rs / ps >= 1.5) AND recent_areas >= 2 AND gain >= 1 AND title_works > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY composition ORDER BY title_works DESC, phrase) AS n, count(*) OVER (PARTITION BY composition) - 1 AS same_works FROM k)"""


def _diffusion(spark: SparkSession, folder: str) -> DataFrame:
    d = docs(spark, folder).select(F.col("doc_id").alias("work"), "window", F.array("source").alias("areas"), F.array_distinct(ascii_words(F.col("text"))).alias("w"), ascii_words(F.col("title")).alias("tw"))
    mentions = d.select("work", "window", "areas", F.explode("w").alias("phrase"), "tw").withColumn("in_title", F.array_contains("tw", F.col("phrase")))
    return phrases.diffusion_candidates(mentions, d, F.col("window") >= 6, F.col("window") < 6)


@query(f"WITH {DIFFUSION_SQL} SELECT phrase, first_window, recent_works, prior_works, round(rs, 9) AS recent_share, recent_areas, prior_areas, title_works, same_works, round(priority, 8) AS priority, composition FROM f WHERE n = 1 ORDER BY f.priority DESC, phrase LIMIT 200")
def diffusion_candidates(spark, folder):
    return _diffusion(spark, folder).select("phrase", "first_window", "recent_works", "prior_works", F.round("recent_share", 9).alias("recent_share"), "recent_areas", "prior_areas", "title_works", "same_works", F.round("priority", 8).alias("priority"), "composition")


@query(f"""WITH {DIFFUSION_SQL}, c AS (SELECT * FROM f WHERE n = 1 ORDER BY priority DESC, phrase LIMIT 200)
SELECT phrase, round((rs - ps) / rs * ln(1 + least(recent_works, 20)) * ln(1 + least(gain, 5)) * pow((first_window + 1) / 12.0, 2), 8) AS emergence FROM c""")
def emergence_rerank(spark, folder):
    return phrases.emergence_rerank(_diffusion(spark, folder), 12, F.col("first_window")).select("phrase", F.round("emergence", 8).alias("emergence"))


@query("""WITH t AS (SELECT doc_id, source, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-zа-яё0-9]+', ' ', 'g')) AS k FROM documents)
SELECT doc_id, CAST(CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 END AS DOUBLE) AS duplicate_rank FROM t""")
def duplicate_rank(spark, folder):
    t = docs(spark, folder).select("doc_id", text.ascii_title_key(F.col("title")).alias("k"))
    return ranking.duplicate_rank(t, "k", ["doc_id"]).select("doc_id", F.col("duplicate_rank").cast("double"))


@query("""WITH t AS (SELECT doc_id, source, sha256(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS story FROM documents)
SELECT story, count(*) AS articles, count(DISTINCT source) AS domains FROM t GROUP BY story""")
def story_groups(spark, folder):
    from signalweave.sources.evidence import syndication

    t = docs(spark, folder).select("doc_id", "source", text.story_fingerprint(F.col("title")).alias("story"))
    return syndication(t, "doc_id", "source", "story").select("story", "articles", "domains")


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_props_extract(spark, folder):
    return table(spark, folder, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's') AS title, len(regexp_extract_all(html, '<meta[^>]*>')) AS metas, regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1) AS host FROM pages""")
def html_meta(spark, folder):
    pages = table(spark, folder, "pages")
    found = publications.html_records(pages, "page_id", "html").select("page_id", "title")
    return pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<meta[^>]*>"), F.lit(0))).cast("long").alias("metas"), text.url_host(F.col("url")).alias("host")).join(found, "page_id").select("page_id", F.coalesce("title", F.lit("")).alias("title"), "metas", "host")


@query(f"""WITH w AS (SELECT doc_id, lang, unnest({WORDS_SQL}) AS t FROM documents), d AS (SELECT lang, t, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang),
s AS (SELECT lang, t, (1 + ln(tf)) * ln((1 + docs) / (1 + df)) AS x FROM d JOIN n USING (lang))
SELECT lang, term, round(x, 6) AS weight FROM (SELECT lang, t AS term, x, row_number() OVER (PARTITION BY lang ORDER BY round(x, 9) DESC, t) AS r FROM s) WHERE r <= 8""")
def top_terms(spark, folder):
    """Terms that tell a group apart: sublinear frequency times rarity inside it."""
    from pyspark.sql import Window as W

    base = table(spark, folder, "documents").select("doc_id", "lang", ascii_words(F.col("text")).alias("w"))
    d = base.select("doc_id", "lang", F.explode("w").alias("t")).groupBy("lang", "t", "doc_id").agg(F.count("*").alias("n")).groupBy("lang", "t").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))
    n = base.groupBy("lang").agg(F.count("*").alias("docs"))
    x = (1 + F.ln("tf")) * F.ln((1 + F.col("docs")) / (1 + F.col("df")))
    ranked = d.join(F.broadcast(n), "lang").withColumn("x", x).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.round("x", 9).desc(), "t")))
    return ranked.where("r <= 8").select("lang", F.col("t").alias("term"), F.round("x", 6).alias("weight"))


@query(None)
def phrase_spans(spark, folder):
    """Phrases with their places in the text; tested against Python."""
    t = phrases.phrase_spans(docs(spark, folder), "doc_id", ["title", "abstract"], 2, 3)
    return t.groupBy("doc_id", "field").agg(F.count("*").alias("spans"), F.count_distinct("phrase").alias("phrases"))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split(lower(split_part(text, chr(10), 1)), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(w, lambda x: CASE WHEN length(x) > 4 AND ends_with(x, 'ies') THEN x[1 : -4] || 'y' WHEN length(x) > 4 AND ends_with(x, 's') AND NOT regexp_matches(x, '(ss|us|is)$') THEN x[1 : -2] ELSE x END), ' ') AS folded FROM t""")
def inflection_keys(spark, folder):
    words = F.array_join(F.filter(F.split(F.lower("title"), " "), lambda x: x != ""), " ")
    return docs(spark, folder).select("doc_id", text.inflection_key(words).alias("folded"))
