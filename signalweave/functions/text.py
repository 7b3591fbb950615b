"""String functions and text predicates as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = r"[\-‐‑–—/_]+"


@F.pandas_udf(T.StringType())
def nfkd(values: pd.Series) -> pd.Series:
    """Compatibility decomposition, which Spark has no function for."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def title_key(title: Column) -> Column:
    """NFKD, lower case, punctuation as spaces, single spaces. ASCII titles skip the Python step's effect."""
    plain = F.when(title.rlike(r"[^\x00-\x7F]"), nfkd(title)).otherwise(title)
    return collapse(F.regexp_replace(F.lower(plain), r"(?U)[^\w\s]|_", " "))


def ascii_title_key(title: Column) -> Column:
    """Lower case, runs of anything but a-z, 0-9 and Cyrillic letters as one space."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-zа-яё0-9]+", " "))


def author_key(name: Column) -> Column:
    """Last word and first initial of a title key; a single word stays."""
    words = F.split(title_key(name), " ")
    return F.when(F.size(words) < 2, title_key(name)).otherwise(F.concat(F.element_at(words, -1), F.lit(" "), F.substring(words[0], 1, 1)))


def inverted_abstract(index: Column) -> Column:
    """{word: [places]} as text, by place, then word."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda x: x["w"]), " ")


def clean_doi(doi: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", "")), F.lit(""))


def bare_arxiv_id(value: Column) -> Column:
    """Identifier without prefix, address and version."""
    return F.nullif(F.regexp_extract(F.lower(value), r"(?:arxiv[.:/]|abs/|pdf/)?(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?", 1), F.lit(""))


def normalise(text: Column, orthographic: bool = False) -> Column:
    """Lower case, single spaces; orthographic: hyphens, dashes, slashes and underscores are spaces."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return collapse(F.regexp_replace(low, SEPARATORS, " ") if orthographic else low)


def phrase_pattern(phrase: str, orthographic: bool = False) -> str:
    """A pattern for a whole phrase: no word character on either side, any white space inside."""
    low = phrase.lower()
    words = (re.sub(SEPARATORS, " ", low) if orthographic else low).split()
    return r"(?U)(?<!\w)" + " ".join(map(re.escape, words)) + r"(?!\w)"


def has_phrase(text: Column, phrase: str, orthographic: bool = False) -> Column:
    """Whole-phrase match within one field. A plain substring test runs first and spares most of the patterns."""
    norm = normalise(text, orthographic)
    low = phrase.lower()
    words = (re.sub(SEPARATORS, " ", low) if orthographic else low).split()
    return norm.contains(" ".join(words)) & norm.rlike(phrase_pattern(phrase, orthographic))


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def all_of(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def plan_matches(fields: list[Column], include: list[str], exclude: list[str] = (), orthographic: bool = False) -> Column:
    """Any included phrase in any field and no excluded one in any."""
    hit = any_of([has_phrase(f, p, orthographic) for p in include for f in fields])
    return hit & ~any_of([has_phrase(f, p, orthographic) for p in exclude for f in fields])


def concept_matches(fields: list[Column], literals: list[str], groups: list[list[str]], exclude: list[str] = ()) -> Column:
    """(Any literal, or a hit in every group) and no exclusion."""
    each = lambda ps: any_of([has_phrase(f, p) for p in ps for f in fields])
    whole = all_of([each(g) for g in groups]) if groups else F.lit(False)
    return (each(literals) | whole) & ~each(list(exclude))


def group_hits(fields: dict[str, Column], groups: dict[str, list[str]]) -> Column:
    """Per group the (phrase, field) pairs that match; an empty list is unobserved, not absent."""
    return F.array(*[F.struct(F.lit(g).alias("group"), F.array_compact(F.array(*[F.when(has_phrase(c, p), F.struct(F.lit(p).alias("phrase"), F.lit(f).alias("field"))) for p in ps for f, c in fields.items()])).alias("hits")) for g, ps in groups.items()])


def gap_pattern(words: list[str], gap: int = 0) -> str:
    """Words in order on a normalised title, up to ``gap`` others between neighbours."""
    return r"(?:^| )" + rf"(?: +[a-z0-9]+){{0,{gap}}} +".join(map(re.escape, words)) + r"(?: |$)"


def trigrams(text: Column) -> Column:
    """Different three-character pieces; shorter texts have none."""
    c, n = F.split(text, ""), F.length(text) - 2
    pairs = F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.when(n > 0, F.array_distinct(F.zip_with(pairs, F.slice(c, F.lit(3), n), lambda a, b: F.concat(a, b)))).otherwise(F.array().cast("array<string>"))


#: Words that look like plurals and stay as they are.
UNCHANGED = ["series", "species", "news", "lens", "bias", "physics", "analysis", "basis"]


def plural_key(phrase: Column) -> Column:
    """Regular plural of a phrase's last word folded: -ies to -y, -sses/-ches/-shes and -s dropped.

    Words under five letters, with other than a-z, or in -ss, -is, -us, -ics, -as, -xes stay.
    """
    low = collapse(F.lower(phrase))
    last = F.element_at(F.split(low, " "), -1)
    keep = ~last.rlike("^[a-z]{5,}$") | last.isin(UNCHANGED) | last.rlike("(ss|is|us|ics|as)$")
    return (
        F.when(keep, low).when(last.rlike("^[a-z]{3,}ies$"), F.regexp_replace(low, "ies$", "y")).when(last.rlike("(ss|ch|sh)es$"), F.regexp_replace(low, "es$", ""))
        .when(last.rlike("s$") & ~last.rlike("xes$"), F.regexp_replace(low, "s$", "")).otherwise(low)
    )


def inflection_key(phrase: Column) -> Column:
    """Each word over four letters without its -ies or -s (not -ss, -us, -is)."""

    def fold(w: Column) -> Column:
        long = F.length(w) > 4
        return F.when(long & w.endswith("ies"), F.regexp_replace(w, "ies$", "y")).when(long & w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.regexp_replace(w, "s$", "")).otherwise(w)

    return F.array_join(F.transform(F.split(phrase, " "), fold), " ")


def story_fingerprint(title: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}]+", " ")), 256)


def composition_hash(ids: Column) -> Column:
    """SHA-256 of the compact JSON list of sorted different numbers."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(ids)).cast("array<string>"), ","), F.lit("]")), 256)


def source_view(text: Column) -> Column:
    """Escapes \\n, \\r, \\t beside white space as two blanks, so that offsets hold."""
    return F.regexp_replace(text, r"(?<=\s)\\[nrt]|\\[nrt](?=\s)", "  ")


def tokens(text: Column, pattern: str = r"[a-z]+(?:-[a-z]+)*") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def url_host(url: Column) -> Column:
    """Host of a safe http(s) address without credentials, without ``www.``; else null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(url.rlike(r"^(?i)https?://") & ~url.rlike(r"^[a-zA-Z]+://[^/]*@"), F.regexp_replace(host, r"^www\.", ""))


def first_sentence(text: Column) -> tuple[Column, Column]:
    """(title, abstract): a text's first line, and the rest."""
    return F.substring_index(text, "\n", 1), F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text)))
