"""Previews of several sources told as publications: an order-dependent fold in rounds of independent rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweave.operators.components import components_bounded
from signalweave.storage import Scratch

#: Years between two records of one title, at most; DOIs that a repository gives its own copies.
YEARS, COPY_DOI = 2, "10.48550/arxiv."
FIELDS = ("key", "title", "doi", "arxiv", "authors", "year")


#: Rows of a component up to which it is folded as one array; larger ones go round by round.
TOGETHER = 1_000
#: Rows of a component up to which one task folds it row by row; it holds the component's publications, about 1 KB each.
IN_TASK = 500_000


def _evidence(p: Column, r: Column) -> Column:
    """What the identifiers and names of a publication and a row say, strongest first; null where they are silent."""
    both = lambda name: (F.size(p[name]) > 0) & (F.size(r[name]) > 0)
    share = lambda name: F.arrays_overlap(p[name], r[name])
    equal = lambda name: (p[name] != "") & (p[name] == r[name])
    strangers = both("authors") & ~share("authors")
    own = lambda x: (x["doi"] != "") & ~F.startswith(x["doi"], F.lit(COPY_DOI))
    near = F.coalesce(F.abs(p["year"] - r["year"]) <= YEARS, F.lit(False))
    return (
        F.when(both("arxiv"), share("arxiv"))
        .when(equal("doi"), (p["title"] == r["title"]) | ~strangers)
        .when(own(p) & own(r), False)
        .when(equal("key") & ~F.startswith(p["key"], F.lit("title:")), True)
        .when(equal("title"), both("authors") & share("authors") & near)
    )


def _marks() -> Column:
    """What two previews must share one of to be the same: an identifier, a key or a title."""
    one = lambda letter, c: F.when(F.col(c) != "", F.concat(F.lit(letter), c))
    # A key that only repeats a title says nothing of its own.
    key = F.when(~F.startswith(F.col("key"), F.lit("title:")), one("k", "key"))
    return F.array_distinct(F.concat(F.array_compact(F.array(one("d", "doi"), key, one("t", "title"))), F.transform("arxiv", lambda x: F.concat(F.lit("x"), x))))


def _grown(p: Column, r: Column) -> Column:
    """A publication after it took in a row: it keeps what is stronger and gains what it lacks."""
    has = p["doi"] != ""
    longer = F.length(r["title"]) > F.length(p["title"])
    union = lambda c: F.array_union(p[c], r[c]).alias(c)
    return F.struct(p["into"].alias("into"), F.when(has, p["key"]).otherwise(r["key"]).alias("key"), F.when(longer, r["title"]).otherwise(p["title"]).alias("title"), F.when(has, p["doi"]).otherwise(r["doi"]).alias("doi"), union("arxiv"), union("authors"), F.least(p["year"], r["year"]).alias("year"))


def _as_publication(r: Column) -> Column:
    return F.struct(r["place"].alias("into"), *(r[c].alias(c) for c in FIELDS))


def _folded_together(rows: DataFrame) -> DataFrame:
    """Each component (``component``, place, fields) as one array, folded in order by the engine's own functions."""
    row = F.struct("place", *FIELDS)
    kind = "array<struct<into:bigint,key:string,title:string,doi:string,arxiv:array<string>,authors:array<string>,year:bigint>>"
    start = F.struct(F.array().cast(kind).alias("held"), F.array().cast("array<struct<place:bigint,into:bigint>>").alias("told"))

    def step(done: Column, r: Column) -> Column:
        into = F.get(F.filter(done["held"], lambda p: _evidence(p, r)), 0)["into"]
        taken = F.transform(done["held"], lambda p: F.when(p["into"] == into, _grown(p, r)).otherwise(p))
        held = F.when(into.isNull(), F.concat(done["held"], F.array(_as_publication(r)))).otherwise(taken)
        return F.struct(held.alias("held"), F.concat(done["told"], F.array(F.struct(r["place"].alias("place"), F.coalesce(into, r["place"]).alias("into")))).alias("told"))

    lists = rows.groupBy("component").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return lists.select(F.inline(F.aggregate("rows", start, step, lambda done: done["told"])))


def _same(p: dict, r: dict) -> bool:
    """``_evidence`` of one publication and one row."""
    shared, strangers = p["authors"] & r["authors"], p["authors"] and r["authors"] and not p["authors"] & r["authors"]
    if p["arxiv"] and r["arxiv"]:
        return bool(p["arxiv"] & r["arxiv"])
    if p["doi"] and p["doi"] == r["doi"]:
        return p["title"] == r["title"] or not strangers
    if all(x["doi"] and not x["doi"].startswith(COPY_DOI) for x in (p, r)):
        return False
    if p["key"] and p["key"] == r["key"] and not p["key"].startswith("title:"):
        return True
    return bool(p["title"] and p["title"] == r["title"] and shared and p["year"] is not None and r["year"] is not None and abs(p["year"] - r["year"]) <= YEARS)


def _traces(x: dict) -> list[tuple[str, str]]:
    """What a row or publication can be found by."""
    found = [("x", a) for a in x["arxiv"]]
    found += [(c, x[c]) for c in ("doi", "title") if x[c]]
    return found if not x["key"] or x["key"].startswith("title:") else [*found, ("key", x["key"])]


def _folded_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole components, sorted by component and place, folded one by one; publications are found by their traces."""
    component, held, by = None, {}, {}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["component"] != component:
                component, held, by = r["component"], {}, {}
            r["arxiv"], r["authors"] = set(r["arxiv"]), set(r["authors"])
            # A publication's former traces stay; the evidence itself decides, on what it is now.
            near = sorted({p for t in _traces(r) for p in by.get(t, ())})
            into = next((p for p in near if _same(held[p], r)), None)
            if into is None:
                into = r["place"]
                held[into] = {c: r[c] for c in FIELDS}
            else:
                p = held[into]
                years = [y for y in (p["year"], r["year"]) if y is not None]
                longer = len(r["title"]) > len(p["title"])
                held[into] = {"key": p["key"] if p["doi"] else r["key"], "title": r["title"] if longer else p["title"], "doi": p["doi"] or r["doi"], "arxiv": p["arxiv"] | r["arxiv"], "authors": p["authors"] | r["authors"], "year": min(years, default=None)}
            for t in _traces(held[into]):
                by.setdefault(t, {})[into] = None
            out.append(into)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("place")), pa.array(out, pa.int64())], names=["place", "into"])


def _folded_in_rounds(left: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for components of any size: in each round all rows settle that wait for no other.

    A row's fate depends only on earlier rows that share a mark with it, or with
    a publication it touches. Rows that are the earliest on every such mark and
    publication are settled at once; rounds are as many as rows stand in a line.
    """
    left = scratch.save(left.select("place", *FIELDS, "marks"), "left_0")
    held = scratch.save(left.limit(0).withColumnRenamed("place", "into"), "held_0")
    settled = left.limit(0).select("place", F.col("place").alias("into"))
    n = 0
    while left.limit(1).count():
        n += 1
        own = left.select("place", F.explode("marks").alias("mark"))
        touched = scratch.save(own.join(held.select("into", F.explode("marks").alias("mark")), "mark").select("place", "into").distinct(), f"touched_{n}")
        bound = own.select("place", "mark").unionByName(touched.select("place", F.concat(F.lit("p"), F.col("into").cast("string")).alias("mark")))
        first = bound.groupBy("mark").agg(F.min("place").alias("first"))
        waiting = bound.join(first, "mark").where("first < place").select("place").distinct()
        ready = scratch.save(left.join(waiting, "place", "left_anti"), f"ready_{n}")
        rows, publications = ready.select("place", F.struct("place", *FIELDS, "marks").alias("r")), held.select("into", F.struct("into", *FIELDS, "marks").alias("p"))
        met = touched.join(rows, "place").join(publications, "into").where(_evidence(F.col("p"), F.col("r")))
        found = scratch.save(met.groupBy("place").agg(F.min("into").alias("into")), f"found_{n}")
        settled = settled.unionByName(ready.select("place").join(found, "place", "left").select("place", F.coalesce("into", "place").alias("into")))
        taken = found.join(rows, "place").join(publications, "into")
        grown = taken.select(_grown(F.col("p"), F.col("r")).alias("g"), F.array_union("p.marks", "r.marks").alias("marks")).select("g.*", "marks")
        same = held.join(found.select("into"), "into", "left_anti")
        new = ready.join(found.select("place"), "place", "left_anti").withColumnRenamed("place", "into")
        left = scratch.save(left.join(ready.select("place"), "place", "left_anti"), f"left_{n}")
        # Publications that no waiting row touches are done with.
        live = left.select(F.explode("marks").alias("mark")).distinct()
        every = same.select("into", *FIELDS, "marks").unionByName(grown).unionByName(new.select("into", *FIELDS, "marks"))
        wanted = every.select("into", F.explode("marks").alias("mark")).join(live, "mark", "left_semi").select("into").distinct()
        held = scratch.save(every.join(wanted, "into", "left_semi"), f"held_{n}")
    return settled


def folded_previews(items: DataFrame, together: int = TOGETHER, in_task: int = IN_TASK) -> DataFrame:
    """(place, into): each preview and the place of the first publication, in order, that it belongs to; often its own.

    ``items``: place (unique), key, title, doi, arxiv (array), authors (array), year.
    A publication changes as it takes rows in, so order counts and likeness is
    not transitive. Rows that share marks form components; those of up to
    ``together`` rows are folded as arrays, those of up to ``in_task`` rows in order
    by one task each, larger ones in rounds. Nulls are
    unknown; rows without marks stand alone.
    """
    scratch = Scratch(items.sparkSession, "previews")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    many = lambda c: F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c)
    clean = items.select("place", text("key"), text("title"), F.lower(F.coalesce("doi", F.lit(""))).alias("doi"), many("arxiv"), many("authors"), F.col("year").cast("long").alias("year"))
    marked = scratch.save(clean.withColumn("marks", _marks()), "marked")
    each = marked.select("place", F.explode("marks").alias("mark"))
    parts = components_bounded(each.join(each.groupBy("mark").agg(F.min("place").alias("dst")), "mark").select(F.col("place").alias("src"), "dst"), scratch, "blocks")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    blocked = scratch.save(marked.join(parts.join(sizes, "component").withColumnRenamed("node", "place"), "place", "left").withColumn("component", F.coalesce("component", "place")), "blocked")
    small = _folded_together(blocked.where(F.coalesce("n", F.lit(1)) <= together))
    line = blocked.where((F.col("n") > together) & (F.col("n") <= in_task)).select("component", "place", *FIELDS)
    line = line.repartition("component").sortWithinPartitions("component", "place").mapInArrow(_folded_in_order, "place long, into long")
    large = blocked.where(F.col("n") > max(together, in_task))
    folded = small.unionByName(line)
    return folded.unionByName(_folded_in_rounds(large, scratch)) if large.limit(1).count() else folded
