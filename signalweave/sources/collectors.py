"""Collectors of works by calendar month and cursor, as a Spark data source that reads in batches and as a stream.

A service answers one request a page: ``{"meta": {"count", "next_cursor"},
"results": [{"id", "title", "publication_date", "doi"}]}``. Months are disjoint
and read apart, one input partition each; within a month pages follow the
cursor. Answers come from recorded pages, so that a run can be repeated; another
transport only needs ``get``.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from signalweave.storage import workers_find_package

#: Requests for one page, seconds that an answer may make us wait, pages of a month.
TRIES, LONGEST_WAIT, MAX_PAGES = 3, 10.0, 10_000

WORKS = "month string, page int, place int, id string, title string, publication_date date, doi string"
AUDIT = "month string, page int, cursor string, next_cursor string, attempts int, records int, expected long, unique_ids long, sha256 string, complete boolean, problem string"

_ID = re.compile(r"https://[^/\s]+/[A-Z]\d+")


class SourceError(Exception):
    """An answer that cannot be used; the month is not read further."""


class RecordedPages:
    """Answers kept as Parquet: month=YYYY-MM/ with cursor, attempt, status, retry_after and body.

    A month's cursors are looked up in one pass over its small columns. Its
    bodies are then read forward, a few rows at a time from each file, as pages
    follow one another; a page behind its file's place begins that file again.
    """

    #: Rows of a file that are decoded at once; files of a month that are held open.
    ROWS, FILES = 16, 4

    def __init__(self, folder: str):
        self.folder, self._month = folder, None

    @staticmethod
    def wait(seconds: float) -> None:
        """A recorded answer does not come sooner or later, so nothing waits for it."""

    def _open(self, month: str) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        self._month, self._found, self._readers, self._files = month, {}, {}, []
        self._store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        at = f"{root}/month={month}"
        if self._store.get_file_info(at).type != fs.FileType.Directory:
            return
        self._files = sorted(f.path for f in self._store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
        for k, path in enumerate(self._files):
            with pq.ParquetFile(path, filesystem=self._store) as file:
                row = 0
                for batch in file.iter_batches(columns=["cursor", "attempt"], use_threads=False):
                    for cursor, attempt in zip(batch.column("cursor").to_pylist(), batch.column("attempt").to_pylist(), strict=True):
                        self._found.setdefault(cursor, []).append((attempt, k, row))
                        row += 1

    def _batches(self, k: int) -> Iterator:
        import pyarrow.parquet as pq

        with pq.ParquetFile(self._files[k], filesystem=self._store, pre_buffer=False, buffer_size=1 << 16) as file:
            yield from file.iter_batches(self.ROWS, columns=["status", "retry_after", "body"], use_threads=False)

    def _row(self, k: int, row: int) -> dict:
        held = self._readers.pop(k, None)
        if held is None or row < held[1]:
            batches = self._batches(k)
            held = [batches, 0, next(batches)]
        while row >= held[1] + held[2].num_rows:
            held[1:] = [held[1] + held[2].num_rows, next(held[0])]
        self._readers[k] = held
        if len(self._readers) > self.FILES:
            self._readers.pop(next(iter(self._readers)))[0].close()
        return held[2].slice(row - held[1], 1).to_pylist()[0]

    def get(self, month: str, cursor: str, attempt: int) -> tuple[int, str | None, bytes]:
        """(status, Retry-After, body); 404 where nothing is recorded. Later attempts than recorded get the last answer."""
        # What is not known yet may have been recorded since.
        if month != self._month or all(x[0] != attempt for x in self._found.get(cursor, [])):
            self._open(month)
        known = [x for x in self._found.get(cursor, []) if x[0] <= attempt]
        if not known:
            return 404, None, b""
        _, k, row = max(known, key=lambda x: x[0])
        got = self._row(k, row)
        return got["status"], got["retry_after"], (got["body"] or "").encode()


@lru_cache(64)
def held_pages(folder: str, month: str) -> RecordedPages:
    """The pages of a month as this process has them open, for streams that come back to them."""
    return RecordedPages(folder)


def months(since: str, until: str) -> list[tuple[date, date]]:
    """Calendar months of an inclusive period, the first and last cut to it."""
    at, last = date.fromisoformat(since), date.fromisoformat(until)
    if at > last:
        raise ValueError("the period ends before it begins")
    out = []
    while at <= last:
        after = date(at.year + at.month // 12, at.month % 12 + 1, 1)
        out.append((at, min(last, after - timedelta(days=1))))
        at = after
    return out


def wait_for(retry_after: str | None, attempt: int) -> float:
    """Seconds before the next try: what the answer asks for, at least a growing pause, never more than the bound."""
    try:
        asked = float(retry_after or 0)
    except ValueError:
        asked = 0.0
    return min(LONGEST_WAIT, max(asked if 0 <= asked < float("inf") else 0.0, 1.5 * 2**attempt))


def request(pages, month: str, cursor: str, sleep: Callable[[float], None] | None = None) -> tuple[bytes | None, int]:
    """(body, tries) of a page; None where it does not exist yet. Only an answer of 429 is tried again, after the transport's own wait."""
    sleep = sleep or getattr(pages, "wait", time.sleep)
    for attempt in range(TRIES):
        status, retry_after, body = pages.get(month, cursor, attempt)
        if status == 200:
            return body, attempt + 1
        if status == 404:
            return None, attempt + 1
        if status != 429 or attempt == TRIES - 1:
            raise SourceError(f"{month} {cursor}: answer {status} after {attempt + 1} tries")
        sleep(wait_for(retry_after, attempt))
    raise AssertionError


def parsed(body: bytes) -> tuple[int, str | None, list[dict]]:
    """(count, next cursor, results) of a page of the known shape."""
    try:
        page = json.loads(body)
        count, after, results = page["meta"]["count"], page["meta"]["next_cursor"], page["results"]
        if type(count) is not int or count < 0 or not isinstance(results, list) or not (after is None or isinstance(after, str) and after):
            raise ValueError("count, results or cursor")
        if any(not isinstance(r["id"], str) or not _ID.fullmatch(r["id"]) for r in results):
            raise ValueError("work id")
    except (KeyError, TypeError, ValueError) as error:
        raise SourceError(f"page of an unknown shape: {error}") from error
    return count, after, results


def walk(pages, window: tuple[date, date], start: str = "*", first_page: int = 1, max_pages: int = MAX_PAGES, sleep: Callable[[float], None] | None = None) -> Iterator[tuple[dict, list[dict]]]:
    """(audit record, results) of each page of a month; the last record says whether the month is complete.

    It is complete only if the cursor ended, all ids differ and are as many as
    the service counted, the count stayed the same and every date lies in the
    month. The first problem ends the month; what was read stays a part of it.
    """
    month = f"{window[0]:%Y-%m}"
    cursor, expected, seen, cursors = start, None, set(), set()
    for page in range(first_page, first_page + max_pages):
        record = {"month": month, "page": page, "cursor": cursor, "next_cursor": None, "attempts": 0, "records": 0, "expected": expected, "unique_ids": len(seen), "sha256": None, "complete": False, "problem": None}
        if cursor in cursors:
            yield record | {"problem": "cursor_repeated"}, []
            return
        cursors.add(cursor)
        try:
            body, tries = request(pages, month, cursor, sleep)
            if body is None:
                yield record | {"attempts": tries, "problem": "page_missing"}, []
                return
            count, after, results = parsed(body)
        except SourceError as error:
            yield record | {"problem": f"unusable: {error}"}, []
            return
        ids = [r["id"] for r in results]
        days = [str(r.get("publication_date") or "")[:10] for r in results]
        problem = None
        if expected is not None and count != expected:
            problem = "count_changed"
        elif len(set(ids)) < len(ids) or seen & set(ids):
            problem = "ids_repeated"
        elif any(not f"{window[0]}" <= d <= f"{window[1]}" for d in days):
            problem = "outside_month"
        seen.update(ids)
        expected = count if expected is None else expected
        if problem is None and len(seen) > expected:
            problem = "more_than_counted"
        elif problem is None and after is not None and not results:
            problem = "empty_page_goes_on"
        elif problem is None and after is None and first_page == 1 and len(seen) < expected:
            problem = "fewer_than_counted"
        done = after is None and problem is None
        yield record | {"next_cursor": after, "attempts": tries, "records": len(ids), "expected": expected, "unique_ids": len(seen), "sha256": hashlib.sha256(body).hexdigest(), "complete": done, "problem": problem}, results
        if problem or after is None:
            return
        cursor = after
    yield record | {"page": page + 1, "cursor": cursor, "next_cursor": None, "attempts": 0, "records": 0, "expected": expected, "unique_ids": len(seen), "sha256": None, "complete": False, "problem": "page_limit"}, []


def _rows(record: dict, results: list[dict]) -> Iterator[tuple]:
    for place, r in enumerate(results):
        day = str(r.get("publication_date") or "")[:10]
        yield record["month"], record["page"], place, r["id"], r.get("title"), date.fromisoformat(day) if re.fullmatch(r"\d{4}-\d\d-\d\d", day) else None, r.get("doi")


class MonthPart(InputPartition):
    """A month from one cursor on; ``pages`` bounds what a stream's batch reads of it."""

    def __init__(self, window: tuple[date, date], cursor: str = "*", page: int = 1, pages: int | None = None):
        self.window, self.cursor, self.page, self.pages = window, cursor, page, pages


class MonthParts(InputPartition):
    """Months that one task of a stream reads, as each has few new pages."""

    #: Pages from which a task takes no further month.
    PAGES = 64

    def __init__(self, parts: list[MonthPart]):
        self.parts = parts


class _Options:
    def __init__(self, options):
        self.folder = options["path"]
        until = options.get("until")
        if cutoff := options.get("before"):
            day = str(date.fromisoformat(cutoff) - timedelta(days=1))
            until = min(until, day) if until else day
        self.windows = months(options["since"], until)
        self.max_pages = int(options.get("maxPages", MAX_PAGES))
        self.per_batch = int(options.get("pagesPerBatch", 0))
        self.audit = str(options.get("audit", "false")).lower() == "true"


class MonthReader(DataSourceReader):
    """One partition a month; equality on ``month`` leaves the other months unread."""

    def __init__(self, options):
        self.options = _Options(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("month",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.options.windows = [w for w in self.options.windows if f"{w[0]:%Y-%m}" in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [MonthPart(w) for w in self.options.windows]

    def read(self, part: MonthPart) -> Iterator[tuple]:
        for record, results in walk(RecordedPages(self.options.folder), part.window, max_pages=self.options.max_pages) if part else ():
            if self.options.audit:
                yield tuple(record[c.split()[0]] for c in AUDIT.split(", "))
            else:
                yield from _rows(record, results)


class MonthStream(DataSourceStreamReader):
    """New pages of every month; the offset holds each month's next cursor, so a restart goes on where the last batch ended.

    The driver follows cursors, ``pagesPerBatch`` pages of a month at a time
    (default: all there are); executors read the pages. A page that does not
    exist yet is asked for again in the next batch. Months with few new pages share
    a task, and processes go on in the files that they have open.
    """

    def __init__(self, options):
        self.options, self.at = _Options(options), None

    def initialOffset(self) -> dict:
        self.at = {f"{w[0]:%Y-%m}": ["*", 1] for w in self.options.windows}
        return self.at

    def latestOffset(self) -> dict:
        # After a restart nothing is known of the last batch: all cursors are followed once.
        start, bound = (self.at, self.options.per_batch) if self.at else ({f"{w[0]:%Y-%m}": ["*", 1] for w in self.options.windows}, 0)
        out = {}
        for w in self.options.windows:
            month = f"{w[0]:%Y-%m}"
            cursor, page = start[month]
            read = 0
            while cursor is not None and not (bound and read >= bound):
                body, _ = request(held_pages(self.options.folder, month), month, cursor)
                if body is None:
                    break
                cursor, page, read = parsed(body)[1], page + 1, read + 1
            out[month] = [cursor, page]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        windows = {f"{w[0]:%Y-%m}": w for w in self.options.windows}
        out: list[MonthParts] = []
        for m in sorted(windows):
            if end[m][1] > start[m][1]:
                if not out or sum(p.pages for p in out[-1].parts) >= MonthParts.PAGES:
                    out.append(MonthParts([]))
                out[-1].parts.append(MonthPart(windows[m], start[m][0], start[m][1], end[m][1] - start[m][1]))
        return out

    def read(self, some: MonthParts) -> Iterator[tuple]:
        for part in some.parts:
            for record, results in walk(held_pages(self.options.folder, f"{part.window[0]:%Y-%m}"), part.window, part.cursor, part.page, part.pages):
                if record["problem"] not in (None, "page_limit"):
                    raise SourceError(f"{record['month']} page {record['page']}: {record['problem']}")
                yield from _rows(record, results)

    def commit(self, end: dict) -> None:
        pass


class CollectedWorks(DataSource):
    """``format("collected_works")``: options path, since, until or before (exclusive), maxPages, audit, pagesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "collected_works"

    def schema(self) -> str:
        return AUDIT if _Options(self.options).audit else WORKS

    def reader(self, schema) -> DataSourceReader:
        return MonthReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MonthStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session; filters on months then reach it."""
    workers_find_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectedWorks)


def record_pages(works: DataFrame, folder: str, per_page: int = 100, busy_every: int = 0) -> None:
    """Write works (id, title, publication_date, doi, month, bucket) as recorded pages of at most ``per_page``.

    A bucket of a month is one page and must hold no more; pages follow one
    another by bucket. Every ``busy_every``-th page is first answered by a 429.
    """
    row = F.struct("id", "title", F.col("publication_date").cast("string").alias("publication_date"), "doi")
    paged = works.groupBy("month", "bucket").agg(F.sort_array(F.collect_list(row)).alias("results"))
    order = "over (partition by month order by bucket)"
    linked = paged.withColumns({"n": F.expr(f"row_number() {order}"), "after": F.expr(f"lead(bucket) {order}"), "total": F.expr("sum(size(results)) over (partition by month)")})
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    meta = F.struct(F.col("total").alias("count"), F.when(F.col("after").isNotNull(), name(F.col("after"))).alias("next_cursor"))
    body = F.to_json(F.struct(meta.alias("meta"), "results"), {"ignoreNullFields": "false"})
    busy = F.col("n") % busy_every == 0 if busy_every else F.lit(False)
    good = F.struct(F.when(busy, 1).otherwise(0).alias("attempt"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("retry_after"), body.alias("body"))
    late = F.struct(F.lit(0).alias("attempt"), F.lit(429).alias("status"), F.lit("0").alias("retry_after"), F.lit("").alias("body"))
    answers = F.when(busy, F.array(late, good)).otherwise(F.array(good))
    out = linked.where(F.size("results") <= per_page).select("month", F.when(F.col("n") == 1, "*").otherwise(name(F.col("bucket"))).alias("cursor"), F.inline(answers))
    out.write.mode("append").partitionBy("month").parquet(folder)
