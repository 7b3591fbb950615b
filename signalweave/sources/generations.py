"""Results of a run as one generation: several tables appear together or not at all."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalweave.operators.ranking import numbered
from signalweave.storage import Scratch


def content_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table whatever its order: sums of four parts of each row's SHA-256, combinable on the way."""
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    got = df.select(row.alias("h")).agg(F.count("*").alias("n"), *parts).first()
    return got.n, hashlib.sha256(",".join([*names, str(got.n), *(str(int(got[f"p{k}"] or 0)) for k in range(4))]).encode()).hexdigest()


class Generations:
    """A folder of generations and a pointer to the current one.

    A run's tables are written under a new name first; a manifest with rows and
    digest of each follows, sealed by its own hash; last the pointer moves, by one
    rename. Who dies before that leaves the old generation as it was. Readers
    take the pointer once, so they never see tables of two runs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), spark._jsc.hadoopConfiguration()) if "://" in root or root.startswith("file:") else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").collect())

    def publish(self, tables: dict[str, DataFrame], run: str, partition_by: dict[str, list[str]] | None = None, most_rows: int | None = None) -> str:
        """Write, check, seal and switch; returns the generation's name. ``most_rows`` bounds a table, which then fails whole."""
        if not tables or not re.fullmatch(r"[\w-]+", run) or any(not re.fullmatch(r"\w+", n) for n in tables):
            raise ValueError("a generation has a run and tables of plain names")
        name = f"generation-{run}-{uuid.uuid4().hex[:12]}"
        entries = []
        for table in sorted(tables):
            df = tables[table]
            df.write.mode("error").option("compression", "zstd").partitionBy(*(partition_by or {}).get(table, [])).parquet(f"{self.root}/{name}/{table}")
            rows, digest = content_digest(self._table(name, table, df.schema.json()))
            if most_rows is not None and rows > most_rows:
                raise ValueError(f"{table} has {rows} rows, more than {most_rows}; nothing is published")
            entries.append({"table": table, "schema": df.schema.json(), "rows": rows, "sha256": digest})
        body = {"generation": name, "run": run, "tables": entries}
        text = json.dumps(body, sort_keys=True)
        self._write(f"{name}/manifest.json", json.dumps({"body": body, "sha256": hashlib.sha256(text.encode()).hexdigest()}))
        self.switch(name)
        return name

    def switch(self, name: str) -> None:
        """Make a sealed generation the current one, by one rename over the pointer."""
        self.manifest(name)
        fresh = f"CURRENT-{uuid.uuid4().hex}"
        self._write(fresh, name)
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._context.rename(self._path(fresh), self._path("CURRENT"), options)

    def current(self) -> str | None:
        return self._read("CURRENT") if self._fs.exists(self._path("CURRENT")) else None

    def manifest(self, name: str) -> dict:
        held = json.loads(self._read(f"{name}/manifest.json"))
        if hashlib.sha256(json.dumps(held["body"], sort_keys=True).encode()).hexdigest() != held["sha256"] or held["body"]["generation"] != name:
            raise ValueError(f"the manifest of {name} is not the one that was sealed")
        return held["body"]

    def _table(self, name: str, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.root}/{name}/{table}")

    def read(self, table: str, name: str | None = None, verify: bool = False) -> DataFrame:
        """A table of the current generation, or of a named one; ``verify`` counts and hashes it first."""
        name = name or self.current()
        if name is None:
            raise ValueError("nothing was published yet")
        entry = next((e for e in self.manifest(name)["tables"] if e["table"] == table), None)
        if entry is None:
            raise ValueError(f"{name} has no table {table}")
        df = self._table(name, table, entry["schema"])
        if verify and content_digest(df) != (entry["rows"], entry["sha256"]):
            raise ValueError(f"{table} of {name} is not what its manifest says")
        return df

    def clear_unfinished(self) -> int:
        """Remove generations that were never sealed; returns how many. Only while no run publishes."""
        gone = 0
        for held in self._fs.listStatus(self._path("")):
            name = held.getPath().getName()
            if name.startswith("generation-") and not self._fs.exists(self._path(f"{name}/manifest.json")):
                gone += bool(self._fs.delete(held.getPath(), True))
        return gone


def ordered_export(rows: DataFrame, order: list[Column], line: Column, path: str, per_chunk: int = 1000) -> DataFrame:
    """Write ``line`` of each row as text in order; returns (chunk, lines, sha256) of each run of ``per_chunk`` lines.

    The order is total if ``order`` is; ranges of it are numbered apart, and files
    follow one another by name. ``seal`` makes one hash of the chunks'. All columns
    of ``rows`` are written once: give those of the order and the line.
    """
    scratch = Scratch(rows.sparkSession, "export")
    placed = numbered(rows.withColumn("line", line), order, scratch).select("line", F.col("number").alias("at"))
    chunked = placed.withColumn("chunk", F.floor(F.col("at") / per_chunk))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked.repartitionByRange(parts, "chunk").sortWithinPartitions("at").select("line").write.mode("error").text(path)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    return scratch.save(chunked.groupBy("chunk").agg(F.count("*").alias("lines"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("sha256")), "chunks")


def seal(chunks: DataFrame) -> str:
    """SHA-256 over the chunks' hashes in order, folded a thousand at a time so that the driver sees one."""
    level = chunks.select(F.col("chunk").alias("at"), "sha256")
    while level.limit(2).count() > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sha256"))), lambda x: x["sha256"]), "")
        level = level.groupBy(F.floor(F.col("at") / 1000).alias("up")).agg(F.sha2(joined.cast("binary"), 256).alias("sha256")).select(F.col("up").alias("at"), "sha256")
    got = level.first()
    return got.sha256 if got else hashlib.sha256(b"").hexdigest()


def publish_vector_index(store: Generations, rows: DataFrame, key: str, vector: str, run: str, links: int = 3) -> str:
    """Publish a catalogue's vectors, of length one, with each one's ``links`` nearest others as candidate links; both or neither appear.

    Links are candidates for review: (key, near, similarity, rank). Rows without
    a usable vector are left out of both tables.
    """
    from signalweave.functions.vectors import norm, unit
    from signalweave.operators import vectors

    v = F.col(vector).cast("array<double>")
    held = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), v.alias("vector")).where(norm(F.col("vector")) > 0)
    held = Scratch(rows.sparkSession, "index").save(held.select(key, unit(F.col("vector")).alias("vector")), "vectors")
    near = vectors.nearest(held, key, "vector", held, key, "vector", links, exclude_self=True)
    table = near.toDF(*("near" if c not in (key, "similarity", "rank") else c for c in near.columns))
    return store.publish({"vectors": held, "links": table}, run)
