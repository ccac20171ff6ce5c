"""A store of month-partitioned fact tables and single dimension tables, with idempotent upserts.

All paths go through Spark, so a store can lie in any file system that Spark reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from tallyforge.schemas import DIMENSIONS, FACTS, KEYS, TABLES, described


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the schema's columns, cast and in order; a missing or further column raises."""
    missing, more = [c for c in schema.names if c not in df.columns], [c for c in df.columns if c not in schema.names]
    if missing or more:
        raise ValueError(f"columns missing: {missing}; not declared: {more}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def reshaped(df: DataFrame, schema: StructType) -> DataFrame:
    """Declared columns cast, missing ones null, others left out."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def describe(spark: SparkSession, table: str | None = None) -> DataFrame:
    """Columns of one table, or of all, in order: type, whether part of the natural key, and what they hold."""
    if table is not None and table not in TABLES:
        raise KeyError(f"no table {table!r}; tables are {', '.join(TABLES)}")
    rows = [(t, k, f.name, f.dataType.simpleString(), f.name in KEYS[t], described(f.name)) for t in ([table] if table else TABLES) for k, f in enumerate(TABLES[t])]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, key boolean, description string")


def spark_type(kind: pa.DataType) -> str:
    """The name that Spark gives a stored type."""
    if pa.types.is_timestamp(kind):  # the older form of timestamps names no zone
        return "timestamp"
    return from_arrow_type(kind).simpleString()


def with_month(df: DataFrame, at: str = "start_time") -> DataFrame:
    return df.withColumn("month", F.date_format(at, "yyyy-MM"))


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    fallback: str | None = None  # where dimension tables are that this store lacks

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise KeyError(f"no table {table!r}; tables are {', '.join(TABLES)}")
        return f"{self.root}/{'assets/' if table in DIMENSIONS else ''}{table}"

    def holds(self, path: str) -> bool:
        """Whether there is a file, or a folder with files."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(hadoop) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(hadoop))

    def exists(self, table: str) -> bool:
        return self.holds(self.path(table))

    def scan(self, table: str) -> DataFrame:
        path = self.path(table)
        if table in DIMENSIONS and self.fallback and not self.exists(table):
            path = Store(self.spark, self.fallback).path(table)
        schema = TABLES[table]
        return self.spark.read.schema(StructType([*schema.fields]).add("month", "string") if table in FACTS else schema).parquet(path)

    def file_schemas(self, table: str) -> DataFrame:
        """One row per stored file: its ``path``, its ``month`` (null for dimensions) and the ``columns`` that its footer declares.

        Footers are read in Spark tasks, one per file, so a table of many months is one job.
        """
        path = self.path(table)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
        listed = files.select("path", F.regexp_extract("path", r"/month=([^/]*)/", 1).alias("month"))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for uri in batch.column("path").to_pylist():
                    store, where = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
                    with store.open_input_file(where) as file:
                        found.append([{"name": f.name, "type": spark_type(f.type)} for f in pq.read_schema(file)])
                kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("month"), pa.array(found, kind)], ["path", "month", "columns"])

        out = listed.mapInArrow(read, "path string, month string, columns array<struct<name: string, type: string>>")
        return out.withColumn("month", F.nullif("month", F.lit("")))

    def drifted(self, table: str) -> DataFrame:
        """Files whose columns or their types differ from the declared ones: month, path, ``missing``, ``more``, ``changed``."""
        declared = {f.name: f.dataType.simpleString() for f in TABLES[table]}
        names, known = F.array(*map(F.lit, declared)), F.create_map(*(F.lit(x) for pair in declared.items() for x in pair))
        stored = F.transform("columns", lambda c: c["name"])
        changed = F.filter("columns", lambda c: known[c["name"]].isNotNull() & (known[c["name"]] != c["type"]))
        rows = self.file_schemas(table).select(
            "month", "path", F.sort_array(F.array_except(names, stored)).alias("missing"), F.sort_array(F.array_except(F.array_remove(stored, "month"), names)).alias("more"),
            F.sort_array(F.transform(changed, lambda c: F.concat(c["name"], F.lit(" "), c["type"]))).alias("changed"),
        )
        return rows.where("size(missing) + size(more) + size(changed) > 0")

    def drift(self, table: str) -> str | None:
        """How the stored columns differ from the declared ones, if they do, and in which months."""
        if not self.exists(table):
            return f"{table} is missing"
        found = self.drifted(table).groupBy("missing", "more", "changed").agg(F.sort_array(F.collect_set("month")).alias("months")).orderBy("missing", "more", "changed").collect()
        said = [f"{'in ' + ', '.join(r.months) + ' ' if r.months else ''}missing {r.missing}, more {r.more}, changed {r.changed}" for r in found]
        return f"{table}: {'; '.join(said)}" if said else None

    def heal(self, table: str) -> list[str]:
        """Rewrites only the months that drifted; the months are returned.  A table without months is rewritten whole."""
        if table not in FACTS:
            if self.drifted(table).isEmpty():
                return []
            self.reshape(table)
            return [table]
        months = sorted(r.month for r in self.drifted(table).select("month").distinct().collect())
        for month in months:  # each may have types of its own
            path = f"{self.path(table)}/month={month}"
            rows = reshaped(self.spark.read.option("mergeSchema", "true").parquet(path), TABLES[table])
            staged = self.staged(f"{table}-{month}", rows.repartitionByRange("match_id").sortWithinPartitions("match_id") if "match_id" in rows.columns else rows)
            self.spark.read.schema(TABLES[table]).parquet(staged).write.mode("overwrite").parquet(path)
            self.clear(staged)
        return months

    def staged(self, name: str, rows: DataFrame) -> str:
        """Writes rows beside the tables, under a new name; ``clear`` takes them away again."""
        path = f"{self.root}/.staging/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def clear(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def overwrite(self, table: str, df: DataFrame) -> None:
        if table in FACTS:
            body = with_month(conform(df, TABLES[table])) if "start_time" in df.columns else df
            body.repartitionByRange("month", "match_id").sortWithinPartitions("month", "match_id").write.mode("overwrite").partitionBy("month").parquet(self.path(table))
        else:
            conform(df, TABLES[table]).write.mode("overwrite").parquet(self.path(table))

    def upsert(self, table: str, batch: DataFrame) -> None:
        """Writes a batch of whole matches: rows of its matches in the months that it touches are replaced.

        The months' new content is written beside the table first, for a path can't be overwritten while it is read, and
        taken away at the end; running the same batch again changes nothing.  A month's rows are written by as many tasks as their ranges of
        matches fill.  A table whose columns drifted from the declared ones is refused; ``reshape`` mends it.
        """
        batch = with_month(conform(batch, TABLES[table]))
        if self.exists(table):
            if said := self.drift(table):
                raise ValueError(said)
            months = batch.select("month").distinct()
            stored = self.scan(table).join(F.broadcast(months), "month", "left_semi")  # a row for each month
            batch = stored.join(batch.select("match_id").distinct(), "match_id", "left_anti").unionByName(batch)
        staging = self.staged(table, batch)
        rows = self.spark.read.schema(batch.schema).parquet(staging)
        rows.repartitionByRange("month", "match_id").sortWithinPartitions("month", "match_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.path(table))
        self.clear(staging)

    def new_only(self, docs: DataFrame) -> DataFrame:
        """Documents of matches that the store does not hold."""
        return docs.join(self.scan("matches").select("match_id"), "match_id", "left_anti") if self.exists("matches") else docs

    def reshape(self, table: str) -> None:
        """Rewrites a table whose stored columns drifted to the declared ones, in order of its matches."""
        stored = self.spark.read.option("mergeSchema", "true").parquet(self.path(table))
        schema = StructType([*TABLES[table].fields, *([stored.schema["month"]] if "month" in stored.columns else [])])
        staging = self.staged(table, reshaped(stored, schema))
        rows = self.spark.read.schema(schema).parquet(staging)
        by = [c for c in ("month", "match_id") if c in schema.names]
        out = (rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows).write.mode("overwrite")
        (out.partitionBy("month") if "month" in schema.names else out).parquet(self.path(table))
        self.clear(staging)

    def counts(self) -> dict[str, int]:
        return {t: self.scan(t).count() for t in TABLES if self.exists(t)}
