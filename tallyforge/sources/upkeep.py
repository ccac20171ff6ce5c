"""Upkeep of a store: matches written again, tables rebuilt with what can't be decoded any more, older layouts, new prices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.operators.records import merged_ledger
from tallyforge.schemas import FACTS, KEYS, TABLES
from tallyforge.sources.matches import normalize
from tallyforge.sources.store import Store, conform, reshaped, with_month


def reexport(store: Store, docs: DataFrame, ids: DataFrame | None = None, **names) -> None:
    """Writes the matches of ``docs`` (of those the ones in ``ids``) again; all other matches stay as they are.

    The ids are written down first, for they may come from the very tables that change.
    """
    if ids is not None:
        path = store.staged("ids", ids.select("match_id").distinct())
        docs = docs.join(store.spark.read.parquet(path), "match_id", "left_semi")
    for table, rows in normalize(docs, **names).items():
        store.upsert(table, rows)
    if ids is not None:
        store.clear(path)


def reprice(store: Store, docs: DataFrame, horizon: str, **names) -> None:
    """Writes matches again that began after the last price era known when they were written."""
    reexport(store, docs, store.scan("matches").where(F.col("start_time") > F.lit(horizon).cast("timestamp")), **names)


def rebuild(store: Store, docs: DataFrame, **names) -> None:
    """Tables made anew from ``docs``; matches without a document keep their old rows, fitted to the declared columns.

    A table is written beside the old one first and takes its place by renaming, so the old one is whole until then.
    """
    spark, decoded = store.spark, docs.select("match_id").distinct()
    for table, rows in normalize(docs, **names).items():
        rows = with_month(conform(rows, TABLES[table]))
        if store.exists(table):
            old = reshaped(spark.read.option("mergeSchema", "true").parquet(store.path(table)), StructType([*TABLES[table].fields]).add("month", "string"))
            rows = old.join(decoded, "match_id", "left_anti").unionByName(rows)
        staging = f"{store.root}/.staging/{table}-{uuid.uuid4().hex}"
        rows.repartitionByRange("month", "match_id").write.partitionBy("month").parquet(staging)
        take_place(store, staging, table)
    fill_missing(store)


def export_new(store: Store, docs: DataFrame, **names) -> dict[str, int]:
    """Brings a store up to ``docs``: what drifted is mended first, then matches that it lacks are added; rows per table.

    Months that only hold columns that are no longer declared, or other types, are rewritten from themselves; where columns
    are missing all tables are made anew from the documents, with old rows carried forward.
    """
    drifted = {t: store.drifted(t) for t in FACTS if t != "downloads" and store.exists(t)}
    if any(not rows.where("size(missing) > 0").isEmpty() for rows in drifted.values()):
        rebuild(store, docs, **names)
    else:
        for table in drifted:
            store.heal(table)
        reexport(store, docs, store.new_only(docs.select("match_id")), **names)
        fill_missing(store)
    return store.counts()


def take_place(store: Store, staging: str, table: str) -> None:
    """Renames a written table to its place; the one there before goes away last."""
    jvm = store.spark._jvm
    new, live = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(store.path(table))
    fs = live.getFileSystem(store.spark._jsc.hadoopConfiguration())
    backup = jvm.org.apache.hadoop.fs.Path(f"{staging}-before")
    fs.mkdirs(live.getParent())
    had = fs.exists(live)
    if had and not fs.rename(live, backup):
        raise OSError(f"{live} can't be moved")
    if not fs.rename(new, live):
        if had:
            fs.rename(backup, live)
        raise OSError(f"{new} can't be moved")
    if had:
        fs.delete(backup, True)


def fill_missing(store: Store) -> list[str]:
    """Fact tables that the store lacks get an empty partition of its first month, so that they can be read."""
    if not store.exists("matches"):
        return []
    month = store.scan("matches").agg(F.min("month")).first()[0]
    lacking = [t for t in FACTS if t != "downloads" and not store.exists(t)] if month else []
    for table in lacking:
        store.spark.createDataFrame([], TABLES[table]).coalesce(1).write.mode("overwrite").parquet(f"{store.path(table)}/month={month}")
    return lacking


def migrate(store: Store, legacy: str) -> list[str]:
    """Tables of one file each (``<table>.parquet`` below ``legacy``) into months, by the start of their match.

    Rows of matches that the old ``matches`` lacks are left out; columns that are no longer declared as well.
    """
    spark, moved = store.spark, []
    starts = spark.read.parquet(f"{legacy}/matches.parquet").select("match_id", "start_time").dropDuplicates(["match_id"])
    old = Store(spark, legacy)
    for table in FACTS:
        path = f"{legacy}/{table}.parquet"
        if table == "downloads" or not old.holds(path):
            continue
        rows = spark.read.parquet(path).drop("start_time").join(starts, "match_id")
        store.upsert(table, reshaped(rows, TABLES[table]))
        moved.append(table)
    return moved


def extend_from_ledger(store: Store, downloads: DataFrame, docs: DataFrame, **names) -> dict[str, int]:
    """A second store: new downloads merged into its ledger, matches that it lacks added; rows per table are returned.

    What drifted is mended first, as of ``export_new``.
    """
    export_new(store, docs, **names)
    parts = [conform(downloads, TABLES["downloads"])] + ([store.scan("downloads").drop("month")] if store.exists("downloads") else [])
    staging = f"{store.root}/.staging/downloads-{uuid.uuid4().hex}"
    conform(merged_ledger(*parts, keys=KEYS["downloads"], at="downloaded_at"), TABLES["downloads"]).write.parquet(staging)
    take_place(store, staging, "downloads")
    return store.counts()


def sample(store: Store, table: str, n: int) -> DataFrame:
    return store.scan(table).limit(n)
