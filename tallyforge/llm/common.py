"""What several operators share: the shared folder, tables cut out of the lineage, word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A maximal run of characters that are not ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Rows whose words a task holds at once.
PIECE = 2000
_LOWER = {ord(a): b for a, b in zip(ASCII_UPPER, ASCII_LOWER)}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors see.

    Only where the session has no such setting (tests on one machine) a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def lower_ascii_py(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def map_batches(df: DataFrame, function: Callable, schema: str | StructType, per_task: Callable | None = None) -> DataFrame:
    """``mapInArrow`` for a function from one batch to one batch, with at most ``PIECE`` rows in a batch.

    What ``per_task`` makes, once in each task, is given to the function as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = (per_task(),) if per_task else ()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                yield function(batch.slice(at, PIECE), *more)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, with null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def give_back() -> None:
    """Returns the worker's free memory to the system.

    An executor's memory is shared by the JVM and all Python workers, and a worker that goes from stage to stage would
    otherwise keep what the allocators of the stages before hold.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))
