"""Pieces that the training-data operators share.

``cut`` ends a lineage by writing a table into the folder that
``spark.checkpoint.dir`` names (shared by the driver and all executors), so a
lost executor never costs more than the stage that it was running.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words, as a character class of Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, for translate().
SPACES = " \t\n\x0b\x0c\r"
#: Largest number of rows that an operator broadcasts after having counted them.
BROADCAST_ROWS = 2_000_000
#: Bytes of one Arrow batch that goes to a Python worker.
BATCH_BYTES = 2 << 20

_ours: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session, or one of our own where that is unset and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="lamella-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes: a batch of very long texts must not be larger than one of short texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it again; its shuffle files go when it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lamella-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    if not _ours:
        atexit.register(release)
    _ours.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cut_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``cut`` of what ``make`` returns; the tables that ``make`` itself has cut are deleted when it is written."""
    first = len(_ours)
    out = cut(make(), name)
    own = _ours.pop()
    release(first)
    _ours.append(own)
    return out


def release(first: int = 0) -> None:
    """Delete the tables that ``cut`` has written, but for the ``first`` ones."""
    while len(_ours) > first:
        spark, path = _ours.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended; its folder is then the cluster's to clean
            pass


def tidy() -> None:
    """Give memory that a finished partition has used back to the system: workers live on, and two share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)
        tidy()

    return df.mapInArrow(run, schema)


def packed(docs: DataFrame, **columns) -> DataFrame:
    """``docs`` as one struct column ``row``, beside the given expressions over its columns: whatever names its other columns have, none clashes with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[x.alias(name) for name, x in columns.items()])


def unpacked(df: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """The columns of ``docs`` again, and the added ones; these stand in place of columns of ``docs`` with the same name."""
    taken = {x.lower() for x in added}
    return df.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in taken], *added)


def text_key(text="text"):
    """Tells rows with one doc_id apart by their text (null: as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sized_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within ``bound``; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= bound else df
