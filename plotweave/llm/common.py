"""Shared helpers: table access, the shared folder, written intermediate tables.

Python workers import this package by name, so a cluster needs it on every
executor (``spark.submit.pyFiles`` or an installed wheel).
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``; also what ``bytes.split()`` splits on.
SPACE = " \t\n\x0b\x0c\r"
SLICE_ROWS = 1024
#: Used where the session names no shared folder and runs on this machine alone (tests).
LOCAL_SHARED = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A cluster without one raises: on machine-local folders a table would be read back in part.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or LOCAL_SHARED).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder; it is deleted when the driver ends, if nothing removes it before."""
    name = f"{shared_dir(spark)}/plotweave-{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: what reads the result doesn't recompute ``df``, and the
    files outlive any executor.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def with_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The identifier and the text, a null text as empty, and what else is named."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def no_clash(carry: Sequence[str], *own: str) -> None:
    """Carried columns that have the name of an output, or the same name, raise."""
    clashes = sorted({c for c in carry if c.lower() in own or [d.lower() for d in carry].count(c.lower()) > 1})
    if clashes:
        raise ValueError(f"carried columns clash: {', '.join(clashes)}")


def give_back() -> None:
    """Return memory that this Python worker has freed to the system, so that its peaks don't add up with those of its neighbours."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there is none but in glibc
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows, so that what a function makes of one stays small; freed memory is given back after each batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        give_back()


def byte_values(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column's values."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs, before the next ones write theirs.

    It does so when the objects that stand for them are collected, first here, then in the JVM.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
