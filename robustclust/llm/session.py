"""Session helpers: the shared folder, staged tables and their removal, block sizing."""

from __future__ import annotations

import ctypes
import gc
import inspect
import re
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A session on one machine (tests) may name none and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{tempfile.gettempdir()}/robustclust-shared"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: for each open scratch of this thread the folders staged in it
_scopes = threading.local()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted with the scratch that it is made in."""
    path = f"{shared_dir(spark)}/robustclust-{name}-{uuid.uuid4().hex}"
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_in = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def unstaged(table: DataFrame) -> None:
    """Delete a staged table that nothing will read any more."""
    delete(table.sparkSession, table._staged_in)


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished work: it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession):
    """What is staged inside goes on leaving, but for the tables given to the function this yields (df, name -> table)."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    own: list[str] = []
    _scopes.open.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        own.remove(out._staged_in)
        if len(_scopes.open) > 1:
            _scopes.open[-2].append(out._staged_in)
        return out

    try:
        yield keep
    finally:
        _scopes.open.remove(own)
        for path in own:
            delete(spark, path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with underscores added, so that it clashes with none of ``taken`` (column names ignore case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


#: ids (with at most a few numbers each) that may be broadcast, counted before
BROADCAST_IDS = 1_000_000
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def light_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """Sees to it that batches of long texts stay small in the Python workers: 8 MB unless the session has less."""
    spark = df.sparkSession
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(BATCH)) or 0) <= most:
        spark.conf.set(BATCH, str(most))
    return df


#: when this process last gave memory back
_given_back = [0.0]


def give_back(least: float = 0.0) -> None:
    """Returns a Python worker's freed memory to the system, at most once in ``least`` seconds."""
    now = time.monotonic()
    if now - _given_back[0] < least:
        return
    _given_back[0] = now
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def lean(run):
    """``run`` over batches, or over a group, after which freed memory goes back: workers stay, idle, for later stages."""
    if inspect.isgeneratorfunction(run):

        def over(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

        return over

    def of(group):
        try:
            return run(group)
        finally:
            give_back(0.2)

    return of


def buckets_for(rows_or_bytes: int, each: int, least: int = 1) -> int:
    """How many buckets keep each near ``each``; grows with the input without a ceiling."""
    return max(least, -(-int(rows_or_bytes) // each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


def crc_mod(column, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``: the folds of the contracts (a null id is in fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(0))
