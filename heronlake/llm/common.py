"""What several operators share: shared scratch folders, stored intermediate tables, files."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder, which spark.checkpoint.dir names.

    Where it is unset, a local run gets a temporary folder and a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; it is not set")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and work is done once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables stored within go to Python in batches of so many rows: memory alone depends on it, no result does."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared ones that nothing reads any more, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of finished work: Spark does so once the driver has collected its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of a membership filter. Its size is the bound of what is broadcast, at every size of the input.
FILTER_BITS = 1 << 24


def perhaps_in(df: DataFrame, ids: DataFrame, columns: list[str], flag: str = "perhaps") -> DataFrame:
    """df with a boolean column: false only for rows whose columns are certainly not those of a row of ids.

    A broadcast bitmap of FILTER_BITS tells most rows that a join would not need before they are shuffled; joins
    that follow decide exactly. With more than about as many ids as bits it tells nothing, and costs no more for it.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    bit = lambda x: F.expr(f"shiftleft(1L, cast({x} & 63 as int))")
    words = ids.select(place.alias("_place")).groupBy((F.col("_place").bitwiseAND(F.lit(-64))).alias("_word")).agg(F.bit_or(bit("_place")).alias("_bits"))
    met = df.withColumn("_place", place).withColumn("_at", F.col("_place").bitwiseAND(F.lit(-64)))
    met = met.join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    return met.withColumn(flag, F.coalesce(F.col("_bits").bitwiseAND(bit("_place")) != 0, F.lit(False))).drop("_place", "_at", "_word", "_bits")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str):
    """pyarrow's file system and the path in it for a URI or a plain path; runs on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file under another name, then rename: a lost or repeated task leaves no half file."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def give_back() -> None:
    """Return freed memory to the system, where the C library offers that."""
    import ctypes
    import gc

    gc.collect()
    if "pyarrow" in sys.modules:
        sys.modules["pyarrow"].default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_state(key: str, make, family: str | None = None):
    """A value kept for the life of a Python worker, across its tasks.

    Values of a family are large; a worker that turns to another family first forgets those of the one before.
    """
    import builtins

    kept = builtins.__dict__.setdefault("_heronlake_worker_state", {})
    if family and key not in kept:
        enter(family)
    if key not in kept:
        kept[key] = family, make()
    return kept[key][1]


def enter(family: str) -> None:
    """A worker's tasks turn to a family of operators: what it keeps for others goes, and the memory with it."""
    import builtins

    kept = builtins.__dict__.setdefault("_heronlake_worker_state", {})
    others = [k for k, (f, _) in kept.items() if f and f != family]
    for other in others:
        del kept[other]
    if others:
        give_back()
