"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import resource
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space; bytes.split() has the same rule.
WORD = r"[^\x20\x09-\x0D]+"

_fallback: list[str] = []

#: Of a step's table on a local disk; other file systems don't know these.
_NO_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share.

    Everything an application leaves there is under ``lodestone-<application id>``.  Where the setting is
    absent, local runs (tests) use a temporary folder that is removed at exit; elsewhere executors would each
    write to a disk of their own, and so ValueError is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="lodestone-"))
            atexit.register(shutil.rmtree, _fallback[0], True)
        root = f"file://{_fallback[0]}"
    return f"{root.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def tasks_for(df: DataFrame, rows: int = 20_000) -> int:
    """How many tasks, and so files, are worth while for work in proportion to ``df``: one for so many of its rows, but one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def files_for(df: DataFrame, rows: int = 100_000) -> int:
    """How many files a small table in proportion to ``df`` is worth: one for so many of its rows."""
    return max(1, -(-df.count() // rows))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: one large file with few row groups would occupy few of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def staged(df: DataFrame, what: str, tasks: int | None = None, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    tasks: the most that make and write it.  files: so many are written, after one more shuffle, however many tasks make
    the rows; for small results of large work.  Each file that Hadoop makes on a local disk costs the executor a program that it
    starts, and another for the checksum file beside it, where Hadoop's native library is missing; such a child counts
    with all of the JVM's memory until it runs.  Hence few files, and no checksum files.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    out = df if tasks is None else df.coalesce(tasks)
    (out if files is None else out.repartition(files)).write.options(**_NO_CHECKSUMS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Remove the folders of staged() frames whose last reader has ended."""
    for df in frames:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/lodestone-{spark.sparkContext.applicationId}/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of finished, unreferenced steps now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_tidied = 0


def _resident() -> int:
    """Bytes of this process in memory; 0 where that can't be read."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()
    except OSError:
        return 0


def tidy_worker(grown: int = 32 << 20) -> None:
    """Give a Python worker's free memory back to the system, once it has grown by so much.

    Workers are reused from stage to stage, and neither Arrow's allocator nor the C library's returns what
    large batches leave behind: a worker would go on holding the most that any of its tasks ever took.
    """
    global _tidied
    if _tidied and 0 < _resident() < _tidied + grown:
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    _tidied = _resident()


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes, one row at least; nothing is copied."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), most)
        yield from pieces(batch.slice(half), most)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, most: int = 4 << 20) -> DataFrame:
    """df.mapInArrow() with batches bounded by bytes, whose memory is given back when a task ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(p for b in batches for p in pieces(b, most))
        finally:
            tidy_worker()

    return df.mapInArrow(bounded, schema)


def uniform(seed: int, *cols: str | Column) -> Column:
    """A repeatable number in (0, 1) for each distinct value of ``cols``."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
