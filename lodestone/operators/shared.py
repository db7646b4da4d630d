"""Tables that operators write for themselves: steps of one job, and indexes that later queries of an application find again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: list[str] = []
_known: dict[tuple, dict[str, DataFrame]] = {}


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share, below ``lodestone-<application id>``.

    Where the setting is absent, local sessions (tests) use a temporary folder that is removed at exit; elsewhere
    executors would each write to a disk of their own, and so ValueError is raised.
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


def spread(df: DataFrame) -> DataFrame:
    """``df`` in more partitions, if it has fewer than there are cores: one file with few row groups would occupy few of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def staged(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Write ``df`` (in folders by the column ``by``) to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner real sizes."""
    path = shared_path(df.sparkSession, what)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes, one row at least; nothing is copied."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), most)
        yield from pieces(batch.slice(half), most)


def remembered(source: DataFrame, kind: str, build: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables that ``build`` makes of ``source``, made once in an application while the files that ``source`` reads stay as they are.

    Files are told apart by path, size and time of change; a source that isn't read from files is built anew.
    """
    state = None
    if files := source.inputFiles():
        meta = source.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n"), F.col("_metadata.file_modification_time").cast("double").alias("t")).distinct()
        state = tuple(meta.agg(F.count("*"), F.sum("n"), F.max("t"), F.sum(F.xxhash64("p", "n", "t").cast("decimal(38,0)"))).first())
    key = (source.sparkSession.sparkContext.applicationId, kind, tuple(source.columns), state, len(files), files[0] if files else None)
    if state is None:
        return build(source)
    if key not in _known:
        _known[key] = build(source)
    return _known[key]
