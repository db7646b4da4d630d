"""Tables that are changed in place, bucket by bucket: a write touches the buckets of its keys and leaves the files of all others alone.

A bucket is a folder, by a hash of the key.  What changes is written beside it and put in its place by Spark's
dynamic overwrite when all tasks have ended.  Children (embeddings of files) lie in buckets of the same key, so those of a
replaced parent are looked for in its bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .access import one_of_each
from .shared import staged

BUCKETS = 32


def in_buckets(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``df`` with the column bucket; null keys are keys too."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), buckets).cast("int"))


def write_table(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table at ``path``, a file or more to a bucket."""
    in_buckets(df, keys, buckets).repartition("bucket").sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _numbers(df: DataFrame) -> list[int]:
    """The buckets of ``df``: numbers below that of buckets, whatever its size."""
    return sorted(r.bucket for r in df.select("bucket").distinct().collect())


def _overwrite(path: str, rows: DataFrame, touched: list[int]) -> None:
    """Put ``rows`` in place of the buckets ``touched``, of which those without rows go."""
    spark = rows.sparkSession
    rows = staged(rows, "buckets-next")  # they come from the files that are about to go
    left = _numbers(rows)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in sorted({*touched} - {*left}):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    b = b.select(*(F.col(k).alias(f"_{k}_of") for k in keys), *(["bucket"] if "bucket" in b.columns else [])).withColumnRenamed("bucket", "_bucket_of")
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"_{k}_of"])
    return a.join(b, on, how)


def replace_rows(path: str, new: DataFrame, keys: list[str], *, order: list[Column] | None = None, children: str | None = None, buckets: int = BUCKETS) -> tuple[list[int], list[int]]:
    """Put ``new`` into the table at ``path`` in place of rows with equal keys, and remove the rows of the table ``children`` whose parents were replaced.

    Both tables have ``keys`` and as many ``buckets``.  Of new rows that share a key one_of_each() stays.  Returns the buckets of
    either table that were written; files in others stay as they are.
    """
    spark = new.sparkSession
    table = read_table(spark, path)
    fields = [f for f in table.schema.fields if f.name != "bucket"]
    new = one_of_each(new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)), keys, order)
    new = staged(in_buckets(new, keys, buckets), "buckets-new")
    touched = _numbers(new)
    if not touched:
        return [], []
    old = table.where(F.col("bucket").isin(touched))
    replaced = staged(_null_safe(new.select(*keys, "bucket"), old, keys, "left_semi"), "buckets-replaced")
    columns = [f.name for f in fields]
    _overwrite(path, new.select(*columns, "bucket").unionByName(_null_safe(old, new, keys, "left_anti").select(*columns, "bucket")), touched)
    return touched, remove_children(children, replaced, keys) if children else []


def remove_children(path: str, parents: DataFrame, keys: list[str]) -> list[int]:
    """Remove the rows of the table at ``path`` that belong to ``parents`` (keys..., bucket); returns the buckets that held any."""
    table = read_table(parents.sparkSession, path)
    near = table.where(F.col("bucket").isin(_numbers(parents)))
    held = _numbers(_null_safe(near, parents, keys, "left_semi"))
    if held:
        _overwrite(path, _null_safe(table.where(F.col("bucket").isin(held)), parents, keys, "left_anti"), held)
    return held
