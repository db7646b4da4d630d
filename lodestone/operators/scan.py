"""Scans that stop as soon as they have enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession


def files_of(df: DataFrame) -> list[str]:
    """The files that ``df`` reads, in the order of their names."""
    return sorted(df.inputFiles())


def first_matches(spark: SparkSession, paths: list[str], read: Callable[[str], DataFrame], condition: Column | None = None, n: int = 20) -> DataFrame:
    """The first ``n`` rows that fulfil ``condition``, in the order of ``paths`` and of the rows in each.

    Files are opened one after the other, and of each Spark reads first one split, then some more, until there are enough
    rows: a hit near the beginning costs a task or two, whatever the size of the rest.  At most ``n`` rows pass through the driver.
    """
    found: list[Row] = []
    df = None
    for path in paths:
        df = read(path)
        rest = (df if condition is None else df.where(condition)).take(n - len(found)) if len(found) < n else []
        found += rest
        if len(found) >= n:
            break
    if df is None:
        raise ValueError("there is no file to read")
    return spark.createDataFrame(found, df.schema)


def table_reader(spark: SparkSession, path: str, rows: int = 1000) -> tuple[list[str], Callable[[str], DataFrame]]:
    """(files, reader of one of them) of a csv or tsv file, or of a folder of such files.

    Types are told from the first ``rows`` lines, so that the whole isn't read for them; a later value of another kind is null.
    """
    found = files_of(spark.read.text(path))
    if not found:
        return [], lambda p: spark.read.text(p)
    sep = "\t" if found[0].lower().endswith((".tsv", ".tsv.gz")) else ","
    lines = [r.value for r in spark.read.text(found[0]).take(rows)]
    kind = spark.read.csv(spark.sparkContext.parallelize(lines, 1), header=True, inferSchema=True, sep=sep).schema
    return found, lambda p: spark.read.csv(p, header=True, schema=kind, sep=sep)
