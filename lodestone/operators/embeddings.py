"""Embeddings by content: a text that was embedded before, by anybody, isn't sent to the model again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import embed, hashing_embedder

SAVED = "text_hash string, embedding array<float>"


def embedded_text(chunk: Column, embedding_text: Column) -> Column:
    """What a chunk is embedded as: its own text, or else the text made for that; empty if there is neither."""
    given = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(given(chunk), given(embedding_text), F.lit(""))


def with_embeddings(chunks: DataFrame, text: Column, path: str, embedder: Callable[[list[str]], list[list[float]]] = hashing_embedder, *, batch: int = 32, to: str = "embedding") -> DataFrame:
    """``chunks`` with the embedding of ``text``, from the table at ``path`` (text_hash, embedding) where it has it; what it lacks is embedded, once for each text, and added.

    Two writers may add a text twice; readers take either, as they are alike.  A null text is an empty one.
    """
    spark = chunks.sparkSession
    hashed = chunks.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_hash", F.sha2("_text", 256))
    asked = hashed.groupBy("_hash").agg(F.min("_text").alias("_text"))
    try:
        saved = spark.read.schema(SAVED).parquet(path)
        asked = asked.join(saved.select(F.col("text_hash").alias("_hash")), "_hash", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    embed(asked, "_text", "embedding", embedder, batch).select(F.col("_hash").alias("text_hash"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(path)
    known = spark.read.schema(SAVED).parquet(path).groupBy("text_hash").agg(F.any_value("embedding").alias(to))
    return hashed.join(known, F.col("_hash") == F.col("text_hash"), "left").drop("_text", "_hash", "text_hash")
