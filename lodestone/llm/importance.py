"""Quality by importance resampling.

Two bag-of-hashed-n-grams models, one of target text and one of all (raw) text, give every document
the log importance weight log p_target(text) - log p_raw(text).  Adding Gumbel noise to the log
weights and keeping the k largest sums draws k documents without replacement in proportion to the
weights.  k is a share of the documents; nothing is ranked in one task: the k-th largest key is
found by counting keys in ever finer bins.

Edge cases: a null text, or one without words, has no n-grams and log weight 0; documents with equal
text differ only in their noise, which depends on the seed, the id and the text; equal rows draw one
noise, and of those that tie at the threshold any may be kept, as many as there is room for; an empty table gives no rows; without target
documents both models are alike and the choice is by noise alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, staged, uniform, unused

_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed_ngrams(text: str | None, buckets: int) -> np.ndarray:
    """Bucket of every word and every pair of neighbouring words of a whole text."""
    words = (text or "").encode("utf-8", "replace").split()
    one = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    two = one[:-1] * _MIX + one[1:] if len(one) > 1 else one[:0]
    both = np.concatenate([one, two])
    return ((both * _MIX >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def count_ngrams(marked: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target) over all rows of ``marked`` (text, is_target): each task sends at most a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text, is_target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.bincount(hashed_ngrams(text, buckets), minlength=buckets)
                raw += n
                if is_target:
                    target += n
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    per_task = map_arrow(marked.select("text", "is_target"), run, "bucket int, raw long, target long")
    return per_task.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame, target_ids: DataFrame, *, buckets: int = 10_000, max_target: int = 20_000) -> np.ndarray:
    """log p_target - log p_raw by bucket, with add-one smoothing.

    The raw model counts every row of ``docs`` (doc_id, text).  The target model learns from the rows
    named by target_ids (doc_id), at most max_target of them: those with the smallest hash.
    """
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)
    marked = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("is_target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    counts = np.ones((2, buckets))
    for r in count_ngrams(marked, buckets).collect():  # one row for each bucket
        counts[:, r["bucket"]] += (r["raw"], r["target"])
    logs = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return logs[1] - logs[0]


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, mark, n_grams, log_weight) for each row of ``docs`` (doc_id, text), with a hash of the text; one pass, no shuffle."""
    box = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = box.value
        for b in batches:
            grams = [hashed_ngrams(t, len(r)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(g) for g in grams], pa.int64()), pa.array([float(r[g].sum()) for g in grams], pa.float64())], ["doc_id", "mark", "n_grams", "log_weight"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text"), run, "doc_id long, mark long, n_grams long, log_weight double")


def _edge(df: DataFrame, at: Column, k: int, bins: int, small: int) -> tuple[float, float, int, int] | None:
    """(lo, hi, rows before, rows inside) of the interval of ``at`` that holds its k-th smallest value: cut into ``bins`` and counted until it has few rows or one value."""
    lo, hi, inside = df.agg(F.min(at), F.max(at), F.count(at)).first()
    if not inside:
        return None
    before = 0
    while inside > small and (step := (hi - lo) / bins) > 0 and lo + step > lo:
        bin_ = F.least(F.lit(bins - 1), F.floor((at - lo) / step).cast("int"))
        counts = {r["bin"]: (r["n"], r["lo"], r["hi"]) for r in df.where(at.between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).collect()}
        for i in sorted(counts):
            if before + counts[i][0] >= k:
                inside, lo, hi = counts[i]
                break
            before += counts[i][0]
    return lo, hi, before, inside


def mark_largest(df: DataFrame, key: str, tie: str, k: int, to: str, *, row: str | None = None, bins: int = 4096, small: int = 10_000) -> DataFrame:
    """``df`` with the boolean column ``to``, true for exactly its ``k`` rows with the largest ``key`` (ties: smaller ``tie``, null ones first, then smaller ``row``).

    The interval that holds the k-th largest key is counted out; where it comes down to a single key with many
    rows, ties are counted out the same way, and then rows (numbers that are all different).  Only a few rows are ever ranked.
    """
    n = df.count()
    if k <= 0 or n == 0:
        return df.withColumn(to, F.lit(False))
    if k >= n:
        return df.withColumn(to, F.lit(True))
    parts: list[DataFrame] = []
    columns = [-F.col(key), F.coalesce(F.col(tie).cast("double"), F.lit(float("-inf"))), *([F.col(row).cast("double")] if row else [])]
    for level, at in enumerate(columns):
        if level and df.where(at == float("-inf")).count() >= k:  # the edge lies among ties that are null
            parts.append(df.where(at > float("-inf")).withColumn(to, F.lit(False)))
            df = df.where(at == float("-inf"))
            continue
        if level and (null := df.where(at == float("-inf"))).count():
            parts.append(null.withColumn(to, F.lit(True)))
            k, df = k - null.count(), df.where(at > float("-inf"))
        lo, hi, before, inside = _edge(df, at, k, bins, small)
        parts.append(df.where(~at.between(lo, hi)).withColumn(to, at < lo))
        df, k = df.where(at.between(lo, hi)), k - before
        if inside <= small:
            break
    place = F.row_number().over(Window.orderBy(F.desc(key), tie, *([row] if row else [])))
    name = unused([*df.columns, to], "place")
    parts.append(df.withColumn(name, place).withColumn(to, F.col(name) <= k).drop(name))
    return reduce(DataFrame.unionByName, parts)


def resample(docs: DataFrame, target_ids: DataFrame, share: float, *, buckets: int = 10_000, max_target: int = 20_000, seed: int = 7) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept) for each row of ``docs``; round(share * rows) of them are kept."""
    scored = log_weights(docs, log_ratios(docs, target_ids, buckets=buckets, max_target=max_target))
    noise = -F.log(-F.log(uniform(seed, "doc_id", "mark")))
    scored = staged(scored.withColumn("gumbel_key", F.col("log_weight") + noise).withColumn("row", F.monotonically_increasing_id()).drop("mark"), "importance")
    return mark_largest(scored, "gumbel_key", "doc_id", round(share * scored.count()), "kept", row="row").drop("row")
