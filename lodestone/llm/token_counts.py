"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; running sums over the histogram then answer, for every
context limit that occurs as a length, how many documents fit, what share of tokens they hold, how
many tokens remain when every document is truncated there, and which quantile the length is.  The
histogram has at most as many rows as there are distinct lengths.  Its sums run in blocks of
``block`` lengths (the blocks' totals first), so no task holds the whole histogram.

Limits and quantiles that are asked for, whether they occur as lengths or not, are answered from the
histogram in one aggregate (at_limits) and from the table by the least length that reaches them (at_quantiles).

Edge cases: null and empty texts have length 0; an empty table gives no rows; rows with a null
length are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def length_histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs, total_tokens): one row for each length of ``lengths``."""
    return (
        lengths.where(F.col(n_tokens).isNotNull()).groupBy(F.col(n_tokens).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
        .withColumn("total_tokens", F.col("n_docs") * F.col("n_tokens"))
    )


def length_table(lengths: DataFrame, n_tokens: str = "n_tokens", *, block: int = 1024) -> DataFrame:
    """For each length L that occurs, in the histogram's columns and (a task puts ``block`` lengths in order at most, whatever the corpus):

    docs_at_most, tokens_at_most: documents of length <= L and their tokens;
    docs_longer, tokens_longer: the suffix sums beyond L;
    truncated_total: tokens left if every document is cut to L;
    quantile: docs_at_most / documents, so the q-quantile is the smallest L with quantile >= q.
    """
    sums = ("n_docs", "total_tokens")
    hist = staged(length_histogram(lengths, n_tokens), "length-histogram")  # used three times, encoded once
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / block))
    blocks = hist.groupBy("block").agg(*[F.sum(c).alias(f"block_{c}") for c in sums])
    over, every = Window.orderBy("block"), Window.partitionBy()
    blocks = blocks.select("block", *[(F.sum(f"block_{c}").over(over) - F.col(f"block_{c}")).alias(f"before_{c}") for c in sums], *[F.sum(f"block_{c}").over(every).alias(f"all_{c}") for c in sums])
    inside = Window.partitionBy("block").orderBy("n_tokens")
    upto = {c: F.col(f"before_{c}") + F.sum(c).over(inside) for c in sums}
    return hist.join(blocks, "block").select(
        "n_tokens", *sums,
        upto["n_docs"].alias("docs_at_most"), upto["total_tokens"].alias("tokens_at_most"),
        (F.col("all_n_docs") - upto["n_docs"]).alias("docs_longer"), (F.col("all_total_tokens") - upto["total_tokens"]).alias("tokens_longer"),
        (upto["total_tokens"] + F.col("n_tokens") * (F.col("all_n_docs") - upto["n_docs"])).alias("truncated_total"),
        (upto["n_docs"] / F.col("all_n_docs")).alias("quantile"),
    )


def at_limits(lengths: DataFrame, limits: Sequence[int], n_tokens: str = "n_tokens") -> DataFrame:
    """(limit, docs_at_most, tokens_at_most, docs_longer, tokens_longer, truncated_total) for each of ``limits``, which needn't occur as lengths; 0 everywhere without documents."""
    n, docs, tokens = F.col("n_tokens"), F.col("n_docs"), F.col("total_tokens")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    row = lambda limit: F.struct(
        F.lit(limit).cast("long").alias("limit"), total(F.when(n <= limit, docs)).alias("docs_at_most"), total(F.when(n <= limit, tokens)).alias("tokens_at_most"),
        total(F.when(n > limit, docs)).alias("docs_longer"), total(F.when(n > limit, tokens)).alias("tokens_longer"), total(docs * F.least(n, F.lit(limit))).alias("truncated_total"),
    )
    hist = length_histogram(lengths, n_tokens)
    return hist.agg(F.array(*[row(int(x)) for x in limits]).alias("rows")).select(F.inline("rows"))


def at_quantiles(table: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(q, n_tokens): the least length in a length_table() whose quantile is at least q; null without documents."""
    row = lambda q: F.struct(F.lit(float(q)).alias("q"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens"))
    return table.agg(F.array(*[row(q) for q in quantiles]).alias("rows")).select(F.inline("rows"))
