"""Retrieval metrics and judge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, precision, recall, mrr, ap) of ranked ``results`` (query_id, rank, id) against ``relevant`` (query_id, id).

    precision divides by k, not by what was returned; recall, mrr and ap are 0 without relevant ids.  A query with relevant
    ids but no result counts with 0 in everything.
    """
    top = results.where(F.col("rank") <= k).join(relevant.distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    asked = relevant.select("query_id").distinct().join(results.select("query_id"), "query_id", "left_anti").select("query_id", *[F.lit(None).cast(top.schema[c].dataType).alias(c) for c in top.columns if c not in ("query_id", "hit")], F.lit(0).alias("hit"))
    return _metrics(top.unionByName(asked), ["query_id"], relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant")), k)


def label_metrics(results: DataFrame, labels: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """query_metrics() where all other ids of a query's label in ``labels`` (id, label) are relevant; their pairs are never built.  An id has one label: the least.

    asked: (query_id) of the queries, if not every id with others of its label is one.
    """
    labels = labels.groupBy("id").agg(F.min("label").alias("label"))
    top = results.where(F.col("rank") <= k).join(labels.select(F.col("id").alias("query_id"), "label"), "query_id", "left").join(labels.select("id", F.col("label").alias("other")), "id", "left")
    hit = F.coalesce((F.col("label") == F.col("other")) & (F.col("id") != F.col("query_id")), F.lit(False)).cast("int")
    top, total = top.withColumn("hit", hit), labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    every = labels.join(total.where("n_relevant > 0").select("label"), "label", "left_semi").select(F.col("id").alias("query_id"), "label")
    every = every if asked is None else every.join(asked.select("query_id"), "query_id", "left_semi")
    silent = every.join(results.select("query_id"), "query_id", "left_anti").select("query_id", "label", F.lit(None).cast("int").alias("rank"), F.lit(0).alias("hit"))
    return _metrics(top.select("query_id", "label", F.col("rank").cast("int").alias("rank"), "hit").unionByName(silent), ["query_id", "label"], total, k)


def _metrics(top: DataFrame, by: list[str], total: DataFrame, k: int) -> DataFrame:
    """query_metrics() of the queries ``by`` from their results ``top`` (by..., rank, hit), and ``total`` (the last of by, n_relevant)."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    per = top.withColumn("hits", F.sum("hit").over(upto)).groupBy(*by).agg(
        F.sum("hit").alias("n_hit"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("gain"),
    )
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("n_relevant").cast("double")), F.lit(0.0))
    return per.join(total, by[-1], "left").select(
        "query_id", F.when(F.col("n_hit") > 0, 1).otherwise(0).alias("hit"), (F.col("n_hit") / float(k)).alias("precision"), share(F.col("n_hit")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), share(F.col("gain")).alias("ap"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return metrics.agg(F.count("*").alias("queries"), mean("hit", "hit_rate"), mean("precision", "precision"), mean("recall", "recall"), mean("mrr", "mrr"), mean("ap", "map"))


def judge_averages(rows: DataFrame, scores: list[str], by: list[str] | None = None) -> DataFrame:
    """Averages over the rows where every one of ``scores`` is set and between 0 and 2; null where there is none."""
    whole: Column = F.lit(True)
    for c in scores:
        whole = whole & F.coalesce(F.col(c).between(0, 2), F.lit(False))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.count_if(whole).alias("scored"), *[F.round(F.avg(F.when(whole, F.col(c))), 4).alias(f"avg_{c}") for c in scores])


def multiset_rest(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``wanted`` as often as they occur there beyond ``done``."""
    return wanted.exceptAll(done)


def replace_or_append(saved: DataFrame, new: DataFrame, key: Column) -> DataFrame:
    """``new`` and the rows of ``saved`` that no row of ``new`` has the same key as; null keys are the same."""
    keys = new.select(key.alias("_new_key")).distinct()
    return saved.withColumn("_key", key).join(keys, F.col("_key").eqNullSafe(F.col("_new_key")), "left_anti").drop("_key").unionByName(new)


def judge_scores(rows: DataFrame, scores: list[str], report: str = "evaluation") -> DataFrame:
    """``rows`` with an int column for each of ``scores`` from a judge's JSON report: null unless it is a whole number from 0 to 2, and never from true or false."""
    raw = lambda c: F.get_json_object(report, f"$.{c}.score")
    return rows.withColumns({c: F.when(raw(c).rlike(r"^[0-2]$"), raw(c).cast("int")) for c in scores})


def recalculated(saved: DataFrame, selected: DataFrame, by: list[str], scores: list[str]) -> DataFrame:
    """judge_averages() of the rows of a ``saved`` report that ``selected`` names, as often as it names them: one row is one case, not all with its key."""
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*[c for c in df.columns if c not in by] or [F.lit(1)])))
    chosen = number(saved).join(number(selected.select(*by)), [*by, "_n"], "left_semi").drop("_n")
    return judge_averages(chosen, scores)
