"""Relational operators around a corpus: ownership, paging, history, quotas, guarded writes."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in an order that a unique key must complete."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def latest(df: DataFrame, by: list[str], order: list[Column], n: int = 1, to: str = "recency") -> DataFrame:
    """The last ``n`` rows of each group, numbered from the newest."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(to) <= n)


def transcript(df: DataFrame, by: list[str], order: str, text: Column, sep: str = "\n", to: str = "transcript") -> DataFrame:
    """Texts of each group joined in order; a group must fit in a task, as a conversation or a streamed answer does."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(to), F.count("*").alias("parts"))


def within_quota(candidates: DataFrame, existing: DataFrame, by: str, limit: int | Column) -> DataFrame:
    """``candidates`` with the number of ``existing`` rows of their owner, and whether one more is allowed."""
    counts = existing.groupBy(by).agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return candidates.join(counts, by, "left").withColumn("n", n).withColumn("allowed", n < limit)


def one_of_each(rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """A row for each of ``keys``: the first by ``order``; without an order, the largest by the other columns."""
    order = order or [F.desc_nulls_last(c) for c, kind in rows.dtypes if c not in keys and not kind.startswith("map")]
    return latest(rows, keys, order or [F.lit(1)]).drop("recency") if set(rows.columns) - set(keys) else rows.distinct()


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``table`` and the rows of ``new`` whose keys it doesn't have, one_of_each() of them."""
    return table.unionByName(one_of_each(new, keys, order).join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The next snapshot: ``new`` in place of the rows with the same keys.  Write it to a new folder, then switch.

    Where ``new`` holds a key several times, the first by ``order`` counts; without an order, the largest by the other columns.
    """
    return one_of_each(new, keys, order).unionByName(table.join(new.select(*keys), keys, "left_anti"))


def latest_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return latest(rows, keys, order).drop("recency")


def mark(table: DataFrame, which: DataFrame, keys: list[str], column: str, value: Column) -> DataFrame:
    """``table`` with ``column`` set to ``value`` where ``which`` has the row's keys (status changes, soft deletes)."""
    flagged = table.join(which.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return flagged.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def cascade(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(*keys), keys, "left_semi")


def nested(parents: DataFrame, children: DataFrame, keys: list[str], fields: list[str], to: str) -> DataFrame:
    """``parents`` with their children as an ordered array of structs, empty if there are none."""
    lists = children.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(to))
    kind = lists.schema[to].dataType
    return parents.join(lists, keys, "left").withColumn(to, F.coalesce(to, F.from_json(F.lit("[]"), kind)))


def write_embeddings(files: DataFrame, embedded: DataFrame, path: str, keys: list[str] | None = None, done: str = "success", failed: str = "failed") -> DataFrame:
    """Append ``embedded`` to the table at ``path``, and return ``files`` with the status of what was written by this call.

    Each write is a folder ``write=<id>`` of its own, a partition of the table: Spark's committer shows all its rows or none,
    and only it is read again, so that neither older rows count nor a model is asked twice.
    """
    keys = keys or ["file_id"]
    own = f"{path.rstrip('/')}/write={uuid.uuid4().hex}"
    embedded.write.parquet(own)
    written = files.sparkSession.read.schema(embedded.schema).parquet(own)
    return mark(files.withColumn("status", F.lit(failed)), written, keys, "status", F.lit(done))


def with_details(saved: DataFrame, new: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """One row of manifest details for each of ``keys``: the latest by ``at``, of rows as late the new one."""
    both = saved.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc_nulls_last(at), F.desc("_new"), F.desc("details")]).drop("recency", "_new")


def new_repositories(saved: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` (repo_full_name, repo_url, repo_created_at as ISO text, ...) that ``saved`` doesn't have yet, by name or address, with a repo_id and a timestamp.

    Of rows with one name the earliest stays, then of rows with one address; ties by the address and the name.
    """
    first = [F.asc_nulls_last("repo_created_at"), F.asc_nulls_last("repo_url"), F.asc_nulls_last("repo_full_name")]
    fresh = one_of_each(one_of_each(found, ["repo_full_name"], first), ["repo_url"], first)
    for key in ("repo_full_name", "repo_url"):
        fresh = fresh.join(saved.select(key), key, "left_anti")
    at = F.try_to_timestamp(F.regexp_replace("repo_created_at", "Z$", "+00:00"))
    return fresh.select(F.sha2(F.lower("repo_full_name"), 256).alias("repo_id"), *found.columns).withColumn("repo_created_at", at)


def update_vectors(table: DataFrame, vectors: DataFrame, id_col: str = "embed_id", vec_col: str = "vector") -> DataFrame:
    """The next snapshot of ``table`` with the vectors of ``vectors`` (id_col, vec_col); ValueError if an id is unknown or comes twice.

    Both checks are one aggregate; nothing is written here.
    """
    asked = vectors.groupBy(id_col).agg(F.count("*").alias("n")).join(table.select(id_col).distinct().withColumn("_known", F.lit(True)), id_col, "left")
    unknown, twice = asked.agg(F.count_if(F.col("_known").isNull()), F.count_if(F.col("n") > 1)).first()
    if unknown or twice:
        raise ValueError(f"{unknown} ids are unknown, {twice} come more than once")
    new = vectors.select(id_col, F.struct(F.col(vec_col).alias("v")).alias("_new"))
    return table.join(new, id_col, "left").withColumn(vec_col, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(vec_col))).drop("_new").select(*table.columns)


def update_latest(table: DataFrame, asked: DataFrame, by: list[str], order: list[Column], keys: list[str], column: str) -> DataFrame:
    """``table`` with ``column`` from ``asked`` (keys..., column), where the row asked for is the latest of its group; other requests change nothing."""
    last = latest(table, by, order).select(*keys)
    fit = asked.join(last, keys, "left_semi").select(*keys, F.struct(F.col(column).alias("v")).alias("_new"))
    return table.join(fit, keys, "left").withColumn(column, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(column))).drop("_new").select(*table.columns)


def new_rooms(asked: DataFrame, existing: DataFrame, by: str, limit: int | Column, name: str = "New Chat") -> DataFrame:
    """Rows of ``asked`` (by, chat_name, ...) within their owner's quota, with a default name where they have none, and named_by_user."""
    allowed = within_quota(asked, existing, by, limit).where("allowed").drop("n", "allowed")
    given = F.nullif(F.trim("chat_name"), F.lit(""))
    return allowed.withColumn("named_by_user", given.isNotNull()).withColumn("chat_name", F.coalesce(given, F.lit(name)))


def is_false(flag: Column) -> Column:
    """True where ``flag`` is false; unlike ``not flag``, never null."""
    return F.coalesce(flag == F.lit(False), F.lit(False))


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the ``rows`` whose ``keys`` the report at ``path`` doesn't hold yet, so that an interrupted report can be resumed; returns the whole report."""
    spark = rows.sparkSession
    try:
        rest = rows.join(spark.read.schema(rows.schema).json(path).select(*keys), keys, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rest = rows
    rest.write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path)
