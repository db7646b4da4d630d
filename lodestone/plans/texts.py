"""Catalogue queries of text functions, small readers and resumable reports that no other query reaches, on the rows of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import access, imports, tools
from ..operators.shared import shared_path
from ..sources import files
from .catalog import query, t
from .relations import _FILES, _resolved, tree


@query("SELECT c_custkey, 'o' || c_nationkey AS owner, 'n.' || c_custkey AS name FROM customer")
def repository_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    tail = F.when(key % 3 == 0, ".git").when(key % 3 == 1, "/").otherwise("?tab=code")
    url = F.concat(F.lit("https://h.org/o"), F.col("c_nationkey").cast("string"), F.lit("/n."), key.cast("string"), tail)
    return t(spark, sf_dir, "customer").select("c_custkey", X.repo_of(url).alias("r")).select("c_custkey", "r.owner", "r.name")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '## T' || p_partkey || chr(10) || 'x' WHEN 1 THEN 'a' || p_partkey || chr(10) || '- item' ELSE '# K' || p_partkey || chr(10) || '#hash' END AS fixed FROM part")
def repaired_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("string")
    made = F.when(F.col("p_partkey") % 3 == 0, F.format_string("  - ## T%s\nx", p)).when(F.col("p_partkey") % 3 == 1, F.format_string("##  \na%s\n- item", p)).otherwise(F.format_string("* # K%s\n#hash", p))
    return t(spark, sf_dir, "part").select("p_partkey", X.repair_headings(made).alias("fixed"))


@query("SELECT event_id, round(86400 - ((epoch_us(ts) / 1e6 - 28800) % 86400), 2) AS seconds FROM events WHERE month(ts) = 1")
def midnight_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until a daily quota begins anew at midnight in Los Angeles; in winter."""
    return t(spark, sf_dir, "events").where(F.month("ts") == 1).select("event_id", X.seconds_to_midnight(F.col("ts").cast("timestamp")).alias("seconds"))


@query("SELECT p_partkey, 'n' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_size END AS alias FROM part")
def import_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, even = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 0
    item = F.when(even, F.concat(F.lit("  n"), p, F.lit("  as  a"), F.col("p_size").cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("n"), p))
    return t(spark, sf_dir, "part").select("p_partkey", X.import_alias(item).alias("i")).select("p_partkey", "i.name", "i.alias")


@query(r"SELECT conv_id, turn, nullif(substring(trim(regexp_replace(trim(text, ' '), '\s+', ' ', 'g'), ' '), 1, 150), '') AS title FROM conversations")
def chat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", X.title(X.one_line(F.col("text"))).alias("title"))


@query(_FILES + " SELECT repo, path, repo || '/' || stem || h || ext AS imported_file_id FROM f WHERE r > 1")
def imported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports with the id of the file that they name."""
    rows, found = _resolved(spark, sf_dir)
    ids = rows.select("repo", "path", F.concat_ws("/", "repo", "path").alias("file_id"))
    return imports.edges(found, ids)[0].select("repo", "path", "imported_file_id")


@query(_FILES + """ SELECT repo, path, 'f' || r AS name, 'function' AS kind, NULL AS source FROM f WHERE ext = '.ts'
                    UNION ALL SELECT repo, path, '*', 'all', './m' || h FROM f WHERE ext = '.ts' AND r > 1""")
def script_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.extract_exports(tree(spark, sf_dir), ("repo", "path"))


@query("""SELECT 'p' || p_partkey || '.rs' AS path, source, alias, is_wildcard FROM part, (VALUES ('::C', NULL, false), ('::d', NULL, true), ('', 's', false), ('::e::F', 'G', false)) x(tail, alias, is_wildcard),
                 LATERAL (SELECT 'a::b' || p_partkey || tail AS source)""")
def rust_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of nested use declarations."""
    p = F.col("p_partkey").cast("string")
    made = t(spark, sf_dir, "part").select(F.concat(F.lit("p"), p, F.lit(".rs")).alias("path"), F.lit("rust").alias("language"), F.format_string("pub use a::b%s::{C, d::*,\n  self as s, e::{F as G}};\nfn x() {}\n", p).alias("content"))
    return imports.extract_imports(made).select("path", "source", "alias", "is_wildcard")


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN 'first' ELSE 'second' END AS run, n_name FROM nation")
def resumed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that was broken off and is resumed: rows that it has already stay as they are."""
    path = shared_path(spark, "report")
    rows = t(spark, sf_dir, "nation").select("n_nationkey", F.lit("first").alias("run"), "n_name", "n_regionkey")
    access.append_new(rows.where("n_regionkey < 3").drop("n_regionkey"), path, ["n_nationkey"])
    return access.append_new(rows.drop("n_regionkey").withColumn("run", F.lit("second")), path, ["n_nationkey"])


def _written(df: DataFrame, order: str, what: str) -> str:
    """``df`` as csv files in ``order``, by which their names are ordered too."""
    path = shared_path(df.sparkSession, what)
    df.orderBy(order).write.option("header", True).csv(path)
    return path


@query("SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 6")
def table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table_preview(spark, _written(t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey", "suppliers-csv"))[0]


@query("SELECT s_suppkey::INTEGER AS s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000 AND s_nationkey IN (1, 3, 5, 7, 9, 11) ORDER BY s_suppkey LIMIT 20")
def tabular_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool call on csv files, as a model would write it."""
    path = _written(t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey", "suppliers-csv")
    asked = '[{"column": "s_acctbal", "operator": "gt", "value": 1000}, {"column": "s_nationkey", "operator": "in", "value": [1, 3, 5, 7, 9, 11]}]'
    found = tools.call({"process_tabular_data": lambda **a: tools.process_tabular_data(spark, **a)}, "process_tabular_data", f'{{"file_path": "{path}", "conditions": {asked}}}')
    return found.select("s_suppkey", "s_acctbal")


@query("SELECT n_nationkey::INTEGER AS query_id, n_name AS query, s_suppkey::VARCHAR AS id FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def golden_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden set in one JSON file: nations ask for their suppliers."""
    path = shared_path(spark, "golden")
    relevant = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.col("s_suppkey").cast("string")).alias("relevant_embed_ids"))
    item = F.struct("n_nationkey", F.col("n_name").alias("query"), F.coalesce("relevant_embed_ids", F.array().cast("array<string>")).alias("relevant_embed_ids"), F.lit("x").alias("ground_truth_answer"))
    t(spark, sf_dir, "nation").join(relevant, "n_nationkey", "left").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("value")).coalesce(1).write.text(path)
    asked, pairs = files.golden_set(spark, path)
    return asked.join(pairs, "query_id").select("query_id", "query", "id")
