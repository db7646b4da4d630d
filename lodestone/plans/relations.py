"""Catalogue queries of what files have to do with each other, over repositories that are built from the rows of ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import code, imports, relations
from ..operators.shared import staged
from .catalog import query, t


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, language, content): a nation's customers, by their number r in it, are files of which each takes names from that of r // 2: Python's are handed on by import, TypeScript's by export."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = t(spark, sf_dir, "customer").select("c_nationkey", n.alias("r")).withColumn("h", F.expr("r div 2"))
    r, h = F.col("r").cast("string"), F.col("h").cast("string")
    python = F.concat(F.when(F.col("r") > 1, F.format_string("from .m%s import f1, f%s as up\n", h, h)).otherwise(""), F.format_string("def f%s():\n    return 1\n", r))
    script = F.concat(F.when(F.col("r") > 1, F.format_string("import { f1, f%s as up } from './m%s';\nexport * from './m%s';\n", h, h, h)).otherwise(""), F.format_string("export function f%s() {\n  return 1;\n}\n", r))
    even = F.col("c_nationkey") % 2 == 0
    return rows.select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("repo"), F.when(even, F.concat(F.lit("pkg/m"), r, F.lit(".py"))).otherwise(F.concat(F.lit("web/m"), r, F.lit(".ts"))).alias("path"), F.when(even, "python").otherwise("typescript").alias("language"), F.when(even, python).otherwise(script).alias("content"))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = staged(tree(spark, sf_dir), "relation-files")
    return files, staged(imports.resolve_imports(imports.extract_imports(files, ("repo", "path")), files), "relation-imports")


_FILES = """WITH RECURSIVE c AS (SELECT c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer),
              f AS (SELECT 'r' || n AS repo, r, r // 2 AS h, CASE WHEN n % 2 = 0 THEN 'pkg/m' || r || '.py' ELSE 'web/m' || r || '.ts' END AS path, CASE WHEN n % 2 = 0 THEN 'pkg/m' ELSE 'web/m' END AS stem, CASE WHEN n % 2 = 0 THEN '.py' ELSE '.ts' END AS ext FROM c)"""


@query(_FILES + " SELECT repo, path, stem || h || ext AS target, false AS is_external, CASE WHEN h = 1 THEN 'f1' ELSE 'f1,f' || h END AS symbols FROM f WHERE r > 1")
def file_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.file_edges(_resolved(spark, sf_dir)[1]).withColumn("symbols", F.array_join("symbols", ","))


@query(_FILES + """ SELECT repo, path, 'f1' AS name, 'f1' AS local, stem || '1' || ext AS target, 'function' AS kind, floor(log2(h))::INTEGER AS hops FROM f WHERE r > 1
                    UNION ALL SELECT repo, path, 'f' || h, 'up', stem || h || ext, 'function', 0 FROM f WHERE r > 1""")
def symbol_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where names are defined that come through chains of files."""
    files, found = _resolved(spark, sf_dir)
    defined = code.code_chunks(files, keys=("repo", "path")).where("kind in ('function', 'class_summary')").select("repo", "path", "name", "kind")
    given = imports.extract_exports(files, ("repo", "path")).where("source is not null")
    # exports from elsewhere are found as imports are
    asked = given.select("repo", "path", F.lit("typescript").alias("language"), "source").distinct()
    given = given.join(imports.resolve_imports(asked, files).select("repo", "path", "source", "resolved_path"), ["repo", "path", "source"])
    return relations.symbol_edges(found, staged(defined, "relation-definitions"), staged(relations.given_names(found, given), "relation-given"))


@query(_FILES + """, e AS (SELECT repo, stem, ext, r, h AS b, 1 AS distance FROM f WHERE r > 1 UNION ALL SELECT repo, stem, ext, r, b // 2, distance + 1 FROM e WHERE b > 1)
       SELECT repo, stem || r || ext AS path, stem || b || ext AS target, distance FROM e""")
def reachable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files that a file depends on, at any remove."""
    return relations.reachable(relations.file_edges(_resolved(spark, sf_dir)[1]).where("not is_external"))
