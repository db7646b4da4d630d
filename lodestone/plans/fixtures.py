"""Catalogue queries over files that are made from the rows of the tables: manifests, sources, notebooks, markdown; and the streams."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.retry import retry_details as details
from ..operators import chunking, code, dispatch, imports, ingest, manifests, markdown
from ..operators.shared import spread
from ..sources import files
from ..streaming import limits, registry
from .catalog import QUERIES as _ALL
from .catalog import SQL as _ALL_SQL
from .catalog import Query, t

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _sql(text: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return add


# Manifests: twelve parts to a file, by turns of six formats.

_PARTS = "SELECT *, p_partkey // 12 AS k, (p_partkey // 12) % 6 AS kind, p_partkey % 2 = 1 AS odd FROM part"
_PATH = {0: "web/package.json", 1: "pyproject.toml", 2: "requirements.txt", 3: "environment.yml", 4: "pom.xml", 5: "go.mod"}
_CASE_PATH = "'m' || k || '/' || CASE kind " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _PATH.items()) + " END"


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of manifests that name the rows of ``part``, odd ones as the second kind that a format has."""
    c = F.col
    p = t(spark, sf_dir, "part").withColumn("k", F.expr("p_partkey div 12")).withColumn("kind", F.expr("(p_partkey div 12) % 6")).withColumn("odd", c("p_partkey") % 2 == 1)
    name, size = F.concat(F.lit("lib-"), c("p_partkey").cast("string")), c("p_size").cast("string")
    show = lambda text: F.format_string(text, name, size)
    line = (
        F.when(c("kind") == 0, show('"%s": "^%s"'))
        .when(c("kind") == 1, F.when(c("odd"), show('%s = {version = "~%s"}')).otherwise(show('"%s>=%s"')))
        .when(c("kind") == 2, F.when(c("p_size") % 7 == 0, name).otherwise(show("%s==%s  # note")))
        .when(c("kind") == 3, F.when(c("odd"), show("    - %s==%s")).otherwise(show("  - %s=%s")))
        .when(c("kind") == 4, F.when(c("odd"), show("<dependency><groupId>g</groupId><artifactId>%s</artifactId><version>%s</version><scope>test</scope></dependency>")).otherwise(show("<dependency><groupId>g</groupId><artifactId>%s</artifactId><version>${v}</version></dependency>")))
        .otherwise(F.concat(show("\tex.org/%s v1.%s.0"), F.when(c("odd"), " // indirect").otherwise("")))
    )
    listed = lambda which, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(which, F.struct("p_partkey", line.alias("x"))))), lambda x: x["x"]), sep)
    sep = {0: ", ", 1: "\n", 2: "\n", 3: "\n", 4: "", 5: "\n"}
    files = p.groupBy("k", "kind").agg(*[listed(c("odd") == bool(i), s).alias(f"{n}{k}") for k, s in sep.items() for i, n in enumerate(("even", "odd"))], listed(~c("odd"), ", ").alias("commas"), listed(F.lit(True), "\n").alias("all"))
    k = c("k").cast("string")
    content = (
        F.when(c("kind") == 0, F.concat(F.lit('{"name": "n'), k, F.lit('", "dependencies": {'), c("even0"), F.lit('}, "devDependencies": {'), c("odd0"), F.lit("}}")))
        .when(c("kind") == 1, F.concat(F.lit("[project]\ndependencies = ["), c("commas"), F.lit("]\n[tool.poetry.dev-dependencies]\n"), c("odd1"), F.lit("\n")))
        .when(c("kind") == 2, F.concat(F.lit("# all\n-r base.txt\n"), c("all"), F.lit("\n")))
        .when(c("kind") == 3, F.concat(F.lit("name: e"), k, F.lit("\ndependencies:\n"), c("even3"), F.lit("\n  - pip:\n"), c("odd3"), F.lit("\n")))
        .when(c("kind") == 4, F.concat(F.lit('<project xmlns="m"><properties><v>'), k, F.lit("</v></properties><dependencies>"), c("even4"), c("odd4"), F.lit("</dependencies></project>")))
        .otherwise(F.concat(F.lit("module ex.org/m"), k, F.lit("\n\ngo 1.21\n\nrequire (\n"), c("all"), F.lit("\n)\n")))
    )
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _PATH.items() for x in kv]), c("kind").cast("int"))
    return files.select(F.concat(F.lit("m"), k, F.lit("/"), kind).alias("path"), content.alias("content"))


_NAMES = """CASE kind WHEN 4 THEN 'g:lib-' || p_partkey WHEN 5 THEN 'ex.org/lib-' || p_partkey ELSE 'lib-' || p_partkey END AS name,
            CASE kind WHEN 0 THEN '^' || p_size WHEN 1 THEN CASE WHEN odd THEN '~' || p_size ELSE '>=' || p_size END WHEN 2 THEN CASE WHEN p_size % 7 = 0 THEN '*' ELSE '==' || p_size END
                      WHEN 3 THEN CASE WHEN odd THEN '==' || p_size ELSE '=' || p_size END WHEN 4 THEN CASE WHEN odd THEN p_size::VARCHAR ELSE k::VARCHAR END ELSE 'v1.' || p_size || '.0' END AS version"""
_TYPE = """CASE kind WHEN 0 THEN CASE WHEN odd THEN 'dev' ELSE 'prod' END WHEN 1 THEN CASE WHEN odd THEN 'dev' ELSE 'prod' END WHEN 2 THEN 'prod' WHEN 3 THEN CASE WHEN odd THEN 'pip' ELSE 'conda' END
                WHEN 4 THEN CASE WHEN odd THEN 'test' ELSE 'compile' END ELSE CASE WHEN odd THEN 'indirect' ELSE 'direct' END END AS type"""


@_sql(f"SELECT {_CASE_PATH} AS path, {_NAMES}, {_TYPE}, CASE kind WHEN 0 THEN 'javascript' WHEN 4 THEN 'java' WHEN 5 THEN 'go' ELSE 'python' END AS language FROM ({_PARTS})")
def dependency_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.dependencies(manifest_files(spark, sf_dir))


@_sql(f"SELECT {_CASE_PATH} AS path, {_NAMES}, {_TYPE} FROM ({_PARTS}) WHERE kind = 5")
def go_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.go_requirements(manifest_files(spark, sf_dir).where(F.col("path").endswith("go.mod")))


@_sql(f"SELECT {_CASE_PATH} AS path, {_NAMES} FROM ({_PARTS}) WHERE kind = 2")
def requirement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.requirement_lines(manifest_files(spark, sf_dir).where(F.col("path").endswith("requirements.txt")))


@_sql(f"""SELECT DISTINCT {_CASE_PATH} AS path, CASE kind WHEN 0 THEN '{{"name": "n' || k || '"}}' WHEN 1 THEN '{{"project": {{}}, "tool": {{"poetry": {{}}}}}}' WHEN 2 THEN '{{}}' WHEN 3 THEN '{{"name": "e' || k || '"}}'
          WHEN 4 THEN '{{"properties": {{"v": "' || k || '"}}}}' ELSE '{{"goVersion": "1.21", "name": "ex.org/m' || k || '"}}' END AS details FROM ({_PARTS})""")
def manifest_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.manifest_details(manifest_files(spark, sf_dir))


# Imports: a source file for each customer, by turns of four languages; nations are repositories.

_NEXT = "c.c_custkey + 4"


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, language, content): every file imports the one of the customer four further on, which may be in another repository, besides a built-in and a foreign one."""
    customers = spread(t(spark, sf_dir, "customer"))
    c, n = F.col("c_custkey").cast("string"), (F.col("c_custkey") + 4).cast("string")
    turn = F.col("c_custkey") % 4
    pick = lambda *x: F.when(turn == 0, x[0]).when(turn == 1, x[1]).when(turn == 2, x[2]).otherwise(x[3])
    show = lambda text, *x: F.format_string(text, *x)
    repo = F.concat(F.lit("r"), F.col("c_nationkey").cast("string"))
    files = customers.select(
        repo.alias("repo"), pick(show("app/p%s.py", c), show("web/j%s.ts", c), show("src/main/java/a/J%s.java", c), show("go/g%s.go", c)).alias("path"), pick(*map(F.lit, ("python", "typescript", "java", "go"))).alias("language"),
        pick(
            show("import os\nfrom .p%s import x as y\nimport lib%s\n", n, c), show("import a, { b as d } from './j%s'\nimport fs from 'fs'\nimport r from 'react%s'\n", n, c),
            show("package a;\nimport java.util.List;\nimport a.J%s;\nimport org.z%s.Y;\n", n, c), show('package main\nimport (\n\t"fmt"\n\t"ex.com/m/go"\n\t"github.com/q/r%s"\n)\n', c),
        ).alias("content"),
    )
    modules = customers.select(repo.alias("repo")).distinct().select("repo", F.lit("go.mod").alias("path"), F.lit(None).cast("string").alias("language"), F.lit("module ex.com/m\n").alias("content"))
    return files.unionByName(modules)


@_sql(f"""WITH c AS (SELECT *, 'r' || c_nationkey AS repo, c_custkey % 4 AS turn, CASE c_custkey % 4 WHEN 0 THEN 'app/p' || c_custkey || '.py' WHEN 1 THEN 'web/j' || c_custkey || '.ts' WHEN 2 THEN 'src/main/java/a/J' || c_custkey || '.java' ELSE 'go/g' || c_custkey || '.go' END AS path FROM customer),
               n AS (SELECT c.*, o.path AS other FROM c LEFT JOIN c o ON o.c_custkey = {_NEXT} AND o.repo = c.repo)
          SELECT repo, path, CASE turn WHEN 0 THEN 'os' WHEN 1 THEN 'fs' WHEN 2 THEN 'java.util.List' ELSE 'fmt' END AS source, 'stdlib' AS category, NULL AS resolved_path FROM n
          UNION ALL SELECT repo, path, CASE turn WHEN 0 THEN '.p' || (c_custkey + 4) WHEN 1 THEN './j' || (c_custkey + 4) WHEN 2 THEN 'a.J' || (c_custkey + 4) ELSE 'ex.com/m/go' END, 'internal', CASE turn WHEN 2 THEN coalesce(other, 'src/main/java/a') WHEN 3 THEN 'go' ELSE other END FROM n
          UNION ALL SELECT repo, path, CASE turn WHEN 0 THEN 'lib' || c_custkey WHEN 1 THEN 'react' || c_custkey WHEN 2 THEN 'org.z' || c_custkey || '.Y' ELSE 'github.com/q/r' || c_custkey END, 'external', NULL FROM n""")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = source_tree(spark, sf_dir)
    found = imports.extract_imports(tree, ("repo", "path"))
    return imports.resolve_imports(found, tree).select("repo", "path", "source", "category", "resolved_path")


# Code: twelve functions and a class to a file, in Python and JavaScript by turns.


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("p_partkey div 12")
    p, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    line = F.when(k % 2 == 0, F.format_string("def f%s(a):\n    return %s\n", p, s)).otherwise(F.format_string("export function f%s(a) {\n  return %s;\n}\n", p, s))
    files = t(spark, sf_dir, "part").groupBy(k.alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("x")))), lambda x: x["x"]), "").alias("body"))
    n = F.col("k").cast("string")
    python = F.concat(F.lit("X"), n, F.lit(" = "), n, F.lit("\n"), "body", F.lit("class C"), n, F.lit(":\n    def m(self):\n        return 1\n"))
    script = F.concat(F.lit("const x"), n, F.lit(" = "), n, F.lit(";\n"), "body", F.lit("class C"), n, F.lit(" {\n  m(a) {\n    return 1;\n  }\n}\n"))
    even = F.col("k") % 2 == 0
    return files.select(F.concat(F.lit("f"), n).alias("path"), F.when(even, "python").otherwise("javascript").alias("language"), F.when(even, python).otherwise(script).alias("content"))


@_sql("""WITH p AS (SELECT p_partkey, p_partkey // 12 AS k, 2 + (p_partkey // 12) % 2 AS height, row_number() OVER (PARTITION BY p_partkey // 12 ORDER BY p_partkey) - 1 AS i FROM part),
              f AS (SELECT k, height, 1 + count(*) * height AS class_at FROM p GROUP BY k, height)
         SELECT 'f' || k AS path, 'function' AS kind, 'f' || p_partkey AS name, (1 + i * height)::INTEGER AS start_line, (i * height + height)::INTEGER AS end_line FROM p
         UNION ALL SELECT 'f' || k, 'global', NULL, 0, 0 FROM f
         UNION ALL SELECT 'f' || k, 'class_summary', 'C' || k, class_at::INTEGER, (class_at + CASE height WHEN 2 THEN 2 ELSE 4 END)::INTEGER FROM f
         UNION ALL SELECT 'f' || k, 'method', 'm', (class_at + 1)::INTEGER, (class_at + CASE height WHEN 2 THEN 2 ELSE 3 END)::INTEGER FROM f""")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.code_chunks(code_files(spark, sf_dir)).select("path", "kind", "name", "start_line", "end_line")


@_sql("""SELECT 'f' || p_partkey // 12 AS path, CASE (p_partkey // 12) % 2 WHEN 0 THEN 'X' ELSE 'x' END || p_partkey // 12 AS name, (p_partkey // 12)::VARCHAR || CASE (p_partkey // 12) % 2 WHEN 0 THEN '' ELSE ';' END AS value FROM part GROUP BY p_partkey // 12""")
def global_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.global_variables(code_files(spark, sf_dir))


_FUNCTIONS = """p AS (SELECT p_partkey, p_size, p_partkey // 12 AS k, (p_partkey // 12) % 2 = 0 AS py, row_number() OVER (PARTITION BY p_partkey // 12 ORDER BY p_partkey) AS i FROM part),
             d AS (SELECT k, py, i AS place, 'function' AS kind, 'f' || p_partkey AS name, NULL AS parent,
                          CASE WHEN py THEN 'def f' || p_partkey || '(a):' || chr(10) || '    return ' || p_size ELSE 'export function f' || p_partkey || '(a) {' || chr(10) || '  return ' || p_size || ';' || chr(10) || '}' END AS content FROM p
                   UNION ALL SELECT DISTINCT k, py, 0, 'global', NULL, NULL, CASE WHEN py THEN 'X' || k || ' = ' || k ELSE 'const x' || k || ' = ' || k || ';' END FROM p
                   UNION ALL SELECT DISTINCT k, py, 1000, 'class_summary', 'C' || k, NULL, 'class C' || k || ': m' FROM p
                   UNION ALL SELECT DISTINCT k, py, 1001, 'method', 'm', 'C' || k, CASE WHEN py THEN '    def m(self):' || chr(10) || '        return 1' ELSE '  m(a) {' || chr(10) || '    return 1;' || chr(10) || '  }' END FROM p),
             q AS (SELECT *, 'f' || k AS path, (row_number() OVER (PARTITION BY k ORDER BY place) - 1)::INTEGER AS chunk_no FROM d)"""


@_sql(f"""WITH {_FUNCTIONS} SELECT path, chunk_no, kind, md5(content) AS chunk_md5,
          md5(concat_ws(' | ', 'File: ' || path || ' | Language: ' || CASE WHEN py THEN 'python' ELSE 'javascript' END, 'Kind: ' || kind, 'Name: ' || name, 'Parent class: ' || parent, 'Code: ' || content)) AS embedding_md5 FROM q""")
def code_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code on its way from files to the texts that are embedded."""
    found = dispatch.code_way(code_files(spark, sf_dir), ["path"])
    number = F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1
    return found.select("path", number.alias("chunk_no"), "kind", F.md5("chunk").alias("chunk_md5"), F.md5("embedding_text").alias("embedding_md5"))


# Notebooks: conversations, what users say as markdown and answers as code.

_CELLS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role = 'user' AS is_user, turn, text FROM conversations"


def notebook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notebook_files_of(t(spark, sf_dir, "conversations"))


def notebook_files_of(said: DataFrame) -> DataFrame:
    """Sources are texts and lists of lines by turns."""
    user = F.col("role") == "user"
    cell = lambda source: F.to_json(F.struct(F.when(user, "markdown").otherwise("code").alias("cell_type"), F.format_string("c%s", F.col("turn").cast("string")).alias("id"), F.when(~user, F.col("turn").cast("int")).alias("execution_count"), source.alias("source")))
    text = F.when(F.col("turn") % 2 == 0, cell(F.col("text"))).otherwise(cell(F.array("text")))
    cells = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", text.alias("x")))), lambda x: x["x"]), ", ")
    return said.groupBy("conv_id").agg(F.concat(F.lit('{"cells": ['), cells, F.lit("]}")).alias("content"))


@_sql(f"SELECT conv_id, i::INTEGER AS cell_index, CASE WHEN is_user THEN 'markdown' ELSE 'code' END AS cell_type, 'c' || turn AS id, CASE WHEN NOT is_user THEN turn::INTEGER END AS execution_count, text AS source FROM ({_CELLS})")
def notebook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.notebook_cells(notebook_files(spark, sf_dir), ("conv_id",)).drop("outputs")


# Markdown: a file for twelve parts; a part is a section with a heading, a paragraph, a block of code or a table.


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, turn = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    block = (
        F.when(turn == 0, F.format_string("## T%s\npara %s", p, p)).when(turn == 1, F.format_string("para %s", p)).when(turn == 2, F.format_string("```\n# code %s\n```", p))
        .otherwise(F.format_string("| a | b |\n|---|---|\n| %s | x |", p))
    )
    k = F.expr("p_partkey div 12").cast("string")
    blocks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", block.alias("x")))), lambda x: x["x"]), "\n\n")
    return t(spark, sf_dir, "part").groupBy(F.concat(F.lit("d"), k).alias("path")).agg(F.concat(F.lit("# K"), F.first(k), F.lit("\n\nintro\n\n"), blocks).alias("content"))


_BLOCKS = """b AS (SELECT p_partkey // 12 AS k, p_partkey AS p, p_size % 4 AS turn FROM part UNION ALL SELECT DISTINCT p_partkey // 12, -1, 1 FROM part),
             m AS (SELECT *, turn <> 1 OR coalesce(lag(turn) OVER w > 1, true) AS opens, max(CASE WHEN turn = 0 THEN p END) OVER w AS head FROM b WINDOW w AS (PARTITION BY k ORDER BY p)),
             g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY k ORDER BY p) AS section FROM m),
             x AS (SELECT k, section, any_value(head) AS head, min(CASE WHEN turn > 1 THEN turn ELSE 0 END) AS kind,
                          string_agg(CASE turn WHEN 2 THEN '```' || chr(10) || '# code ' || p || chr(10) || '```' WHEN 3 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || p || ' | x |'
                                     ELSE CASE WHEN p < 0 THEN 'intro' ELSE 'para ' || p END END, chr(10) || chr(10) ORDER BY p) AS content FROM g GROUP BY k, section)"""


@_sql(f"WITH {_BLOCKS} SELECT 'd' || k AS path, '1=K' || k || CASE WHEN head IS NULL THEN '' ELSE ',2=T' || head END AS headings, content, kind = 2 AS is_code, kind = 3 AS is_table, false AS is_image FROM x")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.sections(markdown_files(spark, sf_dir))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headings")), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"])), ",")
    return found.select("path", shown.alias("headings"), F.btrim("content", F.lit("\n")).alias("content"), "is_code", "is_table", "is_image")


@_sql("SELECT 'd' || p_partkey // 12 AS path, 'part ' || p_partkey AS alt, 'http://i/' || p_partkey || '.png' AS url, (row_number() OVER (PARTITION BY p_partkey // 12 ORDER BY p_partkey) - 1)::INTEGER AS image_no FROM part")
def markdown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("string")
    line = F.format_string("![part %s](http://i/%s.png)", p, p)
    images = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("x")))), lambda x: x["x"]), "\n")
    docs = t(spark, sf_dir, "part").groupBy(F.concat(F.lit("d"), F.expr("p_partkey div 12").cast("string")).alias("path")).agg(F.concat(F.lit("# Images\n"), images).alias("content"))
    return markdown.image_windows(markdown.sections(docs), ["path"]).select("path", "alt", "url", "image_no")


_TOKENS = r"len(regexp_extract_all({0}, '\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]'))"


def fold_sql(units: str) -> str:
    """Chunks of units (doc, i from 1 without gaps, content, n, alone, head): SQL with the columns doc, chunk_no, n_tokens, alone, chunk."""
    return f"""n AS ({units}),
      s AS (SELECT doc, i, content, n, alone, head, 0 AS chunk_no, CASE WHEN alone OR n >= 300 THEN 0 ELSE n END AS size, (alone OR n >= 300) AS closed FROM n WHERE i = 1
            UNION ALL
            SELECT n.doc, n.i, n.content, n.n, n.alone, n.head, s.chunk_no + flush::INT,
                   CASE WHEN n.alone OR (CASE WHEN flush THEN 0 ELSE s.size END) + n.n >= 300 THEN 0 ELSE (CASE WHEN flush THEN 0 ELSE s.size END) + n.n END,
                   n.alone OR (CASE WHEN flush THEN 0 ELSE s.size END) + n.n >= 300
            FROM (SELECT s.*, m.i AS j, s.closed OR m.alone OR (s.head IS DISTINCT FROM m.head AND s.size >= 150) OR s.size + m.n > 450 AS flush FROM s JOIN n m ON m.doc = s.doc AND m.i = s.i + 1) s JOIN n ON n.doc = s.doc AND n.i = s.j),
      c AS (SELECT doc, chunk_no, sum(n)::INTEGER AS n_tokens, bool_or(alone) AS alone, string_agg(content, chr(10) || chr(10) ORDER BY i) AS chunk FROM s GROUP BY doc, chunk_no)"""


_LONG = rf"""w AS (SELECT doc, ord, list_filter(regexp_split_to_array(content, '[ \t\n\r\f]+'), lambda x: x <> '') AS ws FROM l WHERE NOT alone AND tokens > 450),
      e AS (SELECT doc, ord, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
      p AS (SELECT doc, ord, [0::BIGINT] || list(total ORDER BY i) AS sums FROM (SELECT doc, ord, i, sum({_TOKENS.format("word")}) OVER (PARTITION BY doc, ord ORDER BY i)::BIGINT AS total FROM e) GROUP BY doc, ord),
      f AS (SELECT p.doc, p.ord, 0 AS k, 0::BIGINT AS a, greatest(1, len(list_filter(sums, lambda x: x <= 450)) - 1) AS b FROM p
            UNION ALL
            SELECT doc, ord, k + 1, next, greatest(next + 1, len(list_filter(sums, lambda x: x <= sums[next + 1] + 450)) - 1)
            FROM (SELECT f.doc, f.ord, f.k, sums, greatest(f.a + 1, f.b - 20) AS next FROM f JOIN p ON p.doc = f.doc AND p.ord = f.ord WHERE f.b < len(sums) - 1)),
      v AS (SELECT doc, ord, 0 AS k, content, tokens AS n, alone, head FROM l WHERE alone OR tokens <= 450
            UNION ALL
            SELECT f.doc, f.ord, f.k, array_to_string(ws[a + 1 : b], ' '), sums[b + 1] - sums[a + 1], false, head FROM f JOIN w ON w.doc = f.doc AND w.ord = f.ord JOIN p ON p.doc = f.doc AND p.ord = f.ord JOIN l ON l.doc = f.doc AND l.ord = f.ord)"""


@_sql(
    rf"""WITH RECURSIVE l AS (SELECT doc_id AS doc, ord, content, {_TOKENS.format("content")}::BIGINT AS tokens, contains(content, '|') AS alone, regexp_extract(content, '^\s*(\S+)', 1) AS head
                             FROM (SELECT doc_id, unnest(range(0, len(ls))) AS ord, unnest(ls) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(content, ' ') <> ''), {_LONG},
        {fold_sql("SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord, k) AS i, content, n, alone, head FROM v")}
        SELECT doc AS doc_id, chunk_no, n_tokens, alone AS is_table, md5(chunk) AS chunk_md5 FROM c"""
)
def section_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a section; the first word stands in for a heading, and lines with a bar for tables."""
    lines = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "content")).where(F.trim("content") != "")
    first = F.regexp_extract("content", r"^\s*(\S+)", 1)
    sections = lines.select("doc_id", "ord", F.create_map(F.lit(1), first).alias("headings"), "content", F.lit(False).alias("is_image"), F.col("content").contains("|").alias("is_table"), F.lit(False).alias("is_code"))
    return chunking.section_chunks(sections, "doc_id", "ord").select("doc_id", "chunk_no", "n_tokens", "is_table", F.md5("chunk").alias("chunk_md5"))


@_sql(
    rf"""WITH RECURSIVE {_BLOCKS},
        {fold_sql(f"SELECT k AS doc, row_number() OVER (PARTITION BY k ORDER BY section) AS i, content, {_TOKENS.format('content')}::BIGINT AS n, kind = 3 AS alone, head FROM x")}
        SELECT 'd' || doc AS path, chunk_no, n_tokens, alone AS is_table, chunk FROM c"""
)
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.sections(markdown_files(spark, sf_dir)).withColumn("content", F.btrim("content", F.lit("\n")))
    return chunking.section_chunks(found, "path", "ord").select("path", "chunk_no", "n_tokens", "is_table", "chunk")


@_sql(
    rf"""WITH RECURSIVE {_FUNCTIONS}, {_BLOCKS},
        {fold_sql(f"SELECT k AS doc, row_number() OVER (PARTITION BY k ORDER BY section) AS i, content, {_TOKENS.format('content')}::BIGINT AS n, kind = 3 AS alone, head FROM x")}
        SELECT path, chunk_no, kind, name, md5(content) AS chunk_md5 FROM q
        UNION ALL SELECT 'd' || doc || '.md', chunk_no, CASE WHEN alone THEN 'table' ELSE 'markdown' END, NULL, md5(chunk) FROM c
        UNION ALL SELECT 'n' || conv_id || '.ipynb', (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER, CASE WHEN is_user THEN 'markdown' ELSE 'text' END, NULL, md5(text) FROM ({_CELLS})
        UNION ALL SELECT 's' || s_suppkey || '.txt', 0, 'text', NULL, md5(s_name || ' in ' || s_nationkey || ' has ' || s_acctbal) FROM supplier
        UNION ALL SELECT 'r' || n_nationkey || '.json', 0, 'text', NULL, md5('{{"name": "' || n_name || '", "region": ' || n_regionkey || '}}') FROM nation"""
)
def repository_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all kinds, told apart by name and sent their ways, with what is in each chunk; answers in notebooks are prose, and so one piece of text each."""
    code_ = code_files(spark, sf_dir).select("path", F.when(F.col("language") == "python", "py").otherwise("js").alias("ext"), "content")
    marked = markdown_files(spark, sf_dir).select(F.concat("path", F.lit(".md")).alias("path"), F.lit("md").alias("ext"), "content")
    notebooks = notebook_files(spark, sf_dir).select(F.concat(F.lit("n"), F.col("conv_id").cast("string"), F.lit(".ipynb")).alias("path"), F.lit("ipynb").alias("ext"), "content")
    pictures = t(spark, sf_dir, "nation").select(F.concat(F.lit("i"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("path"), F.lit("png").alias("ext"), F.lit("x").alias("content"))
    said = F.format_string("%s\n in  %s has\t%s\n", F.col("s_name"), F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string"))
    prose = t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("path"), F.lit("txt").alias("ext"), said.alias("content"))
    data = F.format_string('{"name": "%s",\n "region": %s}', F.col("n_name"), F.col("n_regionkey").cast("string"))
    settings = t(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("path"), F.lit("json").alias("ext"), data.alias("content"))
    tree = code_.unionByName(marked).unionByName(notebooks).unionByName(pictures).unionByName(prose).unionByName(settings).withColumn("content", F.encode("content", "UTF-8"))
    tree = tree.withColumns({"category": ingest.category(F.col("ext"), F.col("content")), "language": ingest.language(F.col("ext"))})
    found = dispatch.chunk_files(tree, ["path"])
    # a markdown file's sections keep the line breaks around them
    shown = F.when(F.col("path").endswith(".md"), F.btrim(F.regexp_replace("chunk", "\n{3,}", "\n\n"), F.lit("\n"))).otherwise(F.col("chunk"))
    return found.select("path", "chunk_no", "kind", "name", F.md5(shown).alias("chunk_md5"))


# Files by name, and errors of rate limits, from rows of the tables.

_EXTENSIONS = ["py", "PNG", "csv", "md", "lock", "pdf", "bin", "rs", "ipynb", "tsx"]
_FOLDERS = ["src", "node_modules", "doc", "build"]


@_sql("""WITH p AS (SELECT p_partkey, p_partkey % 10 AS e, p_size % 4 AS f FROM part)
         SELECT CASE f WHEN 0 THEN 'src' ELSE 'doc' END || '/x' || p_partkey || '.' || (['py', 'PNG', 'csv', 'md', 'lock', 'pdf', 'bin', 'rs', 'ipynb', 'tsx'])[e + 1] AS path,
                (['code', 'image', 'data', 'text', NULL, 'document', 'binary', 'code', 'text', 'code'])[e + 1] AS category, (['python', NULL, NULL, NULL, NULL, NULL, NULL, 'rust', NULL, 'typescript'])[e + 1] AS language
         FROM p WHERE f IN (0, 2) AND e <> 4""")
def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    path = F.concat(pick(_FOLDERS, F.col("p_size") % 4), F.lit("/x"), F.col("p_partkey").cast("string"), F.lit("."), pick(_EXTENSIONS, F.col("p_partkey") % 10))
    paths = t(spark, sf_dir, "part").select(path.alias("path")).where(ingest.wanted(F.col("path")))
    ext = ingest.extension(F.col("path"))
    return paths.select("path", ingest.category(ext).alias("category"), ingest.language(ext).alias("language"))


@_sql("""SELECT event_id AS id, CASE WHEN event_id % 4 IN (0, 2) THEN 'RPD' ELSE 'RPM_OR_TPM' END AS limit_type,
                CASE event_id % 4 WHEN 0 THEN (event_id % 20) * 3600.0 + 2.5 WHEN 1 THEN 7.66 WHEN 2 THEN (event_id % 50 + 1)::DOUBLE ELSE (event_id % 30) + 0.25 END::DOUBLE AS wait_seconds FROM events""")
def retry_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By turns: a day's limit in a header, a minute's limit, a quota in the body, and a message."""
    e = F.col("event_id")
    turn, c = e % 4, F.col
    body = F.format_string('{"error": {"details": [{"@type": "x.QuotaFailure", "violations": [{"quotaId": "RequestsPerDay"}]}, {"@type": "x.RetryInfo", "retryDelay": "%ds"}]}}', e % 50 + 1)
    errors = t(spark, sf_dir, "events").select(
        e.alias("id"), F.when(turn == 0, "0").when(turn == 1, "5").alias("remaining"), F.lit(None).cast("string").alias("after"), F.when(turn == 0, F.format_string("%dh2.5s", e % 20)).when(turn == 1, "1h").alias("requests"),
        F.when(turn < 2, "7.66s").alias("tokens"), F.when(turn == 2, body).alias("body"), F.when(turn == 3, F.format_string("Please Retry in %d.25s.", e % 30)).otherwise("").alias("message"),
    )
    at = F.to_timestamp(F.lit("2024-01-01 16:00:00Z"))
    return errors.select("id", details(c("remaining"), c("after"), c("requests"), c("tokens"), c("body"), c("message"), at).alias("d")).select("id", "d.limit_type", "d.wait_seconds")


@_add
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default embedder over all documents."""
    return files.embed(t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


SQL["hashed_embeddings"] = r"SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents"


def _streamed(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream has written once it has read all there is; its output and its state lie under spark.checkpoint.dir, or in a temporary folder of a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestone-stream-')}"
    path = f"{root.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    to = stream.writeStream.option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        job = to.format("parquet").option("path", f"{path}/out").start()
    else:  # each batch holds the whole result
        job = to.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@_add
def token_bucket_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token bucket of the catalogue as a stream that reads the events file once."""
    kind = t(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("at", limits.seconds(F.col("ts")))
    out = limits.token_bucket_stream(events, "user_id", "at", "event_id", "value", 400.0, 0.001, ttl=1e12)
    return _streamed(spark, out, "token_bucket_stream_out", "append").withColumn("tokens", F.round("tokens", 4))


SQL["token_bucket_stream"] = _ALL_SQL["token_bucket"]


def _timed_events(spark: SparkSession, sf_dir: str, kinds: dict[str, str] | None = None) -> DataFrame:
    events = spark.readStream.schema(t(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    if kinds:
        named = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
        events = events.withColumn("kind", named[F.col("event_type")]).where(F.col("kind").isNotNull())
    return events.withColumn("trips", F.col("event_type") == "error")


def _with_timers(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What the stream that ``make`` returns has written; timers need a state store that has them, for as long as it runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, registry.PROVIDER)
    try:
        return _streamed(spark, make(), name, "append")
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@_sql("""WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e6 AS sec, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'cancel' END AS kind FROM events WHERE event_type IN ('click', 'purchase', 'error')),
              n AS (SELECT *, lead(sec) OVER w AS next_at, lead(kind) OVER w AS next_kind, max(sec) OVER () AS latest FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
         SELECT user_id::VARCHAR AS key, round(sec, 3) AS started, round(CASE WHEN next_at < sec + 43200 THEN next_at ELSE sec + 43200 END, 3) AS ended,
                CASE WHEN next_at < sec + 43200 THEN CASE next_kind WHEN 'start' THEN 'replaced' ELSE next_kind END ELSE 'expired' END AS how
         FROM n WHERE kind = 'start' AND (next_at IS NOT NULL OR sec + 43200 <= latest)""")
def stream_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks register a stream of their user, purchases finish and errors cancel it; half a day ends what is left, by timers."""
    kinds = {"click": "start", "purchase": "finish", "error": "cancel"}
    made = lambda: registry.stream_registry(_timed_events(spark, sf_dir, kinds), "user_id", "ts", "event_id", "kind", span=43200.0)
    return _with_timers(spark, made, "stream_registry").select("key", F.round("started", 3).alias("started"), F.round("ended", 3).alias("ended"), "how")


@_add
def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's circuit_breaker over a stream."""
    made = lambda: registry.breaker_stream(_timed_events(spark, sf_dir), "user_id", "ts", "event_id", "trips", ttl=7200.0)
    return _with_timers(spark, made, "breaker_stream").select(F.col("id").alias("event_id"), F.col("key").cast("long").alias("user_id"), "open")


SQL["breaker_stream"] = _ALL_SQL["circuit_breaker"]


@_add
def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = t(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = limits.windowed(events, "ts", "1 day", "1 hour", ["event_type"], F.count("*").alias("n"))
    return _streamed(spark, out, "windowed_stream_out", "complete").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n")


SQL["windowed_stream"] = "SELECT time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL"
assert not set(QUERIES) & set(_ALL)
