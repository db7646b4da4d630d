"""What a model may call: named operators with JSON arguments, and the prompt that its answer is asked with."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import predicates, scan

Tool = Callable[..., DataFrame]


def process_tabular_data(spark: SparkSession, file_path: str, conditions: list[dict[str, Any]] | None = None, combine: str = "and", *, limit: int = 20, sample: int = 5) -> DataFrame:
    """The first ``limit`` rows of a csv or tsv file, in the file's order, that fulfil ``conditions``, or its first ``sample`` rows; no more of the file is read than that takes."""
    found, read = scan.table_reader(spark, file_path)
    wanted = predicates.compile_filter(read(found[0]), conditions, combine) if conditions else None
    return scan.first_matches(spark, found, read, wanted, limit if conditions else sample)


def repo_details(repositories: DataFrame, details: DataFrame, repo_id: str) -> DataFrame:
    """(repo_full_name, description, created_at, owner, dep_details array<string>) of a repository; no row for an unknown one."""
    lists = details.where(F.col("repo_id") == repo_id).groupBy("repo_id").agg(F.sort_array(F.collect_list("details")).alias("dep_details"))
    found = repositories.where(F.col("repo_id") == repo_id).join(lists, "repo_id", "left")
    return found.select("repo_full_name", "description", "created_at", "owner", F.coalesce("dep_details", F.array().cast("array<string>")).alias("dep_details"))


def dependency_version(dependencies: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """(name, version, type, file_path) of the dependencies whose name holds ``name``, whatever its case."""
    literal = "".join(f"\\{c}" if c in "%_\\" else c for c in name)
    return dependencies.where(F.col("name").ilike(f"%{literal}%")).join(files.select("file_id", F.col("path").alias("file_path")), "file_id").select("name", "version", "type", "file_path")


def call(tools: dict[str, Tool], name: str, arguments: str | dict[str, Any]) -> DataFrame:
    """The result of a tool, by its name and arguments (a JSON object); ValueError for unknown tools and for what isn't an object."""
    if name not in tools:
        raise ValueError(f"unknown tool {name!r}")
    given = json.loads(arguments or "{}") if isinstance(arguments, str) else arguments
    if not isinstance(given, dict):
        raise ValueError("arguments must be a JSON object")
    return tools[name](**given)


def chat_messages(question: str, context: str | None, system: str, history: Iterable[dict[str, str]] = (), with_context: str = "Passages:\n{context}\n\nQuestion: {question}", without: str = "Question: {question}") -> list[dict[str, str]]:
    """The system's message, what was said before, and the question behind its context, in the wording given."""
    asked = without.format(question=question) if context is None else with_context.format(context=context, question=question)
    return [{"role": "system", "content": system}, *history, {"role": "user", "content": asked}]


def retrieve(question: str, rewrite: Callable[[str, list[str]], str], search: Callable[[str], DataFrame], *, wordings: int = 7, searches: int = 4, history: list[str] | None = None, too_long: type[Exception] = OverflowError) -> DataFrame:
    """What ``search`` finds for the question in the first wording that finds anything, after at most so many wordings and searches.

    A ``rewrite`` that finds its history too long is asked again without the oldest part of it.
    """
    past, tried, found = list(history or []), 0, None
    for _ in range(wordings):
        try:
            wording = rewrite(question, past)
        except too_long:
            if not past:
                break
            past = past[1:]
            continue
        found, tried = search(wording), tried + 1
        if tried == searches or not found.isEmpty():
            break
    return found if found is not None else search(question)
