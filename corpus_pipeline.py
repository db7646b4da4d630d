"""From raw documents to token ids: identify languages, drop near duplicates, cut repeated strings, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of the documents, whatever other columns there are and however they are called.

Edge cases, stage by stage: an empty table gives no rows in any.  A null or blank text has no language and goes in the first
stage.  Rows with a null id make no near-duplicate links and all stay; they come after all others where repeated strings
are cut, and are drawn like others in the mix.  Repeated rows (one id, one text) become one row in the second stage.
Unlike texts that share an id are documents of their own.  A null source is a source of its own, a null language is filled in
by what was identified.  Texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, mixing, near_dups, suffixes
from lodestone.llm.common import load, staged, tasks_for
from lodestone.llm.queries import vocabulary


def _in_few_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """What a stage returns, in as many files as its documents are worth, however many partitions they came in or were shuffled to."""
    return out.coalesce(tasks_for(docs))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; dictionaries are learned from the labelled ones that aren't held out.

    Null texts, texts without a letter and those whose best two languages are too close go.  Equal texts share their fate.
    """
    return _in_few_files(langid.keep_identified(docs, langid.fit_dictionaries(docs.where(~langid.held_out()))), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, and of those that share it the text with the smallest hash."""
    return _in_few_files(near_dups.drop_near_duplicates(docs), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that occur earlier; documents of which nothing is left go.

    Earlier is the smaller id, or the earlier start in one document; of equal strings the first stays.
    """
    cut = suffixes.remove_repeats(docs)
    return _in_few_files(cut.where(F.length("text") > 0).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken once or repeated, the last of a budget in part.

    Better documents, by the posterior of the quality rules, are drawn more readily.  Documents without words are left out.
    """
    mixed = mixing.mixed_documents(docs)
    return _in_few_files(mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; an empty text has none."""
    tokens = bpe.with_tokens(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return _in_few_files(tokens.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids"), docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix),
    ("bpe", encode),
]

#: Language identification, the sketches and the tokenizer are beyond SQL; tests/llm hold each stage's whole output against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
