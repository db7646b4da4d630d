from __future__ import annotations

import random
from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession

#: As in the documents table, with extra columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size long, band string, piece int"

FR, EN = "le la eau que ment eux des une dans pour", "the of and ing tion with that from his are"


def sentence(rng: random.Random, n: int, words: str = EN) -> str:
    w = words.split()
    return " ".join(rng.choice(w) + rng.choice(w) for _ in range(n))


def sample_texts(seed: int = 3) -> list[str | None]:
    """Clean texts, near and exact copies, shared passages, repetition, junk, empty, null and very long texts."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(60, 200), EN if i % 3 else FR) for i in range(30)]
    shared = sentence(rng, 40)
    out: list[str | None] = [*base, None, "", "   \n\t ", "one", "one two three four", "…", "12 34"]
    out += [base[0], base[0], base[1].upper(), base[2] + " tail", "head " + base[3], base[4][:-40]]
    for i in range(5, 9):
        w = base[i].split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [f"{sentence(rng, 30)}\n{shared}\n{sentence(rng, 30)}" for _ in range(6)]
    out += ["ab " * 400, "x" * 5000, sentence(rng, 20000), "same line here\n" * 80, " ".join(w + "***" for w in base[9].split()), "é" * 300 + base[10], "<|endoftext|>a<|endoftext|>"]
    return out


@pytest.fixture(scope="session")
def make_docs(spark: SparkSession) -> Callable[[list[str | None]], DataFrame]:
    def make(texts: list[str | None], ids: list[int] | None = None) -> DataFrame:
        rows = [(i if ids is None else ids[i], t, None if i % 17 == 5 else ("fr" if i % 3 == 0 and i < 30 else "en"), None if i % 7 == 6 else f"s{i % 4}", len(t or ""), 1, 2, "b", 3) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def docs(make_docs: Callable[[list[str | None]], DataFrame]) -> DataFrame:
    return make_docs(sample_texts()).cache()


@pytest.fixture(scope="session")
def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
