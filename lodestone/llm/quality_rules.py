"""Quality rules by weak supervision.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0).  Nobody says how far a
rule can be trusted: expectation-maximisation over the votes of all documents estimates how often
each rule casts each vote on good and on bad documents, and the posterior probability of "good"
decides, instead of asking that every rule passes.  The votes' patterns are sufficient statistics,
so the driver sees only their counts: at most 3 ** rules rows, whatever the corpus.

Edge cases: a null or blank text has no words, fails the base test and isn't kept; rows with equal
text get equal verdicts; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, staged

_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_LOWER, _UPPER = bytes(range(97, 123)), bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marked")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _repeats(words: list[bytes]) -> int:
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = 1
    return sum(hit)


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text: words are runs of anything but ASCII white space."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "replace")
    words = data.split()
    size = len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (size - len(data.translate(None, _SPACE))),
        size - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeats(words),
        len(lines),
        size - len(data.translate(None, _UPPER)),
        size - len(data.translate(None, _LOWER)),
        sum(map(_ends_marked, words)),
    )


def _ends_marked(word: bytes) -> bool:
    return word[-1] in b"#*$%&|<>!"


def count_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS...) for each row of ``docs`` (doc_id, text); one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(t) for t in b.column(1).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *COUNTS])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def with_counts(docs: DataFrame, to: str) -> DataFrame:
    """``docs`` with the counts of its ``text`` as the new struct column ``to``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(t) for t in b.column(at).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
            counts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns, counts], [*b.schema.names, to])

    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(to, kind)]))


def _vote(ratio: Column, good: Column, bad: Column) -> Column:
    return F.when(ratio.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("byte")


@dataclass(frozen=True)
class Limits:
    """(good, bad) of each rule: it votes good up to the first share and bad from the second on, and abstains between."""

    symbols: tuple[float, float] = (0.01, 0.08)
    marked_words: tuple[float, float] = (0.05, 0.30)
    repeated_words: tuple[float, float] = (0.10, 0.40)
    repeated_lines: tuple[float, float] = (0.05, 0.30)
    capitals: tuple[float, float] = (0.20, 0.60)
    #: Mean letters a word: good between the first two, bad below the third or above the fourth.
    word_length: tuple[float, float, float, float] = (3.0, 12.0, 2.0, 20.0)


def rules(at: str = "", limits: Limits = Limits()) -> dict[str, Column]:
    """Name and vote of each rule, from the counts; at: what their columns' names begin with."""
    n = lambda c: F.col(at + c).cast("double")

    def low(part: Column, whole: Column, limit: tuple[float, float]) -> Column:
        r = F.try_divide(part, whole)
        return _vote(r, r <= limit[0], r >= limit[1])

    length = F.try_divide(n("word_chars"), n("n_words"))
    least, most, short, long = limits.word_length
    return {
        "symbols": low(n("n_symbols"), n("word_chars"), limits.symbols),
        "marked_words": low(n("n_marked"), n("n_words"), limits.marked_words),
        "repeated_words": low(n("n_repeat_words"), n("n_words"), limits.repeated_words),
        "repeated_lines": low(n("n_dup_lines"), n("n_lines"), limits.repeated_lines),
        "capitals": low(n("n_upper"), n("n_upper") + n("n_lower"), limits.capitals),
        "word_length": _vote(length, length.between(least, most), (length < short) | (length > long)),
    }


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], *, rounds: int = 200, prior: float = 0.8) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """EM for two classes and three votes: (share of good, P(vote | class, rule), posterior of each pattern).

    patterns: votes and the number of documents that have them.  The start says that votes are right
    rather than wrong, which names the classes; half a pseudo-count keeps every probability positive.
    """
    if not patterns:
        return prior, np.zeros((2, 0, 3)), {}
    votes = np.array([p for p, _ in patterns], dtype=np.int64)
    n = np.array([c for _, c in patterns], dtype=np.float64)
    k, m = votes.shape
    onehot = votes[:, :, None] == np.array([-1, 0, 1])
    score = votes.sum(axis=1) - 2.0 * (votes < 0).sum(axis=1)  # a rule speaks up against a text less readily than for it
    good = np.where(score > 0, 0.9, np.where(score < 0, 0.1, prior))
    for _ in range(rounds):
        w = np.stack([(1 - good) * n, good * n])
        share = (w[1].sum() + 1) / (n.sum() + 2)
        p = np.einsum("ck,kmv->cmv", w, onehot) + 0.5
        p /= p.sum(axis=2, keepdims=True)
        logs = np.einsum("kmv,cmv->ck", onehot, np.log(p)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        if np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    return share, p, {tuple(int(x) for x in v): float(g) for v, g in zip(votes, good, strict=True)}


def posteriors(votes: DataFrame, named: list[str]) -> Column | None:
    """Posterior quality by pattern, as a map literal from the votes ``named`` joined by commas; None without rows.

    Only the patterns' counts reach the driver, at most 3 ** len(named) rows.
    """
    rows = votes.groupBy(*named).agg(F.count("*").alias("n")).collect()
    _, _, good = fit_votes(sorted((tuple(r[c] for c in named), r["n"]) for r in rows))
    return F.create_map(*[F.lit(x) for k, v in good.items() for x in (",".join(map(str, k)), v)]) if good else None


def judge_quality(docs: DataFrame, *, threshold: float = 0.5, min_words: int = 50, max_repeat: float = 0.5, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, counts, base_failed, kept, quality, votes) for each row of ``docs`` (doc_id, text)."""
    votes = rules(limits=limits)
    counted = staged(count_texts(docs).withColumns(votes), "quality-counts")
    good = posteriors(counted, list(votes))
    pattern = F.concat_ws(",", *[F.col(c).cast("string") for c in votes])
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rows = counted.select("*", pattern.alias("pattern"), (F.element_at(good, pattern) if good is not None else F.lit(0.0)).alias("quality"))
    return rows.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality", F.col("pattern").alias("votes"))
