"""Language identification by compression.

Every language gets a zstandard raw-content dictionary made of text known to be in it.  A text is
cut into pieces, each piece is compressed with every dictionary, and the language with the smallest
total wins.  Case is folded on both sides.  Small pieces keep the dictionaries, not the text's own repetitions, in charge; every
piece of the whole text counts.

The margin is ``(second - best) / second`` of the totals; a prediction whose margin is below
``min_margin`` is rejected (too close to call), but still reported.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and is rejected; equal totals go to
the dictionary that holds more of the text's words, then to the first by code point (margin 0); null or empty tables give no rows; null languages
are not learned from, nor are rows with a null id; repeated rows are predicted alike; other columns of the input are ignored.
Text that is not white space or letters takes part like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, staged

_LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows that no model may learn from: crc32 of the id's text leaves 0, or there is no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit_dictionaries(labelled: DataFrame, *, docs_per_lang: int = 96, chars_per_doc: int = 1200, max_chars: int = 64_000_000) -> dict[str, bytes]:
    """A dictionary for each value of ``lang`` in ``labelled`` (doc_id, lang, text).

    The bound of the sample: of each language the docs_per_lang different texts with the smallest hash, and
    of each of them chars_per_doc characters from a hashed position (about 115 kB a language, as much as a
    dictionary can use).  All languages together take max_chars: beyond some 550 of them, each gets a smaller share.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text", F.xxhash64("text").alias("mark"))
    first = Window.partitionBy("lang").orderBy("mark")
    marks = known.select("lang", "mark").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_per_lang)
    marks = staged(marks, "dictionary-texts")
    langs = marks.select("lang").distinct().count()
    chars = min(chars_per_doc, max(1, max_chars // max(1, langs * docs_per_lang)))
    start = F.pmod(F.xxhash64("mark"), F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    chosen = known.select("doc_id", "lang", "mark", F.col("text").substr(start, F.lit(chars)).alias("text")).join(marks, ["lang", "mark"])
    rows = chosen.groupBy("lang", "n").agg(F.min("text").alias("text")).collect()
    parts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], -r["n"])):
        parts.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v).lower().encode() for k, v in parts.items()}


def _coders(dictionaries: dict[str, bytes], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    coders = []
    for lang, data in dictionaries.items():
        words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level)
        coders.append((lang, zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return coders


def classify(text: str | None, coders: list[tuple[str, zstandard.ZstdCompressor]], known: dict[str, frozenset[bytes]], piece: int, min_margin: float) -> tuple[str, float, bool]:
    if text is None or not coders or not _LETTER.search(text):
        return "und", 0.0, True
    data = text.lower().encode("utf-8", "replace")
    pieces = [data[i : i + piece] for i in range(0, len(data), piece)]
    totals = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in coders)
    best, lang = totals[0]
    second = totals[1][0] if len(totals) > 1 else len(data) + len(pieces)
    if second == best:  # too short for whole bytes to tell: the dictionary that holds more of the words
        words = set(data.split())
        lang = min((n for size, n in totals if size == best), key=lambda n: (-len(words & known[n]), n))
    margin = max(0.0, (second - best) / second)
    return lang, margin, margin < min_margin


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], *, piece: int = 1024, level: int = 6, min_margin: float = 0.005) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs`` (doc_id, text); one pass, no shuffle."""
    box = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(box.value, level)
        known = {k: frozenset(v.split()) for k, v in box.value.items()}
        for b in batches:
            out = [classify(t, coders, known, piece, min_margin) for t in b.column(1).to_pylist()]
            langs, scores, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def label_languages(docs: DataFrame, **options: object) -> DataFrame:
    """Learn from the rows of ``docs`` that aren't held out, and predict every row."""
    fit = {k: options.pop(k) for k in ("docs_per_lang", "chars_per_doc", "max_chars") if k in options}
    found = identify_languages(docs, fit_dictionaries(docs.where(~held_out()), **fit), **options)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], *, piece: int = 1024, level: int = 6, min_margin: float = 0.005) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected, with all their columns; a null ``lang`` is filled in."""
    box = docs.sparkSession.sparkContext.broadcast(dictionaries)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(box.value, level)
        known = {k: frozenset(v.split()) for k, v in box.value.items()}
        for b in batches:
            out = [classify(t, coders, known, piece, min_margin) for t in b.column(text).to_pylist()]
            langs = pa.array([a if a is not None else f[0] for a, f in zip(b.column(lang).to_pylist(), out, strict=True)], pa.string())
            columns = [langs if k == lang else b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names).filter(pa.array([not f[2] for f in out], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
