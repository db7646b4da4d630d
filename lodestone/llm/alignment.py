"""Alignment of two tokenizers' vocabularies over a corpus, by a postings cogroup.

A text is encoded twice: space and text by a byte-level vocabulary (side A), the text by a SentencePiece model
that adds the space itself (side B); the strings of special tokens are plain text.  Where tokens of both sides
end at one byte a group ends, and every A and B token of a group are linked.  A pair's count is the number of
documents that hold it linked.

Words that both sides cut off alike (a space after something that isn't white space) are encoded, aligned and
remembered once.  Each block of documents then emits one posting list for each bucket of A ids: its id pairs,
and for each pair the documents with the multiplicity of its links.  Pairs and their numbers of documents are
merged by bucket to whole counts with each A id's maximum.  These tables meet the postings in a stream sorted by
bucket, table first, so that a task holds one bucket's table and one posting list; a bucket of many postings
is divided by a hash of their blocks, and its table goes to each part.  What each posting adds to its documents
is summed by block of documents.

Edge cases: texts that are null, empty or whose tokens' bytes don't join to space and text (those that hold
U+2581, or characters that the model replaces or doesn't know) have no tokens and zeros; rows with a null or a
repeated id are documents of their own; an empty table gives no rows; other columns are ignored; texts of any length
are encoded whole, and one text makes a block if it is long.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters, read_vocabulary
from .common import forget, map_arrow, spread, staged
from .merges import Memory, Merges, by_size, gather, group_sums, offsets
from .pieces import SPACE, pieces, read_model

BUCKETS = 64
#: Postings of one bucket that a task takes, and documents whose sums it holds before it passes them on.
POSTINGS, HELD = 4_000_000, 1_000_000
_BORDER = regex.compile(r"(?<=\S)(?= )", regex.V1)
_LOOSE = regex.compile(r"\s ")


class ByteWords:
    """Side A: byte-level encoding of plain text."""

    def __init__(self, content: str) -> None:
        model, letters = json.loads(content)["model"], byte_letters()
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(*zip(*((vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)), strict=True))
        self.size = max(vocab.values()) + 1
        self.byte_id, self.width = np.zeros(256, dtype=np.int64), np.zeros(self.size, dtype=np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        for t, i in vocab.items():
            self.width[i] = len(t)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``texts`` end to end, and how many each has."""
        words = [PATTERN.findall(t) for t in texts]
        flat = [w.encode("utf-8", "replace") for w in chain.from_iterable(words)]
        sizes = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
        ids, sizes = self.merges.merge(self.byte_id[np.frombuffer(b"".join(flat), dtype=np.uint8)], sizes)
        return ids, group_sums(sizes, np.fromiter(map(len, words), dtype=np.int64, count=len(words)))


class Pair:
    """Both sides, and what they make of words."""

    def __init__(self, vocabulary: str, model: bytes) -> None:
        self.a, self.b = ByteWords(vocabulary), pieces(model)
        self.shift = int(self.b.size - 1).bit_length()
        self.code = np.dtype("<u4") if int(self.a.size - 1).bit_length() + self.shift <= 32 else np.dtype("<u8")
        self.width_b = np.diff(self.b.surface_at)
        digits = [str(i).encode() for i in range(max(self.a.size, self.b.size))]
        self.digits, self.digits_at = np.frombuffer(b"".join(digits), dtype=np.uint8), offsets(np.array([len(d) for d in digits]))
        self.memory = Memory(self._align, most=120_000)

    def words(self, text: str) -> list[str]:
        """``text``, which begins with a space, cut where both sides begin a new token whatever stands around."""
        if not self.b.cuts:
            return [text]
        if _LOOSE.search(text):
            return _BORDER.split(text)
        return [f" {w}" for w in text.split(" ")[1:]]

    def _align(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By word: numbers (of A and B ids, groups, links, whether the bytes agree), links as codes, and the groups in writing."""
        fair = np.array([SPACE not in w for w in words], dtype=bool)
        words = [w if SPACE not in w else " " for w in words]
        a, n_a = self.a.encode(words)
        # what is remembered there are the piece model's own words: its first space is implied where words are cut
        (n_b, b), _ = self.b._encode_words([w[1:].replace(" ", SPACE) if self.b.cuts else w.replace(" ", SPACE) for w in words])
        if self.b.unk is not None and (b == self.b.unk).any():
            fair &= group_sums((b == self.b.unk).astype(np.int64), n_b) == 0
        b = b.astype(np.int64)
        end_a, end_b = np.cumsum(self.a.width[a]), np.cumsum(self.width_b[b])
        size_a, size_b = group_sums(self.a.width[a], n_a), group_sums(self.width_b[b], n_b)
        if not np.array_equal(size_a, size_b):  # an unknown piece has a surface of its own
            same = np.flatnonzero(size_a == size_b)
            parts = self._align([words[k] if ok else " " for k, ok in enumerate((size_a == size_b).tolist())])
            still = np.zeros(len(words), dtype=bool)
            still[same] = True
            parts[0][1].reshape(-1, 5)[:, 4] &= still & fair
            return parts
        ends = np.zeros(int(end_a[-1]) + 1, dtype=np.int8)
        ends[end_a] = 1
        ends[end_b] += 1
        common = ends == 2
        upto = np.cumsum(common)
        group_a, group_b = upto[end_a] - common[end_a], upto[end_b] - common[end_b]
        n = int(upto[-1])
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        word_of = np.repeat(np.arange(len(words)), n_a)[np.cumsum(in_a) - 1]
        n_groups = np.bincount(word_of, minlength=len(words))
        n_links = group_sums(in_a * in_b, n_groups)
        first_b = np.cumsum(in_b) - in_b
        times = in_b[group_a]
        at = np.repeat(first_b[group_a] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        codes = (np.repeat(a, times) << self.shift) | b[at]
        # digits of each id, followed by a comma, or by the mark that ends its side of the group
        marks = np.full(len(a) + len(b), ord(","), dtype=np.uint8)
        marks[np.cumsum(in_a) - 1] = ord("|")
        marks[len(a) + np.cumsum(in_b) - 1] = ord(";")
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        ids, marks = np.concatenate([a, b])[order], marks[order]
        text, long_ = gather(self.digits_at, self.digits, ids)
        written = np.empty(len(text) + len(ids), dtype=np.uint8)
        mark_at = np.cumsum(long_ + 1) - 1
        inside = np.ones(len(written), dtype=bool)
        inside[mark_at] = False
        written[inside], written[mark_at] = text, marks
        per_group = np.bincount(np.concatenate([group_a, group_b])[order], weights=long_ + 1, minlength=n).astype(np.int64)
        numbers = np.stack([n_a, n_b, n_groups, n_links, fair.astype(np.int64)], axis=1).astype(np.int32).reshape(-1)
        return [(np.full(len(words), 5), numbers), (n_links, codes.astype(self.code)), (group_sums(per_group, n_groups), written)]


@lru_cache(maxsize=1)
def _pair(vocabulary: str, model: bytes) -> Pair:
    return Pair(vocabulary, model)


def bucket_of(a: np.ndarray, buckets: int) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def _block(pair: Pair, texts: list[str], buckets: int) -> tuple[list[list], list[tuple]]:
    """What a block of documents has: columns (n_a, n_b, n_groups, n_links, groups_sha256), and posting lists (bucket, codes, docs of each, docs, links)."""
    usable = [bool(t) and (pair.b.normalizer.plain or pair.b.normalizer.normalize(t)[0] == SPACE + t.replace(" ", SPACE)) for t in texts]
    words, counts = [], []
    for t, ok in zip(texts, usable, strict=True):
        got = pair.words(" " + t) if ok else []
        counts.append(len(got))
        words += got
    count = np.array(counts, dtype=np.int64)
    rows = pair.memory.rows(words) if words else np.zeros(0, dtype=np.int64)
    numbers = pair.memory.runs(0, rows)[0].astype(np.int64).reshape(-1, 5)
    fair = group_sums(numbers[:, 4], count) == count
    sums = [np.where(fair, group_sums(numbers[:, k], count), 0) for k in range(4)]
    writing, written = pair.memory.runs(2, rows)
    at = offsets(group_sums(written, count)).tolist()
    data = writing.tobytes()
    shas = [hashlib.sha256(data[i : j - 1]).hexdigest() if ok and j > i else "" for (i, j), ok in zip(pairwise(at), fair.tolist(), strict=True)]
    columns = [*(s.tolist() for s in sums), shas]
    doc = np.repeat(np.arange(len(texts)), count)
    use = fair[doc]
    if not use.any():
        return columns, []
    # documents' words with their numbers, then the links of these
    base = int(rows.max()) + 1
    keys, times = np.unique(doc[use] * base + rows[use], return_counts=True)
    codes, n = pair.memory.runs(1, keys % base)
    codes, doc, times = codes.astype(np.int64), np.repeat(keys // base, n), np.repeat(times, n)
    # by bucket, pair and document
    wide = len(texts).bit_length()
    key = (codes << wide) | doc
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    links, key = np.add.reduceat(times[order], new), key[new]
    codes, doc = key >> wide, key & ((1 << wide) - 1)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    n_docs = np.diff(np.concatenate([first, [len(codes)]]))
    codes = codes[first]
    bucket = bucket_of(codes >> pair.shift, buckets)
    order = np.argsort(bucket, kind="stable")
    place = offsets(n_docs)
    lists = []
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        docs, _ = gather(place, doc, part)
        lists.append((int(bucket[part[0]]), codes[part].astype(pair.code).tobytes(), n_docs[part].astype("<u4").tobytes(), docs.astype("<u4").tobytes(), gather(place, links, part)[0].astype("<u4").tobytes()))
    return columns, lists


def _walk(docs: DataFrame, vocabulary: str, model: str, buckets: int) -> DataFrame:
    """Rows of documents (block, place, doc_id, ...) and of posting lists (block, bucket, ...) in one frame; bucket is null in the former."""
    sc = docs.sparkSession.sparkContext
    box, box_b = sc.broadcast(read_vocabulary(vocabulary)), sc.broadcast(read_model(model))
    schema = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, codes binary, n_docs binary, docs binary, links binary"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), *[pa.binary()] * 4]

    def rows(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(box.value, box_b.value)
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, begin = b.column(0).to_pylist(), 0
            for part in by_size([t or "" for t in b.column(1).to_pylist()]):
                n = len(part)
                columns, lists = _block(pair, part, buckets)
                yield rows([[block] * n, range(n), ids[begin : begin + n], *columns, *[[None] * n] * 5])
                if lists:
                    none = [None] * len(lists)
                    yield rows([[block] * len(lists), *[none] * 7, *zip(*lists, strict=True)])
                block, begin = block + 1, begin + n

    return map_arrow(spread(docs.select(F.col("doc_id").cast("long"), "text")), run, schema)


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c = c[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, dtype=np.int64)
    return c[first], np.add.reduceat(n[order], first) if len(c) else n


def pair_counts(postings: DataFrame, code: str) -> DataFrame:
    """(bucket, codes, counts, n_postings) for each bucket: pairs in order and how many documents hold them; merged in tasks before and after one shuffle."""
    schema = "bucket int, codes binary, counts binary, n_postings long"

    def table(bucket: int, codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        c, n = _merged(codes, counts)
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([c.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64())], ["bucket", "codes", "counts", "n_postings"])

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        size = 0
        for b in batches:
            for bucket, c, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                codes, counts = held.setdefault(bucket, [[], []])
                codes.append(np.frombuffer(c, dtype=code))
                counts.append(np.frombuffer(n, dtype="<u4").astype("<i8"))
                size += len(codes[-1])
                if len(codes) >= 32:
                    size -= sum(map(len, codes))
                    merged = _merged(codes, counts)
                    held[bucket] = [[merged[0]], [merged[1]]]
                    size += len(merged[0])
            if size > 2_000_000:
                yield from (table(k, *v) for k, v in held.items())
                held, size = {}, 0
        yield from (table(k, *v) for k, v in held.items())

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, codes, counts = None, [], []
        for b in batches:
            for bucket, c, n, _ in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if bucket != current:
                    if codes:
                        yield table(current, codes, counts)
                    current, codes, counts = bucket, [], []
                codes.append(np.frombuffer(c, dtype=code))
                counts.append(np.frombuffer(n, dtype="<i8"))
                if len(codes) >= 8:
                    merged = _merged(codes, counts)
                    codes, counts = [merged[0]], [merged[1]]
        if codes:
            yield table(current, codes, counts)

    return map_arrow(map_arrow(postings.select("bucket", "codes", "n_docs"), before, schema).repartition("bucket").sortWithinPartitions("bucket"), after, schema)


def contributions(stream: DataFrame, code: str, shift: int) -> DataFrame:
    """(block, best, total) from a stream sorted by bucket and part, each bucket's table (block null) before its postings: sums for each place in the block, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        codes = counts = best = np.zeros(0, dtype=np.int64)
        for b in batches:
            for block, c, n, d, m in zip(*(b.column(x).to_pylist() for x in ("block", "codes", "n_docs", "docs", "links")), strict=True):
                if block is None:
                    codes, counts = np.frombuffer(c, dtype=code), np.frombuffer(n, dtype="<i8")
                    a = codes >> shift
                    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                    best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.concatenate([first, [len(a)]])))
                    continue
                at = np.searchsorted(codes, np.frombuffer(c, dtype=code))
                times = np.frombuffer(n, dtype="<u4")
                doc, links = np.frombuffer(d, dtype="<u4"), np.frombuffer(m, dtype="<u4").astype(np.int64)
                sums = held.get(block)
                top = int(doc.max()) + 1
                if sums is None or len(sums[0]) < top:
                    grown = [np.zeros(top, dtype=np.int64), np.zeros(top, dtype=np.int64)]
                    if sums is not None:
                        for g, s in zip(grown, sums, strict=True):
                            g[: len(s)] = s
                        size -= len(sums[0])
                    held[block], sums = grown, grown
                    size += top
                np.add.at(sums[0], doc, np.where(np.repeat(best[at], times), links, 0))
                np.add.at(sums[1], doc, links * np.repeat(counts[at], times))
            if size > HELD:
                yield packed(held)
                held, size = {}, 0
        if held:
            yield packed(held)

    def packed(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), *(pa.array([v[k].tobytes() for v in held.values()], pa.binary()) for k in (0, 1))], ["block", "best", "total"])

    return map_arrow(stream, run, "block long, best binary, total binary")


def _by_document(sums: DataFrame) -> DataFrame:
    """(block, place, n_best, count_sum): what all tasks add to each document."""

    def rows(block: int, best: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        n = len(best)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(best, pa.int64()), pa.array(total, pa.int64())], ["block", "place", "n_best", "count_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, [np.zeros(0, dtype=np.int64)] * 2
        for b in batches:
            for block, *parts in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if block != current:
                    if current is not None:
                        yield rows(current, *held)
                    current, held = block, [np.zeros(0, dtype=np.int64)] * 2
                parts = [np.frombuffer(p, dtype=np.int64) for p in parts]
                n = max(len(parts[0]), len(held[0]))
                held = [np.pad(h, (0, n - len(h))) + np.pad(p, (0, n - len(p))) for h, p in zip(held, parts, strict=True)]
        if current is not None:
            yield rows(current, *held)

    return map_arrow(sums.repartition("block").sortWithinPartitions("block"), run, "block long, place int, n_best long, count_sum long")


def align(docs: DataFrame, vocabulary: str, model: str, buckets: int = BUCKETS, postings_each: int = POSTINGS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs`` (doc_id, text).

    n_best: links whose count is the highest that their A id has; count_sum: counts over all links.
    postings_each: a bucket with more postings is divided among so many more tasks.
    """
    pair = _pair(read_vocabulary(vocabulary), read_model(model))
    walked = staged(_walk(docs, vocabulary, model, buckets), "alignment")
    postings, rows = walked.where(F.col("bucket").isNotNull()), walked.where(F.col("bucket").isNull())
    counts = staged(pair_counts(postings, pair.code.str), "alignment-counts")
    parts = counts.select("bucket", F.greatest(F.lit(1), F.ceil(F.col("n_postings") / postings_each)).cast("int").alias("parts"))
    tables = counts.join(F.broadcast(parts), "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("block"), "codes", F.col("counts").alias("n_docs"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("links"),
    )  # parts has a row for each bucket, and so is bounded
    lists = postings.join(F.broadcast(parts), "bucket").select("bucket", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"), "block", "codes", "n_docs", "docs", "links")
    stream = lists.unionByName(tables).repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("block").asc_nulls_first())
    sums = staged(_by_document(contributions(stream, pair.code.str, pair.shift)), "alignment-sums")
    forget(counts)
    return rows.join(sums, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
