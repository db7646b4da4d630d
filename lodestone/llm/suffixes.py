"""Removal of repeated byte strings by external induced sorting of suffixes.

A byte is removed if a string of ``length`` bytes covers it that also starts earlier in the corpus.
Sorting every suffix of a corpus costs many times its size on disk, so the sort works on samples.

Sampling.  Of the ``SEED``-byte strings inside a window of ``length`` bytes, the one with the smallest
hash (leftmost of equals) is the window's anchor; equal windows have equal anchors at the same place.
Neighbouring windows share anchors, which leaves about one sampled suffix in 35 bytes, and a piece of
text around it that holds all its windows.  Anchors that occur once in the corpus can't be in a
repeat and are dropped after counting.  Equal pieces are settled by their first occurrence.

Induction.  The pieces left over that share an anchor, but differ, are brought together by Spark's
external sort, which is the disk-backed priority queue here: runs spill and merge, so neither a
task's share nor the input has to fit in memory.  A task sorts the sampled suffixes and takes the
common-prefix values of neighbours; the suffix one byte further left is the tuple (that byte, rank of
the suffix it precedes), so each step derives the order of all suffixes at distance d from that at
distance d - 1 by one stable sort on a byte, and its common-prefix values as 1 + the minimum over the
ranks between.  Neighbours that share ``length`` bytes are a repeat; all but the earliest go.

Groups of more than ``HOT`` distinct pieces (the rims of a passage that very many documents hold) are
cut up by the contents of their windows instead, aggregated before the shuffle.

Edge cases: a null text is empty; a text shorter than ``length`` loses nothing; a text that was seen
whole before loses everything; repeated rows are one document, so a row isn't removed for its twin,
and rows that share an id but not their text are ordered by where strings start; overlapping repeats
count; rows with a null id come after all others; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, release, staged, tasks_for, unused

LENGTH, SEED = 100, 32
HOT = 4096
_SEGMENT = 1 << 17
#: Where rows with a null id stand.
_LAST = (1 << 63) - 1
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D


def _powers(base: int) -> np.ndarray:
    steps = np.full(_SEGMENT + LENGTH + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POW, _INV = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[4]
    return h ^ (h >> np.uint64(29))


def text_mark() -> Column:
    """16 bits that tell texts apart whose rows share an id; with them, rows without an id are many groups and not one."""
    return F.pmod(F.xxhash64("text"), F.lit(1 << 16)).cast("long")


def pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """A piece's place in its document as one number that sorts by start: 33 bits start, 7 bits windows, 7 bits anchor's offset, 16 bits text mark."""
    return (start << 30) | (windows << 23) | (offset << 16) | mark


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return at >> 30, (at >> 23) & 127, (at >> 16) & 127, at & 0xFFFF


def _segments(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Bytes of up to about _SEGMENT with (text, offset of the part in the text, bytes) of each part; parts of a long text overlap by LENGTH - 1."""
    data: list[bytes] = []
    parts: list[tuple[int, int, int]] = []
    size = 0
    for k, t in enumerate(texts):
        for i in range(0, max(0, len(t) - LENGTH + 1), _SEGMENT // 2):
            part = t[i : i + _SEGMENT // 2 + LENGTH - 1]
            if size + len(part) > _SEGMENT:
                yield b"".join(data), parts
                data, parts, size = [], [], 0
            data.append(part)
            parts.append((k, i, len(part)))
            size += len(part)
    if parts:
        yield b"".join(data), parts


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, windows, offset of the anchor from start, anchor hash, piece hash) of every piece of ``texts``."""
    found: list[tuple[np.ndarray, ...]] = []
    for data, parts in _segments(texts):
        x = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
        v = x[:-1] | (x[1:] << np.uint64(8))
        v = v[:-2] | (v[2:] << np.uint64(16))
        v = v[:-4] | (v[4:] << np.uint64(32))
        h = _scramble(v[:-24] * _C[0] + v[8:-16] * _C[1] + v[16:-8] * _C[2] + v[24:] * _C[3])
        best, at, width, span = h, np.arange(len(h), dtype=np.int32), 1, LENGTH - SEED + 1
        while width < span:
            step = min(width, span - width)
            later = best[step:] < best[:-step]
            best, at = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step])
            width += step
        sizes = np.array([n for _, _, n in parts])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        inside = owner[: len(at)] == owner[LENGTH - 1 :]
        new = np.flatnonzero((at[1:] != at[:-1]) | (inside[1:] != inside[:-1])) + 1
        first = np.concatenate([[0], new])
        count = np.diff(np.concatenate([first, [len(at)]]))
        keep = inside[first]
        first, count = first[keep], count[keep]
        to = first + count + LENGTH - 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(x * _POW[: len(x)], dtype=np.uint64)])
        offset = at[first] - first
        piece = _scramble((sums[to] - sums[first]) * _INV[first] * _C[0] + (count * 128 + offset).astype(np.uint64))
        part = owner[first]
        base = np.array([i for _, i, _ in parts]) - (ends - sizes)
        found.append((np.array([k for k, _, _ in parts])[part], first + base[part], count, offset.astype(np.int64), h[at[first]].astype(np.int64), piece.astype(np.int64)))
    if not found:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(6))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _pieces(docs: DataFrame) -> DataFrame:
    """(anchor, piece, doc_id, at): a row for every piece of ``docs`` (doc_id, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), _bytes(b.column(2))
            for i in range(0, len(texts), 256):
                text, start, windows, offset, anchor, piece = anchors(texts[i : i + 256])
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (anchor, piece, ids[i + text], pack(start, windows, offset, marks[i + text]))], ["anchor", "piece", "doc_id", "at"])

    return map_arrow(docs, run, "anchor long, piece long, doc_id long, at long")


def induce(anchor: np.ndarray, doc_id: np.ndarray, at: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to): the byte ranges of each piece's document that repeat an earlier window among the given pieces.

    anchor, doc_id, at, data: one entry for each piece; data holds its bytes.
    """
    start, windows, offset, mark = unpack(at)
    n, depth = len(at), int(offset.max()) if len(at) else 0
    nearest, farthest = offset - windows + 1, offset  # a window's distance from its anchor
    right, left = np.zeros((n, LENGTH), dtype=np.uint8), np.zeros((n, max(depth, 1)), dtype=np.uint8)
    for i, (d, o) in enumerate(zip(data, offset.tolist(), strict=True)):
        row = np.frombuffer(d, dtype=np.uint8)
        right[i, : len(row) - o] = row[o:]
        left[i, :o] = row[:o][::-1]
    earlier = np.empty(n, dtype=np.int64)  # place in the corpus
    earlier[np.lexsort((mark, start + offset, doc_id))] = np.arange(n)
    group = np.unique(anchor, return_inverse=True)[1].astype(np.int64)
    name = np.unique(right.view(f"S{LENGTH}").ravel(), return_inverse=True)[1]
    order = np.lexsort((name, group))
    lcp = np.zeros(n + 1, dtype=np.int64)  # with the suffix before; 0 at the end
    if n > 1:
        same = right[order[1:]] == right[order[:-1]]
        lcp[1:n] = np.where(group[order[1:]] != group[order[:-1]], 0, np.where(same.all(axis=1), LENGTH, same.argmin(axis=1)))
    marks: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(depth + 1):
        if d:
            reach = np.maximum(lcp[:-1], lcp[1:]) + farthest[order] - d + 1 >= LENGTH
            rank = np.flatnonzero((farthest[order] >= d) & (lcp[:-1] + lcp[1:] > 0) & reach)
            if not len(rank):
                break
            key = (group[order[rank]] << 8) | left[order[rank], d - 1]
            by = np.argsort(key, kind="stable")
            rank, key = rank[by], key[by]
            new = np.zeros(len(rank) + 1, dtype=np.int64)
            tied = np.flatnonzero(key[1:] == key[:-1])
            if len(tied):
                ends = np.stack([rank[tied] + 1, rank[tied + 1] + 1], axis=1).ravel()
                new[tied + 1] = 1 + np.minimum.reduceat(lcp, ends)[::2]
            order, lcp = order[rank], new
        opens = np.flatnonzero(lcp[:-1] < LENGTH)
        if len(opens) == len(order):
            continue
        whole = (nearest[order] <= d) & (farthest[order] >= d)
        place = np.where(whole, earlier[order], n)
        first = np.repeat(np.minimum.reduceat(place, opens), np.diff(np.append(opens, len(order))))
        again = order[whole & (place > first)]
        marks.append((again, np.full(len(again), d)))
    if not marks:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
    piece, d = (np.concatenate(z) for z in zip(*marks, strict=True))
    by = np.lexsort((-d, piece))
    piece, begin = piece[by], (start + offset)[piece[by]] - d[by]
    new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (begin[1:] != begin[:-1] + 1)])) if len(piece) else np.empty(0, dtype=np.int64)
    last = np.append(new[1:], len(piece)) - 1 if len(piece) else new
    return piece[new], begin[new], begin[last] + LENGTH


def _induced(pieces: DataFrame, at_once: int = 20_000) -> DataFrame:
    """(doc_id, mark, from, to) of the repeats among ``pieces`` (anchor, doc_id, at, data), which come sorted by anchor within their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.Table) -> pa.RecordBatch:
            anchor, doc_id, at = (rows.column(c).to_numpy() for c in ("anchor", "doc_id", "at"))
            once = np.sort(np.unique(np.stack([anchor, doc_id, at]), axis=1, return_index=True)[1])  # twins show a piece several times
            anchor, doc_id, at = anchor[once], doc_id[once], at[once]
            piece, begin, end = induce(anchor, doc_id, at, rows.column("data").take(pa.array(once)).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(z) for z in (doc_id[piece], (at & 0xFFFF)[piece], begin, end)], ["doc_id", "mark", "from", "to"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= at_once:
                rows = pa.Table.from_batches(held)
                anchor = rows.column("anchor").to_numpy()
                whole = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                held = rows.slice(whole).to_batches()
                if whole:
                    yield settle(rows.slice(0, whole))
        if held:
            yield settle(pa.Table.from_batches(held))

    return map_arrow(pieces.repartition("anchor").sortWithinPartitions("anchor"), run, "doc_id long, mark long, from long, to long")


def _mark_of(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _shown(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (anchor, doc_id, at, hot) with the bytes of their pieces from ``docs`` (doc_id, mark, text)."""
    lists = wanted.groupBy("doc_id", _mark_of("at").alias("mark")).agg(F.collect_list(F.struct("anchor", "at", "hot")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, bool, bytes]] = []
            for doc_id, text, want in zip(b.column(0).to_pylist(), _bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                out += [(w["anchor"], doc_id, w["at"], w["hot"], text[(s := w["at"] >> 30) : s + ((w["at"] >> 23) & 127) + LENGTH - 1]) for w in want]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["anchor", "doc_id", "at", "hot", "data"])

    return map_arrow(docs.join(lists, ["doc_id", "mark"]).select("doc_id", "text", "wanted"), run, "anchor long, doc_id long, at long, hot boolean, data binary")


def _by_window(pieces: DataFrame) -> DataFrame:
    """(doc_id, mark, from, to) of the repeats among ``pieces``, one window at a time, by 128-bit hashes of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, at, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "data")), strict=True):
                n = len(data) - LENGTH + 1
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i : i + LENGTH]) for i in range(n)), dtype=np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(n, doc_id)), pa.array((at >> 30) + np.arange(n)), pa.array(np.full(n, at & 0xFFFF))], ["h1", "h2", "doc_id", "from", "mark"])

    windows = map_arrow(pieces, run, "h1 long, h2 long, doc_id long, from long, mark long")
    place = F.struct("doc_id", "from", "mark")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(firsts, ["h1", "h2"]).where(place > F.col("first")).select("doc_id", "mark", "from", (F.col("from") + LENGTH).alias("to"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, from, to): byte ranges of ``docs`` (doc_id, text) to remove; they may overlap and touch."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), text_mark().alias("mark"), "text")
    tasks = tasks_for(docs)
    pieces = _pieces(docs)
    often = staged(pieces.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors", tasks)
    release(spark)
    # written first: a join of two plain shuffles can be split where an anchor is very common
    common = staged(pieces.join(often.hint("shuffle_hash"), "anchor"), "pieces", tasks)
    release(spark)
    place = F.struct("doc_id", "at")
    firsts = staged(common.groupBy("anchor", "piece").agg(F.min(place).alias("first"), F.count("*").alias("n")), "first-pieces", tasks)
    twins = common.join(firsts.where("n > 1").select("anchor", "piece", "first"), ["anchor", "piece"]).where(place > F.col("first"))
    start, windows = F.shiftright("at", 30), F.shiftright("at", 23).bitwiseAND(F.lit(127))
    spans = staged(twins.select("doc_id", _mark_of("at").alias("mark"), start.alias("from"), (start + windows + LENGTH - 1).alias("to")), "twin-spans", tasks)
    unlike = firsts.groupBy("anchor").agg(F.count("*").alias("pieces")).where("pieces > 1")
    wanted = firsts.join(unlike, "anchor").select("anchor", "first.doc_id", "first.at", (F.col("pieces") > HOT).alias("hot"))
    shown = staged(_shown(wanted, docs), "shown-pieces", tasks)
    forget(often, common, firsts)
    release(spark)
    return spans.unionByName(_induced(shown.where("not hot"))).unionByName(_by_window(shown.where("hot")))


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``data``, and the number of maximal removed runs."""
    kept: list[bytes] = []
    end = runs = 0
    for a, b in sorted(spans):
        if a > end or not runs:
            kept.append(data[end:a])
            runs += 1
        end = max(end, b)
    kept.append(data[end:])
    return b"".join(kept), runs


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the spans to remove in a new column, and the column's name."""
    spans = staged(repeated_spans(docs.select("doc_id", "text")), "spans", tasks_for(docs))
    release(docs.sparkSession)
    to, i, m = (unused([*docs.columns, *taken], c) for c, taken in (("spans", "im"), ("i", ["m"]), ("m", "i")))
    lists = spans.groupBy(F.col("doc_id").alias(i), F.col("mark").alias(m)).agg(F.collect_set(F.struct("from", "to")).alias(to))  # equal rows show the same spans
    return docs.join(lists, (F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)) == F.col(i)) & (text_mark() == F.col(m)), "left").drop(i, m), to


def _pairs(spans: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    return [(s["from"], s["to"]) for s in spans or ()]


def repeat_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data, spans in zip(_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                left, runs = cut_spans(data, _pairs(spans))
                rows.append((len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest()))
            n, removed, runs, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows, spans = _with_spans(docs.select(F.col("doc_id").cast("long"), "text"))
    return map_arrow(rows.select("doc_id", "text", spans), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; bytes of a character that was cut in two go as well.  Texts without repeats (null ones too) stay as they are."""
    at, docs_columns = docs.columns.index("text"), docs.columns
    rows, to = _with_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, spans in enumerate(b.column(len(docs_columns)).to_pylist()):
                if texts[i] and spans:
                    texts[i] = cut_spans(texts[i].encode("utf-8", "replace"), _pairs(spans))[0].decode("utf-8", "ignore")
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    return map_arrow(rows.select(*docs_columns, to), run, docs.schema)
