"""A graph of nearest neighbours by descent: neighbours of neighbours are likely neighbours.

Each vector keeps a list of its ``width`` nearest so far.  The first lists come from a few random partitions of the
space, compared within blocks of bounded size.  In each round every vector brings its list, and those whose lists it is in,
together: all of them are compared with each other, and what is nearer than the last of a list goes in.  Work and
shuffles of a round are in proportion to the number of vectors, whatever that is.

What travels to the meetings are codes, a byte a component: each vector goes to as many of them as lists are long, twice over.
Lists are in the order of the codes' distances; in the end all that may be among the k nearest by them is measured on the
vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

EDGES = "id long, nb long, distance double"


def _unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, code, error): vectors of length 1 as bytes, and as codes that are so far from them, of rows with a finite one that isn't zero; of rows that share an id the least.

    A code is a scale and a signed byte for each component.
    """
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, codes, errors = [], [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(v or [], dtype=np.float64)
                norm = float(np.sqrt((x * x).sum()))
                if 0 < norm < np.inf:
                    x /= norm
                    scale = np.float32(np.abs(x).max() / 127)
                    code = np.clip(np.rint(x / scale), -127, 127).astype(np.int8)
                    ids.append(i)
                    out.append(x.tobytes())
                    codes.append(scale.tobytes() + code.tobytes())
                    errors.append(float(np.linalg.norm(x - code * float(scale))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(codes, pa.binary()), pa.array(errors, pa.float64())], ["id", "vec", "code", "error"])

    return kept.mapInArrow(run, "id long, vec binary, code binary, error double")


def _decoded(codes: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of those of ``codes`` that are as long as the first."""
    off = np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset : codes.offset + len(codes) + 1]
    data = np.frombuffer(codes.buffers()[2], dtype=np.uint8)
    sizes = np.diff(off)
    at = np.flatnonzero(sizes == sizes[0])
    raw = data[off[0] : off[-1]].reshape(len(at), -1) if len(at) == len(codes) else np.stack([data[off[k] : off[k + 1]] for k in at])
    return at, raw[:, 4:].view(np.int8) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _edges(ids: np.ndarray, x: np.ndarray, worst: np.ndarray, new: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs among a group of vectors that are nearer than the last of the first one's list; with ``new``, only those of which one is new."""
    d = np.round(1.0 - x @ x.T, 6).astype(np.float64)
    near = d < worst[:, None]
    np.fill_diagonal(near, False)
    if new is not None:
        near &= new[:, None] | new[None, :]
    a, b = np.nonzero(near)
    if width < len(ids):  # no more of a group than a list takes
        order = np.lexsort((d[a, b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
        nth = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        a, b = a[nth < width], b[nth < width]
    return ids[a], ids[b], d[a, b]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of rows with the same first column, whichever batches they come in."""
    rest = None
    for b in batches:
        b = b if rest is None else pa.concat_batches([rest, b])
        key = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)
        rest = b.slice(cuts[-1]) if len(key) else None
    if rest is not None:
        yield rest


def _batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*parts, strict=True)], ["id", "nb", "distance"])


def _partitioned(vectors: DataFrame, n: int, trees: int, block: int, width: int, seed: int) -> DataFrame:
    """First edges: each tree cuts the space by as many random planes as make blocks of about ``block`` vectors, and vectors are compared within blocks."""
    planes = max(0, int(np.ceil(np.log2(max(1, n / block)))))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(1)
            sizes = np.diff(np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset : codes.offset + len(codes) + 1])
            side = np.zeros((trees, len(codes)), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = _decoded(codes.take(pa.array(at)))[1]
                for tree in range(trees):
                    through = np.random.default_rng([seed, tree, size]).normal(size=(planes, x.shape[1]))
                    side[tree, at] = ((x @ through.T > 0) @ (1 << np.arange(planes))) if planes else 0
            for tree in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(side[tree] * trees + tree), b.column(0), codes], ["leaf", "id", "code"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in _groups(batches):
            for i in range(0, leaf.num_rows, 2 * block):
                part = leaf.slice(i, 2 * block)
                at, x = _decoded(part.column(2))  # vectors of another length have no cosine with these
                if len(at) > 1:
                    yield _batch([_edges(part.column(1).to_numpy()[at], x, np.full(len(at), np.inf), None, width)])

    dealt = vectors.select("id", "code").mapInArrow(leaves, "leaf long, id long, code binary").repartition("leaf").sortWithinPartitions("leaf", F.xxhash64("id"))
    return dealt.mapInArrow(compare, EDGES)


def _nearest(edges: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest of each list, each neighbour once; new says whether it wasn't in the list before."""
    once = edges.groupBy("id", "nb").agg(F.min("distance").alias("distance"), F.min("new").alias("new"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("distance", "nb"))).where(F.col("nth") <= width)


def descent_graph(df: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", width: int = 24, trees: int = 6, block: int = 128, rounds: int = 8, least: float = 0.002, seed: int = 7) -> DataFrame:
    """(query_id, rank, id, distance): about the k nearest other rows of each row of ``df``, nearest first, ties by id.

    rounds: at most so many; they end when fewer than ``least`` of all list entries are new.  Distances are exact.  Rows with a
    null id, and null, zero or non-finite vectors, take no part; of rows that share an id the least vector counts.
    """
    vectors = staged(_unit_vectors(df, id_col, vec_col), "descent-vectors")
    n, error = vectors.agg(F.count("*"), F.coalesce(F.max("error"), F.lit(0.0))).first()
    graph = staged(_nearest(_partitioned(vectors, n, trees, block, width, seed).withColumn("new", F.lit(1)), width), "descent-graph")
    for r in range(rounds):
        graph, changed = _round(graph, vectors, width, seed + r)
        if changed <= least * n * width:
            break
    return _measured(graph, vectors, k, 2 * error * (1 + error) + 1e-5)


def _measured(graph: DataFrame, vectors: DataFrame, k: int, error: float) -> DataFrame:
    """The k nearest of each list by the vectors themselves, where the list's distances are off by ``error`` at most: all up to so much behind the k-th are measured."""
    kth = F.max(F.when(F.col("nth") <= k, F.col("distance"))).over(Window.partitionBy("id"))
    likely = graph.withColumn("kth", kth).where(F.col("distance") <= F.col("kth") + 2 * error).select("id", "nb")
    pairs = likely.join(vectors.select(F.col("id").alias("nb"), F.col("vec").alias("other")), "nb").join(vectors.select("id", "vec"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            d = [round(1.0 - float(np.frombuffer(x) @ np.frombuffer(y)), 9) for x, y in both]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], ["id", "nb", "distance"])

    exact = pairs.select("id", "nb", "vec", "other").mapInArrow(run, EDGES)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "nb"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("nb").alias("id"), "distance")


def _round(graph: DataFrame, vectors: DataFrame, width: int, seed: int) -> tuple[DataFrame, int]:
    def some(side: Column) -> Window:
        return Window.partitionBy(side).orderBy(F.desc("new"), F.xxhash64(F.lit(seed), "id", "nb"))

    # who meets at v: its list and, as many at most, those whose lists it is in; a vector that very many name doesn't draw them all together
    back = graph.select(F.col("nb").alias("v"), F.col("id").alias("u"), "new", F.row_number().over(some(F.col("nb"))).alias("n")).where(F.col("n") <= width).drop("n")
    meet = graph.select(F.col("id").alias("v"), F.col("nb").alias("u"), "new").unionByName(back).groupBy("v", "u").agg(F.max("new").alias("new"))
    full = graph.groupBy("id").agg(F.when(F.count("*") >= width, F.max("distance")).otherwise(float("inf")).alias("worst"))
    known = vectors.join(full, "id", "left").select(F.col("id").alias("u"), "code", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for group in _groups(batches):
            new = group.column(2).to_numpy().astype(bool)
            if group.num_rows > 1 and new.any():
                at, x = _decoded(group.column(4))
                parts.append(_edges(group.column(1).to_numpy()[at], x, group.column(3).to_numpy()[at], new[at], width))
                held += len(parts[-1][0])
            if held > 50_000:
                yield _batch(parts)
                parts, held = [], 0
        if held:
            yield _batch(parts)

    found = meet.join(known, "u").select("v", "u", "new", "worst", "code").repartition("v").sortWithinPartitions("v").mapInArrow(compare, EDGES)
    merged = _nearest(graph.select("id", "nb", "distance", F.lit(0).alias("new")).unionByName(found.withColumn("new", F.lit(1))), width)
    after = staged(merged, "descent-graph")
    return after, after.where("new = 1").count()
