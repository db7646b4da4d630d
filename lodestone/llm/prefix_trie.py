"""The trie of conversations' common beginnings, from the array of common prefixes of neighbours in sorted order.

Turns become digests, and a conversation the line of its turns' digests.  Lines are sorted; for each the number of
turns shared with the line before it (lcp) is known.  An inner node of the trie is a run of lines between two smaller
values of that array, as deep as the least value within.  These runs are the Cartesian tree of the array: each value's
nearest smaller values on both sides are found by a stack within a block, and beyond it in the block that the blocks'
minima name, at a step of that block's descending minima.  Runs with equal ends and depth are one node.  A line that is
longer than both its neighbours' shares ends in a leaf of its own.  Depths between a node and its parent that the tree
leaves out are filled in, and what a node needs of its members comes from prefix sums over the order and from least ids
of ranges.

Edge cases: a null role or text is empty; of equal turn numbers (null first) the order is by role, then by text (its first 32
characters, then its digest); repeated rows are turns of their own; rows without a conv_id are left out; an empty table
gives no rows; other columns are ignored; texts may be of any length.  A conversation's digests (36 bytes a turn, never its
text) stand in one row.  Equal digests of 128 bits are taken for equal turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_arrow, staged, tasks_for

SHARED = 6
#: Letters of a turn's digest in a line.
DIGEST = 32
_NONE = (1 << 63) - 1
_HIGH = 1 << 30
_POSITIONS = (
    "p int, kind string, pos long, conv_id long, n int, lcp int, nxt int, saved_before long, saved_after long, leaves_before long, same boolean, "
    "l long, l_lcp int, r long, r_lcp int, low long, above int, block int"
)
_NAMES = [c.split()[0] for c in _POSITIONS.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in _POSITIONS.split(", ")]


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns in order, an array of (digest, letters)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), F.substring(text, 1, 32).alias("head"), digest.alias("digest"), F.length(text).alias("letters"))
    lines = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return lines.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["letters"].alias("letters"))).alias("turns"))


def rebuild(lines: DataFrame, every: int = 100, most: int = SHARED) -> DataFrame:
    """Each line of turns with its first h replaced by those of the conversation whose id is the next lower multiple of ``every``; h is its id's checksum modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    bases = lines.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    none = F.array().cast(lines.schema["turns"].dataType)
    joined = lines.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(bases, "base", "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.lit(0), F.size("turns") - h))).alias("turns"))


def shared(a: str, b: str) -> int:
    """How many whole digests two lines begin with in common."""
    most = min(len(a), len(b)) // DIGEST
    if a[: most * DIGEST] == b[: most * DIGEST]:
        return most
    low, step = 0, 1
    while a[low * DIGEST : (low + step) * DIGEST] == b[low * DIGEST : (low + step) * DIGEST] and low + step <= most:
        low, step = low + step, step * 2
    while step > 1:
        step //= 2
        if low + step <= most and a[low * DIGEST : (low + step) * DIGEST] == b[low * DIGEST : (low + step) * DIGEST]:
            low += step
    return low


def ordered(lines: DataFrame, tasks: int) -> DataFrame:
    """Lines in order: (p, k, conv_id, n, lcp, nxt, sums, line) for the k-th of partition p.

    lcp, nxt: turns shared with the line before and after, null at the ends of a partition.  sums: letters of the first so many turns.
    line: only of a partition's first and last.
    """
    schema = "p int, k long, conv_id long, n int, lcp int, nxt int, sums array<long>, line string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, k = TaskContext.get().partitionId(), 0
        held: list | None = None  # the last row: what comes after it isn't known yet
        for b in batches:
            out = []
            for conv, line, letters in zip(*(x.to_pylist() for x in b.columns), strict=True):
                common = None if held is None else shared(held[7], line)
                if held is not None:
                    out.append([*held[:5], common, held[6], held[7] if held[1] == 0 else None])
                held = [p, k, conv, len(letters), common, None, [0, *np.cumsum(letters, dtype=np.int64).tolist()], line]
                k += 1
            if out:
                yield batch(out)
        if held is not None:
            yield batch([held])

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    keyed = lines.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("line"), F.transform("turns", lambda t: t["letters"]).alias("letters"))
    return map_arrow(keyed.repartitionByRange(tasks, "line", "conv_id").sortWithinPartitions("line", "conv_id"), run, schema)


def _blocks(lines: DataFrame) -> dict[int, dict]:
    """What is known of each block as a whole; a row a partition, and so bounded by how many there are."""
    sums = lambda upto: F.element_at("first_sums", upto + 1)
    totals = lines.groupBy("p").agg(
        F.count("*").alias("rows"), F.min("lcp").alias("inner"), F.min("conv_id").alias("low"), F.sum(F.element_at("sums", F.col("lcp") + 1)).alias("saved"), F.sum((F.col("nxt") < F.col("n")).cast("long")).alias("leaves"),
        F.min_by("line", "k").alias("first"), F.max_by("line", "k").alias("last"), F.min_by("sums", "k").alias("first_sums"), F.max_by("n", "k").alias("last_n"),
    )
    common = F.udf(lambda a, b: -1 if a is None else shared(a, b), "int")
    near = Window.orderBy("p")
    found = totals.withColumns({"first_lcp": common(F.lag("last").over(near), F.col("first")), "before_n": F.coalesce(F.lag("last_n").over(near), F.lit(-1))}).withColumn("after", F.coalesce(F.lead("first_lcp").over(near), F.lit(-1)))
    found = found.select(
        "p", "rows", "low", "first_lcp", "before_n", "after", F.least(F.coalesce("inner", "first_lcp"), "first_lcp").alias("least"),
        (F.coalesce("saved", F.lit(0)) + sums(F.greatest(F.lit(0), F.col("first_lcp")))).alias("saved"), (F.coalesce("leaves", F.lit(0)) + (F.col("after") < F.col("last_n")).cast("long")).alias("leaves"),
    )
    blocks = {r.p: r.asDict() for r in found.orderBy("p").collect()}
    pos = saved = leaves = 0
    for b in blocks.values():
        b |= {"pos": pos, "saved_before": saved, "leaves_before": leaves}
        pos, saved, leaves = pos + b["rows"], saved + b["saved"], leaves + b["leaves"]
    return blocks


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """For each value the place of the nearest smaller one before and after it: -1 and the length where there is none."""
    n = len(values)
    before, after, stack = [-1] * n, [n] * n, []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1] if values[stack[-1]] < v else before[stack[-1]]
        stack.append(i)
    return before, after


class RangeLeast:
    """Least value of any range, in constant time."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp((end - begin).astype(float))[1] - 1
        out = np.empty(len(begin), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][begin[at]], self.rows[k][end[at] - (1 << int(k))])
        return out


def _block(p: int, blocks: dict[int, dict], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Positions of a block with what is smaller near them; steps of its descending minima, and what it asks of other blocks'."""
    own, n_all = blocks[p], sum(b["rows"] for b in blocks.values())
    order = sorted(blocks)
    here = order.index(p)
    first = own["pos"]
    conv, n, lcp, nxt, saved, sums = ([*c] for c in zip(*rows, strict=True))
    lcp[0], nxt[-1] = own["first_lcp"], own["after"]
    saved[0] = sums[0][max(0, lcp[0])]
    m = len(lcp)
    before, after = nearest_smaller(lcp)
    low_of = RangeLeast(np.array(conv, dtype=np.int64))
    v, l, r = np.array(lcp), np.array(before), np.array(after)
    low = low_of(np.maximum(l, 0), r)
    # sums of what comes before, and whether a line equals the one before it
    length, then = np.array(n), np.array(nxt)
    saved_after = own["saved_before"] + np.cumsum(saved, dtype=np.int64)
    saved_before = saved_after - np.array(saved)
    leaves_before = own["leaves_before"] + np.concatenate([[0], np.cumsum(then < length)[:-1]])
    same = (v == length) & (np.concatenate([[own["before_n"]], length[:-1]]) == length)
    l_pos: list[int | None] = [first + x if x >= 0 else None for x in before]
    r_pos: list[int | None] = [first + x if x < m else None for x in after]
    l_lcp, r_lcp = [lcp[x] if x >= 0 else None for x in before], [lcp[x] if x < m else None for x in after]
    asks = []
    for side, places, step in (("l", [i for i in range(m) if before[i] < 0 and lcp[i] >= 0], -1), ("r", [i for i in range(m) if after[i] == m and lcp[i] >= 0], 1)):
        by_value: dict[int, list[int]] = {}
        for i in places:
            by_value.setdefault(lcp[i], []).append(i)
        for value, at in by_value.items():
            q, least = here + step, _NONE
            while 0 <= q < len(order) and blocks[order[q]]["least"] >= value:
                least = min(least, blocks[order[q]]["low"])
                q += step
            low[at] = np.minimum(low[at], least)
            if 0 <= q < len(order):
                asks.append((f"ask_{side}", value, order[q]))
            else:  # to the end of all
                for i in at:
                    r_pos[i], r_lcp[i] = n_all, -1
    blank: list[None] = [None] * m
    yield _rows([[p] * m, ["at"] * m, range(first, first + m), conv, n, lcp, nxt, saved_before, saved_after, leaves_before, same, l_pos, l_lcp, r_pos, r_lcp, low, blank, blank])
    if here == len(order) - 1:  # the place after the last line
        yield _rows([[p], ["at"], [n_all], *[[None]] * 4, [saved_after[-1]], [None], [own["leaves_before"] + own["leaves"]], *[[None]] * 8])
    steps = []
    least = _HIGH
    for j in range(m):
        if lcp[j] < least:
            steps.append(("r", lcp[j], least, first + j, int(low_of(np.array([0]), np.array([j]))[0]) if j else _NONE))
            least = lcp[j]
    least = _HIGH
    for j in range(m - 1, -1, -1):
        if lcp[j] < least:
            steps.append(("l", lcp[j], least, first + j, int(low_of(np.array([j]), np.array([m]))[0])))
            least = lcp[j]
    side, value, above, pos, low_to = ([*c] for c in zip(*steps, strict=True))
    blank = [None] * len(steps)
    yield _rows([[p] * len(steps), side, pos, blank, blank, value, *[blank] * 9, low_to, above, blank])
    if asks:
        kind, value, block = zip(*asks, strict=True)
        blank = [None] * len(asks)
        yield _rows([[p] * len(asks), kind, blank, blank, blank, value, *[blank] * 9, blank, blank, block])


def _rows(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def positions(lines: DataFrame) -> DataFrame:
    """A row for each line of ordered(): its place, and the places (l, r) and values of the nearest smaller shares on both sides; low is the least conv_id from l to before r.

    saved_before, leaves_before: letters of shared turns and leaves of all lines before.  A last row, for the place after all lines, has only these.
    """
    blocks = lines.sparkSession.sparkContext.broadcast(_blocks(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for b in batches:
            for p, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if p != current:
                    if rows:
                        yield from _block(current, blocks.value, rows)
                    current, rows = p, []
                rows.append(tuple(row))
        if rows:
            yield from _block(current, blocks.value, rows)

    # the share of a block's first line isn't in its row: all its sums go along
    small = lines.select("p", "k", "conv_id", "n", "lcp", "nxt", F.element_at("sums", F.col("lcp") + 1).alias("saved"), F.when(F.col("lcp").isNull(), F.col("sums")).alias("sums"))
    found = staged(map_arrow(small.repartition("p").sortWithinPartitions("p", "k").select("p", "conv_id", "n", "lcp", "nxt", "saved", "sums"), run, _POSITIONS), "trie-positions")
    out = found.where("kind = 'at'").drop("kind", "above", "block")
    for side in "lr":
        step = found.where(F.col("kind") == side).select(F.col("p").alias("block"), F.col("lcp").alias("value"), "above", F.col("pos").alias("to"), F.col("low").alias("low_to"))
        asked = found.where(F.col("kind") == f"ask_{side}").select("p", F.col("lcp").alias("share"), "block")
        told = asked.join(step, (asked["block"] == step["block"]) & (step["value"] < asked["share"]) & (asked["share"] <= step["above"])).select(F.col("p").alias("asker"), "share", "value", "to", "low_to")
        out = out.join(told, (out["p"] == told["asker"]) & (out["lcp"] == told["share"]) & out[side].isNull(), "left")
        out = out.withColumns({side: F.coalesce(side, "to"), f"{side}_lcp": F.coalesce(f"{side}_lcp", "value"), "low": F.least("low", "low_to")}).drop(*told.columns)
    return out


def _digests(at: DataFrame) -> DataFrame:
    """(start, ends_sha256) of each group of equal lines, by the place of its first: ids are joined by block, and the blocks' parts hashed one after the other."""
    parts = at.where(F.col("conv_id").isNotNull()).groupBy(F.when(F.col("same"), F.col("l")).otherwise(F.col("pos")).alias("start"), "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha = None, hashlib.sha256()
        for b in batches:
            starts, shas = [], []
            for start, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if start == current:
                    sha.update(f",{ids}".encode())
                    continue
                if current is not None:
                    starts.append(current)
                    shas.append(sha.hexdigest())
                current, sha = start, hashlib.sha256(ids.encode())
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(shas, pa.string())], ["start", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["start", "ends_sha256"])

    return map_arrow(parts.repartition("start").sortWithinPartitions("start", "p").select("start", "ids"), run, "start long, ends_sha256 string")


def nodes(conversations: DataFrame, every: int = 100, most: int = SHARED) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of rebuilt conversations."""
    rebuilt = staged(rebuild(sequences(conversations), every, most), "trie-rebuilt")
    lines = staged(ordered(rebuilt, tasks_for(rebuilt)), "trie-lines")
    forget(rebuilt)
    return _expanded(staged(positions(lines), "trie-at"), lines)


def _parent(left: Column, right: Column, left_at: Column, right_at: Column) -> dict[str, Column]:
    return {"up": F.greatest(left, right), "up_at": F.when(left >= right, left_at).otherwise(right_at)}


def _expanded(at: DataFrame, lines: DataFrame) -> DataFrame:
    inner = at.where("lcp >= 0").groupBy("l", F.col("lcp").alias("depth")).agg(F.max("r").alias("r"), F.max("l_lcp").alias("l_lcp"), F.max("r_lcp").alias("r_lcp"), F.min("low").alias("low"), F.sum((F.col("n") > F.col("lcp")).cast("long")).alias("starts"))
    inner = inner.withColumns(_parent(F.col("l_lcp"), F.col("r_lcp"), F.col("l"), F.col("r"))).select("l", "r", "depth", "low", "starts", "up", "up_at")
    alone = at.where(F.col("n") > F.greatest("lcp", "nxt")).withColumns(_parent(F.col("lcp"), F.col("nxt"), F.col("pos"), F.col("pos") + 1))
    alone = alone.select(F.col("pos").alias("l"), (F.col("pos") + 1).alias("r"), F.col("n").alias("depth"), F.col("conv_id").alias("low"), F.lit(0).cast("long").alias("starts"), "up", "up_at")
    starts = at.join(lines.select("conv_id", "sums"), "conv_id").select(F.col("pos").alias("l"), "sums", F.col("n").alias("n_l"), F.col("saved_after").alias("saved_l"), F.col("leaves_before").alias("leaves_l"))
    ends = at.select(F.col("pos").alias("r"), F.col("saved_before").alias("saved_r"), F.col("leaves_before").alias("leaves_r"))
    found = inner.unionByName(alone).join(starts, "l").join(ends, "r")
    found = found.join(at.select(F.col("pos").alias("up_at"), F.col("low").alias("up_low")), "up_at", "left")
    found = found.join(_digests(at).withColumnRenamed("start", "l"), "l", "left")
    width = F.col("r") - F.col("l")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    deepest = F.col("d") == F.col("depth")
    below = F.when(F.col("d") > 0, F.element_at("sums", F.col("d"))).otherwise(F.lit(0))
    children = F.col("starts") + F.when((width > 1) & (F.col("n_l") > F.col("depth")), 1).otherwise(0)
    return found.withColumn("d", F.explode(F.sequence(F.col("up") + 1, F.col("depth")))).select(
        F.col("low").alias("conv_id"), F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") == 0, F.lit(None)).when(F.col("d") - 1 > F.col("up"), F.col("low")).otherwise(F.col("up_low")).cast("long").alias("parent_conv_id"),
        width.alias("n_convs"), F.when(deepest, children).otherwise(1).cast("long").alias("n_children"), (F.col("leaves_r") - F.col("leaves_l")).alias("n_leaves"),
        (F.col("saved_r") - F.col("saved_l") - (width - 1) * below).alias("saved_tokens"),
        F.when(deepest & (F.col("n_l") == F.col("depth")), F.col("ends_sha256")).otherwise(nothing).alias("ends_sha256"),
    )
