"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct five-word shingles.  Its sketch holds, for each of ``bands *
rows`` hash functions, the smallest exponentially distributed value over the set, kept as the floor
of its logarithm to a base just above 1 and truncated to 16 bits: such registers merge by maximum,
and two of them are equal with nearly the probability of the Jaccard similarity.  Bands of registers
name candidates; the likelihood of the registers' order, with both set sizes known, estimates the
similarity of a candidate pair and drops the hopeless ones; full sets decide the rest.

Documents with equal sets are one node.  A bucket of nodes that share a band is never expanded into
all pairs: its members are compared with one pivot first; once linked nodes are joined to components,
only members outside a bucket's largest component are compared with members of other components, by
estimates in blocks of sketches, the best pairs first and then all.  That leaves no likely pair of
different components untested; at similarity 0.75, 32 bands of 4 registers miss a pair with
probability 5e-6.

Edge cases: a null, empty or blank text has an empty set, links with nothing and is kept; fewer than
five words make one shingle; repeated rows (and rows that share an id) are nodes by their text alone,
so equal texts always share a component; a row with a null id makes no link and is kept, but shows the
component of an equal text if there is one; an empty table gives no rows; other columns are ignored.
Where documents are dropped, unlike texts that share an id are documents of their own.
Sets are compared as sets of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import files_for, forget, map_arrow, staged, tasks_for, unused

BANDS, ROWS = 32, 4
BLOCK = 512
#: A group whose texts are compared in one go has so many shingles at most, unless a single text has more.
SHINGLES = 4_000_000
#: START keeps the registers of the smallest sets above 0: one shingle's hash exceeds e ** (START * (BASE - 1)) = 60 with probability e ** -60.
BASE, START, TOP = 1.001, 4096, (1 << 16) - 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = np.random.default_rng(75).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a whole text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(len(w), k), dtype=np.uint64)
    for j in range(min(len(w), k)):
        h = h * _M1 + w[j : j + n]
    return np.unique(_mixed(h))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set, from 0 (empty) to TOP."""
    if not len(hashes):
        return np.zeros(len(_ODD), dtype=np.uint16)
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(low, np.multiply.outer(_ODD, hashes[i : i + 1024]).min(axis=1), out=low)
    x = -np.log1p(-((low >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))
    return np.clip(np.floor(START + 1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of paired sketches (rows), from which register is larger how often, given the set sizes."""
    if len(a) > rows:  # each pair takes about 10 kB while its likelihoods are compared
        return np.concatenate([estimate(*(x[i : i + rows] for x in (a, b, n_a, n_b))) for i in range(0, len(a), rows)])
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    top = np.minimum(u / (1 - u), (1 - u) / u)  # what the sizes allow
    j = np.linspace(0, 1, 101)[None, :] * top
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    gt, lt = p(u - (1 - u) * j), p((1 - u) - u * j)
    fit = more * np.log(gt) + less * np.log(lt) + same * np.log(np.clip(1 - gt - lt, 1e-12, 1))
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _mark() -> Column:
    return F.xxhash64("text")


def sketch_documents(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, mark, n_shingles, node, sketch) for each row of ``docs`` (doc_id, text); node and sketch are null for empty sets.  mark: a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, k) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "mark", "n_shingles", "node", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), _mark().alias("mark"), "text"), run, "doc_id long, mark long, n_shingles long, node long, sketch binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(band, node): a row for each band of each row of ``nodes`` (node, sketch)."""
    salt = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                packed = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint64).reshape(-1, BANDS)  # ROWS registers of 16 bits
                keys = _mixed(packed ^ salt).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["band", "node"])

    return map_arrow(nodes.select("node", "sketch"), run, "band long, node long")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose estimated similarity is at least ``least``, with the ids of documents that show their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for c in ("s_a", "s_b"))
                ok = estimate(s, t, b.column("n_a").to_numpy(), b.column("n_b").to_numpy()) >= least
                yield b.select(["a", "b", "doc_a", "doc_b"]).filter(pa.array(ok))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("rep").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a long, b long, doc_a long, doc_b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, shingles(None))
        for b in batches:
            ok = []
            for a_id, b_id, a, c in zip(*(b.column(x).to_pylist() for x in ("a", "b", "t_a", "t_b")), strict=True):
                if last[0] != c:
                    last = (c, shingles(c, k))
                x, y = shingles(a, k), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(_node(x) == a_id and _node(y) == b_id and 100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: texts.select(F.col("doc_id").alias(f"doc_{x}"), F.col("text").alias(f"t_{x}"))
    return map_arrow(pairs.join(side("a"), "doc_a").join(side("b"), "doc_b").select("a", "b", "t_a", "t_b"), run, "a long, b long").distinct()


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, label): for each node of ``links`` (a, b), the smallest node that it reaches.  files: how many a step is written in.

    Labels are replaced by the smallest of the neighbours' labels and then by their label's label, so the
    distance that a label travels about doubles with every round.
    """
    edges = staged(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "edges", files=files)
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels", files=files)
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = staged(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels-near", files=files)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = staged(step.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels", files=files)
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            forget(edges, step)
            return labels
        forget(step)


def _pair_up(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that hold few[r] and many[r] items, laid end to end: the indices of all pairs within a row."""
    left = np.repeat(np.arange(few.sum()), np.repeat(many, few))
    size = few * many
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    right = np.repeat(np.cumsum(many) - many, size) + within % np.repeat(many, size)
    return left, right


def _in_blocks(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """The ``nodes`` of ``members`` (band, node, pivot) with the block (tb) of about ``BLOCK`` alike nodes, and ``SHINGLES``, in which their texts travel."""
    near = nodes.join(members.groupBy("node").agg(F.min("pivot").alias("cluster")), "node")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES))
    large = near.groupBy("cluster").agg(parts.alias("parts")).where(F.col("parts") > 1)
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    return near.join(large, "cluster", "left").withColumn("tb", F.xxhash64("cluster", part)).select(*nodes.columns, "tb")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with the label of their component."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _across(members: DataFrame, nodes: DataFrame, least: float, best: int, tasks: int | None = None) -> DataFrame:
    """Likely neighbours across components: what ``members`` (band, node) share, among ``nodes`` of _labelled().

    Nodes outside their bucket's largest component (x) meet all others of the bucket that have another
    label (y), as blocks of sketches; nothing is sent anywhere before its estimate is known to be at least
    ``least``.  best > 0: (x, y, doc_x, doc_y), the so many best pairs of each x.  0: (x, tb), the blocks
    that hold at least one likely y.
    """
    m = members.join(nodes, "node")
    sizes = m.groupBy("band", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("total")).where("labels > 1").select("band", F.col("top.label").alias("top"), "total")
    m = staged(m.join(largest, "band"), "open-buckets", tasks)
    m = m.withColumn("part", F.pmod("tb", F.ceil(F.col("total") / BLOCK)))  # one block for all but the large buckets
    item = F.collect_list(F.struct("node", "label", "rep", "n", "sketch", "tb"))
    few = m.where("label <> top").groupBy("band", "part").agg(F.first("top").alias("top"), item.alias("few")).drop("part")
    many = m.groupBy("band", "part").agg(item.alias("many")).drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            work = np.cumsum(batch.column("few").value_lengths().to_numpy().astype(np.int64) * batch.column("many").value_lengths().to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(work // 250_000)) + 1).tolist(), batch.num_rows]  # about 250,000 pairs at a time
            for i, j in zip(cuts, cuts[1:], strict=False):
                b = batch.slice(i, j - i)
                top = b.column("top").to_numpy()
                few, many = b.column("few"), b.column("many")
                n_few, n_many = few.value_lengths().to_numpy().astype(np.int64), many.value_lengths().to_numpy().astype(np.int64)
                few, many = few.flatten(), many.flatten()
                get = lambda z, c: z.field(c).to_numpy(zero_copy_only=False)
                left, right = _pair_up(n_few, n_many)
                row = np.repeat(np.arange(len(top)), n_few)[left]
                x, y, lx, ly = get(few, "node")[left], get(many, "node")[right], get(few, "label")[left], get(many, "label")[right]
                ok = np.flatnonzero((lx != ly) & ((ly == top[row]) | (x < y)))
                kf, km = (np.frombuffer(b"".join(z.field("sketch").to_pylist()), dtype=np.uint16).reshape(-1, BANDS * ROWS) for z in (few, many))
                out = []
                for k in range(0, len(ok), 20_000):
                    at = ok[k : k + 20_000]
                    like = estimate(kf[left[at]], km[right[at]], get(few, "n")[left[at]], get(many, "n")[right[at]])
                    out.append((at[like >= least], like[like >= least]))
                at, like = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (ok, ok.astype(float))
                if best:
                    order = np.lexsort((-like, x[at]))
                    at, like = at[order], like[order]
                    first = np.arange(len(at)) - np.searchsorted(x[at], x[at]) < best  # of this slice of blocks; the best of all are picked below
                    at, like = at[first], like[first]
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (x[at], y[at], get(few, "rep")[left[at]], get(many, "rep")[right[at]], like)], ["x", "y", "doc_x", "doc_y", "like"])
                else:
                    found = np.unique(np.stack([x[at], get(many, "tb")[right[at]]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["x", "tb"])

    met = few.join(many, "band").select("top", "few", "many")
    if not best:
        return map_arrow(met, run, "x long, tb long").distinct()
    pairs = map_arrow(met, run, "x long, y long, doc_x long, doc_y long, like double").distinct()
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("like"), "y"))).where(F.col("k") <= best).drop("k", "like")


def _confirmed_blocks(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b): the links between the nodes x of ``wanted`` (x, tb) and the nodes of other components in the blocks tb, by full sets.

    The askers of a block come in parts of bounded size, and the block's texts pass by each part one at a
    time: a task holds the hashes of one part's askers and no list of texts.
    """
    shown = nodes.select("node", "label", "tb", "n", F.col("rep").alias("doc_id")).join(texts, "doc_id")
    asked = wanted.select("tb", F.col("x").alias("node")).join(shown.drop("tb"), "node")
    parts = wanted.select("tb", F.col("x").alias("node")).join(nodes.select("node", "n"), "node").groupBy("tb").agg(F.ceil(F.greatest(F.count("*") / 64, F.sum("n") / (SHINGLES / 4))).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    asked = asked.join(parts, "tb").select("tb", part.alias("part"), F.lit(0).alias("turn"), "node", "label", "text")
    passing = shown.join(parts, "tb").select("tb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("turn"), "node", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: list[tuple[int, int, np.ndarray]] = []
        for b in batches:
            links: list[tuple[int, int]] = []
            for tb, part, turn, node, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (tb, part):
                    at, held = (tb, part), []
                if turn and not held:
                    continue
                t = shingles(text, k)
                if _node(t) != node:
                    continue  # another text with the same id
                if not turn:
                    held.append((node, label, t))
                    continue
                for x, own, s in held:
                    if own != label and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if 100 * both >= percent * (len(s) + len(t) - both):
                            links.append((x, node))
            yield pa.RecordBatch.from_arrays([pa.array([z[c] for z in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    rows = asked.unionByName(passing).repartition("tb", "part").sortWithinPartitions("tb", "part", "turn")
    return map_arrow(rows, run, "a long, b long").distinct()


def _grouped(docs: DataFrame, percent: int, k: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """(sketched rows (doc_id, mark, n_shingles, node), found (node, label, component_id)) of ``docs`` (doc_id, text)."""
    n, m = tasks_for(docs), files_for(docs)  # pairs and labels are small
    sketched = staged(sketch_documents(docs, k), "sketches", n)
    nodes = staged(sketched.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "nodes", n)
    keys = band_keys(nodes)
    shared = keys.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").select("band", "pivot")
    members = staged(keys.join(shared, "band"), "members", n)
    involved = members.select("node").distinct().join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct()
    texts = staged(docs.select(F.col("doc_id").cast("long"), "text").join(involved, "doc_id", "left_semi"), "candidate-texts", n)

    least = percent / 100 - slack
    pairs = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    tested = staged(_likely(pairs, nodes, least), "pairs", files=m)
    first = staged(_confirmed(tested, texts, percent, k), "links", files=m)
    blocked = staged(_in_blocks(nodes, members), "blocked-nodes", n)
    # the best pairs join most of what belongs together, and leave few for the complete pass
    some = _across(members.select("band", "node"), _labelled(blocked, components(first, m)), least, best=4, tasks=n)
    some = staged(some.toDF("a", "b", "doc_a", "doc_b").join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs", files=m)
    second = staged(_confirmed(some, texts, percent, k), "links", files=m)
    known = staged(_labelled(blocked, components(first.union(second), m)), "labelled", n)
    wanted = staged(_across(members.select("band", "node"), known, least, best=0, tasks=n), "blocks", files=m)
    third = staged(_confirmed_blocks(wanted, known, texts, percent, k), "links", files=m)
    labels = components(first.union(second).union(third), m)

    labelled = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = staged(labelled.join(smallest, "label").select("node", "label", "component_id"), "components", files=m)
    forget(nodes, members, texts, tested, first, blocked, some, second, known, wanted, third, labels)
    return sketched.drop("sketch"), found


def near_duplicates(docs: DataFrame, *, percent: int = 75, k: int = 5, slack: float = 0.15) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach; kept is doc_id = component_id.  slack: how far
    below the threshold an estimate may lie for its pair to be tested (4 standard errors: 3e-5 of the pairs right at the threshold).
    """
    sketched, found = _grouped(docs, percent, k, slack)
    component = F.coalesce("component_id", "doc_id")
    return sketched.select("doc_id", "n_shingles", "node").join(found, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, percent: int = 75, k: int = 5, slack: float = 0.15) -> DataFrame:
    """``docs`` without near duplicates, with all columns: one row of each component stays.

    It is the one with the smallest doc_id, of rows that share it the one whose text has the smallest hash, and of
    rows with equal texts too the first by the other columns.  Rows without words and rows with a null id all stay.
    """
    sketched, found = _grouped(docs, percent, k, slack)
    rows = sketched.where("node is not null and doc_id is not null").groupBy("node", "doc_id", "mark").agg(F.count("*").alias("rows")).join(found.select("node", "label"), "node")
    few = files_for(sketched)
    rows = staged(rows.select("label", "doc_id", "mark", "rows"), "documents", files=few)
    stays = rows.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("stays"))
    d, m, n = unused(docs.columns, "d"), unused(docs.columns, "m"), unused(docs.columns, "n")
    named = (F.col("doc_id").alias(d), F.col("mark").alias(m))
    gone = rows.join(stays, "label").where(F.struct("doc_id", "mark") != F.col("stays")).select(*named)
    own = (F.col("doc_id").cast("long") == F.col(d)) & (_mark() == F.col(m))
    left = docs.join(gone, own, "left_anti")
    twice = staged(rows.where("rows > 1").select(*named), "repeated", files=few)
    if twice.isEmpty():
        return left
    order = [F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")]
    again = left.join(twice, own, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order)))
    return left.join(twice, own, "left_anti").unionByName(again.where(F.col(n) == 1).drop(n))
