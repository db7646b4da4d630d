"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget; whole epochs of the source come first and the rest of the budget
is a weighted sample without replacement: every document draws the exponential key ``-ln(u) / weight``
(the order of ``u ** (1 / weight)``, falling), the source is sorted by rising key, and documents are
taken while the prefix sum of their sizes stays within the budget.  The document that crosses the
budget is taken in part, so a source's taken words equal its budget rounded to a word.  The weight is
the posterior quality of the quality rules, 0.05 at least.

No source is sorted in one task.  Prefix sums over counted bins of the key name the bin in which a
source's budget is used up; that bin is cut into bins again, until it holds few documents, and only
these are put in order.  All others are known to lie before or behind the edge, however the keys or the
sources are spread.

Edge cases: a null text has size 0 and takes 0 words; null is a source of its own, ranked last;
documents that share an id (or have none) draw keys of their own unless their texts are equal too, and
then any of them may be the one that is taken; an empty table gives no rows; the target of a source
without words is 0; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quality_rules
from .common import WORD, n_words, staged, tasks_for, uniform, unused

#: Sources up to this number travel to the executors by broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with source_id, their place by code point from 0, null last: sorted in ranges, counted, then numbered within the ranges."""
    name = F.col("source").asc_nulls_last()
    sources = staged(sources, "mix-totals")
    ranges = staged(sources.repartitionByRange(tasks_for(sources), name).withColumn("range", F.spark_partition_id()), "mix-sources")
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(name)) - 1
    return ranges.join(F.broadcast(before), "range").withColumn("source_id", (F.col("before") + place).cast("long")).drop("range", "before")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """(source, source_id, source_size, target) of ``sizes`` (source, size): one row for each source.

    Weighted water-filling.  Sources whose cap lies below the level that all uncapped ones share stop at
    their cap and raise the level; it settles after a few rounds, each an aggregate over sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = staged(_numbered(totals).withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs)), "mix-totals")
    level = -1.0
    while True:
        free = F.col("cap") >= level * F.col("w")
        all_words, capped, shares = totals.agg(F.sum("source_size"), F.sum(F.when(free, 0.0).otherwise(F.col("cap"))), F.sum(F.when(free, F.col("w")))).first()
        if not shares:
            break
        new = (all_words - capped) / shares
        if new <= level:
            break
        level = new
    return totals.select("source", "source_id", "source_size", F.least(F.col("cap"), level * F.col("w")).alias("target"))


def _drawn(docs: DataFrame, columns: list[str], weights: Sequence[float], max_epochs: float, quality: Column | None, seed: int) -> tuple[DataFrame, str, DataFrame]:
    """Rows of ``docs`` with ``columns`` and a struct of what mixing knows of them; the struct's name; the targets with epochs and budget."""
    to = unused(docs.columns, "mix")
    mark, row = F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row")
    if quality is None:
        rows = quality_rules.with_counts(docs.select(*dict.fromkeys([*columns, "doc_id", "source", "text"])), to)
        votes = quality_rules.rules(f"{to}.")
        rows = staged(rows.withColumn(to, F.struct(F.col(f"{to}.n_words").alias("size"), mark, row, F.struct(*[v.alias(k) for k, v in votes.items()]).alias("votes"))).select(*dict.fromkeys([*columns, "doc_id", "source", to])), "mix-sizes", tasks_for(docs))
        good = quality_rules.posteriors(rows.select(f"{to}.votes.*"), list(votes))
        weight = F.greatest(F.lit(0.05), F.element_at(good, F.concat_ws(",", *[F.col(f"{to}.votes.{k}").cast("string") for k in votes]))) if good is not None else F.lit(1.0)
    else:
        rows = docs.select(*dict.fromkeys([*columns, "doc_id", "source"]), F.struct(n_words(F.col("text")).alias("size"), mark, row, quality.cast("double").alias("weight")).alias(to))
        rows = staged(rows, "mix-sizes", tasks_for(docs))
        weight = F.col(f"{to}.weight")
    targets = source_targets(rows.select("source", F.col(f"{to}.size").alias("size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    targets = staged(targets, "mix-targets", tasks_for(targets))
    k = -F.log(uniform(seed, "doc_id", f"{to}.mark")) / weight
    return rows.withColumn(to, F.struct(f"{to}.size", f"{to}.row", (k / (1 + k)).alias("key"))), to, targets


def _small(sources: DataFrame) -> DataFrame:
    """``sources``, marked for broadcast if they are few enough."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def _edges(keyed: DataFrame, targets: DataFrame, bins: int, few: int) -> DataFrame:
    """(source_id, lo, hi, from, to, before) for each source with a budget: the documents of ``keyed`` (source_id, size, key, row) with lo <= key <= hi (and from <= row <= to) hold the edge of the budget, and ``before`` words come before them."""
    c, tasks = F.col, tasks_for(targets)
    edges = targets.where("budget > 0").select("source_id", "budget", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0).cast("long").alias("from"), F.lit((1 << 63) - 1).alias("to"), F.lit(0).cast("long").alias("before"))
    while True:
        by_row = c("lo") >= c("hi")  # equal keys are told apart by their rows
        at, a, b = (F.when(by_row, c(x).cast("double")).otherwise(c(y)) for x, y in (("row", "key"), ("from", "lo"), ("to", "hi")))
        inside = keyed.join(_small(edges), "source_id").where(c("key").between(c("lo"), c("hi")) & (~by_row | c("row").between(c("from"), c("to"))))
        at = F.when(b > a, F.least(F.lit(bins - 1), F.floor((at - a) / (b - a) * bins).cast("int"))).otherwise(0)
        counts = inside.groupBy("source_id", "budget", "before", at.alias("bin")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("row").alias("from"), F.max("row").alias("to")
        )
        upto = c("before") + F.sum("words").over(Window.partitionBy("source_id").orderBy("bin"))  # bins of one source: a bounded number
        found = counts.withColumn("upto", upto).where((c("upto") >= c("budget")) & (c("upto") - c("words") < c("budget")))
        edges = staged(found.select("source_id", "budget", "lo", "hi", "from", "to", (c("upto") - c("words")).alias("before"), "rows"), "mix-edges", tasks)
        if (edges.agg(F.max("rows")).first()[0] or 0) <= few:
            return edges.drop("budget", "rows")


def _taken(docs: DataFrame, columns: list[str], *, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, quality: Column | None = None, seed: int = 20, buckets: int = 4096, few: int = 10_000) -> tuple[DataFrame, str]:
    """``columns`` of ``docs`` with a struct (size, source_size, target, taken), and the struct's name."""
    rows, to, targets = _drawn(docs, columns, weights, max_epochs, quality, seed)
    c = F.col
    of = unused([*rows.columns, "s"], "of")
    every = targets.select(F.col("source").alias("s"), F.struct("source_id", "source_size", "target", "epochs", "budget").alias(of))
    s = unused([*rows.columns, of], "s")
    rows = rows.join(_small(every.withColumnRenamed("s", s)), c("source").eqNullSafe(c(s))).drop(s)
    keyed = rows.select(c(f"{of}.source_id").alias("source_id"), f"{to}.size", f"{to}.key", f"{to}.row")
    edges = _edges(keyed, targets, buckets, few)
    edge = unused([*rows.columns, "i"], "edge")
    i = unused([*rows.columns, edge], "i")
    rows = rows.join(_small(edges.select(c("source_id").alias(i), F.struct("lo", "hi", "from", "to", "before").alias(edge))), c(f"{of}.source_id") == c(i), "left").drop(i)
    key, row, lo, hi = c(f"{to}.key"), c(f"{to}.row"), c(f"{edge}.lo"), c(f"{edge}.hi")
    within = lambda r: (lo < hi) | r.between(c(f"{edge}.from"), c(f"{edge}.to"))
    rows = rows.withColumn(to, c(to).withField("on", F.coalesce(key.between(lo, hi) & within(row), F.lit(False))).withField("whole", F.coalesce((key < lo) | ((key == lo) & (lo >= hi) & (row < c(f"{edge}.from"))), F.lit(False))))
    # the few documents of an edge are put in order; the rest of the rows stay where they are
    in_order = Window.partitionBy(f"{of}.source_id").orderBy(f"{to}.key", f"{to}.row").rowsBetween(Window.unboundedPreceding, 0)
    size, budget = c(f"{to}.size"), c(f"{of}.budget")
    part = F.greatest(F.lit(0), F.least(size, budget - c(f"{edge}.before") - F.sum(f"{to}.size").over(in_order) + size))
    parts = rows.where(c(f"{to}.on")).withColumn(to, c(to).withField("part", part.cast("long")))
    rest = rows.where(~c(f"{to}.on")).withColumn(to, c(to).withField("part", F.when(c(f"{to}.whole"), size).otherwise(0).cast("long")))
    shown = F.struct(size.alias("size"), f"{of}.source_size", f"{of}.target", (c(f"{of}.epochs") * size + c(f"{to}.part")).cast("long").alias("taken"))
    return rest.unionByName(parts).select(*columns, shown.alias(to)), to


def mix_sources(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each row of ``docs`` (doc_id, source, text).

    weights: cycled over the sources in the order of their names by code point ((5, 2, 1)).  max_epochs: a source's target
    in terms of its size, at most (3).  quality: the sampling weight of a document, the posterior of the quality
    rules if None.  seed: of the keys.  buckets, few: how edges are searched; no influence on what is taken.
    """
    rows, to = _taken(docs.select("doc_id", "source", "text"), ["doc_id", "source"], **options)
    return rows.select("doc_id", f"{to}.size", "source", f"{to}.source_size", f"{to}.target", f"{to}.taken")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` as mix_sources() takes them: a row for each whole copy, and the last document of a budget cut to the words taken."""
    rows, to = _taken(docs, docs.columns, **options)
    rows = rows.where(F.col(f"{to}.taken") > 0)
    whole, rest = F.floor(F.col(f"{to}.taken") / F.col(f"{to}.size")).cast("int"), (F.col(f"{to}.taken") % F.col(f"{to}.size")).cast("int")
    n = unused(rows.columns, "copy")
    copies = rows.select("*", F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0))).alias(n))
    words = F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    some = F.array_join(F.slice(words, 1, rest), "")
    return copies.withColumn("text", F.when(F.col(n) > whole, some).otherwise(F.col("text"))).select(*docs.columns)
