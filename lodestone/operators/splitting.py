"""Sections split at hard boundaries: a change of the first two headings, a long table and a long text all end what is gathered.

Boundaries are windows over neighbours, and what lies between two of them is packed by itself; long tables are sliced by
their rows in closed form, with their head repeated, and long texts packed by lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .chunking import pack_bounds


def packed_to(costs: Column, target: int, most: int) -> Column:
    """array<struct<first, n, cost>>: parts that end once ``target`` is reached, and before ``most`` would be passed."""
    state = lambda done, first, n, cost: F.struct(done.alias("done"), first.alias("first"), n.alias("n"), cost.alias("cost"))
    zero = F.lit(0)
    closed = lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["n"].alias("n"), a["cost"].alias("cost"))))).otherwise(a["done"])
    after = lambda a: state(closed(a), a["first"] + a["n"], zero, zero)

    def add(acc: Column, c: Column) -> Column:
        room = F.when((acc["n"] > 0) & (acc["cost"] + c > most), after(acc)).otherwise(acc)
        # a name for the state between the two steps
        with_it = lambda a: state(a["done"], a["first"], a["n"] + 1, a["cost"] + c)
        return F.transform(F.transform(F.array(room), with_it), lambda a: F.when(a["cost"] >= target, after(a)).otherwise(a))[0]

    start = state(F.array().cast("array<struct<first:int,n:int,cost:int>>"), zero, zero, zero)
    return F.aggregate(costs, start, add, closed)


def hard_bounded_chunks(sections: DataFrame, by: list[str], order: str = "ord", *, target: int = 250, most: int = 400, rows: int = 15, count: Callable[[Column], Column] = X.word_count) -> DataFrame:
    """(by..., chunk_no, h1, h2, kind, label, words, content) of ``sections`` (by..., order, headings map<int,string>, content, is_table).

    Parts of one section (equal first two headings) are joined by blank lines up to ``target`` words and never beyond ``most``.  A table of more
    than ``rows`` lines stands alone, cut into slices of so many rows below its head (label: which); so does a text of more than ``most``
    words, cut between lines (label: its number).  Blank contents are left out; a null heading is none.
    """
    c = F.col
    head = lambda k: F.coalesce(F.trim(F.try_element_at(c("headings"), F.lit(k))), F.lit(""))
    rows_ = sections.withColumn("_content", F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))).where("_content <> ''")
    rows_ = rows_.select(*by, c(order).alias("_ord"), c("_content").alias("content"), F.coalesce("is_table", F.lit(False)).alias("is_table"), head(1).alias("h1"), head(2).alias("h2")).withColumn("words", count(c("content")).cast("int"))
    big = c("is_table") & (F.size(F.split("content", "\n")) - 1 > rows)
    long_ = ~c("is_table") & (c("words") > most)
    near = Window.partitionBy(*by).orderBy("_ord")
    rows_ = rows_.withColumn("kind", F.when(big, "table").when(long_, "long").otherwise("text"))
    new = F.lag("kind").over(near).isNull() | (c("kind") != "text") | (F.lag("kind").over(near) != "text") | (F.lag("h1").over(near) != c("h1")) | (F.lag("h2").over(near) != c("h2"))
    rows_ = rows_.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    given = [*by, "_run", "h1", "h2", "kind"]

    runs = rows_.where("kind = 'text'").groupBy(*given).agg(F.sort_array(F.collect_list(F.struct("_ord", "words", "content"))).alias("_items"))
    parts = runs.withColumn("_b", packed_to(F.transform("_items", lambda x: x["words"]), target, most)).select(*given, "_items", F.posexplode("_b").alias("_part", "_b"))
    text = parts.select(*given, "_part", F.lit(None).cast("string").alias("label"), c("_b.cost").alias("words"), F.array_join(F.transform(F.slice("_items", c("_b.first") + 1, c("_b.n")), lambda x: x["content"]), "\n\n").alias("content"))

    lines = rows_.where("kind = 'table'").withColumn("_lines", F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""))
    body = F.size("_lines") - 2
    slices = lines.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((body - 1) / rows)).cast("int"))))
    cut = F.when(body > 0, F.array_join(F.concat(F.slice("_lines", 1, 2), F.slice("_lines", c("_part") * rows + 3, F.lit(rows))), "\n")).otherwise(c("content"))
    label = F.when(body > 0, F.concat(F.lit("rows "), (c("_part") * rows + 1).cast("string"), F.lit("-"), F.least(body, (c("_part") + 1) * rows).cast("string")))
    tables = slices.select(*given, "_part", label.alias("label"), cut.alias("content")).withColumn("words", count(c("content")).cast("int"))

    texts = rows_.where("kind = 'long'").withColumn("_lines", F.split("content", "\n")).withColumn("_b", pack_bounds(F.transform("_lines", lambda x: count(x).cast("int")), most))
    longs = texts.select(*given, "_lines", F.posexplode("_b").alias("_part", "_b")).select(*given, "_part", F.concat(F.lit("part "), (c("_part") + 1).cast("string")).alias("label"), c("_b.cost").alias("words"), F.array_join(F.slice("_lines", c("_b.first") + 1, c("_b.n")), "\n").alias("content"))

    found = reduce(DataFrame.unionByName, [text, tables, longs])
    number = F.row_number().over(Window.partitionBy(*by).orderBy("_run", "_part")) - 1
    return found.withColumn("chunk_no", number).select(*by, "chunk_no", "h1", "h2", "kind", "label", "words", "content")
