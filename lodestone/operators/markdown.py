"""Markdown sections by windows over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def sections(files: DataFrame, by: str | list[str] = "path", text: str = "content") -> DataFrame:
    """(by..., ord, headings map<int,string>, content, is_image, is_table, is_code) for each section, fenced block and table of ``files``, whose ``by`` are unique.

    Headings inside fences are text.  A heading stays in force until one of its level or above; lines
    before the first heading make a section without headings.
    """
    by = [by] if isinstance(by, str) else by
    lines = files.select(*by, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    upto = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    lines = lines.withColumn("fenced", F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1).withColumn("fence", fence)
    is_head = ~F.col("fenced") & F.col("line").rlike(r"^#{1,6}\s+\S")
    lines = lines.withColumn("level", F.when(is_head, X.heading_level(F.col("line"))))
    for k in range(1, 7):
        # a heading of level k holds from its line until the next heading of a smaller or the same level
        seen = F.when(F.col("level") == k, F.trim(F.regexp_replace("line", "^#+", ""))).when(F.col("level") < k, F.lit(""))
        lines = lines.withColumn(f"h{k}", F.nullif(F.last(seen, True).over(upto), F.lit("")))
    kind = F.when(F.col("fenced") | F.col("fence"), "code").when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "table").when(F.col("line").rlike(r"!\[[^\]]*\]\([^)]+\)|(?i)<img\b"), "image").otherwise("text")
    lines = lines.withColumn("kind", kind)
    new = F.col("level").isNotNull() | (F.lag("kind", 1, "text").over(Window.partitionBy(*by).orderBy("n")) != F.col("kind"))
    lines = lines.withColumn("ord", F.sum(new.cast("int")).over(upto)).where(F.col("level").isNull())
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.first(f"h{k}", True).alias("value")) for k in range(1, 7)]), lambda x: x["value"].isNotNull())
    found = lines.groupBy(*by, "ord").agg(body.alias("content"), F.map_from_entries(entries).alias("headings"), F.first("kind").alias("kind")).where(F.trim("content") != "")
    flags = [(F.col("kind") == k).alias(f"is_{k}") for k in ("image", "table", "code")]
    return found.select(*by, "ord", "headings", "content", *flags)


def image_windows(sections_: DataFrame, by: list[str]) -> DataFrame:
    """A row for each image of the image sections, with alt, url and its place."""
    return sections_.where("is_image").select(*by, "headings", F.posexplode(X.markdown_images(F.col("content"))).alias("image_no", "image")).select(*by, "headings", "image_no", "image.alt", "image.url")
