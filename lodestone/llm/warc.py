"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing.  Payloads are grouped by SHA-1 and length; of each group of at least ``min_bytes`` the
record with the largest id is a response and the others are revisits that name it and carry no
payload.  Rows become records of WARC/1.1 files through Spark's own text writer, whose line
separator is the blank pair of lines that ends every record.

Reading.  The magic that opens a record may also stand inside a payload, so its presence proves
nothing.  Files are split at every magic by Spark's splittable text reader; each task emits, for
each such candidate, its offset and the offset of the successor that its Content-Length implies.
Candidates in a row that each name the one behind are one run.  Pointer jumping from offset 0 then
doubles the reach of every run's pointer and the set of reached runs round by round, for all files at once: a file
that its false magics cut into n runs takes log2(n) rounds of joins at most.  Candidates that
stay unreached lie inside a payload and are given back to the record around them.  Archives are read
once for the candidates and once for the payloads; how Spark splits the files may differ between the
two, so that the second reading knows its rows by a digest of their content, never by their place.

Files may be far larger than a task's memory; a record may not.

Edge cases: a null html is an empty payload, and so a response; urls may be null (then the header is
left out) and lose control characters; a null id is written empty, read back as null and always a response; repeated ids are written once each, and among equal payloads
any one of the repeated largest id is the response; empty tables write and read no rows; other
columns are ignored.  Bytes before a file's first magic or after its last complete record (a torn
file) are never reached.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, staged

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"


def mark_revisits(pages: DataFrame, *, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) for each row of ``pages`` (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"))
    largest = staged(
        sized.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "payload_bytes", "response"),
        "warc-responses",
    )  # written first: when few payloads repeat, its known size lets the join leave the payloads where they are
    revisit = F.col("response") > F.col("page_id")  # null, and so false, for payloads that stand alone
    return (
        sized.join(largest, ["payload_digest", "payload_bytes"], "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("response")))
        .drop("response")
    )


def record_text(date: str) -> Column:
    """A record of mark_revisits() without the separator that ends it."""
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    payload = F.when(revisit, "").otherwise(F.col("html"))
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END), payload,
    )


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 0) -> None:
    """Write a record for each row of ``pages`` into the new folder ``path``; records_per_file 0: a file for each task."""
    marked = mark_revisits(pages, min_bytes=min_bytes)
    marked.select(record_text(date).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the magics of the archives: (file, block, at) tell the place, at rising within the block that a task reads.

    Places hold for one reading only: blocks depend on the number of cores alive when it is planned.  ``digest`` holds for all.
    """
    head = F.substring_index("value", END, 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d{1,18})\r?$", 1)
    return (
        spark.read.option("lineSep", MAGIC).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
        .withColumn("digest", F.sha1(F.encode("value", "UTF-8")))
        .withColumn("size", (F.octet_length("value") + len(MAGIC)).cast("long"))
        .withColumn("head_size", F.octet_length(head).cast("long"))
        .withColumn("length", F.when(F.octet_length("value") > F.col("head_size"), F.try_to_number(length, F.lit("9" * 18)).cast("long")))
    )


def candidates(rows: DataFrame) -> DataFrame:
    """(file, digest, off, next, size, length, head_size): every place with the magic, and where its header says that the next record starts.

    The rows between two magics cover a file without gaps, so that offsets are sums of sizes: within a
    block, and over the totals of the blocks before it.  Payloads aren't shuffled.  Places are written first, so that
    all sums are over one reading.
    """
    rows = staged(rows.drop("value"), "warc-places")
    in_block = Window.partitionBy("file", "block").orderBy("at")
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = rows.groupBy("file", "block").agg(F.sum("size").alias("total")).withColumn("base", F.sum("total").over(in_file) - F.col("total")).drop("total")
    return (
        rows.withColumn("upto", F.sum("size").over(in_block)).join(blocks, ["file", "block"])
        .withColumn("off", F.col("base") + F.col("upto") - F.col("size") - len(MAGIC))
        .select("file", "digest", "off", (F.col("off") + len(MAGIC) + F.col("head_size") + F.col("length") + 2 * len(END)).alias("next"), "size", "length", "head_size")
    )


def reached(links: DataFrame) -> DataFrame:
    """(file, off) of the candidates of ``links`` (file, off, next) that a chain from offset 0 of their file reaches.

    Candidates that lie in a row, each naming the one behind it, are one run: what is entered at some
    place is passed through to its end.  A file without false magics is a single run.  Runs point to the
    run that their last candidate's successor lies in, and pointers are doubled over runs until none reaches a new one.
    """
    c = F.col
    order = Window.partitionBy("file").orderBy("off")
    opens = F.coalesce(F.lag("next").over(order) != c("off"), F.lit(True)).cast("int")
    runs = staged(links.select("file", "off", "next", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run")), "warc-runs")
    ends = runs.groupBy("file", "run").agg(F.max_by("next", "off").alias("jump"), F.min("off").alias("first"))
    to = runs.select("file", c("off").alias("jump"), c("run").alias("to"))
    steps = staged(ends.join(to, ["file", "jump"], "left").select("file", "run", "to", "jump", (c("first") == 0).alias("hit")), "warc-steps")
    hops, most = steps.select("file", "run", "to", "hit"), steps.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    hits = hops.where("hit").count()
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        far = hops.select("file", c("run").alias("to"), c("to").alias("to2"))
        found = hops.where("hit and to is not null").select("file", c("to").alias("run"), F.lit(True).alias("new"))
        hops = staged(
            hops.join(far, ["file", "to"], "left").join(found, ["file", "run"], "left")
            .select("file", "run", c("to2").alias("to"), (c("hit") | c("new").isNotNull()).alias("hit")),
            "warc-hops",
        )
        before, hits = hits, hops.where("hit").count()
        if hits == before:
            break
    entered = steps.drop("hit").join(hops.where("hit").select("file", "run"), ["file", "run"], "left_semi").where("to is not null").select("file", c("to").alias("run"), c("jump").alias("from"))
    entered = entered.unionByName(steps.where("hit").select("file", "run", F.lit(0).cast("long").alias("from")))
    return runs.join(entered, ["file", "run"]).where(c("off") >= c("from")).select("file", "off")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_length, payload) for each record of the archives in ``path``.

    payload is null for revisits.  payload_digest and payload_length are what the header declares.
    """
    rows = _rows(spark, path)
    links = staged(candidates(rows), "warc-candidates")
    true = reached(links.where("off >= 0").select("file", "off", "next")).withColumn("true", F.lit(True))
    whole = F.coalesce(F.col("true") & (F.col("next") == F.col("off") + F.col("size")), F.lit(False))
    # nearly every row is a whole record; only the others have to be brought together
    known = links.join(true, ["file", "off"], "left").withColumn("whole", whole)
    holder = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    rest = known.where(~F.col("whole")).withColumn("owner", F.last(F.when(F.col("true"), F.col("off")), True).over(holder))
    columns = ["file", "digest", "off", "owner", F.col("true").isNotNull().alias("opens"), "length", "head_size"]
    rest = staged(rest.select(*columns), "warc-rest")
    # equal rows can stand for each other: those that are whole here and parts there are all taken by their digest
    digests = staged(rest.select("digest").distinct(), "warc-digests")
    both = known.where("whole").join(digests, "digest", "left_semi").withColumn("owner", F.col("off")).select(*columns)
    values = rows.join(digests, "digest", "left_semi").groupBy("digest").agg(F.first("value").alias("value"))
    alone = rows.join(digests, "digest", "left_anti").select("length", "head_size", "value")
    patched = (
        rest.where(F.col("owner").isNotNull()).unionByName(both).join(values, "digest").groupBy("file", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("parts"), F.max(F.when(F.col("opens"), F.col("length"))).alias("length"), F.max(F.when(F.col("opens"), F.col("head_size"))).alias("head_size"))
        .where(F.col("length").isNotNull())
        .select("length", "head_size", F.array_join(F.col("parts.value"), MAGIC).alias("value"))
    )
    return _parsed(alone.unionByName(patched))


def _parsed(records: DataFrame) -> DataFrame:
    head = F.concat(F.substring_index("value", END, 1), F.lit("\r"))
    field = lambda name: F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r]*)\r", 1)
    data = F.encode("value", "UTF-8")
    payload = F.substring(data, F.col("head_size").cast("int") + len(END) + 1, F.col("length").cast("int"))
    number = lambda c: c.try_cast("long")
    page = lambda name: number(F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1))
    kind = F.lower(field("WARC-Type"))
    return records.where(F.octet_length("value") >= F.col("head_size") + F.col("length") + len(END)).select(
        page("WARC-Record-ID").alias("page_id"), F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"), kind.alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), number(field("X-Payload-Length")).alias("payload_length"),
        F.when(kind != "revisit", payload).alias("payload"),
    )


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record after writing ``pages`` and reading the archives back.

    Responses report what was read; revisits what their header declares of the payload they leave out.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, min_bytes=min_bytes)
    kept = F.col("payload").isNotNull()
    return read_warc(spark, path).select(
        "page_id", F.when(kept, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(kept, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
