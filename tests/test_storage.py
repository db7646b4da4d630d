"""Tables changed in place, scans that stop, pictures' sizes, kept embeddings, and streams with timers."""

from __future__ import annotations

import os
import random
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import pictures
from lodestone.operators import embeddings, scan, snapshots
from lodestone.streaming import registry


def files_under(path: str) -> dict[str, float]:
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.drop("bucket").collect()), key=str)


def test_a_write_touches_its_own_buckets(spark, tmp_path):
    files, parts = str(tmp_path / "files"), str(tmp_path / "parts")
    old = spark.createDataFrame([(i, f"v{i}") for i in range(60)] + [(None, "none")], "k int, v string")
    snapshots.write_table(old, files, ["k"], 8)
    snapshots.write_table(spark.createDataFrame([(i, j) for i in range(70) for j in range(2)], "k int, j int"), parts, ["k"], 8)
    before = files_under(files) | files_under(parts)
    # a bigint key, a key twice, a null one, and one that is new
    new = spark.createDataFrame([(3, "a"), (3, "b"), (None, "again"), (65, "new")], "k long, v string")
    written, cleared = snapshots.replace_rows(files, new, ["k"], children=parts, buckets=8)
    assert 0 < len(written) < 8 and 0 < len(cleared) < 8
    after = files_under(files) | files_under(parts)
    untouched = {f for f in before if not any(f"{p}/bucket={b}/" in f for p, bs in ((files, written), (parts, cleared)) for b in bs)}
    assert untouched and all(after.get(f) == before[f] for f in untouched)
    assert rows_of(snapshots.read_table(spark, files)) == sorted([(i, f"v{i}") for i in range(60) if i != 3] + [(3, "b"), (None, "again"), (65, "new")], key=str)
    # 65 wasn't replaced, so its children stay
    assert rows_of(snapshots.read_table(spark, parts)) == sorted([(i, j) for i in range(70) for j in range(2) if i != 3], key=str)
    assert snapshots.replace_rows(files, new.limit(0), ["k"], children=parts, buckets=8) == ([], [])


def test_a_bucket_without_rows_goes(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_table(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, j int"), path, ["k"], 64)
    gone = snapshots.in_buckets(spark.createDataFrame([(1,)], "k int"), ["k"], 64)
    assert len(snapshots.remove_children(path, gone, ["k"])) == 1
    assert rows_of(snapshots.read_table(spark, path)) == [(2, 1)] and len(files_under(path)) == 1


def test_a_scan_ends_with_its_hits(spark, tmp_path):
    path = str(tmp_path / "t")
    for part in range(6):
        spark.range(part * 1000, part * 1000 + 1000, numPartitions=1).withColumn("even", F.col("id") % 2 == 0).coalesce(1).write.parquet(f"{path}/part={part}")
    files = scan.files_of(spark.read.parquet(path))
    assert len(files) == 6

    def tasks(condition, n):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "scan")
        try:
            got = [r.id for r in scan.first_matches(spark, files, spark.read.parquet, condition, n).collect()]
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        status = spark.sparkContext.statusTracker()
        # the last job shows the rows that were found
        return got, sum(status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds)

    early, some = tasks(F.col("even"), 20)
    late, all_ = tasks(F.col("id") >= 5990, 20)
    assert early == list(range(0, 40, 2)) and late == list(range(5990, 6000))
    assert some < all_ and all_ >= 6
    assert tasks(F.col("id") == 1500, 1)[0] == [1500] and tasks(None, 3)[0] == [0, 1, 2] and tasks(F.lit(False), 3)[0] == []
    with pytest.raises(ValueError):
        scan.first_matches(spark, [], spark.read.parquet)


def test_types_of_a_table_come_from_its_beginning(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(50)) + "late,y\n")
    files, read = scan.table_reader(spark, str(tmp_path / "t.csv"), rows=20)
    assert dict(read(files[0]).dtypes) == {"a": "int", "b": "string"}
    assert [tuple(r) for r in scan.first_matches(spark, files, read, F.col("b") == "y").collect()] == [(None, "y")]


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"


def jpeg(w: int, h: int, *before: bytes, marker: int = 0xC0) -> bytes:
    return b"\xff\xd8" + b"".join(before) + bytes([0xFF, marker]) + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\1\x11\0\xff\xda"


def segment(marker: int, data: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


CASES = [
    (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 640, 70_000) + b"\x08\x06\0\0\0"), (640, 70_000)),
    (b"GIF87a" + struct.pack("<HH", 300, 65_535) + b"\0", (300, 65_535)),
    (b"BM" + b"\0" * 16 + struct.pack("<II", 17, 19), (17, 19)),
    (b"RIFF\0\0\0\0WEBPVP8X" + b"\x0a\0\0\0\0\0\0\0" + (999).to_bytes(3, "little") + (499).to_bytes(3, "little"), (1000, 500)),
    (b"RIFF\0\0\0\0WEBPVP8L" + b"\x0a\0\0\0\x2f" + ((1233) | (566 << 14)).to_bytes(4, "little") + b"\0", (1234, 567)),
    (b"RIFF\0\0\0\0WEBPVP8 " + b"\x0a\0\0\0" + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 320, 240), (320, 240)),
    (jpeg(800, 600), (800, 600)),
    (jpeg(801, 601, *[segment(0xE1, b"\xff\xc0" * 500)] * 40, marker=0xC2), (801, 601)),
    (jpeg(5, 6, segment(0xC4, b"x" * 30), b"\xff\xff\xff"[:1] + b"\xff", segment(0xDB, b"yy")[1:]), (5, 6)),
    (b"\xff\xd8" + segment(0xE0, b"a") + b"\xff\xda\0\0", (None, None)),
    (b"\xff\xd8\xff\xe0", (None, None)), (b"\x89PNG\r\n\x1a\n", (None, None)), (b"GIF89a\1", (None, None)), (b"plain", (None, None)), (b"", (None, None)), (None, (None, None)),
]


def test_picture_sizes(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, content binary")
    got = df.select("i", pictures.picture_size(F.col("content")).alias("s")).orderBy("i").collect()
    assert [(r.s.width, r.s.height) for r in got] == [want for _, want in CASES]


def test_a_text_is_embedded_once(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "saved")

    def model(texts: list[str]) -> list[list[float]]:
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "aa", None), (2, "aa", "zz"), (3, None, "bbb"), (4, "  ", "bbb"), (5, None, None)], "i int, chunk string, made string").repartition(3)
    text = embeddings.embedded_text(F.col("chunk"), F.col("made"))
    got = lambda df: {r.i: r.embedding for r in embeddings.with_embeddings(df, text, path, model).collect()}
    assert got(rows.where("i < 3")) == {1: [2.0, 1.0], 2: [2.0, 1.0]}
    assert got(rows) == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [3.0, 1.0], 4: [3.0, 1.0], 5: [0.0, 1.0]}
    assert got(rows.limit(0)) == {}
    assert sorted(open(log).read().split("\n")[:-1]) == ["", "aa", "bbb"]


@pytest.fixture
def timed_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", registry.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, path, make, batches):
    """Rows of a stream that reads a file a batch, and the state left at its end."""
    schema = "key string, ts timestamp, id long, kind string, trips boolean"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, s double, id long, kind string, trips boolean").selectExpr("key", "timestamp_micros(cast(s * 1000000 as bigint)) as ts", "id", "kind", "trips").coalesce(1).write.parquet(f"{path}/in/b{i}")
    found: list[tuple] = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    job = make(stream).writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    job.awaitTermination()
    return sorted(found), [p.stateOperators[0].numRowsTotal for p in job.recentProgress if p.stateOperators]


def test_registered_streams_end(spark, tmp_path, timed_store):
    rng = random.Random(2)
    events = sorted((rng.randrange(40_000) / 4, rng.choice("abc")) for _ in range(60))
    rows = [(k, s, i, rng.choice(["start", "start", "finish", "cancel"]), False) for i, (s, k) in enumerate(events)]
    end = ("z", 90_000.0, 99, "finish", False)
    want, live = [], {}
    for k, s, _, kind, _ in rows:
        if k in live:
            over = s >= live[k] + 600
            want.append((k, live[k], live[k] + 600 if over else s, "expired" if over else "replaced" if kind == "start" else kind))
            del live[k]
        if kind == "start":
            live[k] = s
    want = sorted(want + [(k, s, s + 600, "expired") for k, s in live.items()])
    make = lambda df: registry.stream_registry(df, "key", "ts", "id", "kind", span=600.0)
    for name, batches in (("one", [[*rows, end]]), ("many", [rows[:13], rows[13:31], rows[31:], [end]])):
        got, state = streamed(spark, str(tmp_path / name), make, batches)
        assert got == want
        assert state[-1] == 0


def test_breakers_close_by_themselves(spark, tmp_path, timed_store):
    rows = [("a", 0.0, 1, "", True), ("a", 5.0, 2, "", False), ("a", 10.0, 3, "", False), ("b", 10.0, 4, "", False), ("a", 12.0, 5, "", True), ("a", 13.0, 6, "", True), ("a", 22.5, 7, "", False), ("b", 60.0, 8, "", False)]
    rows = [(k, s + 100.0, *rest) for k, s, *rest in rows]  # the watermark begins at 0
    make = lambda df: registry.breaker_stream(df, "key", "ts", "id", "trips", ttl=10.0)
    want = [("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 5, False), ("a", 6, True), ("a", 7, True), ("b", 4, False), ("b", 8, False)]
    for name, batches in (("one", [rows]), ("many", [rows[:2], rows[2:5], rows[5:7], rows[7:]])):
        got, state = streamed(spark, str(tmp_path / name), make, batches)
        assert got == want
        assert state[-1] == 0


def test_timers_need_their_store(spark):
    with pytest.raises(ValueError):
        registry.stream_registry(spark.readStream.format("rate").load(), "value", "timestamp", "value", "value")
