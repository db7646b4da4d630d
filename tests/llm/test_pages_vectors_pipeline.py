from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import ann, warc
from lodestone.llm.common import shared_path

FALSE = "zz WARC/1.1\r\nContent-Length: 7\r\n\r\nabcdefg\r\n\r\nWARC/1.1\r\nabc"


def plain_records(pages):
    out = {}
    for i, html in pages.items():
        data = (html or "").encode()
        twins = [k for k, h in pages.items() if (h or "") == (html or "")]
        again = len(data) >= 1000 and max(twins) != i
        out[i] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(twins) if again else None)
    return out


def test_archives_come_back_whole(spark):
    rng = random.Random(1)
    pages = {}
    for i in range(120):
        html = "".join(rng.choice("<p>é x\r\n") for _ in range(rng.randint(0, 2500)))
        pages[i] = [html, None, "", FALSE * 3 + html, html + FALSE, "twin" * 400, FALSE * 50][i % 7]
    table = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i % 5 else None, h, "x") for i, h in pages.items()], "page_id long, url string, html string, file string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # many blocks to a file
    try:
        found = {r.page_id: tuple(r)[1:] for r in warc.archive_round_trip(table.coalesce(2)).collect()}
        path = shared_path(spark, "test")
        warc.write_warc(table.coalesce(1), path)
        records = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == plain_records(pages)
    for i, h in pages.items():
        kept = found[i][2] == "response"
        assert records[i].payload == (bytearray((h or "").encode()) if kept else None)
        assert records[i].url == (f"http://h/{i}X:y" if i % 5 else None)


def test_archives_split_otherwise_when_read_again(spark, monkeypatch):
    """As when executors come or go between the reading of the candidates and that of the payloads."""
    pages = {i: [f"page {i} " * 40, FALSE * 3 + f"{i}", f"{i}" + FALSE, FALSE * 40][i % 4] for i in range(80)}
    table = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in pages.items()], "page_id long, url string, html string")
    setting, old, plain = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"), warc.reached

    def reached(links):
        found = plain(links)
        spark.conf.set(setting, "7k")
        return found

    monkeypatch.setattr(warc, "reached", reached)
    spark.conf.set(setting, "20k")
    try:
        path = shared_path(spark, "test")
        warc.write_warc(table.coalesce(1), path, min_bytes=1 << 40)
        records = [(r.page_id, bytes(r.payload)) for r in warc.read_warc(spark, path).collect()]
    finally:
        spark.conf.set(setting, old)
    assert sorted(records) == sorted((i, h.encode()) for i, h in pages.items())


def test_torn_archive_and_empty_table(spark):
    table = spark.createDataFrame([(1, "u", "a" * 50), (2, "u", "b" * 60)], "page_id long, url string, html string")
    path = shared_path(spark, "torn")
    whole = table.select(F.col("page_id"), "url", "html")
    marked = warc.mark_revisits(whole).orderBy("page_id").select(warc.record_text("2024-01-01T00:00:00Z").alias("r")).collect()
    data = "\r\n\r\n".join(r.r for r in marked)[:-20]
    spark.createDataFrame([(data,)], "value string").coalesce(1).write.option("lineSep", "!").text(path)
    assert [r.page_id for r in warc.read_warc(spark, path).collect()] == [1]
    assert warc.archive_round_trip(table.limit(0)).count() == 0


def test_ids_that_are_null_negative_or_large(spark):
    rows = [(None, "u", "p" * 1200), (-7, "u", "p" * 1200), (1 << 62, None, "p" * 1200), (None, "u", None), (3, "u", "short")]
    found = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found) == Counter(
        [(None, 1200, "response", None), (-7, 1200, "revisit", 1 << 62), (1 << 62, 1200, "response", None), (None, 0, "response", None), (3, 5, "response", None)]
    )


def test_pointer_jumping_follows_only_the_chain(spark):
    links = [("f", 0, 10), ("f", 10, 30), ("f", 20, 30), ("f", 30, 40), ("f", 40, None), ("g", 5, 9), ("g", 9, 12)]
    found = warc.reached(spark.createDataFrame(links, "file string, off long, next long")).collect()
    assert sorted(map(tuple, found)) == [("f", 0), ("f", 10), ("f", 30), ("f", 40)]


def vectors(n, dim, rng):
    centres = rng.standard_normal((12, dim))
    return centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dim))


def plain_nearest(rows, k=5):
    ok = {i: np.array(v, dtype=float) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        a = ok[q]
        s = sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12), i) for i, b in ok.items() if i != q)[:k]
        out[q] = [i for _, i in s]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(3000, 16, rng))]
    same = rows[100][1]
    rows[500:900] = [(i, same) for i in range(500, 900)]  # ties
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [None] + [1.0] * 15), (5150, [float("nan")] * 16), (5200, [1.0] * 3)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, part int")
    found = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, part_rows=200, sample=2000, block=300).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    want = plain_nearest(rows)
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert found[100] == [500, 501, 502, 503, 504]
    few = table.where("vec_id in (0, 7, 9)")
    assert [(r.query_id, r["rank"]) for r in ann.nearest(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_holds_for_loose_vectors_outside_the_sample(spark):
    x = np.random.default_rng(5).standard_normal((6000, 128))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, part_rows=187, sample=600).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: set(np.argsort(-(unit @ unit[q]), kind="stable")[1:6]) for q in range(0, 6000, 20)}
    assert np.mean([len(set(found.get(q, [])) & want[q]) / 5 for q in want]) >= 0.9


def test_the_driver_is_sent_the_sample_alone(spark):
    """Of 40 partitions each has as many rows as the sample; the results of a job may take 1 MB together."""
    x = np.random.default_rng(8).standard_normal((12000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(40)
    old = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    limit, conf = "spark.driver.maxResultSize", spark.sparkContext._jsc.sc().conf()
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60k")  # a partition for each file that was written
    conf.set(limit, "1m")
    try:
        found = {}
        for r in ann.nearest(table, F.col("vec_id") % 400 == 0, part_rows=12000, sample=300).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append(r.vec_id)
    finally:
        conf.remove(limit)
        spark.conf.set("spark.sql.files.openCostInBytes", old[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[1])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert found == {q: np.argsort(-(unit @ unit[q]), kind="stable")[1:6].tolist() for q in range(0, 12000, 400)}
    s = ann.hash_sample(table.select("vec_id", F.col("embedding").alias("vec")), 300)
    assert s[0].tolist() == [r.vec_id for r in table.orderBy(F.xxhash64("vec_id")).limit(300).select("vec_id").collect()] and np.array_equal(s[1], x[s[0]])


def test_queries_of_small_parts_find_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i if i % 16 else 0, (np.eye(16)[i % 16] + 0.01 * rng.standard_normal(16)).tolist()) for i in range(640)]  # all around id 0 have its id
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counts = Counter(r.query_id for r in ann.nearest(table, F.col("vec_id").isin(0, 1), part_rows=40, target_recall=0.01).collect())
    assert counts == {0: 5, 1: 5}


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = vectors(1024, 16, rng)
    graph = ann.neighbour_graph(x / np.linalg.norm(x, axis=1, keepdims=True), 10)
    label = ann.balanced_parts(graph, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() - sizes.min() <= 1
    assert np.mean(label[graph] == label[:, None]) > 0.6


def test_pipeline_stages(spark, docs):
    table = docs
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, "").cache()
        kept.append({r.doc_id for r in table.select("doc_id").collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or table.columns == columns
    assert {0, 1, 2, 29} <= kept[0] and not {30, 31, 32} & kept[0]  # null and blank texts have no language
    assert 37 in kept[0] and 37 not in kept[1] and 38 not in kept[1]  # exact copies of 0
    assert kept[4] == kept[3] <= kept[2] <= kept[1] <= kept[0]
    assert table.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]
