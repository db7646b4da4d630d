"""Faults that show in larger tables: rare texts, and steps whose work or memory grew faster than their input."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, imports, indexes, relations, retrieval
from lodestone.operators.shared import pieces
from lodestone.plans import storage  # noqa: F401  adds to the catalogue
from lodestone.plans.catalog import QUERIES, SQL
from lodestone.sources import files


def test_texts_whose_words_cancel_out_have_a_norm(spark):
    """w11 and w15 are hashed to one component with opposite signs."""
    df = spark.createDataFrame([(0, "w11 w15"), (1, "w11"), (2, " \n"), (3, None)], "doc_id long, text string")
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3)
    assert [r[0] for r in files.embed(df).orderBy("doc_id").select(norm).collect()] == pytest.approx([1.0, 1.0, 0.0, 0.0])


def test_kept_embeddings_of_odd_texts(spark, tmp_path):
    """Signed words that cancel out (w11, w15), no words, and letters that lower() changes by what follows."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["w1", "w11 w15", "  ", None, "w11 w15 w1", "ΑΣ W1", "", "İx w2", "w15 W11 ", "made"]
    rows = [(i, t, "w11" if i == 6 else None if i == 9 else "web", "w15" if i == 6 else "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = c.execute(SQL["kept_embeddings"]).fetchall()
    assert sorted(map(tuple, QUERIES["kept_embeddings"](spark, str(tmp_path)).collect())) == sorted(want)
    assert {r[0] for r in want} == {0, 3, 4, 5, 7, 9}


def alike(spark, n=150):
    """Texts of which most grams are in all."""
    words = ["".join(x) for x in itertools.product("bcd", "aei", "lnr", "st")]
    return spark.createDataFrame([(i, " ".join(words[(i * 7 + j * (1 + i % 5)) % len(words)] for j in range(20 + i % 9)) + " 𝒜𝒷 y"[: i % 6]) for i in range(n)], "doc_id long, text string")


@pytest.mark.parametrize("common", [0, 5, 4096])
def test_many_trigram_searches_by_blocks(spark, common):
    """No row per gram is written, and whichever grams are columns of a matrix, the rows found are those of single scans."""
    df = alike(spark)
    tables = indexes.trigram_tables(df)
    assert {name: x.count() for name, x in tables.items()} == {"rows": 150}
    asked = df.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    got = indexes.trigram_search(tables, asked, 7, common=common).orderBy("query_id", "rank").collect()
    rows = df.where("doc_id % 50 = 0").orderBy("doc_id").collect()
    plain = lambda text: F.round(T.overlap_with(T.trigrams(F.col("text")), spark.range(1).select(T.trigrams(F.lit(text))).first()[0]), 9)
    assert [(r.query_id, r.id, r.similarity) for r in got] == [(q.doc_id, r.doc_id, r.s) for q in rows for r in df.select("doc_id", plain(q.text).alias("s")).orderBy(F.desc("s"), "doc_id").limit(7).collect()]


@pytest.mark.parametrize("sizes", [(16384, 65536, 2048), (1, 150, 7), (2, 10, 1)])
def test_many_trigram_searches_join_no_blocks(spark, sizes):
    """Neither are blocks of rows written nor pairs of blocks joined, whose rows of several MB filled the memory of writers and readers; groups and parts of any size give the same."""
    df = alike(spark)
    tables = indexes.trigram_tables(df)
    asked = df.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    plain = indexes.trigram_search(tables, asked, 7)
    plan = plain._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    most, part, block = sizes
    got = indexes.trigram_search(tables, asked, 7, common=100, most=most, part=part, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_hybrid_looks_at_each_text_once(spark, tmp_path):
    df = alike(spark, 60)
    df.write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    vectors = spark.createDataFrame([(i, [1.0, i / 60]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = [r.text for r in df.where("doc_id < 3").orderBy("doc_id").collect()]
    got = retrieval.hybrid(texts, vectors, asked, [[1.0, 0.1 * i] for i in range(3)])
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    indexed = retrieval.hybrid(texts, vectors, asked, [[1.0, 0.1 * i] for i in range(3)], tables=indexes.trigram_tables(texts))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in indexed.collect()]


@pytest.mark.parametrize("words", ["conspiracy runs", "sensible", "the tie", "nothing"])
def test_postings_of_a_query_alone(spark, words):
    """Only the query's lexemes are indexed, whatever its words are written like in texts."""
    texts = ["conspiracies run", "a conspiracy ran running", "sensibility of senses", "sensibly sensible", "tying ties tied", "tie running conspiracy", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    some, all_ = indexes.fulltext_tables(df, only=words), indexes.fulltext_tables(df)
    assert some["postings"].select("lexeme").distinct().count() <= len(words.split())
    assert [tuple(r) for r in indexes.fulltext_search(some, words).collect()] == [tuple(r) for r in indexes.fulltext_search(all_, words).collect()]


@pytest.mark.parametrize(("kind", "size"), [("float", 16), ("double", 3), ("copies", 8)])
def test_batch_search_deals_rows_not_pairs(spark, kind, size):
    """A row goes to each group of queries once, whatever the number of blocks; hits are those of brute force, ties included."""
    x = np.random.default_rng(4).normal(size=(900, size))
    if kind == "copies":
        x[100:700] = x[50]
    if kind == "float":
        x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{'float' if kind == 'float' else 'double'}>").repartition(3)
    found = retrieval.batch_topk(df.where("vec_id % 5 = 0"), df, 6, block=64, most=70)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    d = 1 - (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None, :])
    if kind == "copies":
        same = np.r_[50, 100:700]
        d[np.ix_(same, same)] = 0
    d = np.round(d, 9)
    want = sorted((q, r + 1, i, v) for q in range(0, 900, 5) for r, (v, i) in enumerate(sorted((d[q, i], i) for i in range(900) if i != q)[:6]))
    got = sorted(map(tuple, found.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-9)


def test_a_long_way_is_found_in_few_rounds(spark, monkeypatch):
    """Ways of a chain double in a round; a cycle and a short cut keep their fewest steps."""
    rounds, plain = [], relations.staged
    monkeypatch.setattr(relations, "staged", lambda df, what: rounds.append(what) or plain(df, what))
    pairs = [(i, i + 1) for i in range(20)] + [(20, 18), (2, 9)]
    got = {(r.path, r.target): r.distance for r in relations.reachable(spark.createDataFrame([("r", str(a), str(b)) for a, b in pairs], "repo string, path string, target string")).collect()}
    want: dict[tuple[str, str], int] = {}
    for a in range(21):
        last, d = {a}, 0
        while last:
            d, last = d + 1, {y for x, y in pairs if x in last} - {int(t) for s, t in want if s == str(a)}
            want |= {(str(a), str(y)): d for y in last}
    assert got == want and len(rounds) <= 7


def test_a_place_is_looked_at_once_for_all_who_ask(spark, monkeypatch):
    rows, plain = [], relations.staged
    monkeypatch.setattr(relations, "staged", lambda df, what: (lambda x: rows.append(x.count()) or x)(plain(df, what)))
    n = 7
    one = lambda i: ("r", f"m{i}", "python", f"m{i - 1}", False, [("f", None)])
    resolved = spark.createDataFrame([one(i) for i in range(1, n + 1)], "repo string, path string, language string, resolved_path string, is_wildcard boolean, symbols array<struct<name:string,alias:string>>")
    defined = spark.createDataFrame([("r", "m0", "f", "function")], "repo string, path string, name string, kind string")
    got = relations.symbol_edges(resolved, defined, relations.given_names(resolved)).collect()
    assert sorted((r.path, r.target, r.hops) for r in got) == [(f"m{i}", "m0", i - 1) for i in range(1, n + 1)]
    assert max(rows) <= n and len([x for x in rows[:4] if x]) <= 3  # places are known from the start: no round of asking follows


def test_sections_become_objects_a_megabyte_at_a_time(spark):
    """What Python makes of a batch at once is bounded by bytes, not by the batch."""
    body = F.repeat(F.lit("word "), 400)
    df = spark.range(1500).select("id", F.posexplode(F.array(body, F.lit("a | b"), body)).alias("ord", "content"))
    flags = [F.lit(False).alias(c) for c in ("is_image", "is_code")]
    found = chunking.section_chunks(df.select("id", "ord", F.create_map(F.lit(1), F.lit("H")).alias("headings"), "content", F.col("content").contains("|").alias("is_table"), *flags), "id", "ord")
    assert "MapInArrow" in found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 4500 and found.where("is_table and chunk_no = 1 and chunk = 'a | b' and headings[1] = 'H'").count() == 1500
    assert max(p.num_rows for p in pieces(pa.RecordBatch.from_pydict({"x": ["y" * 1000] * 5000}), 1 << 20)) <= 1250


def test_imports_meet_files_without_the_driver(spark, tmp_path):
    """No side that grows with the files is broadcast, however small its file is, and each part of a repository's imports gets its modules."""
    rows = [(f"r{i % 2}", f"go/g{i}.go", "go", 'package main\nimport (\n\t"ex.com/m/go"\n\t"fmt"\n\tx "fmt"\n)\n') for i in range(200)] + [("r0", "go.mod", None, "module ex.com/m\n")]
    rows += [("r0", "m/src/main/java/a/A.java", "java", "package a;\nimport a.B;\nimport b.C;\nimport z.Y;\n"), ("r0", "m/src/main/java/a/B.java", "java", ""), ("r0", "n/src/main/java/b/C.java", "java", "")]
    spark.createDataFrame(rows, "repo string, path string, language string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    found = imports.resolve_imports(imports.extract_imports(files, ("repo", "path")), files)
    got = [(r.repo, r.path, r.source, r.category, r.resolved_path) for r in found.collect()]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "HashJoin" in plan
    want = [(f"r{i % 2}", f"go/g{i}.go", *x) for i in range(200) for x in [("ex.com/m/go", "external", None) if i % 2 else ("ex.com/m/go", "internal", "go"), ("fmt", "stdlib", None), ("fmt", "stdlib", None)]]
    want += [("r0", "m/src/main/java/a/A.java", *x) for x in [("a.B", "internal", "m/src/main/java/a/B.java"), ("b.C", "internal", "n/src/main/java/b/C.java"), ("z.Y", "external", None)]]
    assert sorted(got, key=str) == sorted(want, key=str)
