"""Faults found in review, each with the case that showed it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import access, code, evaluation, retrieval

VECTORS = "vec_id long, embedding array<double>"


def test_batch_topk_agrees_with_vector_topk(spark):
    """Unlike lengths, zero, null and non-finite vectors: no distance, and last."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0, 0.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.5]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [])]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    for block in (1, 2, 1024):
        got = retrieval.batch_topk(df.where("vec_id = 0"), df, 10, block=block).orderBy("rank").collect()
        assert [(r.id, r.distance) for r in got] == [(3, 0.105572809), (2, 1.0), (1, None), (4, None), (5, None), (6, None), (7, None)]
    single = retrieval.vector_topk(df.where("vec_id in (0, 2, 3, 4, 5)"), [1.0, 0.0], 10).select("vec_id", "distance").collect()
    assert [tuple(r) for r in single] == [(0, 0.0), (3, 0.105572809), (2, 1.0), (4, None), (5, None)]


def test_query_rows_that_share_an_id_are_one_query(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], VECTORS)
    twice = df.where("vec_id = 3").unionByName(df.where("vec_id = 3"))
    assert [r.id for r in retrieval.batch_topk(twice, df, 4).orderBy("rank").collect()] == [r.id for r in retrieval.batch_topk(df.where("vec_id = 3"), df, 4).orderBy("rank").collect()] == [4, 5, 2, 1]
    assert retrieval.batch_topk(df.limit(0), df, 4).count() == retrieval.batch_topk(df, df.limit(0), 4).count() == 0


def test_blocks_have_the_same_names_when_they_are_made_again(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], VECTORS).repartition(3)
    made = retrieval._vector_blocks(df, "q", 2, "vec_id", "embedding").select("q_block")
    assert sorted(made.collect()) == sorted(made.collect())


def test_older_rows_do_not_count_as_written(spark, tmp_path):
    files = spark.createDataFrame([(1,), (2,)], "file_id long")
    rows = spark.createDataFrame([(1, "a")], "file_id long, text string")
    path = str(tmp_path / "embeddings")
    status = lambda df: sorted(map(tuple, df.collect()))
    assert status(access.write_embeddings(files, rows, path)) == [(1, "success"), (2, "failed")]
    assert status(access.write_embeddings(files, rows.limit(0), path)) == [(1, "failed"), (2, "failed")]
    assert spark.read.parquet(path).select("file_id", "text").collect() == rows.collect()


@pytest.mark.parametrize(
    ("language", "text", "names"),
    [
        ("javascript", "function a() {\n  const s = `{ ${x} {`;\n}\nfunction b() {\n  return 1;\n}", ["a", "b"]),
        ("javascript", "function a() {\n  return `x ${ {k: `{${y}`} } {`;\n}\nfunction b() {\n}", ["a", "b"]),
        ("typescript", "function a(): string {\n  return s.replace(/[{/]{/g, '') / 2;\n}\nfunction b() {\n}", ["a", "b"]),
        ("javascript", "function a() {\n  const q = n / 2; const r = m / 3; // {\n}\nfunction b() {\n}", ["a", "b"]),
        ("javascript", "/* a {\n function no() {\n*/\nfunction a() {\n}\nfunction b() {\n}", ["a", "b"]),
        ("go", "func A() {\n  s := `{\n {`\n}\nfunc B() {\n}", ["A", "B"]),
        ("rust", "fn a<'x>(s: &'x str) -> char {\n  '{'\n}\nfn b() {\n  let r = r#\"{ \" {\"#;\n}\nfn c() {\n}", ["a", "b", "c"]),
        ("java", "class A {\n  void m() {\n    String s = \"\"\"\n {\n\"\"\";\n  }\n  void n() {\n  }\n}\nclass B {\n}", ["A", "m", "n", "B"]),
        ("php", "function a() {\n  # {\n  $s = '{';\n}\nfunction b() {\n}", ["a", "b"]),
    ],
)
def test_braces_in_literals_and_comments(language, text, names):
    found = code.chunks_of(language, text)
    assert [r[1] for r in found if r[0] != "global"] == names
    assert all(r[7] < s[6] or r[0] == "class_summary" for r, s in zip(found, found[1:], strict=False) if r[0] != "global")
    assert [len(x) for x in code.bare_lines(text, language)] == [len(x) for x in text.split("\n")]


def test_which_of_rows_with_one_key_stays_is_defined(spark):
    rows = [("o/a", "u1", "2024-01-02T00:00:00Z"), ("o/a", "u2", "2024-01-01T00:00:00Z"), ("o/b", "u2", "2024-01-01T00:00:00Z"), ("o/c", "u3", None)]
    saved = spark.createDataFrame([], "repo_full_name string, repo_url string")
    for n in (1, 3):
        found = spark.createDataFrame(rows, "repo_full_name string, repo_url string, repo_created_at string").repartition(n, "repo_url")
        assert sorted((r.repo_full_name, r.repo_url) for r in access.new_repositories(saved, found).collect()) == [("o/a", "u2"), ("o/c", "u3")]
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert sorted(map(tuple, access.insert_absent(new.where("k = 2"), new, ["k"]).collect())) == [(1, "b"), (2, "c")]
    assert sorted(map(tuple, access.insert_absent(new.where("k = 2"), new, ["k"], [F.asc("v")]).collect())) == [(1, "a"), (2, "c")]


def test_rows_with_null_keys_are_replaced(spark):
    old, new = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int"), spark.createDataFrame([(None, 9), ("a", 8)], "k string, v int")
    assert sorted(map(str, (tuple(r) for r in evaluation.replace_or_append(old, new, F.col("k")).collect()))) == ["('a', 8)", "('b', 3)", "(None, 9)"]
