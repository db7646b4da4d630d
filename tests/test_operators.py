from __future__ import annotations

import hashlib
import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.operators import access, chunking, evaluation, imports, ingest, manifests, predicates, retrieval
from lodestone.sources import files
from lodestone.streaming import limits


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<double>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int")
    return df.select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [("word", "two words", 4 / 11), ("same", "same", 1.0), ("", "", 0.0), ("abc", "xyz", 0.0), ("Élan", "élan", 1.0)])
def test_trigram_similarity(spark, a, b, want):
    assert one(spark, X.trigram_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)
    assert one(spark, X.trigram_similarity(F.col("b"), F.col("a")), a=a, b=b) == pytest.approx(want)


def test_cosine(spark):
    d = V.cosine_distance(F.col("a"), F.col("b"))
    assert one(spark, d, a=[1.0, 0.0], b=[2.0, 0.0]) == pytest.approx(0)
    assert one(spark, d, a=[1.0, 0.0], b=[-1.0, 0.0]) == pytest.approx(2)
    assert one(spark, d, a=[0.0, 0.0], b=[1.0, 0.0]) is None


def test_scalar_functions(spark):
    c = F.col("a")
    assert one(spark, X.duration_seconds(c), a="1h12m4.2s") == pytest.approx(4324.2)
    assert one(spark, X.duration_seconds(c), a="soon") == 0
    assert tuple(one(spark, X.requirement(c), a="pkg >= 1, < 2")) == ("pkg", ">= 1, < 2")
    assert tuple(one(spark, X.requirement(c), a="pkg")) == ("pkg", "*")
    assert one(spark, X.clean(c), a="a\0b\n\n\n\nc") == "ab\n\nc"
    assert one(spark, X.repair_headings(c), a="- # T\n##\ntext") == "# T\ntext"
    assert one(spark, X.heading_level(c), a="### x") == 3
    assert [tuple(x) for x in one(spark, X.html_images(c), a='<IMG alt="x" src=\'y.png\'><img src="z">')] == [("y.png", "x")]
    assert tuple(one(spark, X.import_alias(c), a=" x.y as z ")) == ("x.y", "z")
    assert tuple(one(spark, X.repo_of(c), a="https://host.org/own/name.git")) == ("own", "name")
    assert one(spark, X.is_uuid(c), a="123e4567-e89b-12d3-a456-426614174000") is True
    assert one(spark, X.is_uuid(c), a=None) is False
    assert one(spark, X.title(c), a="  ") is None
    assert one(spark, X.retry_after(F.lit(1500), F.lit(2000))) == 1
    assert one(spark, X.seconds_to_midnight(F.to_timestamp(F.lit("2024-07-01 00:00:00Z")))) == 7 * 3600
    assert one(spark, X.token_count(c), a="ab 12,x") == chunking.count_tokens("ab 12,x") == 4


def test_embedding_text_is_whole(spark, tmp_path):
    from lodestone.plans import catalog

    rows = [(1, "en", "s", "x" * 80 + "one"), (2, "en", "s", "x" * 80 + "two"), (3, "en", "s", " "), (4, "en", "s", " a ")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.embedding_md5 for r in catalog.QUERIES["embedding_text_whole"](spark, str(tmp_path)).collect()}
    plain = {i: " | ".join(p for p in r if p.strip(" ")) for i, *r in rows}
    assert got == {i: hashlib.md5(p.encode()).hexdigest() for i, p in plain.items()} and got[1] != got[2]


def test_fusion_ties_and_single_lists(spark):
    rows = [(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (2, 1, "d")]
    fused = retrieval.fuse(spark.createDataFrame(rows, "list_no int, rank int, id string"))
    assert [r.id for r in retrieval.top_fused(fused, 10).collect()] == ["a", "b", "d", "c"]
    score = {r.id: r.rrf for r in fused.collect()}
    assert score["a"] == score["b"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "b"), (2, 1, "q"), (3, 1, "a")], "query_id int, rank int, id string")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z"), (2, "m"), (1, "a")], "query_id int, id string")
    rows = {r.query_id: r for r in evaluation.query_metrics(results, relevant, 4).collect()}
    assert (rows[1].hit, rows[1].precision, rows[1].recall, rows[1].mrr) == (1, 0.5, pytest.approx(2 / 3), 0.5)
    assert rows[1].ap == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert [(rows[q].hit, rows[q].recall, rows[q].mrr, rows[q].ap) for q in (2, 3)] == [(0, 0, 0, 0)] * 2


def test_batch_topk_keeps_queries_off_the_driver(spark, monkeypatch):
    x = np.random.default_rng(0).integers(-2, 3, (90, 4)).astype(float)  # many ties, and zero vectors
    x[7] = 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>").repartition(3).cache()
    for name in ("toLocalIterator", "collect", "toPandas", "toArrow"):
        monkeypatch.setattr(type(df), name, lambda *a, **b: pytest.fail("rows went through the driver"))
    found = retrieval.batch_topk(df, df, 3, block=8)
    monkeypatch.undo()
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.round(1 - (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None, :]), 9)
    want = {(q, r + 1, i) for q in range(90) for r, (_, i) in enumerate(sorted((d[q, i], i) for i in range(90) if i != q and np.isfinite(d[q, i]))[:3])}
    assert {(r.query_id, r["rank"], r.id) for r in found.collect()} == want


def test_label_metrics_equal_those_of_pairs(spark):
    labels = [(i, None if i == 9 else i % 3) for i in range(20)] + [(20, 7)]
    results = spark.createDataFrame([(q, r, (q * 5 + r * 2) % 21) for q in (0, 3, 9, 11, 20) for r in range(1, 6)], "query_id long, rank int, id long").where("id <> query_id")
    pairs = spark.createDataFrame([(a, b) for a, x in labels for b, y in labels if a != b and x is not None and x == y], "query_id long, id long")
    got = evaluation.label_metrics(results, spark.createDataFrame(labels, "id long, label long"), 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evaluation.query_metrics(results, pairs, 4).collect()))


def test_judge_averages_need_whole_rows(spark):
    df = spark.createDataFrame([(2, 1), (1, None), (3, 1), (0, 0)], "a int, b int")
    r = evaluation.judge_averages(df, ["a", "b"]).first()
    assert (r.rows, r.scored, r.avg_a, r.avg_b) == (4, 2, 1.0, 0.5)
    assert evaluation.judge_averages(df.limit(0), ["a"]).first().avg_a is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 60), st.integers(0, 30))
def test_slices_cover_and_fit(costs, target, overlap):
    slices = chunking.slice_by_cost(costs, target, overlap)
    covered = sorted({i for a, b in slices for i in range(a, b)})
    assert covered == list(range(len(costs)))
    assert all(sum(costs[a:b]) <= target or b == a + 1 for a, b in slices)
    assert all(y[0] > x[0] for x, y in zip(slices, slices[1:]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab |\n", max_size=40), max_size=8))
def test_merged_sections_keep_every_word(texts):
    sections = [{"headings": {1: f"h{i // 2}"}, "content": t, "is_image": False, "is_table": False, "is_code": False} for i, t in enumerate(texts)]
    merged = chunking.merge_sections(sections, target=6, most=10, least=3)
    assert set(" ".join(texts).split()) <= set(" ".join(m["content"] for m in merged).split()) | {""}


def test_paragraph_packing(spark):
    df = spark.createDataFrame([(1, "a b\nc d e\nf\n\n" + "w " * 9 + "\ng"), (2, None), (3, "")], "id int, text string")
    rows = chunking.paragraph_chunks(df, target=5).orderBy("id", "chunk_no").collect()
    assert [(r.id, r.chunk_words, r.chunk.strip()) for r in rows] == [(1, 5, "a b\nc d e"), (1, 1, "f"), (1, 9, ("w " * 9).strip()), (1, 1, "g")]


def test_tables_and_code_split_with_their_heads():
    table = "| a |\n|---|\n" + "\n".join(f"| r{i} |" for i in range(20))
    parts = chunking.split_table(table, 30)
    assert all(p.startswith("| a |\n|---|\n") and chunking.count_tokens(p) <= 30 for p in parts)
    assert chunking.split_table("| a |\n|---|", 1) == ["| a |\n|---|"]
    code = "def f():\n" + "\n".join(f"    x{i} = {i}" for i in range(100))
    assert all(p.startswith("def f():") for p in chunking.split_code(code, 50))


def test_filter_language(spark):
    rows = [(1, True, 1.5, "aB", None), (2, False, float("nan"), None, 4), (3, None, None, "x+", 5)]
    df = spark.createDataFrame(rows, "id int, b boolean, d double, s string, n int")
    ids = lambda *c, how="and": [r.id for r in df.where(predicates.compile_filter(df, list(c), how)).orderBy("id").collect()]
    spec = lambda c, op, v=None: {"column": c, "operator": op, "value": v}
    assert ids(spec("b", "eq", "yes")) == [1] and ids(spec("b", "eq", "0")) == [2]
    assert ids(spec("s", "neq", "aB")) == [2, 3]
    assert ids(spec("d", "is_null")) == [2, 3] and ids(spec("d", "not_null")) == [1]
    assert ids(spec("s", "contains", "ab|X")) == [1, 3]
    assert ids(spec("n", "in", ["4", 9])) == [2] and ids(spec("n", "between", [4, "5"])) == [2, 3]
    assert ids(spec("n", "gt", 4), spec("s", "eq", "aB"), how="or") == [1, 3]
    for bad in (spec("zz", "eq", 1), spec("n", "like", 1), spec("n", "gt"), spec("n", "in", 3), spec("n", "between", [1])):
        with pytest.raises(ValueError):
            predicates.condition(df, bad)
    with pytest.raises(ValueError):
        predicates.compile_filter(df, [spec("n", "gt", 1)], "xor")
    assert [r.id for r in predicates.filter_table(df, [], order=["id"], sample=2).collect()] == [1, 2]
    plan = df.where(predicates.compile_filter(df, [spec("n", "gt", 4)]))._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan


def test_ingest_is_idempotent_and_drops_deleted_files(spark):
    files_ = ingest.with_hash(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string"))
    assert ingest.ingest(files_, files_, ["path"])[0].count() == 0
    new = ingest.with_hash(spark.createDataFrame([("a", "1"), ("c", "3")], "path string, content string"))
    changed, snapshot = ingest.ingest(files_, new, ["path"])
    assert [r.path for r in changed.collect()] == ["c"] and sorted(r.path for r in snapshot.collect()) == ["a", "c"]
    image = lambda w, h: one(spark, ingest.meaningful_image(F.lit(w), F.lit(h)))
    assert image(200, 200) and not image(119, 900) and not image(130, 130) and not image(130, 700)


def test_access(spark):
    rooms = spark.createDataFrame([("u", 1), ("u", 2)], "user string, room int")
    users = spark.createDataFrame([("u",), ("v",)], "user string")
    assert {r.user: (r.n, r.allowed) for r in access.within_quota(users, rooms, "user", 2).collect()} == {"u": (2, False), "v": (0, True)}
    found = access.nested(users, rooms, ["user"], ["room"], "rooms").collect()
    assert {r.user: [x.room for x in r.rooms] for r in found} == {"u": [1, 2], "v": []}
    assert access.insert_absent(rooms, spark.createDataFrame([("w", 2), ("w", 3), ("w", 3)], "user string, room int"), ["room"]).count() == 3
    assert [r.room for r in access.page(rooms, ["room"], 2, 1).collect()] == [2]


def test_token_bucket_rules():
    ok, s = limits.spend(None, 0.0, 10.0, 10.0, 1.0, 100.0)
    assert ok and s == (0.0, 0.0, 100.0)
    ok, s = limits.spend(s, 5.0, 6.0, 10.0, 1.0, 100.0)
    assert not ok and s == (5.0, 5.0, 100.0)  # keeps its refill and its old expiry
    ok, s = limits.spend(s, 6.0, 6.0, 10.0, 1.0, 100.0)
    assert ok and s == (0.0, 6.0, 106.0)
    assert limits.spend(s, 106.0, 10.0, 10.0, 0.0, 100.0)[0]  # expired: full again


def plain_bucket(rows, *limit):
    state, out = {}, []
    for k, t, o, c in sorted(rows, key=lambda r: (r[1], r[2])):
        ok, state[k] = limits.spend(state.get(k), t, c, *limit)
        out.append((k, o, ok, state[k][0]))
    return sorted(out)


def test_token_bucket_holds_no_whole_group(spark, monkeypatch):
    rows = [(i % 7 if i % 3 else 0, float(i * 37 % 500), i, 1.0 + i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "user long, at double, event long, cost double").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = limits.token_bucket(df, "user", "at", "event", "cost", 20.0, 0.5, 1e3)
        assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, out.collect())) == plain_bucket(rows, 20.0, 0.5, 1e3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_rows_of_a_group_are_put_in_order_in_bounded_frames():
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": 1, "t": rng.integers(0, 50, 1000).astype(float), "o": rng.permutation(1000)})
    pdf.loc[::97, "t"] = np.nan
    got = list(limits._in_order((pdf.iloc[i : i + 30] for i in range(0, 1000, 30)), ["t", "o"], run_rows=100, piece=20))
    assert max(map(len, got)) <= 20
    pd.testing.assert_frame_equal(pd.concat(got, ignore_index=True), pdf.sort_values(["t", "o"], ignore_index=True))


def test_extractors():
    got = imports.js_imports("import a, { b as c } from './m'\nconst { x: y } = require(\"n\")\nimport 's'\nawait import('d')")
    assert [(g[0], g[2], g[3], g[5]) for g in got] == [("./m", [("default", "a"), ("b", "c")], False, False), ("s", [], True, False), ("n", [("x", "y")], False, False), ("d", [], False, True)]
    assert manifests.split_requirement("a~=1") == ("a", "~=1")
    assert manifests.requirement_type("requirements/dev.txt") == "dev"


def office(**members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_png", ".png"), content)
    return bytearray(data.getvalue())


def test_office_files_and_tables(spark, tmp_path):
    w = 'xmlns:w="w"'
    body = f'<w:d {w}><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:d>'
    chart = "<c><ser><tx><v>S</v></tx><cat><pt><v>x</v></pt></cat><val><pt><v>2.5</v></pt></val></ser></c>"
    doc = office(word__document_xml=body, word__media__i_png="p", word__charts__chart1_xml=chart)
    sheet = office(**{"xl__sharedStrings_xml": "<s><si><t>name</t></si><si><t>bob</t></si></s>", "xl__worksheets__sheet1_xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>9</v></c></row></w>'})
    table = spark.createDataFrame([("a.docx", doc), ("bad.docx", bytearray(b"x")), ("p.pdf", bytearray(b"y"))], "path string, content binary")
    rows = {r.path: r for r in files.office_documents(table, lambda b: f"pdf {len(b)}").collect()}
    assert rows["a.docx"].markdown == "## T\n\nbody\n\n| h |\n|---|\n| v |" and rows["a.docx"].images == ["word/media/i.png"]
    assert [tuple(c) for c in rows["a.docx"].charts] == [("word/charts/chart1.xml", "S", "x", 2.5)]
    assert rows["bad.docx"].markdown is None and rows["p.pdf"].markdown == "pdf 1"
    cells = files.spreadsheet_rows(spark.createDataFrame([("s.xlsx", sheet)], "path string, content binary")).collect()
    assert [r["values"] for r in cells] == [{"name": "bob", "7": "9"}]
    for n, whole in ((5, True), (6, False), (7, False)):
        (tmp_path / f"{n}.tsv").write_text("a\tb\n" + "1\tx\n" * n)
        head, kinds, complete = files.table_preview(spark, str(tmp_path / f"{n}.tsv"))
        assert complete == whole and head.count() == min(n, 6) and kinds == {"a": "int", "b": "string"}


def test_repository_reader(spark, tmp_path):
    for name, data in {"a.py": b"x=1", "node_modules/b.js": b"", "img/noext": b"\x89PNG\r\n", "yarn.lock": b"", "raw": b"\0\1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path: (r.category, r.language) for r in files.repository(spark, str(tmp_path), "r").collect()}
    assert rows == {"a.py": ("code", "python"), "img/noext": ("image", None), "raw": ("binary", None)}


def test_embedder_contract(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("",)], "text string")
    got = [r.embedding for r in files.embed(df).collect()]
    assert got[0] == got[1] and sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-5) and not any(got[2])
