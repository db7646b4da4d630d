"""Repeated and null ids, hot sources, clashing names, and operators against plain versions of themselves."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import ann, bpe, importance, langid, mixing, near_dups, quality_rules, suffixes
from lodestone.llm.common import forget, pieces, shared_path, staged, uniform, unused
from lodestone.llm.queries import vocabulary

from .conftest import EN, FR, sample_texts, sentence
from .test_documents import WORD, plain_components, plain_repeats, plain_targets


# shared helpers


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 100)], ["t"])
    cut = list(pieces(b, 10_000))
    assert sum(p.num_rows for p in cut) == 100 and all(p.nbytes <= 10_000 for p in cut) and len(cut) <= 20
    assert [p.num_rows for p in pieces(b.slice(0, 1), 10)] == [1] and [p.num_rows for p in pieces(b.slice(0, 0), 10)] == [0]


def test_staged_folders_can_be_forgotten(spark):
    import os

    df = staged(spark.range(5).toDF("x"), "forget")
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
    forget(df)
    assert not os.path.exists(folder)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    if spark.conf.get("spark.checkpoint.dir", None) is not None:
        pytest.skip("a shared folder is set")
    monkeypatch.setattr(type(spark.sparkContext), "master", property(lambda _: "spark://host:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_path(spark, "x")


def test_unused_names():
    assert unused(["a", "MIX"], "mix") == "_mix" and unused([], "mix") == "mix"


# language identification


def test_compression_decides_as_plain_loops_do(make_docs):
    rng = random.Random(7)
    texts = [sentence(rng, rng.randint(20, 400), FR if i % 3 == 0 else EN) for i in range(30)]
    docs = make_docs(texts)
    dictionaries = langid.fit_dictionaries(docs.where("lang is not null"))
    found = {r.doc_id: r for r in langid.identify_languages(docs, dictionaries).collect()}
    for i, t in enumerate(texts):
        data, totals = t.lower().encode(), {}
        for lang, d in dictionaries.items():
            coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            totals[lang] = sum(len(coder.compress(data[j : j + 1024])) for j in range(0, len(data), 1024))
        best, second = sorted(totals.values())[:2]
        if best < second:
            assert totals[found[i].lang_pred] == best
            assert found[i].score == pytest.approx((second - best) / second)


def test_any_number_of_languages_and_one_row_a_text(spark):
    rows = [(i, f"l{i % 400}", f"word{i % 400} " * 30) for i in range(1200)]
    found = langid.fit_dictionaries(spark.createDataFrame(rows, "doc_id long, lang string, text string"), docs_per_lang=2, max_chars=400 * 2 * 50)
    assert len(found) == 400
    assert all(len(v) <= 50 for v in found.values())  # copies of a text are learned once


# nearest neighbours


def test_repeated_query_rows_are_one_query(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(rng.standard_normal((300, 8)))]
    table = spark.createDataFrame([*rows, rows[50], rows[44]], "vec_id long, embedding array<double>, part string")
    for part_rows in (1000, 30):
        hits = ann.nearest(table, F.col("vec_id") % 50 == 0, part_rows=part_rows, target_recall=1.0).where("query_id = 50").orderBy("rank").collect()
        unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
        want = sorted(((-float(unit[50] @ unit[i]), i) for i in [*unit, 44] if i != 50))[:5]
        assert [r["rank"] for r in hits] == [1, 2, 3, 4, 5] and [r.vec_id for r in hits] == [i for _, i in want]


# near duplicates


def test_unlike_texts_with_one_id_both_stay(make_docs):
    rng = random.Random(2)
    a, b, c = (sentence(rng, 100) for _ in range(3))
    rows = near_dups.drop_near_duplicates(make_docs([a, b, a, a, c, None, ""], [1, 1, 1, 2, 3, 4, 4])).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter([(1, a), (1, b), (3, c), (4, None), (4, "")])


def test_one_row_of_each_component_stays(make_docs):
    texts = sample_texts()
    kept = {r.doc_id for r in near_dups.drop_near_duplicates(make_docs(texts)).collect()}
    assert kept == {i for i, (_, low, _) in plain_components(texts).items() if low == i or not WORD.findall(texts[i] or "")}


def test_short_texts_are_no_candidates_of_each_other(spark):
    one = [near_dups.sketch(near_dups.shingles(f"word{i}")) for i in range(200)]
    assert min(int(s.min()) for s in one) > 0
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(one)], "node long, sketch binary")
    assert near_dups.band_keys(nodes).groupBy("band").count().where("count > 1").isEmpty()


# repeated strings


def test_rows_without_ids_are_many_groups(make_docs):
    rng = random.Random(12)
    shared = "".join(rng.choice("abcdef") for _ in range(150))
    texts = [shared + chr(ord("A") + i) + "".join(rng.choice("ghij") for _ in range(50 + i)) for i in range(20)]
    found = suffixes.repeat_digest(make_docs(texts, [None] * 20)).collect()
    assert Counter(r.n_removed for r in found) == Counter([0] + [150] * 19)


def test_twins_in_many_batches_keep_what_they_share(make_docs):
    rng = random.Random(13)
    common = "".join(rng.choice("abcdef") for _ in range(130))
    a, b = "x" * 30 + common + "y" * 90, "z" * 40 + common + "w" * 80
    docs = make_docs([a, a, a, b], [5, 5, 5, 6]).repartition(4)
    want = plain_repeats([a, b], [5, 6])
    assert sorted((r.doc_id, r.n_removed) for r in suffixes.repeat_digest(docs).collect()) == [(5, want[5][1])] * 3 + [(6, want[6][1])]


# importance resampling


def test_weights_and_draws_equal_a_plain_version(make_docs):
    rng = random.Random(17)
    texts = [sentence(rng, rng.randint(5, 60), EN if i % 2 else FR) for i in range(120)] + [None, ""]
    docs = make_docs(texts)
    buckets, target = 1000, set(range(1, 60, 2))

    def grams(t):
        h = [crc32(w) for w in (t or "").encode().split()]
        mix, wrap = 0x9E3779B97F4A7C15, (1 << 64) - 1
        return [((x * mix & wrap) >> 20) % buckets for x in h + [(a * mix + b) & wrap for a, b in zip(h, h[1:])]]

    raw, good = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        good.update(grams(t) if i in target else ())
    weight = [sum(math.log((good[g] + 1) / (sum(good.values()) + buckets)) - math.log((raw[g] + 1) / (sum(raw.values()) + buckets)) for g in grams(t)) for t in texts]
    u = {r.doc_id: r.u for r in docs.select("doc_id", uniform(7, "doc_id", F.xxhash64("text")).alias("u")).collect()}
    key = {i: w - math.log(-math.log(u[i])) for i, w in enumerate(weight)}
    rows = {r.doc_id: r for r in importance.resample(docs, docs.where(F.col("doc_id").isin(*target)).select("doc_id"), 0.4, buckets=buckets).collect()}
    for i in key:
        assert rows[i].log_weight == pytest.approx(weight[i], abs=1e-8) and rows[i].gumbel_key == pytest.approx(key[i], abs=1e-8)
    assert {i for i, r in rows.items() if r.kept} == set(sorted(key, key=lambda i: (-key[i], i))[: round(0.4 * len(texts))])


def test_largest_among_many_ties(spark):
    rows = [(None if i % 2 else i % 7, 1.0 if i < 900 else 2.0, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, key double, row long").repartition(4)
    for k in (50, 100, 400, 550, 900, 999):
        got = {r["row"] for r in importance.mark_largest(df, "key", "id", k, "top", row="row", bins=7, small=10).where("top").collect()}
        want = sorted(rows, key=lambda r: (-r[1], -1 if r[0] is None else r[0], r[2]))[:k]
        assert got == {r[2] for r in want}


# mixing


def plain_mix(spark, docs, weights=(5, 2, 1), cap=3.0):
    """taken by doc_id: keys from the same hash, everything else in plain loops."""
    quality = {r.doc_id: r.quality for r in quality_rules.judge_quality(docs).collect()}
    u = {r.doc_id: (r.u, r.source, r.text) for r in docs.select("doc_id", "source", "text", uniform(20, "doc_id", F.xxhash64("text")).alias("u")).collect()}
    groups = defaultdict(list)
    for i, (x, source, text) in u.items():
        groups[source].append((-math.log(x) / max(0.05, quality[i]), i, len(WORD.findall(text or ""))))
    target = plain_targets({s: sum(n for _, _, n in g) for s, g in groups.items()}, weights, cap)
    out = {}
    for s, g in groups.items():
        total = sum(n for _, _, n in g)
        epochs = int(target[s] // total) if total else 0
        left = round(target[s] - epochs * total)
        for _, i, n in sorted(g):
            out[i] = epochs * n + min(n, max(0, left))
            left -= n
    return out


def test_the_documents_drawn_equal_a_plain_version(spark, docs):
    got = {r.doc_id: r.taken for r in mixing.mix_sources(docs, buckets=8, few=2).collect()}
    assert got == plain_mix(spark, docs)


def test_low_weights_pile_up_nowhere(spark):
    """However the keys lie, the documents that are put in order are few."""
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("w w w").alias("text")).unionByName(spark.range(n, n + 100).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit("w").alias("text")))
    seen = []
    plain = mixing._edges

    def edges(keyed, targets, buckets, few):
        found = plain(keyed, targets, buckets, few)
        inside = keyed.join(found, "source_id").where(F.col("key").between(F.col("lo"), F.col("hi")))
        seen.append(inside.groupBy("source_id").count().agg(F.max("count")).first()[0])
        return found

    mixing._edges = edges
    try:
        rows = mixing.mix_sources(docs, weights=(1, 1), quality=F.lit(0.05), buckets=64, few=50).collect()
    finally:
        mixing._edges = plain
    assert seen and seen[0] <= 50
    target = {r.source: r.target for r in rows}
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_rows_without_ids_are_taken_one_by_one(make_docs):
    rng = random.Random(21)
    texts = [sentence(rng, 10) if i % 3 else "same ten words " * 3 for i in range(90)]
    docs = make_docs(texts, [None] * 90)
    taken = sum(r.taken for r in mixing.mix_sources(docs, few=3, buckets=4).collect())
    rows = mixing.mixed_documents(docs, few=3, buckets=4).collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == taken


def test_many_sources_and_reruns(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), F.col("id") % 97)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"))
    rows = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    target = plain_targets(sizes)
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=str)


# names that operators use themselves


def test_columns_with_clashing_names_stay(make_docs):
    rng = random.Random(30)
    texts = [sentence(rng, 40) for _ in range(12)]
    clash = ["mix", "_mix", "of", "edge", "copy", "spans", "i", "m", "d", "n", "s", "mark", "row", "label", "tb", "rep", "taken", "key", "source_id", "quality", "votes"]
    docs = make_docs(texts).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"{c}!").alias(c) for c in clash])
    for made in (near_dups.drop_near_duplicates(docs), suffixes.remove_repeats(docs), mixing.mixed_documents(docs), langid.keep_identified(docs, langid.fit_dictionaries(docs)), bpe.with_tokens(docs, vocabulary()).drop("token_ids")):
        assert made.columns == docs.columns
        rows = made.collect()
        assert rows and all(r[c] == f"{c}!" for r in rows for c in clash)
    hidden = docs.withColumn("size", F.lit("x")).withColumn("weight", F.lit("x"))
    assert mixing.mix_sources(hidden).count() == 12 and quality_rules.judge_quality(hidden).count() == 12


# the pipeline


def cut_plainly(texts):
    """texts by id without the bytes that repeat an earlier string."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        d = t.encode()
        gone = bytearray(len(d))
        for p in range(len(d) - 99):
            if d[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(d[p : p + 100])
        out[i] = bytes(x for x, g in zip(d, gone) if not g).decode("utf-8", "ignore") if any(gone) else t
    return out


def test_every_stage_equals_brute_force(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(vocabulary())
    texts = dict(enumerate(sample_texts()))
    dictionaries = langid.fit_dictionaries(docs.where(~langid.held_out()))
    coders, known = langid._coders(dictionaries, 6), {k: frozenset(v.split()) for k, v in dictionaries.items()}
    clear = {i: t for i, t in texts.items() if not langid.classify(t, coders, known, 1024, 0.005)[2]}
    names = sorted(clear)
    low = plain_components([clear[i] for i in names])
    alone = {i: clear[i] for k, i in enumerate(names) if low[k][2]}
    cut = {i: t for i, t in cut_plainly(alone).items() if t}

    table = docs
    out = []
    for name, stage in corpus_pipeline.STAGES:
        table = staged(stage(spark, table, ""), f"test-{name}")
        out.append(table)
    for want, got in zip((clear, alone, cut), out, strict=False):
        assert {r.doc_id: r.text for r in got.collect()} == want and got.count() == len(want)
        assert got.columns == docs.columns
    assert all(r.n_chars == len(r.text) and r.lang for r in out[2].collect())
    words = Counter()
    for r in out[3].collect():
        assert cut[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    assert dict(words) == {i: n for i, n in plain_mix(spark, out[2]).items() if n}
    plain = Counter((r.doc_id, r.lang, r.source, tuple(lib.encode(r.text, add_special_tokens=False).ids)) for r in out[3].collect())
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.token_ids)) for r in table.collect()) == plain
    assert all(r.n_tokens == len(r.token_ids) for r in table.collect())


def test_pipeline_on_odd_tables(spark, make_docs, no_docs):
    rng = random.Random(40)
    rows = [sentence(rng, 30000), sentence(rng, 50), sentence(rng, 50), None, ""]
    odd = make_docs([*rows, rows[1]], [1, 2, 2, 3, None, None])
    for table, least in ((no_docs, 0), (odd, 3)):
        for _, stage in corpus_pipeline.STAGES:
            table = staged(stage(spark, table, ""), "test-odd")
        assert table.count() >= least and table.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]


def test_limits_that_are_no_lengths(spark):
    from lodestone.llm import token_counts

    n = [0, 3, 3, 10, 50]
    lengths = spark.createDataFrame([(x,) for x in [*n, None]], "n_tokens long")
    for r in token_counts.at_limits(lengths, [0, 1, 7, 100]).collect():
        assert (r.docs_at_most, r.tokens_at_most) == (sum(x <= r.limit for x in n), sum(x for x in n if x <= r.limit))
        assert (r.docs_longer, r.tokens_longer, r.truncated_total) == (sum(x > r.limit for x in n), sum(x for x in n if x > r.limit), sum(min(x, r.limit) for x in n))
    assert [tuple(r) for r in token_counts.at_quantiles(token_counts.length_table(lengths), [0.1, 0.5, 0.61, 1.0]).collect()] == [(0.1, 0), (0.5, 3), (0.61, 10), (1.0, 50)]
    assert token_counts.at_limits(lengths.limit(0), [5]).first().docs_at_most == 0


def test_spans_of_many_equal_rows_are_those_of_one(spark, no_docs):
    """A thousand rows with one id and text: the list of their spans is as long as there are different ones, and the results are brute force's."""
    from lodestone.llm import suffixes

    text = " ".join(f"word{i % 37}" for i in range(120))
    df = spark.createDataFrame([(5, text)] * 1000 + [(9, f"new {text}")], "doc_id long, text string").repartition(4)
    rows, to = suffixes._with_spans(df)
    lists = rows.where(f"`{to}` is not null").select("doc_id", f"`{to}`").collect()
    assert len(lists) == 1001
    assert max(len(r[1]) for r in lists) <= len(text) and all(len({tuple(s) for s in r[1]}) == len(r[1]) for r in lists)
    # the first of the equal rows can't be told from the others: all of them lose what repeats within the text, and what an equal row has
    digests = {tuple(r)[1:] for r in suffixes.repeat_digest(df).where("doc_id = 5").collect()}
    assert len(digests) == 1
