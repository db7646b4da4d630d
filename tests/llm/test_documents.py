"""Operators on documents against plain single-machine versions of their contracts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import bpe, importance, langid, mixing, near_dups, quality_rules, suffixes, token_counts
from lodestone.llm.queries import vocabulary

from .conftest import EN, FR, sample_texts, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_counts_and_verdicts(make_docs):
    texts = sample_texts()
    texts += [" ".join(w + "***" for w in t.split()) for t in texts[:15]]  # one bad text alone tells nothing about the rules
    rows = {r.doc_id: r for r in quality_rules.judge_quality(make_docs(texts)).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, t in enumerate(texts):
        n, *rest = plain_counts(t)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r.base_failed and r.kept)
    assert all(rows[i].kept for i in range(30))
    assert not any(rows[i].kept for i in range(len(texts) - 15, len(texts)))


def test_votes_are_weighed_by_estimated_accuracy():
    rng = random.Random(5)
    counts = Counter()
    accuracy = (0.95, 0.9, 0.55, 0.6)
    truth_share = 0.7
    for _ in range(20000):
        y = 1 if rng.random() < truth_share else -1
        counts[tuple(y if rng.random() < a else -y if rng.random() < 0.7 else 0 for a in accuracy)] += 1
    share, p, good = quality_rules.fit_votes(sorted(counts.items()))
    assert abs(share - truth_share) < 0.05
    assert np.all(np.abs(p[1, :, 2] - accuracy) < 0.06)
    assert good[1, 1, -1, -1] > 0.5 > good[-1, -1, 1, 1]  # two good rules outvote two poor ones


def test_empty_tables(no_docs):
    assert quality_rules.judge_quality(no_docs).count() == 0
    assert langid.label_languages(no_docs).count() == 0
    assert near_dups.near_duplicates(no_docs).count() == 0
    assert suffixes.repeat_digest(no_docs).count() == 0
    assert mixing.mix_sources(no_docs).count() == 0
    assert bpe.encode_documents(no_docs, vocabulary()).count() == 0
    assert token_counts.length_table(bpe.encoded_lengths(no_docs, vocabulary())).count() == 0
    assert importance.resample(no_docs, no_docs.select("doc_id"), 0.5).count() == 0


# language identification


def test_languages(make_docs):
    rng = random.Random(1)
    texts = [sentence(rng, rng.randint(20, 120), FR if i % 3 == 0 else EN) for i in range(200)]
    rows = {r.doc_id: r for r in langid.label_languages(make_docs(texts + [None, "", "12 34", "…"], list(range(204)))).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    # beyond the first 30, the fixture's labels call French text English: only right labels are learned from
    labelled = make_docs(texts[:30])
    found = {r.doc_id: r for r in langid.identify_languages(make_docs(texts), langid.fit_dictionaries(labelled.where("lang is not null"))).collect()}
    assert np.mean([found[i].lang_pred == ("fr" if i % 3 == 0 else "en") for i in found]) > 0.97
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].rejected for i in range(200, 204))
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_no_labels_no_language(docs):
    assert {r.lang_pred for r in langid.identify_languages(docs, {}).collect()} == {"und"}


# near duplicates


def plain_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(docs):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect()}
    assert found == plain_components(sample_texts())


def test_chains_of_near_duplicates_and_large_groups(make_docs):
    rng = random.Random(9)
    words = sentence(rng, 300).split()
    texts = []
    for _ in range(60):  # each differs a little from the one before, and a lot from the first
        words = list(words)
        for _ in range(4):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts.append(" ".join(words))
    base = sentence(rng, 200).split()
    for _ in range(80):  # near copies of one text that are further from each other
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = f"own{rng.random()}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 30
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(make_docs(texts)).collect()}
    assert found == plain_components(texts)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.75, 0.9):
        got = []
        for _ in range(30):
            n = 1000
            both = int(2 * n * j / (1 + j))
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n - both :])
            sa, sb = near_dups.sketch(a), near_dups.sketch(b)
            assert np.array_equal(near_dups.merge(sa, sb), near_dups.sketch(np.union1d(a, b)))
            got.append(near_dups.estimate(sa[None], sb[None], np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(got) - j) < 0.03


# repeated strings


def plain_repeats(texts, ids=None):
    seen, out = set(), {}
    for i, t in sorted(enumerate(texts) if ids is None else zip(ids, texts)):
        d = (t or "").encode()
        gone = bytearray(len(d))
        for p in range(len(d) - 99):
            if d[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(d[p : p + 100])
        left = bytes(x for x, g in zip(d, gone) if not g)
        out[i] = (len(d), sum(gone), sum(1 for j in range(len(d)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_strings(make_docs, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "_SEGMENT", 20000)  # cuts the long text
    texts = sample_texts()
    rng = random.Random(4)
    common = "".join(rng.choice("abcdefgh ") for _ in range(160))
    texts += ["".join(rng.choice("ij") for _ in range(rng.randint(0, 90))) + common[rng.randint(0, 60) : rng.randint(100, 160)] + "".join(rng.choice("kl") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += ["".join(rng.choice("ab") for _ in range(40)) * 6, "\0" * 350, "\0" * 99, "\0" * 100, "q" * 100, "q" * 101]
    found = {r.doc_id: tuple(r)[1:] for r in suffixes.repeat_digest(make_docs(texts)).collect()}
    assert found == plain_repeats(texts)


def test_repeats_are_cut_out_of_texts(make_docs):
    texts = ["é" * 200 + "tail", "x" + "é" * 120, None, "plain"]
    rows = {r.doc_id: r for r in suffixes.remove_repeats(make_docs(texts)).collect()}
    assert rows[2].text is None and rows[3].text == "plain" and rows[1].text == "x"
    assert rows[3].band == "b"


def test_rows_with_one_id(make_docs):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef") for _ in range(300))
    rows = suffixes.repeat_digest(make_docs([text, text, "x" + text, text], [7, 7, 7, 8])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == [(7, 300, 0), (7, 300, 0), (7, 301, 300), (8, 300, 300)]


# BPE and token counts


def test_bpe_equals_the_library(make_docs, docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(vocabulary())
    rng = random.Random(8)
    letters = "etaoin shrdlu THE'sre  \n\t0123.,*#!éüßñ中文字😀"
    texts = sample_texts() + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["the" * 500, "a" * 3000, " " * 500]
    rows = {r.doc_id: r for r in bpe.encode_documents(make_docs(texts), vocabulary()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    some = bpe.with_tokens(docs, vocabulary())
    back = bpe.decode_tokens(some.drop("text"), vocabulary()).select("doc_id", "text")
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(sample_texts())}
    assert docs.columns == some.columns[:-1]


def test_speculation_and_exact_merging_agree():
    b = bpe.Bpe(bpe.read_vocabulary(vocabulary()))
    rng = random.Random(6)
    words = ["".join(rng.choice("thenigraos") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    encoded = b.encode_words(words)
    assert encoded == [b.merge_exactly(w.encode()) for w in words]
    assert any(b.propose(w.encode()) != e for w, e in zip(words, encoded))  # some words do need merging


def test_token_counts(docs):
    lengths = bpe.encoded_lengths(docs, vocabulary())
    n = [r.n_tokens for r in lengths.collect()]
    rows = token_counts.length_table(lengths, block=16).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(n))
    for r in rows:
        limit = r.n_tokens
        assert r.n_docs == n.count(limit) and r.total_tokens == limit * n.count(limit)
        assert (r.docs_at_most, r.tokens_at_most) == (sum(x <= limit for x in n), sum(x for x in n if x <= limit))
        assert (r.docs_longer, r.tokens_longer) == (sum(x > limit for x in n), sum(x for x in n if x > limit))
        assert r.truncated_total == sum(min(x, limit) for x in n)
        assert abs(r.quantile - r.docs_at_most / len(n)) < 1e-12


# mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(docs):
    rows = mixing.mix_sources(docs, buckets=8).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(sample_texts())}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == size[r.doc_id]
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    target = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        epochs = int(target[r.source] // sizes[r.source])
        assert epochs * r["size"] <= r.taken <= (epochs + 1) * r["size"]  # complete epochs first
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(7), buckets=8).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_better_documents_are_drawn_more_often(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"), F.lit("w " * 10).alias("text"))
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25)
    rows = mixing.mix_sources(docs, weights=(1, 3), quality=weight).where("source = 'a'").collect()
    even, odd = (sum(r.taken > 0 for r in rows if r.doc_id % 2 == k) for k in (0, 1))
    assert even > 2 * odd


def test_mixed_documents_hold_the_words_taken(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    words = defaultdict(int)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = sample_texts()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)


# importance resampling


def test_resampling_prefers_target_text(make_docs):
    rng = random.Random(11)
    texts = [sentence(rng, 60) if i % 2 else " ".join(w + "***" for w in sentence(rng, 60).split()) for i in range(400)] + [None, ""]
    docs = make_docs(texts)
    rows = {r.doc_id: r for r in importance.resample(docs, docs.where("doc_id % 2 = 1 and doc_id < 100").select("doc_id"), 0.5).collect()}
    assert sum(r.kept for r in rows.values()) == round(0.5 * len(texts))
    assert np.mean([rows[i].kept for i in range(1, 400, 2)]) > 0.97
    assert rows[400].log_weight == rows[401].log_weight == 0


def test_largest_are_marked_exactly(spark):
    rng = random.Random(3)
    values = [(i, round(rng.gauss(0, 1), 2)) for i in range(3000)]
    df = spark.createDataFrame(values, "id long, key double").repartition(4)
    for k in (0, 1, 700, 2999, 3000, 5000):
        got = {r.id for r in importance.mark_largest(df, "key", "id", k, "top", bins=7, small=10).where("top").collect()}
        assert got == {i for i, _ in sorted(values, key=lambda x: (-x[1], x[0]))[:k]}


# all of them


def test_null_ids(make_docs):
    texts = sample_texts()
    ids = [None if i % 9 == 4 or i > 40 else i for i in range(len(texts))]
    docs = make_docs(texts, ids)
    some = [i for i in ids if i is not None]
    for found in (
        quality_rules.judge_quality(docs), langid.label_languages(docs), near_dups.near_duplicates(docs), suffixes.repeat_digest(docs), bpe.encode_documents(docs, vocabulary()), mixing.mix_sources(docs),
        importance.resample(docs, docs.where("doc_id < 9").select("doc_id"), 0.5),
    ):
        rows = found.collect()
        assert len(rows) == len(texts) and sorted(r.doc_id for r in rows if r.doc_id is not None) == some
    last = [i if i is not None else 10**6 + k for k, i in enumerate(ids)]
    cut = Counter((r.n_bytes, r.n_removed) for r in suffixes.repeat_digest(docs).collect() if r.doc_id is not None)
    assert cut == Counter(v[:2] for k, v in plain_repeats(texts, last).items() if k < 10**6)
    kept = near_dups.drop_near_duplicates(docs).collect()
    assert sum(r.doc_id is None for r in kept) == ids.count(None)
    taken = {r.doc_id for r in mixing.mix_sources(docs).collect() if r.taken}
    assert {r.doc_id for r in mixing.mixed_documents(docs).collect()} == taken  # of rows that share an id and a size, any may be taken
