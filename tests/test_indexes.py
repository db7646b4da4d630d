"""Indexes against scans and plain Python versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.stemming import stem
from lodestone.operators import indexes, retrieval, shared

# word and stem, as the algorithm's authors list them
STEMS = """consign consign;consigned consign;consigning consign;consignment consign;consistency consist;consistently consist;consolation consol;consolatory consolatori;consolidating consolid;consolingly consol;
conspicuously conspicu;conspiracy conspiraci;conspirators conspir;conspired conspir;constables constabl;constancy constanc;knackeries knackeri;knaves knave;knavish knavish;kneaded knead;kneeled kneel;knees knee;
knightly knight;knitted knit;knitting knit;knives knive;knockers knocker;generating generat;generally general;generically generic;generously generous;skies sky;dying die;news news;inning inning;innings inning;
proceeds proceed;ties tie;cries cri;by by;say say;cry cri;hopping hop;hoping hope;luxuriated luxuri;relational relat;conditional condit;valenci valenc;digitizer digit;vietnamization vietnam;operator oper;
feudalism feudal;decisiveness decis;hopefulness hope;sensibiliti sensibl;triplicate triplic;formative format;electrical electr;goodness good;allowance allow;adjustable adjust;irritant irrit;replacement replac;
dependent depend;adoption adopt;communication communic;communism communism;activate activ;rate rate;cease ceas;controll control;roll roll;bed bed;embed emb;gas gas;this this;gaps gap;kiwis kiwi;feed feed;agreed agre;
fly fli;flying fli;youth youth;boyish boyish;sayings say;arsenal arsenal"""


def test_stems(spark):
    pairs = [tuple(x.split()) for x in STEMS.replace("\n", "").split(";")]
    df = spark.createDataFrame(pairs, "word string, want string")
    assert [tuple(r) for r in df.withColumn("got", stem("word")).where("got <> want").collect()] == []


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = [a + b for a in "ba ce di fo gu".split() for b in "lt rn st mp nk".split()]
    rows: list[tuple[int | None, str | None]] = [(i, " ".join(rng.choice(words[: rng.choice([4, 10, 25])]) for _ in range(rng.choice([1, 3, 20, 60])))) for i in range(120)]
    rows += [(500, rows[7][1]), (501, f"{rows[7][1]} more"), (600, None), (601, ""), (602, "…"), (None, rows[7][1]), (7, "fonk the balt")]  # a copy, a near copy, nothing, an id twice
    return rows, spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string").repartition(3)


def test_trigram_searches_equal_scans(spark, texts):
    rows, df = texts
    tables = indexes.trigram_tables(df)
    once = df.where("doc_id is not null and doc_id <> 7")
    scanned = once.select("doc_id", "text").unionByName(spark.createDataFrame([(7, " ".join(t for i, t in rows if i == 7))], "doc_id long, text string"))
    for text, k, floor in ((rows[7][1], 5, 0.05), (rows[11][1], 20, 0.05), ("balt", 200, 0.05), ("zzz qqq", 3, 0.05), ("", 3, 0.05), (rows[3][1], 1, 0.05), (rows[4][1], 8, 0.6)):
        want = [(r.doc_id, r.similarity) for r in retrieval.trigram_topk(scanned, text, k, floor=floor).collect()]
        assert [tuple(r) for r in indexes.trigram_nearest(tables, text, k, floor=floor).collect()] == want
        asked = spark.createDataFrame([(1, text), (1, text), (None, text)], "query_id long, text string")
        assert [(r.id, r.similarity) for r in indexes.trigram_search(tables, asked, k, floor=floor).orderBy("rank").collect()] == want


def test_tables_of_nothing(spark, texts):
    none = texts[1].limit(0)
    assert indexes.trigram_nearest(indexes.trigram_tables(none), "balt").count() == 0
    assert indexes.trigram_search(indexes.trigram_tables(none), none.withColumnRenamed("doc_id", "query_id")).count() == 0
    assert indexes.fulltext_search(indexes.fulltext_tables(none), "balt").count() == 0


def plain_rank(places: list[list[int]]) -> float:
    if len(places) == 1:
        return sum(0.1 / (j * j) for j in range(1, len(places[0]) + 1)) / 1.64493406685
    apart = 1.0
    for i, a in enumerate(places):
        for b in places[:i]:
            for p in a:
                for q in b:
                    apart *= 1 - 0.1 * math.sqrt(1e-30 if abs(p - q) > 100 else 1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
    return 1 - apart


@pytest.mark.parametrize("words", ["balt", "balt fonk", "the balt and fonk dilt", "nothing balt", "the and"])
@pytest.mark.parametrize("block", [1, 8, 256])
def test_full_text_by_plain_loops(spark, texts, words, block):
    rows, df = texts
    key = (spark.sparkContext.applicationId, block)
    tables = _tables.setdefault(key, None) or _tables.__setitem__(key, indexes.fulltext_tables(df, block=block)) or _tables[key]
    wanted = [w for w in words.split() if w not in ("the", "and")]
    held: dict[int, dict[str, set[int]]] = {}
    for i, t in rows:
        if i is not None:
            for at, w in enumerate((t or "").split()):
                held.setdefault(i, {}).setdefault(w, set()).add(at + 1)
    ranks = [(-round(plain_rank([sorted(h[w])[:255] for w in wanted]), 9), i) for i, h in held.items() if wanted and all(w in h for w in wanted)]
    got = indexes.fulltext_search(tables, words, 10, first=2).collect()
    assert [r.id for r in got] == [i for _, i in sorted(ranks)[:10]]
    assert [r.rank_score for r in got] == pytest.approx([-r for r, _ in sorted(ranks)[:10]], abs=1e-8)


_tables: dict = {}


def test_an_index_is_made_again_only_for_other_files(spark, tmp_path):
    made = []

    def build(df):
        made.append(df.count())
        return {"t": df}

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    for _ in range(2):
        shared.remembered(spark.read.parquet(path), "k", build)
    spark.range(4).write.mode("append").parquet(path)
    shared.remembered(spark.read.parquet(path), "k", build)
    shared.remembered(spark.read.parquet(path).select(F.col("id").alias("x")), "k", build)
    assert made == [3, 7, 7]
    for _ in range(2):
        shared.remembered(spark.range(2), "k", build)
    assert made == [3, 7, 7, 2, 2]
