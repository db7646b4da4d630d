"""Operators 11 to 13 against the libraries and plain Python versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from lodestone.llm import alignment, pieces, prefix_trie
from lodestone.llm.merges import Memory, Merges, gather, offsets
from lodestone.llm.queries import vocabulary

from .conftest import sample_texts

MODEL, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
ODD = [
    "", " ", "  ", "a  b", "▁", "a▁b  ▁ c", "\n", "\n\n a", "<s>x</s>", "<unk><0x41> <|endoftext|>", "é中\U0001F600 x\n", "x" * 500, "ab " * 300, " lead", " \t mix  　  z",
    "\x00a\x01", " " * 40 + "a", "the", "the", "the", "don't we'll", "a   b", "tail ", "tail\n ",
]


def noise(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("ab é中😀\n\t,.'1ß▁") for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=vocabulary(MODEL))


def test_merging_equals_one_pair_after_the_other():
    rng = random.Random(5)
    pairs = {(a, b): (rng.randrange(6), rng.randrange(8, 14)) for a in range(14) for b in range(14) if rng.random() < 0.4}
    rules = Merges([a for a, _ in pairs], [b for _, b in pairs], [r for r, _ in pairs.values()], [j for _, j in pairs.values()])

    def plain(ids: list[int]) -> list[int]:
        while ready := [(pairs[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]:
            _, i = min(ready)
            ids = [*ids[:i], pairs[ids[i], ids[i + 1]][1], *ids[i + 2 :]]
        return ids

    words = [[rng.randrange(8) for _ in range(rng.choice([0, 1, 2, 5, 12, 80]))] for _ in range(300)]
    flat, sizes = rules.merge(np.array([x for w in words for x in w], dtype=np.int64), np.array(list(map(len, words))))
    at = offsets(sizes)
    assert [flat[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [plain(w) for w in words]


def test_memory_forgets_what_is_beyond_its_bound():
    asked = []

    def encode(words):
        asked.append(list(words))
        return [(np.array([len(w) for w in words]), np.frombuffer("".join(words).encode(), dtype=np.uint8))]

    memory = Memory(encode, most=2, longest=3)
    for words in (["aa", "b", "cc", "toolong"], ["b", "cc", "aa"], ["cc", "d"], ["aa"]):
        rows = memory.rows(words)
        assert memory.runs(0, rows)[0].tobytes().decode() == "".join(words)
    assert asked == [["aa", "b", "cc", "toolong"], ["cc"], ["cc", "d"]]
    assert gather(np.array([0, 2]), np.arange(2), np.zeros(0, dtype=np.int64))[0].tolist() == []


def test_pieces_equal_the_library_with_spans(library):
    m = pieces.pieces(pieces.read_model(vocabulary(MODEL)))
    texts = [t or "" for t in sample_texts()] + ODD + noise(600)
    ids, sizes, first, last = m.encode(texts)
    at = offsets(sizes)
    for k, t in enumerate(texts):
        run = slice(at[k], at[k + 1])
        assert ids[run].tolist() == library.encode(t)
        assert m.decode(ids[run]).decode() == library.decode(ids[run].tolist())
        if len(t) < 1000:
            assert list(zip(first[run].tolist(), last[run].tolist(), strict=True)) == [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]


def test_decoding_any_ids_equals_the_library(library):
    m, rng = pieces.pieces(pieces.read_model(vocabulary(MODEL))), random.Random(2)
    for _ in range(400):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(260) for _ in range(rng.randint(0, 12))]
        assert m.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
def test_normaliser_reads_compiled_maps(rule):
    sp = pytest.importorskip("sentencepiece")
    try:
        made = sp.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        proto = made.serialized_model_proto()
    except Exception as e:  # noqa: BLE001  an older library
        pytest.skip(str(e))
    spec = dict(next(pieces.fields(v) for n, v in pieces.fields(proto) if n == 3))
    ours = pieces.Normalizer(spec[2], True, True, True)
    assert ours.map.units
    for t in [*ODD, *noise(200), "ﬁ Ⅷ ｆｕｌｌ  width é ① ㌔ …", "  Ünï  ", "Å̀ ß İ"]:
        norm, places = ours.normalize(t)
        want, borders = made.normalize(t, with_offsets=True)
        assert norm == want
        points = t.encode("utf-8")
        assert [len(points[:p].decode()) for p in places] == list(borders)


def test_encoded_documents(spark, docs, library):
    got = {r.doc_id: r for r in pieces.encode_documents(docs, vocabulary(MODEL)).collect()}
    for i, t in enumerate(sample_texts()):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        r = got[i]
        assert (r.n_tokens, r.n_source_bytes) == (len(ids), len((t or "").encode()))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_spans_are_columns_and_ids_decode(spark, docs, no_docs):
    out = pieces.decode(pieces.encode(docs, vocabulary(MODEL)), vocabulary(MODEL), to="again")
    assert out.columns == [*docs.columns, "token_ids", "starts", "ends", "again"]
    for r in out.collect():
        data = (r.text or "").encode()
        assert b"".join(data[i:j] for i, j in zip(r.starts, r.ends, strict=True)) == data
        assert r.again == (r.text or "")
    assert pieces.encode_documents(no_docs, vocabulary(MODEL)).collect() == []


def aligned(texts: list[str | None]) -> list[tuple]:
    """Each text's row by the libraries and plain loops."""
    from lodestone.llm.bpe import byte_letters
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, letters = Tokenizer.from_file(vocabulary(BYTES)), byte_letters()
    t.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=vocabulary(MODEL))
    rows, count, best = [], Counter(), defaultdict(int)
    for x in texts:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        wide_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        wide_b = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not x or {b"".join(wide_a), b"".join(wide_b)} != {(" " + x).encode()}:
            rows.append(None)
            continue
        ends = [offsets(np.array(list(map(len, w))))[1:].tolist() for w in (wide_a, wide_b)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        count.update(links.keys())
        rows.append((len(a), len(b), groups, links))
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = r
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(m for (p, q), m in links.items() if count[p, q] == best[p]), sum(m * count[k] for k, m in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("sizes", [{}, {"buckets": 3, "postings_each": 400}])
def test_alignment_by_plain_loops(spark, make_docs, sizes):
    texts = [*(t if t is None or len(t) < 20_000 else t[:20_000] for t in sample_texts()), *ODD, *noise(150)]
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(make_docs(texts), vocabulary(BYTES), vocabulary(MODEL), **sizes).collect()}
    assert [got[i] for i in range(len(texts))] == aligned(texts)


def test_alignment_of_nothing_and_of_repeated_rows(spark, make_docs, no_docs):
    assert alignment.align(no_docs, vocabulary(BYTES), vocabulary(MODEL)).collect() == []
    texts = ["the cat", "the cat", None, "a dog"]
    got = sorted(tuple(r) for r in alignment.align(make_docs(texts, [1, 1, 2, 3]), vocabulary(BYTES), vocabulary(MODEL)).collect())
    assert got == sorted((i, *row) for i, row in zip([1, 1, 2, 3], aligned(texts), strict=True))


SCHEMA = "conv_id long, turn int, role string, text string, p int, k long, low long"


def plain_trie(rows: list[tuple]) -> list[tuple]:
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - abs(c) % 100 * (1 if c >= 0 else -1), [])[:h] + turns[c][h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    out = []
    for k, m in members.items():
        ends = sorted(c for c in m if len(whole[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def talk(n: int, said: list[str | None], most: int, seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-50, n * 3), n):
        for t in range(rng.randint(1, most)):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["u", "a", None]) if rng.random() < 0.1 else "u", rng.choice(said)))
    return rows


@pytest.mark.parametrize(
    ("rows", "tasks"),
    [
        ([], 3), ([(5, 0, "u", "x")], 2), ([(None, 1, "a", "b"), (7, 1, None, None)], 2), ([(7, 1, "a", "b")] * 3, 2), (talk(60, ["a", "b", None], 4, 1), 5), (talk(300, ["a"], 7, 2), 7),
        (talk(200, ["a", "bb", "c😀"], 5, 3), 40), (talk(40, ["a", "b"], 80, 4), 3), ([(c, t, "u", f"{t}") for c in range(100, 160) for t in range(9)], 11), ([(100, t, "u", "x" * 20_000 if t == 3 else "y") for t in range(900)], 2),
    ],
)
def test_trie_by_plain_loops(spark, monkeypatch, rows, tasks):
    monkeypatch.setattr(prefix_trie, "tasks_for", lambda df: tasks)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, prefix_trie.nodes(df).collect()), key=str) == plain_trie(rows)


def test_nearest_smaller_values():
    rng = random.Random(1)
    for n in (0, 1, 2, 30):
        v = [rng.randrange(6) for _ in range(n)]
        before, after = prefix_trie.nearest_smaller(v)
        assert before == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert after == [min((j for j in range(i + 1, n) if v[j] < v[i]), default=n) for i in range(n)]


def test_shared_turns_of_lines():
    d = prefix_trie.DIGEST
    lines = ["".join(c * d for c in w) for w in ("", "a", "ab", "abc", "abcabcabcabcabc", "abcabcabcabcabd", "b")]
    for x in lines:
        for y in lines:
            assert prefix_trie.shared(x, y) == next((k for k in range(min(len(x), len(y)) // d) if x[k * d : k * d + d] != y[k * d : k * d + d]), min(len(x), len(y)) // d)
