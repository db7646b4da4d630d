"""Byte-level BPE by speculation and verification.

A text is cut into words by the vocabulary's pattern.  Greedy longest match proposes the tokens of
each word.  A proposal is right exactly if each token is what its own bytes encode to and every
two neighbours are compatible, that is, if no merge ever joins bytes across their border; the
check walks down the right edge of one token's merge tree and the left edge of the other's, for all
pairs of a batch of words at once in numpy.  Only words with a failing pair are merged exactly.

The vocabulary file is a parameter.  Its added tokens are found in a text before anything else.
Executors read it where its path leads; its content is sent to them otherwise (about 1.5 MB).

Edge cases: a null text encodes like an empty one, to no tokens; any text is encoded whole,
whatever its length; repeated rows get equal results; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Distinct words whose tokens a worker remembers: the first it meets of up to so many letters, and so most of the common ones.
MEMORY, LONGEST = 100_000, 40
_NEVER = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary with its merges; encode() and decode() work on words and token ids."""

    def __init__(self, content: str) -> None:
        data = json.loads(content)
        vocab, letters = data["model"]["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        size = max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in t)
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.names = [str(i) for i in range(size)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        # by token: the merge that makes it (rank, left, right); single bytes are there from the start
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        for rank, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((i, j), (rank, k))
            if self.rank[k] < 0 and self.left[k] < 0:
                self.rank[k], self.left[k], self.right[k] = rank, i, j
        keys = np.array([(i << 32) | j for i, j in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], dtype=np.int64)[order]
        #: by a token's first five bytes, the length of the longest token that starts so
        self.longest: dict[bytes, int] = {}
        self.known = self._sound_tokens(vocab)
        self.memory: dict[str, tuple[int, ...]] = {}

    def _sound_tokens(self, vocab: dict[str, int]) -> dict[bytes, int]:
        """Tokens that their own bytes encode to, in the order of their merges: single bytes, then those whose two parts are sound and stay apart until their own merge."""
        sound = np.zeros(len(self.rank), dtype=bool)
        sound[self.byte_id] = True
        made = np.flatnonzero(self.left >= 0)
        made = made[np.argsort(self.rank[made])]
        fit = self.compatible(self.left[made], self.right[made], self.rank[made])
        for k, ok in zip(made.tolist(), fit.tolist(), strict=True):
            sound[k] = ok and sound[self.left[k]] and sound[self.right[k]]
        found = {self.bytes_of[i]: i for i in vocab.values() if sound[i]}
        for t in found:
            if len(t) > 4:
                self.longest[t[:5]] = max(len(t), self.longest.get(t[:5], 0))
        return found

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER) if len(self.pair_keys) else np.full(len(a), _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair (a, b) stays apart up to the merge rank ``until`` (for good if None).

        Going back in time, x is the piece at the right end of a and y that at the left end of b.
        They are neighbours from the moment the later of them is made until the earlier of them is
        used up; a merge of (x, y) in that time joins them.  Of two uses of the same merge, the one
        further left happens first, so y's use at that very rank comes too late and x's doesn't.
        """
        x, y = a.copy(), b.copy()
        end_x = np.full(len(a), _NEVER) if until is None else until.copy()
        end_y = end_x.copy()
        apart, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            xs, ys = x[live], y[live]
            rank = self.pair_rank(xs, ys)
            joined = (rank != _NEVER) & (rank < end_x[live]) & ((rank < end_y[live]) | ((rank == end_y[live]) & (end_y[live] != (until[live] if until is not None else _NEVER))))
            apart[live[joined]] = False
            open_ = ~joined & ((self.left[xs] >= 0) | (self.left[ys] >= 0))
            live, xs, ys = live[open_], xs[open_], ys[open_]
            back_x = self.rank[xs] > self.rank[ys]
            i, j = live[back_x], live[~back_x]
            end_x[i], x[i] = self.rank[xs[back_x]], self.right[xs[back_x]]
            end_y[j], y[j] = self.rank[ys[~back_x]], self.left[ys[~back_x]]
        return apart

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, known, longest = [], 0, len(word), self.known, self.longest
        while i < n:
            j = i + longest.get(word[i : i + 5], 4)
            if j > n:
                j = n
            while (t := known.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge_exactly(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals: for words of more than 64 bytes a heap over a linked list, n log n in the word's length."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) <= 64:
            return self._merge_short(ids)
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merge[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        merge, none = self.merge, (_NEVER, -1)
        ready = [merge.get(pair, none) for pair in pairwise(ids)]
        while ready:
            best = min(ready)
            if best is none:
                break
            i = ready.index(best)
            ids[i] = best[1]
            del ids[i + 1], ready[i]
            if i < len(ready):
                ready[i] = merge.get((ids[i], ids[i + 1]), none)
            if i:
                ready[i - 1] = merge.get((ids[i - 1], ids[i]), none)
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each of ``words``: proposals whose pairs are all compatible, exact merging for the rest."""
        data = [w.encode("utf-8", "replace") for w in words]
        out = [self.propose(w) for w in data]
        sizes = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        flat = np.fromiter(chain.from_iterable(out), dtype=np.int64, count=int(sizes.sum()))
        if len(flat) < 2:
            return out
        owner = np.repeat(np.arange(len(out)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique((flat[inside] << 32) | flat[inside + 1], return_inverse=True)
        fit = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        for k in np.unique(owner[inside[~fit[which]]]).tolist():
            out[k] = self.merge_exactly(data[k])
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut: list[list[list[str] | int]] = []
        fresh: dict[str, None] = {}
        known = self.memory
        for text in texts:
            segments = self.split_added.split(text or "") if self.split_added else [text or ""]
            cut.append([self.added[s] if s in self.added else PATTERN.findall(s) for s in segments if s])
            for s in cut[-1]:
                if not isinstance(s, int):
                    fresh.update(dict.fromkeys(w for w in s if w not in known))
        words = list(fresh)
        room = MEMORY - len(known)
        known.update(zip(words, map(tuple, self.encode_words(words)), strict=True))
        look = known.__getitem__
        out = [list(chain.from_iterable([s] if isinstance(s, int) else chain.from_iterable(map(look, s)) for s in segments)) for segments in cut]
        for i, w in enumerate(words):
            if i >= room or len(w) > LONGEST:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _bpe(content: str) -> Bpe:
    return Bpe(content)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _batches(texts: list[str | None], chars: int = 500_000) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs`` (doc_id, text); one pass, no shuffle."""
    box = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(box.value)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for part in _batches(b.column(1).to_pylist()):
                for ids in bpe.encode_batch(part):
                    n.append(len(ids))
                    ids_sha.append(sha(",".join(map(bpe.names.__getitem__, ids)).encode()))
                    text_sha.append(sha(bpe.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def with_tokens(docs: DataFrame, vocabulary: str, to: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of its ``text`` in the new column ``to`` (array<int>)."""
    box = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(box.value)
        for b in batches:
            ids = [x for part in _batches(b.column(at).to_pylist()) for x in bpe.encode_batch(part)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, to])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))]))


def decode_tokens(docs: DataFrame, vocabulary: str, ids: str = "token_ids", to: str = "text") -> DataFrame:
    """``docs`` with the text of its column ``ids`` in the new column ``to``; null ids give a null text."""
    box = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    at = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(box.value)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, to])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())]))


def encoded_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs`` (doc_id, text)."""
    box = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(box.value)
        for b in batches:
            n = [len(x) for part in _batches(b.column(1).to_pylist()) for x in bpe.encode_batch(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long")
