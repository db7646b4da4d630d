"""SentencePiece byte-pair encoding that keeps track of where every piece comes from.

A text is first normalised as the model's file says: the longest prefix that its compiled character map
knows is replaced, again and again, and for every character of the result the place in the source is
recorded.  Where the map is empty, that record is arithmetic over the text's code points.  The result is cut
where no piece of the vocabulary can reach across, words are merged in order of the pieces' scores, characters
without a piece become bytes, and each piece is projected through the record to the bytes of the original text.

The model file is a parameter; its content is sent to executors (about 0.5 MB).  Models of type BPE are read;
user-defined and unused pieces, and white space as a suffix, raise ValueError.

Edge cases: a null text encodes like an empty one, to begin and end ids alone, and has no spans; any text is
encoded whole, whatever its length (a word of very many letters takes n log n); repeated rows get equal results;
an empty table gives no rows; other columns stay in encode() and are ignored by the digest.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, spread
from .merges import Memory, Merges, by_size, gather, group_sums, offsets

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_source_bytes long"


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message: numbers, or the bytes of what has a length or a fixed width."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = message[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, message[i : i + size]
        i += size


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes whose values point into a table of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes replaced) of the longest key that begins at ``at``."""
        units, found = self.units, None
        node = _jump(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= _jump(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        begin = found[0]
        return self.replacements[begin : self.replacements.index(0, begin)], found[1]


def _jump(unit: int) -> int:
    return (unit >> 10) << ((unit >> 9 & 1) * 8)


class Normalizer:
    """From a text to what is encoded, and back to the places it came from."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True) -> None:
        self.map, self.dummy, self.squeeze = CharacterMap(charsmap), dummy_prefix, squeeze
        self.space = SPACE if escape else " "
        #: nothing is replaced but spaces
        self.plain = not self.map.units and not squeeze and escape and dummy_prefix

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each border between its characters, the byte of ``text`` where it lies."""
        data, chunks = text.encode("utf-8", "replace"), []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units else None
            if hit is None:
                b = data[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                hit = (data[at : at + n], n)
            chunks.append((hit[0].decode("utf-8", "replace"), at))
            at += hit[1]
        out: list[str] = []
        places: list[int] = []
        first = next((k for k, (s, _) in enumerate(chunks) if s != " "), len(chunks)) if self.squeeze else 0
        if first == len(chunks):
            return "", np.zeros(1, dtype=np.int64)
        if self.dummy:
            out.append(self.space)
            places.append(chunks[first][1])
        after_space = self.squeeze
        for s, place in chunks[first:]:
            if after_space:
                s = s.lstrip(" ")
            if s:
                out.append(s.replace(" ", self.space))
                places += [place] * len(s)
                after_space = self.squeeze and s[-1] == " "
        whole, end = "".join(out), len(data)
        if self.squeeze:
            kept = len(whole.rstrip(self.space))
            if kept < len(whole):
                end = places[kept]
            whole, places = whole[:kept], places[:kept]
        return whole, np.array([*places, end], dtype=np.int64)


class Pieces:
    """A model; encode() and decode() work on batches."""

    def __init__(self, content: bytes) -> None:
        self.texts: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        norm: dict[int, int | bytes] = {}
        train: dict[int, int | bytes] = {}
        for number, value in fields(content):
            if number == 1:
                piece = dict(fields(value))
                self.texts.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number in (2, 3):
                (train if number == 2 else norm).update(fields(value))
        if train.get(3, 1) != 2 or {USER, UNUSED} & set(kinds) or train.get(24, 0):
            raise ValueError("only BPE models without user-defined or unused pieces and without suffixed white space are read")
        self.normalizer = Normalizer(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))
        # -1 comes as a ten-byte number
        self.unk, self.bos, self.eos = (None if (v := train.get(k, d)) >> 31 else v for k, d in ((40, 0), (41, 1), (42, 2)))
        self.unk_surface = train.get(44, " ⁇ ".encode()).decode()
        self.kinds = np.array(kinds)
        self.size = n = len(self.texts)
        by_text = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == NORMAL}
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(t[1:-1], 16)] = i
        self.fallback = bool(train.get(35, 0)) and bool((self.byte_ids >= 0).all())
        #: symbol of each code point: its piece, or else ``size`` plus the code point
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for t, i in by_text.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        rules = []
        for t, i in by_text.items():
            for cut in range(1, len(t)):
                a, b = t[:cut], t[cut:]
                i_a = by_text.get(a, n + ord(a) if len(a) == 1 else None)
                i_b = by_text.get(b, n + ord(b) if len(b) == 1 else None)
                if i_a is not None and i_b is not None:
                    rules.append((i_a, i_b, order[scores[i]], i))
        self.merges = Merges(*zip(*rules, strict=True)) if rules else Merges([], [], [], [])
        #: whether no piece goes on with a space after something else: words can be cut there
        self.cuts = not any(regex.search(f"[^{SPACE}]{SPACE}", t) for t in by_text) and self.normalizer.space == SPACE
        self.chars = np.array([len(t) if k == NORMAL else 0 for t, k in zip(self.texts, kinds, strict=True)], dtype=np.int64)
        surface = [b"" if k == CONTROL else self.unk_surface.encode() if k == UNKNOWN else bytes([int(t[1:-1], 16)]) if k == BYTE else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, kinds, strict=True)]
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_at = offsets(np.array([len(s) for s in surface]))
        self.memory = Memory(self._encode_words)

    def _encode_words(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each word, and of each id the characters that it covers: none for any but the last byte of a character."""
        n = self.size
        whole = (SPACE + SPACE.join(words)) if self.cuts else "".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + self.cuts
        ids, sizes = self.merges.merge(self.symbol[np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)].astype(np.int64), sizes)
        lost = ids >= n
        chars = np.ones(len(ids), dtype=np.int64)
        chars[~lost] = self.chars[ids[~lost]]
        if not lost.any():
            return [(sizes, ids.astype(np.int32)), (sizes, chars.astype(np.int32))]
        if not self.fallback:
            ids[lost] = self.unk if self.unk is not None else 0
            return [(sizes, ids.astype(np.int32)), (sizes, chars.astype(np.int32))]
        point = np.where(lost, ids - n, 0)
        wide = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        begin = offsets(wide)
        source = np.repeat(np.arange(len(ids)), wide)
        nth, width, point = np.arange(len(source)) - begin[source], wide[source], point[source]
        low = point >> (6 * (width - 1 - nth))
        value = np.where(nth > 0, 0x80 | (low & 0x3F), low | np.array([0, 0, 0xC0, 0xE0, 0xF0])[width])
        chars = np.where(nth == width - 1, chars[source], 0)
        ids = np.where(lost[source], self.byte_ids[value & 0xFF], ids[source])
        sizes = group_sums(wide, sizes)
        return [(sizes, ids.astype(np.int32)), (sizes, chars.astype(np.int32))]

    def _words(self, norm: str) -> list[str]:
        if not self.cuts:
            return [norm] if norm else []
        words = norm.split(SPACE)
        if norm and words[0]:  # no dummy prefix
            raise ValueError("a model whose words can be cut must put a space before the text")
        del words[0]
        return words if "" not in words else [w[1:] for w in regex.findall(f"{SPACE}+[^{SPACE}]*", norm)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, number of each text's, first byte and byte after the last of each id's part of its text)."""
        plain = self.normalizer.plain
        if plain:
            norms = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        else:
            norms, places = zip(*map(self.normalizer.normalize, texts), strict=True) if texts else ((), ())
        words, counts = [], []
        for s in norms:
            got = self._words(s)
            counts.append(len(got))
            words += got
        rows = self.memory.rows(words) if words else np.zeros(0, dtype=np.int64)
        ids, per_word = self.memory.runs(0, rows)
        chars = self.memory.runs(1, rows)[0].astype(np.int64)
        sizes = group_sums(per_word, np.array(counts, dtype=np.int64))
        # borders between characters: one more than characters in each text
        if plain:
            line = "".join(["\0\0" + t if t else "\0" for t in texts])
            points = np.frombuffer(line.encode("utf-32-le", "replace"), dtype=np.uint32)
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            border_at = offsets(np.array([len(t) + 2 if t else 1 for t in texts], dtype=np.int64))
            full = np.array([bool(t) for t in texts], dtype=bool)
            width[border_at[:-1]] = 0
            width[border_at[:-1][full] + 1] = 0
            borders = np.cumsum(width)
            borders -= np.repeat(borders[border_at[:-1]], np.diff(border_at))
        else:
            border_at = offsets(np.array([len(p) for p in places], dtype=np.int64))
            borders = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(chars)
        done = offsets(sizes)
        before = np.concatenate([[0], ends])[done[:-1]]
        last = ends - np.repeat(before, sizes) + np.repeat(border_at[:-1], sizes)
        return ids, sizes, borders[last - chars], borders[last]

    def framed(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the begin and end ids around each text's."""
        front, back = [x for x in (self.bos,) if x is not None], [x for x in (self.eos,) if x is not None]
        at = offsets(sizes)
        where = np.concatenate([np.repeat(at[:-1], len(front)), np.repeat(at[1:], len(back))])
        order = np.argsort(where, kind="stable") if not front or not back else None
        values = np.concatenate([np.tile(front, len(sizes)), np.tile(back, len(sizes))])
        if order is not None:
            return np.insert(ids, where[order], values[order].astype(ids.dtype)), sizes + len(front) + len(back)
        out = np.empty(len(ids) + 2 * len(sizes), dtype=ids.dtype)
        inside = np.ones(len(out), dtype=bool)
        first = at[:-1] + 2 * np.arange(len(sizes))
        inside[first] = inside[first + sizes + 1] = False
        out[inside], out[first], out[first + sizes + 1] = ids, self.bos, self.eos
        return out, sizes + 2

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one sequence of ids, in UTF-8; bytes that are no character become U+FFFD, one each."""
        said = np.flatnonzero(self.kinds[ids] != CONTROL)
        if not len(said):
            return b""
        cut = (self.normalizer.dummy or self.normalizer.squeeze) and self.texts[ids[said[0]]].startswith(SPACE)
        # bytes on both sides of a control id don't make one character
        runs = [ids[said[0] : said[-1] + 1]] if said[-1] - said[0] + 1 == len(said) else [ids[r] for r in np.split(said, np.flatnonzero(np.diff(said) > 1) + 1)]
        out = []
        for run in runs:
            data = gather(self.surface_at, self.surface, run)[0].tobytes()
            try:
                data.decode()
            except UnicodeDecodeError:
                data = data.decode("utf-8", "lone").encode()
            out.append(data)
        return b"".join(out)[1 if cut else 0 :]


def _lone(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


@lru_cache(maxsize=2)
def pieces(content: bytes) -> Pieces:
    import codecs

    codecs.register_error("lone", _lone)
    return Pieces(content)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str, to: str = "token_ids", starts: str = "starts", ends: str = "ends") -> DataFrame:
    """``docs`` with three new columns: the ids of its ``text``, begin and end ids not among them, and the first byte and the byte after the last of each id's part of the text."""
    box, at = docs.sparkSession.sparkContext.broadcast(read_model(model)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(box.value)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            ids, sizes, first, last = m.encode(texts)
            border = pa.array(offsets(sizes), pa.int32())
            more = [pa.ListArray.from_arrays(border, pa.array(x, pa.int32())) for x in (ids, first, last)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, to, starts, ends])

    kind = T.ArrayType(T.IntegerType())
    return map_arrow(docs, run, T.StructType([*docs.schema.fields, *(T.StructField(c, kind) for c in (to, starts, ends))]), most=1 << 20)


def decode(docs: DataFrame, model: str, ids: str = "token_ids", to: str = "text") -> DataFrame:
    """``docs`` with the text of its column ``ids`` in the new column ``to``; null ids give a null text."""
    box, at = docs.sparkSession.sparkContext.broadcast(read_model(model)), docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(box.value)
        for b in batches:
            texts = [None if x is None else m.decode(np.array(x, dtype=np.int64)).decode() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, to])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())]), most=1 << 20)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_source_bytes) of each row; one pass, no shuffle.

    Ids stand between begin and end ids.  n_source_bytes: how many bytes of the text the ids' parts cover together, which is
    all of them unless normalisation drops some.
    """
    box = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(box.value)
        for b in batches:
            n: list[int] = []
            ids_sha: list[str] = []
            text_sha: list[str] = []
            covered: list[int] = []
            for part in by_size([t or "" for t in b.column(1).to_pylist()]):
                ids, sizes, first, last = m.encode(part)
                covered += group_sums(last - first, sizes).tolist()
                ids, sizes = m.framed(ids, sizes)
                at = [0, *accumulate(sizes.tolist())]
                for i, j in zip(at, at[1:], strict=False):
                    n.append(j - i)
                    ids_sha.append(hashlib.sha256(ids[i:j].astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(m.decode(ids[i:j])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(covered, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes"])

    return map_arrow(spread(docs.select(F.col("doc_id").cast("long"), "text")), run, SCHEMA)
