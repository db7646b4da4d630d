"""Token-budgeted chunking."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .shared import pieces, spread

_TOKEN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")

_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]+\)|<img\b", re.IGNORECASE)
# Fixed value: the note before a piece of a table row.
_ROW_NOTE = "<!-- Oversized table row fragment -->"
SECTION_CHUNK = "chunk_no:int,n_tokens:int,chunk:string,is_image:boolean,is_table:boolean,is_code:boolean,headings:map<int,string>,h1:array<string>,h2:array<string>,fragment:int"
_CHUNK_ROW = pa.schema([("chunk_no", pa.int32()), ("n_tokens", pa.int32()), ("chunk", pa.string()), *((c, pa.bool_()) for c in ("is_image", "is_table", "is_code")), ("headings", pa.map_(pa.int32(), pa.string())), ("h1", pa.list_(pa.string())), ("h2", pa.list_(pa.string())), ("fragment", pa.int32())])


def count_tokens(text: str) -> int:
    """The same count as functions.text.token_count; additive over words, which chunking relies on."""
    return len(_TOKEN.findall(text))


_ROW_COST = count_tokens(_ROW_NOTE)


def word_chunks(df: DataFrame, text: str = "text", target: int = 300, overlap: int = 50) -> DataFrame:
    """A row for each chunk of ``target`` words that overlaps its neighbour by ``overlap``, with the columns chunk_no, chunk_words and chunk.

    With every word at cost 1 the greedy packing has a closed form, so nothing is scanned word by word.
    """
    step = target - overlap
    n = F.size("_words")
    last = F.greatest(F.lit(0), F.ceil((n - target) / step)).cast("int")
    out = df.withColumn("_words", X.words(F.col(text))).where(n > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    part = F.slice("_words", F.col("chunk_no") * step + 1, F.lit(target))
    return out.withColumn("chunk_words", F.size(part).cast("long")).withColumn("chunk", F.array_join(part, " ")).drop("_words")


def slice_by_cost(costs: list[int] | np.ndarray, target: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy maximal slices [a, b) with a cost of at most ``target`` (one item at least), each starting where ``overlap`` of the last is reached."""
    sums = np.concatenate([[0], np.cumsum(costs, dtype=np.int64)])
    out, a, n = [], 0, len(costs)
    while a < n:
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + target, side="right")) - 1)
        out.append((a, b))
        if b == n:
            break
        # the last place from which overlap is reached, but always onward
        a = max(a + 1, min(b, int(np.searchsorted(sums, sums[b] - overlap, side="right")) - 1))
    return out


def token_chunks(df: DataFrame, id_col: str, text: str = "text", target: int = 300, overlap: int = 50, count: Callable[[str], int] | None = None) -> DataFrame:
    """(id_col, chunk_no, n_tokens, chunk): words packed up to ``target`` tokens; a single longer word stands alone.

    count: tokens of a word, where they aren't functions.text.token_count's, which stays in the JVM.  Only the words' costs go to
    Python, where a chunk's end is looked up in their sums.
    """

    @F.pandas_udf("array<struct<first:int,n:int,n_tokens:int>>")  # type: ignore[call-overload]
    def slices(costs: pd.Series) -> pd.Series:
        return pd.Series([[(a, b - a, int(np.sum(c[a:b]))) for a, b in slice_by_cost(c, target, overlap)] for c in costs])

    @F.pandas_udf("array<int>")  # type: ignore[call-overload]
    def counted(words: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        return pd.Series([[known[w] if w in known else known.setdefault(w, count(w)) for w in ws] for ws in words])

    words = spread(df.select(id_col, text)).select(id_col, F.coalesce(X.words(F.col(text)), F.array().cast("array<string>")).alias("_words"))
    costs = F.transform("_words", X.token_count) if count is None else counted("_words")
    cut = words.withColumn("_slices", slices(costs)).select(id_col, "_words", F.posexplode("_slices").alias("chunk_no", "_s"))
    return cut.select(id_col, "chunk_no", F.col("_s.n_tokens").alias("n_tokens"), F.array_join(F.slice("_words", F.col("_s.first") + 1, F.col("_s.n")), " ").alias("chunk"))


def pack_bounds(costs: Column, target: int) -> Column:
    """array<struct<first, n, cost>>: where an array of costs is cut so that each part is packed up to ``target``; a greater cost stands alone.  A fold in the JVM whose state grows with the parts, not the items."""
    part = lambda acc: F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n"), acc["cost"].alias("cost")))
    state = lambda done, first, n, cost: F.struct(done.alias("done"), first.alias("first"), n.alias("n"), cost.alias("cost"))
    zero = F.lit(0)
    start = state(F.array().cast("array<struct<first:int,n:int,cost:int>>"), zero, zero, zero)

    def add(acc: Column, c: Column) -> Column:
        fits = (acc["n"] == 0) | (acc["cost"] + c <= target)
        return F.when(fits, state(acc["done"], acc["first"], acc["n"] + 1, acc["cost"] + c)).otherwise(state(F.concat(acc["done"], part(acc)), acc["first"] + acc["n"], F.lit(1), c))

    return F.aggregate(costs, start, add, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], part(acc))).otherwise(acc["done"]))


def pack_units(units: Column, cost: Callable[[Column], Column], target: int) -> Column:
    """array<struct<cost, parts>>: an array of texts packed greedily up to ``target``; a longer unit stands alone."""
    bounds = pack_bounds(F.transform(units, lambda u: cost(u).cast("int")), target)
    return F.transform(bounds, lambda b: F.struct(b["cost"].alias("cost"), F.slice(units, b["first"] + 1, b["n"]).alias("parts")))


def paragraph_chunks(df: DataFrame, text: str = "text", target: int = 300, sep: str = "\n") -> DataFrame:
    """A row for each chunk of whole paragraphs, with chunk_no, chunk_words and chunk."""
    split = spread(df).withColumn("_units", F.filter(F.split(text, sep), lambda x: F.trim(x) != ""))
    packed = pack_units(F.col("_units"), lambda u: F.size(X.words(u)), target)
    return split.select(*df.columns, F.posexplode(packed).alias("chunk_no", "_c")).withColumn("chunk_words", F.col("_c.cost")).withColumn("chunk", F.array_join(F.col("_c.parts"), sep)).drop("_c")


def merge_sections(sections: list[dict[str, Any]], target: int = 300, most: int = 450, least: int = 150, count: Callable[[str], int] = count_tokens, overlap: int = 0) -> list[dict[str, Any]]:
    """Sections {headings {level: title}, content, is_image, is_table, is_code, context_tokens} merged up to a token budget.

    Images and tables flush what is gathered and stand alone, split if they are too long; a change of
    the first two heading levels flushes once ``least`` tokens are there; nothing grows beyond ``most``, of which
    context_tokens (0 if absent) are kept free for what a section's embedding text says before its content.
    overlap: how many sections of a chunk open the next one too, if it has more of them.
    """
    out: list[dict[str, Any]] = []
    held: list[dict[str, Any]] = []
    fresh = False  # whether anything was added since the last flush

    def flush(keep: int) -> None:
        nonlocal fresh
        if held and fresh:
            covered = {f"h{k}": list(dict.fromkeys(h for s in held if (h := s["headings"].get(k)))) for k in (1, 2)}
            out.append({
                "content": "\n\n".join(s["content"] for s in held), "token_count": sum(s["n"] for s in held), "headings": held[0]["headings"], "sections": covered,
                "is_image": False, "is_table": False, "is_code": any(s.get("is_code") for s in held), "fragment": held[0]["fragment"] if len(held) == 1 else None,
            })
        held[:] = held[-keep:] if 0 < keep < len(held) else []
        fresh = False

    for s in sections:
        room = max(1, most - s.get("context_tokens", 0))
        alone = {"headings": s["headings"], "sections": {}, "is_image": bool(s.get("is_image")), "is_table": bool(s.get("is_table")), "is_code": False}
        if s.get("is_image") or s.get("is_table"):
            flush(0)
            windows = image_pieces(s["content"]) if s.get("is_image") else [s["content"]]
            for w in windows:
                pieces = table_pieces(w, room, count) if s.get("is_table") else split_text(w, room, count)
                out += [{**alone, "content": p, "token_count": count(p), "fragment": f} for p, f in pieces]
            continue
        for p, fragment in split_text(s["content"], room, count):
            n = count(p)
            size = sum(x["n"] for x in held)
            if held and ([held[-1]["headings"].get(k) for k in (1, 2)] != [s["headings"].get(k) for k in (1, 2)] and size >= least or size + n > most):
                flush(overlap)
                if sum(x["n"] for x in held) + n > most:
                    held.clear()
            held.append({**s, "content": p, "n": n, "fragment": fragment})
            fresh = True
            if sum(x["n"] for x in held) >= target:
                flush(overlap)
    flush(0)
    return out


def split_text(text: str, most: int, count: Callable[[str], int] = count_tokens, overlap_words: int = 20) -> list[tuple[str, int | None]]:
    """Paragraphs packed up to ``most`` tokens; longer ones cut between words with an overlap and numbered as fragments."""
    if count(text) <= most:
        return [(text, None)]
    out: list[tuple[str, int | None]] = []
    held: list[str] = []
    size = 0
    for p in (p for p in text.split("\n\n") if p.strip()):
        n = count(p)
        if held and size + n > most:
            out.append(("\n\n".join(held), None))
            held, size = [], 0
        if n > most:
            words = p.split()
            sums = [0, *accumulate(map(count, words))]
            a = k = 0
            while a < len(words):
                b = max(a + 1, bisect_right(sums, sums[a] + most) - 1)
                out.append((" ".join(words[a:b]), k))
                a, k = (b, k) if b == len(words) else (max(a + 1, b - overlap_words), k + 1)
        else:
            held.append(p)
            size += n
    if held:
        out.append(("\n\n".join(held), None))
    return out


def image_pieces(text: str) -> list[str]:
    """A window for each image of ``text``, from the image before it (or the start) to the one behind it (or the end)."""
    starts = [m.start() for m in _IMAGE.finditer(text)]
    if len(starts) < 2:
        return [text]
    edges = [0, *starts[1:], len(text)]  # the first window opens with the text, the others with the image before
    return [re.sub(r"\n{3,}", "\n\n", text[(edges[0] if i == 0 else starts[i - 1]) : (starts[i + 1] if i + 1 < len(starts) else edges[-1])].strip()) for i in range(len(starts))]


def table_pieces(text: str, most: int, count: Callable[[str], int] = count_tokens, overlap_chars: int = 100) -> list[tuple[str, int | None]]:
    """(piece, fragment): rows packed up to ``most`` tokens under what stands before the table and its two header lines.

    What stands behind the table goes with its last piece.  A row that is too long alone is cut into
    numbered fragments that overlap by ``overlap_chars``; a header alone stays whole.
    """
    if count(text) <= most:
        return [(text, None)]
    lines = text.split("\n")
    in_table = [x.strip().startswith("|") for x in lines]
    first = in_table.index(True) if True in in_table else len(lines)
    end = next((i for i in range(first, len(lines)) if not in_table[i]), len(lines))
    head, rows, tail = lines[: first + 2], lines[first + 2 : end], lines[end:]
    if end - first < 3:
        return [(text, None)]
    base = count("\n".join(head))
    out: list[tuple[list[str], int | None]] = []
    held: list[str] = []
    size = base
    for r in rows:
        n = count(r)
        if held and size + n > most:
            out.append((head + held, None))
            held, size = [], base
        if base + n > most:
            a = k = 0
            while a < len(r):
                low, high = a + 1, len(r)  # the longest slice that fits, one character at least
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if count(r[a:middle]) <= most - base - _ROW_COST else (low, middle - 1)
                out.append(([*head, _ROW_NOTE, r[a:low]], k))
                a, k = (low if low == len(r) else max(a + 1, low - overlap_chars)), k + 1
            continue
        held.append(r)
        size += n
    if held:
        out.append((head + held, None))
    out[-1] = (out[-1][0] + tail, out[-1][1])
    return [("\n".join(x), k) for x, k in out]


def split_table(table: str, most: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """table_pieces() without their numbers."""
    return [p for p, _ in table_pieces(table, most, count)]


def split_code(code: str, limit: int = 450, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Lines packed up to ``limit`` tokens, each piece after the first opening with the first line (the signature); a longer line stands alone."""
    if count(code) <= limit:
        return [code]
    lines = code.split("\n")
    head, out, held, size = lines[0], [], [], 0
    base = count(head)
    for line in lines:
        n = count(line)
        if held and size + n > limit:
            out.append("\n".join(held))
            held, size = [head], base
        held.append(line)
        size += n
    out.append("\n".join(held))
    return out


def split_definition(code: str, statements: list[tuple[int, int]], limit: int = 450, count: Callable[[str], int] = count_tokens) -> list[tuple[str, int, int]]:
    """(piece, first line, last line) of a definition whose body has ``statements`` (first and last line within ``code``).

    Whole statements are packed behind the signature, what stands before the first of them, and a brace that
    closes the body closes each piece.  Where a statement is too long for that, lines are packed instead.
    """
    lines = code.split("\n")
    last = len(lines) - 1
    if count(code) <= limit:
        return [(code, 0, last)]
    if statements:
        signature = "\n".join(lines[: statements[0][0]])
        closing = "\n}" if signature.rstrip().endswith("{") else ""
        base = count(signature) + count(closing)
        groups: list[list[tuple[int, int]]] = []
        size = limit
        for a, b in statements:
            n = count("\n".join(lines[a : b + 1]))
            if not groups or size + n > limit:
                groups.append([])
                size = base
            groups[-1].append((a, b))
            size += n
        pieces = [("\n".join([signature, *lines[g[0][0] : g[-1][1] + 1]]) + closing, g[0][0], g[-1][1]) for g in groups]
        if all(count(p) <= limit for p, _, _ in pieces):
            return pieces
    return [(p, 0, last) for p in split_code(code, limit, count)]


def section_chunks(sections: DataFrame, by: str | list[str], order: str, **limits: int) -> DataFrame:
    """merge_sections() over ``sections`` (by..., order, headings, content, is_image, is_table, is_code), one file at a time.

    A file's sections travel as one array, so a file must fit in a task; files do.  Python holds the objects of about 1 MB of
    files at a time, or of one file, however many come in a batch.
    """
    keys = [by] if isinstance(by, str) else by
    fields = ["headings", "content", "is_image", "is_table", "is_code", *(["context_tokens"] if "context_tokens" in sections.columns else [])]
    lists = sections.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.to_json(F.struct(*fields)).alias("s")))).alias("_sections"))

    def merged(items: list[str]) -> Iterator[dict[str, Any]]:
        rows = [json.loads(x) for x in items]
        rows = [{**r, "content": r.get("content") or "", "headings": {int(k): v for k, v in (r.get("headings") or {}).items()}} for r in rows]
        for i, m in enumerate(merge_sections(rows, **limits)):
            flags = {c: m[c] for c in ("is_image", "is_table", "is_code", "fragment")}
            yield {"chunk_no": i, "n_tokens": m["token_count"], "chunk": m["content"], **flags, "headings": [(k, v) for k, v in m["headings"].items() if v], "h1": m["sections"].get("h1", []), "h2": m["sections"].get("h2", [])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, 1 << 20):
                at, rows = [], []
                for i in range(part.num_rows):
                    found = list(merged(part.column(len(keys))[i].as_py()))
                    at += [i] * len(found)
                    rows += found
                own = [part.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[f.name] for r in rows], f.type) for f in _CHUNK_ROW)], [*keys, *_CHUNK_ROW.names])

    types = {f.name: f.dataType.simpleString() for f in lists.schema}
    plain = lists.select(*keys, F.transform("_sections", lambda x: x["s"]).alias("_sections"))
    return plain.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keys), SECTION_CHUNK.replace(":", " ")]))
