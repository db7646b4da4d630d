"""Hard-bounded chunks against a sequential version."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import splitting


def plain(sections: list[tuple], target: int, most: int, rows: int) -> list[tuple]:
    out: list[tuple] = []
    held: list[str] = []
    size, key = 0, None

    def flush() -> None:
        nonlocal size
        if held:
            out.append((*key, "text", None, size, "\n\n".join(held)))
        held.clear()
        size = 0

    for h1, h2, content, is_table in sections:
        content = (content or "").strip()
        if not content:
            continue
        n, now = len(content.split()), ((h1 or "").strip(), (h2 or "").strip())
        if is_table and content.count("\n") > rows:
            flush()
            lines = [x for x in content.split("\n") if x.strip(" ")]
            cut = [lines[i : i + rows] for i in range(2, len(lines), rows)]
            out += [(*now, "table", f"rows {i * rows + 1}-{i * rows + len(c)}", len(" ".join(lines[:2] + c).split()), "\n".join(lines[:2] + c)) for i, c in enumerate(cut)]
            key = now
            continue
        if now != key or size + n > most:
            flush()
        if n > most and not is_table:
            flush()
            part: list[str] = []
            parts, cost = [], 0
            for line in content.split("\n"):
                if part and cost + len(line.split()) > most:
                    parts.append(part)
                    part, cost = [], 0
                part.append(line)
                cost += len(line.split())
            parts.append(part)
            out += [(*now, "long", f"part {i + 1}", len(" ".join(p).split()), "\n".join(p)) for i, p in enumerate(parts)]
            key = now
            continue
        key = now
        held.append(content)
        size += n
        if size >= target:
            flush()
    flush()
    return out


def test_chunks_equal_those_of_one_pass(spark):
    rng = random.Random(6)
    docs: dict[int, list[tuple]] = {}
    for d in range(30):
        docs[d] = []
        for _ in range(rng.randint(0, 25)):
            table = rng.random() < 0.2
            text = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(rng.randint(1, 14))) if table else rng.choice([" ", "\n"]).join(f"w{i}" for i in range(rng.choice([0, 1, 4, 9, 15, 40])))
            docs[d].append((rng.choice(["A", "B ", None]), rng.choice(["x", None]), rng.choice([text, text, f"  {text}\n", None]), table))
    rows = [(d, i, {k: v for k, v in ((1, h1), (2, h2)) if v is not None}, c, t, "extra") for d, items in docs.items() for i, (h1, h2, c, t) in enumerate(items)]
    df = spark.createDataFrame(rows, "doc long, ord int, headings map<int,string>, content string, is_table boolean, words string").repartition(4)
    found = splitting.hard_bounded_chunks(df, ["doc"], target=12, most=20, rows=4, count=lambda c: F.size(X.words(c)))
    got: dict[int, list[tuple]] = {d: [] for d in docs}
    for r in sorted(found.collect(), key=lambda r: (r.doc, r.chunk_no)):
        assert r.chunk_no == len(got[r.doc])
        got[r.doc].append((r.h1, r.h2, r.kind, r.label, r.words, r.content))
    for d, items in docs.items():
        assert got[d] == plain(items, 12, 20, 4)
    assert splitting.hard_bounded_chunks(df.limit(0), ["doc"]).count() == 0
