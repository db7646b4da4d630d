"""Edges between files, names and closures, with cycles."""

from __future__ import annotations

import random

from lodestone.operators import imports, relations


def resolved(spark, sources: dict[str, tuple[str, str]]):
    files = spark.createDataFrame([("r", p, lang, text) for p, (lang, text) in sources.items()], "repo string, path string, language string, content string")
    return files, imports.resolve_imports(imports.extract_imports(files, ("repo", "path")), files)


def test_names_go_round_and_come_to_an_end(spark):
    files, found = resolved(spark, {
        "p/a.py": ("python", "from .b import x, y as z, nothing\nimport os\n"), "p/b.py": ("python", "from .c import *\nfrom .a import nothing\n"), "p/c.py": ("python", "from .b import w as y\nfrom .d import x\n"),
        "p/d.py": ("python", "def x(): pass\ndef w(): pass\n"), "p/e.py": ("python", "from .d import w\n"),
    })
    defined = spark.createDataFrame([("r", "p/d.py", "x", "function"), ("r", "p/d.py", "w", "function")], "repo string, path string, name string, kind string")
    given = relations.given_names(found)
    got = {(r.path, r.name, r.local, r.target, r.hops) for r in relations.symbol_edges(found, defined, given).collect()}
    # y is only ever given on in a circle; c's own x stands in d
    assert got == {("p/a.py", "x", "x", "p/d.py", 2), ("p/c.py", "x", "x", "p/d.py", 0), ("p/e.py", "w", "w", "p/d.py", 0)}
    edges = {(r.path, r.target, r.is_external, tuple(r.symbols)) for r in relations.file_edges(found).collect()}
    assert ("p/a.py", "p/b.py", False, ("nothing", "x", "y")) in edges and ("p/a.py", "os", True, ("*",)) in edges and ("p/b.py", "p/c.py", False, ("*",)) in edges


def test_closure_equals_search(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    df = spark.createDataFrame([("r", a, b) for a, b in pairs] + [("s", 1, 2)], "repo string, path long, target long")
    want = {("s", 1, 2, 1)}
    for a in range(30):
        level, seen, d = {b for x, b in pairs if x == a}, set(), 1
        while level - seen:
            want |= {("r", a, b, d) for b in level - seen}
            seen |= level
            level, d = {b for x, b in pairs if x in level}, d + 1
    assert {tuple(r) for r in relations.reachable(df).collect()} == want
    assert relations.reachable(df.limit(0)).count() == 0
