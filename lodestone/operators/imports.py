"""Import statements of source files, and the graph they make between files."""

from __future__ import annotations

import ast
import posixpath
import re
import sys
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

# Names and path rules that the languages themselves define.
NODE_BUILTINS = frozenset("assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split())
JAVA_PREFIXES = ("java.", "javax.", "jdk.", "sun.", "com.sun.", "org.w3c.", "org.xml.")
JS_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
JAVA_ROOTS = ("", "src", "src/main/java", "src/test/java")

SCHEMA = "source:string,alias:string,symbols:array<struct<name:string,alias:string>>,is_wildcard:boolean,is_static:boolean,is_dynamic:boolean"
RUST_PREFIXES = ("std::", "core::", "alloc::")
PARTS = 32  # that a repository's imports are dealt to, each with its modules
Import = tuple[str, str | None, list[tuple[str, str | None]], bool, bool, bool]


def python_imports(code: str) -> list[Import]:
    out: list[Import] = []
    for node in ast.walk(ast.parse(code)):
        if isinstance(node, ast.Import):
            out += [(a.name, a.asname, [], False, False, False) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            names = [(a.name, a.asname) for a in node.names]
            out.append(("." * node.level + (node.module or ""), None, [n for n in names if n[0] != "*"], ("*", None) in names, False, False))
        elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            name = ast.unparse(node.func)
            if name in ("__import__", "import_module", "importlib.import_module"):
                out.append((node.args[0].value, None, [], False, False, True))
    return out


def _items(text: str, sep: str = r"\s+as\s+") -> list[tuple[str, str | None]]:
    parts = [re.split(sep, x.strip()) for x in text.split(",") if x.strip()]
    return [(p[0].strip(), p[1].strip() if len(p) > 1 else None) for p in parts]


def js_imports(code: str) -> list[Import]:
    out: list[Import] = []
    for m in re.finditer(r"""^\s*import\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s*as\s+([\w$]+)\s*|\{([^}]*)\}\s*)?from\s*["']([^"']+)["']""", code, re.M):
        named = _items(m[3] or "")
        out.append((m[4], m[2], ([("default", m[1])] if m[1] else []) + named, bool(m[2]), False, False))
    out += [(m[1], None, [], True, False, False) for m in re.finditer(r"""^\s*import\s*["']([^"']+)["']""", code, re.M)]
    for m in re.finditer(r"""(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\(\s*["']([^"']+)["']\s*\)""", code):
        out.append((m[3], m[1], _items(m[2] or "", r"\s*:\s*"), False, False, False))
    out += [(m[1], None, [], False, False, True) for m in re.finditer(r"""\bimport\(\s*["']([^"']+)["']\s*\)""", code)]
    return out


def js_exports(code: str | None) -> list[tuple[str, str, str | None]]:
    """(name, kind, source) of what a file exports: declarations, lists with their outer names, defaults, and all of another file as *."""
    code = code or ""
    out: list[tuple[str, str, str | None]] = [(m[2], m[1], None) for m in re.finditer(r"^\s*export\s+(?:declare\s+)?(?:async\s+)?(class|function|const|let|var|interface|type|enum)\s*\*?\s+([\w$]+)", code, re.M)]
    out += [("default", m[1] or "value", None) for m in re.finditer(r"^\s*export\s+default\s+(?:async\s+)?(class|function)?", code, re.M)]
    for m in re.finditer(r"""^\s*export\s+(?:type\s+)?(?:\{([^}]*)\}|\*(?:\s+as\s+([\w$]+))?)\s*(?:from\s*["']([^"']+)["'])?""", code, re.M):
        out += [(alias or name, "list", m[3]) for name, alias in _items(m[1])] if m[1] is not None else [(m[2] or "*", "all", m[3])]
    return out


def extract_exports(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys..., name, kind, source) of the exports of JavaScript and TypeScript files (keys..., language, content)."""
    found = F.udf(js_exports, "array<struct<name:string,kind:string,source:string>>", useArrow=True)
    return files.where(F.col("language").isin("javascript", "typescript")).select(*keys, F.inline(found("content")))


def java_imports(code: str) -> list[Import]:
    found = re.finditer(r"^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", code, re.M)
    return [(m[2], None, [] if m[3] else [(m[2].rpartition(".")[2], None)], bool(m[3]), bool(m[1]), False) for m in found]


def go_imports(code: str) -> list[Import]:
    blocks = re.findall(r"^\s*import\s*\(([^)]*)\)", code, re.M) + re.findall(r'^\s*import\s+((?:[\w.]+\s+)?"[^"]+")', code, re.M)
    return [(m[2], m[1], [], m[1] == ".", False, False) for b in blocks for m in re.finditer(r'(?:([\w.]+)\s+)?"([^"]+)"', b)]


def rust_imports(code: str) -> list[Import]:
    """One import for each leaf of the trees that ``use`` declares."""
    out: list[Import] = []

    def leaves(prefix: str, tree: str) -> None:
        head, brace, rest = tree.partition("{")
        if not brace:
            path, _, alias = (x.strip() for x in (prefix + tree).partition(" as "))
            star, self_ = path.endswith("::*"), path.endswith("::self")
            path = path.removesuffix("::*").removesuffix("::self")
            out.append((path, alias or None, [] if star or self_ else [(path.rpartition("::")[2], alias or None)], star, False, False))
            return
        depth, start = 0, 0
        inner = rest.rpartition("}")[0]
        for i, ch in enumerate(inner + ","):
            depth += (ch == "{") - (ch == "}")
            if ch == "," and not depth:
                if part := inner[start:i].strip():
                    leaves(prefix + head.strip(), part)
                start = i + 1

    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code, re.M):
        leaves("", re.sub(r"\s+", " ", m[1]).strip())
    return out


EXTRACTORS = {"rust": rust_imports, "python": python_imports, "javascript": js_imports, "typescript": js_imports, "java": java_imports, "go": go_imports}


def imports_of(language: str | None, code: str | None) -> list[Import]:
    """The imports of a file; none if it doesn't parse."""
    try:
        return EXTRACTORS[language](code) if language in EXTRACTORS and code is not None else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def extract_imports(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys..., language, SCHEMA) for every import of ``files`` (keys..., language, content); files that don't parse give none."""
    found = F.udf(imports_of, f"array<struct<{SCHEMA}>>", useArrow=True)
    return files.where(F.col("language").isin(*EXTRACTORS)).select(*keys, "language", F.inline(found("language", "content")))


def _roots(folder: str) -> list[str]:
    """The file's folder and those above it, nearest first; the last is the repository's root."""
    parts = folder.split("/") if folder else []
    return ["/".join(parts[:i]) for i in range(len(parts), -1, -1)]


def _join(*parts: str) -> str:
    path = posixpath.normpath("/".join(p for p in parts if p) or ".")
    return "" if path == "." else path


def candidates(path: str, language: str, source: str, go_modules: dict[str, str]) -> tuple[str, Iterable[str]]:
    """(category if nothing is found, paths to look for, best first, made as they are asked for).  go_modules: module name by folder of its go.mod."""
    folder = posixpath.dirname(path)
    roots = _roots(folder)
    if language == "python":
        if source.split(".")[0] in sys.stdlib_module_names:
            return "stdlib", []
        level = len(source) - len(source.lstrip("."))
        tail = source.lstrip(".").replace(".", "/")
        if level:
            base = _join(folder, *[".."] * (level - 1))
            return "internal", ([_join(base, tail + ".py")] if tail else []) + [_join(base, tail, "__init__.py")]
        return "external", (c for r in roots for s in (r, _join(r, "src")) for c in (_join(s, tail + ".py"), _join(s, tail, "__init__.py")))
    if language in ("javascript", "typescript"):
        if source.startswith("node:") or source.split("/")[0] in NODE_BUILTINS:
            return "stdlib", []
        if source.startswith(("./", "../")):
            return "internal", (_join(folder, source) + s for s in JS_SUFFIXES)
        if source.startswith(("@", "~/")):
            rest = source.lstrip("@~").lstrip("/")
            return "external", (_join(b, rest) + s for r in roots for b in (_join(r, "src"), r) for s in JS_SUFFIXES)
        return "external", []
    if language == "java":
        if source.startswith(JAVA_PREFIXES):
            return "stdlib", []
        parts = source.split(".")
        stems = ["/".join(parts[:i]) for i in range(len(parts), 0, -1)]
        return "external", (c for s in stems for r in roots for j in JAVA_ROOTS for c in (_join(r, j, s + ".java"), _join(r, j, s)))
    if language == "go":
        if source.startswith(("./", "../")):
            return "internal", [_join(folder, source)]
        home = next((r for r in roots if r in go_modules), None)
        if home is not None and (source == go_modules[home] or source.startswith(go_modules[home] + "/")):
            return "internal", [_join(home, source[len(go_modules[home]) :].lstrip("/"))]
        return ("external" if "." in source.split("/")[0] else "stdlib"), []
    if language == "rust":
        if source.startswith(RUST_PREFIXES):
            return "stdlib", []
        parts = source.split("::")
        if parts[0] not in ("crate", "self", "super"):
            return "external", []
        # the folder that a module's children lie in: its own for main, lib and mod, else the one named after it
        stem = posixpath.basename(path).removesuffix(".rs")
        own = folder if stem in ("main", "lib", "mod") else _join(folder, stem)
        home = next((r for r in roots if posixpath.basename(r) == "src"), "src") if parts[0] == "crate" else own
        while parts and parts[0] in ("crate", "self", "super"):
            home = _join(home, "..") if parts[0] == "super" else home
            parts = parts[1:]
        stems = [_join(home, *parts[:i]) for i in range(len(parts), 0, -1)]  # the last names may be items of a module
        return "internal", (c for s in stems for c in (s + ".rs", _join(s, "mod.rs")))
    return "unknown", []


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (repo, path, language, source, ...) with category and resolved_path (a file or folder of the same repository's ``files`` (repo, path, content)).

    Candidate paths are exploded and met by an equi-join; the best hit has the lowest priority.  Java
    imports that no direct path answers are looked for in every module of the repository.  All sides grow
    with the files, so they are shuffled: by the sizes of compressed files, the planner would send whole tables
    through the driver.
    """
    imports = staged(imports, "imports")
    prefixes = F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    places = files.select("repo", "path", F.explode(prefixes).alias("target")).groupBy("repo", "target").agg(F.max(F.col("path") == F.col("target")).alias("is_file"))
    modules = files.where(F.col("path").rlike(r"(^|/)go\.mod$")).select("repo", F.regexp_replace("path", r"/?go\.mod$", "").alias("folder"), F.regexp_extract("content", r"(?m)^module\s+[\"'`]?([^\s\"'`]+)", 1).alias("module"))
    modules = modules.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("folder", "module"))).alias("go_modules"))

    @F.pandas_udf("array<string>")  # type: ignore[call-overload]
    def look(path: pd.Series, language: pd.Series, source: pd.Series, go: pd.Series) -> pd.Series:
        return pd.Series([list(candidates(p, x, s, dict(g) if g is not None else {})[1]) for p, x, s, g in zip(path, language, source, go, strict=True)], dtype=object)

    @F.pandas_udf("string")  # type: ignore[call-overload]
    def kind(path: pd.Series, language: pd.Series, source: pd.Series, go: pd.Series) -> pd.Series:
        return pd.Series([candidates(p, x, s, dict(g) if g is not None else {})[0] for p, x, s, g in zip(path, language, source, go, strict=True)], dtype=object)

    key = ["repo", "path", "language", "source"]
    distinct = imports.select(*key).distinct()
    dealt = modules.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    told = distinct.withColumn("part", F.pmod(F.hash("path", "source"), F.lit(PARTS))).join(dealt.hint("merge"), ["repo", "part"], "left")
    asked = told.select(*key, F.posexplode(look("path", "language", "source", "go_modules")).alias("priority", "target"))
    hit = asked.join(places.hint("shuffle_hash"), ["repo", "target"]).where(F.col("is_file") | F.col("language").isin("java", "go"))  # only these import folders
    near = hit.groupBy(*key).agg(F.min(F.struct("priority", "target")).alias("near"))
    best = told.select(*key, kind("path", "language", "source", "go_modules").alias("category")).join(near.hint("merge"), key, "left")
    # Java also looks through all modules, for a longer part of the name before any place with a shorter one
    tails = files.where(F.col("path").rlike(r"(^|/)src/(main|test)/java/.*\.java$")).select("repo", F.regexp_extract("path", r"src/(?:main|test)/java/(.*)\.java$", 1).alias("tail"), "path").groupBy("repo", "tail").agg(F.min("path").alias("file"))
    names = F.split("source", r"\.")
    stems = distinct.where("language = 'java'").select(*key, F.posexplode(F.transform(F.sequence(F.size(names), F.lit(1)), lambda i: F.array_join(F.slice(names, 1, i), "/"))).alias("step", "tail"))
    far = stems.join(tails.hint("merge"), ["repo", "tail"]).groupBy(*key).agg(F.min(F.struct("step", "file")).alias("far"))
    best = best.join(far.hint("merge"), key, "left")
    per_step = F.size(F.split("path", "/")) * (2 * len(JAVA_ROOTS))  # places tried for one part of the name
    sooner = F.col("far").isNotNull() & (F.col("category") != "stdlib") & (F.col("near").isNull() | (F.floor(F.col("near.priority") / per_step) > F.col("far.step")))
    resolved = F.when(sooner, F.col("far.file")).otherwise(F.col("near.target"))
    best = best.select(*key, resolved.alias("resolved_path"), F.when(resolved.isNotNull(), "internal").otherwise(F.col("category")).alias("category"))
    return imports.join(best.hint("merge"), key)


def edges(resolved: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imports with imported_file_id, log of internal imports that name no file); ``files`` (repo, path, file_id)."""
    ids = files.select("repo", F.col("path").alias("resolved_path"), F.col("file_id").alias("imported_file_id"))
    found = resolved.join(ids, ["repo", "resolved_path"], "left")
    missing = found.where((F.col("category") == "internal") & F.col("imported_file_id").isNull())
    return found, missing.select("repo", "path", F.concat(F.lit("unresolved import: "), "source").alias("log"))
