"""Chunks of source code: classes, methods, functions and what is global."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import count_tokens, split_definition

SCHEMA = "kind:string,name:string,comment:string,parent_class:string,parent_function:string,content:string,start_line:int,end_line:int"
Chunk = tuple[str, str | None, str | None, str | None, str | None, str, int, int]
#: Nested functions shorter than this stay inside their parent.
INLINE_LINES = 10
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|inline|extern|unsafe|default|synchronized|readonly)\s+)*"
_OPENERS = {
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|function|interface|type|enum)\s*\*?\s*([\w$]+)|^\s*(?:export\s+)?const\s+([\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>",
    "java": rf"^\s*{_MODIFIERS}(class|interface|enum|record)\s+(\w+)",
    "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?(\w+)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|impl|mod)\b(?:<[^>]*>)?\s*(?:[\w:<>]+\s+for\s+)?(\w+)",
    "c": r"^(?:typedef\s+)?(struct|enum|union|class|namespace)\s+(\w+)[^;=()]*$|^(?!\s|#|return\b|else\b)[\w:*&<>,~\s]*?[\s*&](\w[\w:~]*)\s*\([^;]*$",
}
_OPENERS |= {"typescript": _OPENERS["javascript"], "cpp": _OPENERS["c"], "kotlin": rf"^\s*{_MODIFIERS}(class|interface|enum|fun|object)\s+(\w+)", "php": rf"^\s*{_MODIFIERS}(class|interface|trait|enum|function)\s+(\w+)"}
_KINDS = {"func": "function", "fn": "function", "fun": "function", "record": "class", "impl": "class", "object": "class", "trait": "interface", "union": "struct", "mod": "namespace"}
#: Lines inside the braces of a class that open a method.
_METHODS = {
    "javascript": r"^\s*(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*[*#]?([\w$]+)\s*(?:<[^>]*>)?\([^;]*\)?[^;=]*\{\s*$|^\s*(?:(?:public|private|protected|static|readonly)\s+)*([\w$]+)\s*=\s*(?:async\s*)?\([^)]*\)[^=]*=>",
    "java": rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*{_MODIFIERS}(?:<[^>]*>\s*)?(?:[\w.<>\[\],?\s]+\s+)?(\w+)\s*\([^;]*$",
    "rust": _OPENERS["rust"],
}
_METHODS |= {"typescript": _METHODS["javascript"], "kotlin": r"^\s*(?:\w+\s+)*fun\s+(\w+)", "php": r"^\s*(?:\w+\s+)*function\s+(\w+)", "cpp": r"^\s*[\w:*&<>,~\s]*?(~?\w+)\s*\([^;]*$"}
_CONTROL = frozenset("if for while switch catch return else do try match loop foreach synchronized function".split())


def significant(name: Column, value: Column, keep_all: Column | bool = False) -> Column:
    """Global variables worth keeping: upper-case names, or literal or call values."""
    literal = value.rlike(r"""^\s*(["'\[{(\d-]|True|False|None|[\w.]+\()""")
    return F.lit(keep_all) | (F.upper(name) == name) & name.rlike("[A-Z]") | literal if isinstance(keep_all, bool) else keep_all | (F.upper(name) == name) | literal


def _comment(lines: list[str], start: int) -> str | None:
    """The block of comment lines right above."""
    a = start
    while a > 0 and lines[a - 1].strip().startswith(("#", "//", "*", "/*")) and not lines[a - 1].lstrip().startswith(("#include", "#define", "#pragma", "#[")):
        a -= 1
    return "\n".join(x.strip() for x in lines[a:start]) or None


def python_chunks(code: str) -> list[Chunk]:
    lines = code.split("\n")
    out: list[Chunk] = []
    rest: list[tuple[int, int]] = []

    def span(node: ast.stmt) -> tuple[int, int]:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1
        return first, (node.end_lineno or node.lineno) - 1

    def add(kind: str, name: str | None, node: ast.stmt, cls: str | None, fn: str | None, text: str | None = None) -> None:
        a, b = span(node)
        out.append((kind, name, ast.get_docstring(node) if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) else None or _comment(lines, a), cls, fn, text if text is not None else "\n".join(lines[a : b + 1]), a, b))

    def visit(body: list[ast.stmt], cls: str | None, fn: str | None) -> None:
        for node in body:
            a, b = span(node)
            if isinstance(node, ast.ClassDef):
                methods = [n.name for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
                add("class_summary", node.name, node, cls, fn, f"class {node.name}: " + ", ".join(methods))
                visit([n for n in node.body if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))], node.name, fn)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if fn is None or b - a + 1 >= INLINE_LINES:
                    add("method" if cls and fn is None else "function", node.name, node, cls, fn)
                    visit([n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], cls, node.name)
            elif cls is None and fn is None and not isinstance(node, (ast.Import, ast.ImportFrom)):
                rest.append((a, b))

    visit(ast.parse(code).body, None, None)
    if rest:
        out.insert(0, ("global", None, None, None, None, "\n".join("\n".join(lines[a : b + 1]) for a, b in rest), rest[0][0], rest[-1][1]))
    return out


_BLOCK_STRING = r'"""(?:\\.|(?!""").)*(?:"""|\Z)'
_QUOTED = r'"(?:\\.|[^"\\\n])*"?'
#: What may hide braces: comments and literals.  A single quote opens a character in some languages, a string in others, and a lifetime in Rust.
_HIDING = {
    "javascript": rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{_QUOTED}|'(?:\\.|[^'\\\n])*'?|`|/",
    "go": rf"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`?|{_QUOTED}|'(?:\\.|[^'\\\n])*'",
    "rust": rf"//[^\n]*|/\*.*?(?:\*/|\Z)|r(#+)\".*?\"\1|{_QUOTED}|'(?:\\[^\n]{{1,9}}?|[^'\\\n])'",
    "php": rf"//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z)|{_QUOTED}|'(?:\\.|[^'\\])*'?",
}
_HIDING_ELSE = rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{_BLOCK_STRING}|{_QUOTED}|'(?:\\.|[^'\\\n])*'?"
_REGEX_LITERAL = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: A slash after one of these begins a regular expression; after anything else it divides.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else))\s*\Z")


def bare_lines(code: str, language: str) -> list[str]:
    """The lines of ``code`` with its comments, strings, template and regular-expression literals blanked: braces that are left are the code's own."""
    script = language in ("javascript", "typescript")
    hiding = re.compile(rf"(?:{_HIDING.get('javascript' if script else language, _HIDING_ELSE)})|[{{}}]", re.S)
    out: list[str] = []
    blank = lambda text: re.sub(r"[^\n]", " ", text)
    open_: list[int] = []  # braces inside each ${ } of the templates around
    i = 0
    while m := hiding.search(code, i):
        before, found = code[i : m.start()], m[0]
        out.append(blank(before) if open_ else before)
        i = m.end()
        if found in "{}":
            if not open_:
                out.append(found)
                continue
            out.append(" ")
            open_[-1] += 1 if found == "{" else -1
            if open_[-1] < 0:  # the rest of the template
                open_.pop()
                i = _template(code, i, out, open_)
        elif script and found == "`":
            out.append(" ")
            i = _template(code, i, out, open_)
        elif script and found == "/":
            line = code[code.rfind("\n", 0, m.start()) + 1 : m.start()]
            literal = _REGEX_LITERAL.match(code, m.start()) if _BEFORE_REGEX.search(line) else None
            out.append(blank(literal[0]) if literal else found)
            i = literal.end() if literal else i
        else:
            out.append(blank(found))
    out.append(code[i:])
    return "".join(out).split("\n")


def _template(code: str, i: int, out: list[str], open_: list[int]) -> int:
    """Blank a template literal from ``i`` to its end, or to where an expression opens in it."""
    m = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*(`|\$\{|\Z)", re.S).match(code, i)
    end = m.end() if m else len(code)
    out.append(re.sub(r"[^\n]", " ", code[i:end]))
    if m and m[1] == "${":
        open_.append(0)
    return end


def _block_end(lines: list[str], i: int, stop: int, opener: str) -> int:
    """The last of the bare ``lines`` of the definition that opens at line ``i``: where its braces close, or where it ends without any."""
    depth, opened = 0, False
    for j in range(i, stop):
        bare = lines[j]
        depth += bare.count("{") - bare.count("}")
        opened = opened or "{" in bare
        if opened and depth <= 0 or not opened and bare.rstrip().endswith(";"):
            return j
        if not opened and (j > i and bare.rstrip().endswith(")") or j + 1 < stop and re.match(opener, lines[j + 1])):
            return j
    return stop - 1


def _methods(lines: list[str], bare: list[str], start: int, end: int, language: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of the methods between the braces of a class."""
    found: list[tuple[str, int, int]] = []
    pattern = _METHODS.get(language)
    i = next((k for k in range(start, end + 1) if "{" in bare[k]), end) + 1
    while pattern and i < end:
        m = re.match(pattern, lines[i]) if bare[i].strip() else None
        name = next((g for g in reversed(m.groups()) if g), None) if m else None
        if not name or name in _CONTROL:
            i += 1
            continue
        j = _block_end(bare, i, end, r"(?!)")
        if any("{" in x for x in bare[i : j + 1]):
            found.append((name, i, j))
            i = j
        i += 1
    return found


def brace_chunks(code: str, language: str) -> list[Chunk]:
    """Definitions of a language with braces, up to the brace that closes them; a class gives a summary and its methods; the rest is global."""
    lines, bare = code.split("\n"), bare_lines(code, language)
    out: list[Chunk] = []
    rest: list[int] = []
    i = 0
    while i < len(lines):
        m = re.match(_OPENERS[language], lines[i]) if bare[i].strip() else None
        word = (m[1] or "function") if m else ""
        name = next((g for g in m.groups()[1:] if g), None) if m else None
        if not m or name in _CONTROL:
            if lines[i].strip() and not re.match(r"\s*(//|/\*|\*|(import|package|from|use|using)\b|#include\b)", lines[i]):
                rest.append(i)
            i += 1
            continue
        j = _block_end(bare, i, len(lines), _OPENERS[language])
        kind = _KINDS.get(word, word)
        if language == "go" and word == "type":
            kind = "struct" if " struct" in lines[i] else "interface" if " interface" in lines[i] else "type"
        methods = _methods(lines, bare, i, j, language) if kind == "class" else []
        if methods:
            out.append(("class_summary", name, _comment(lines, i), None, None, f"class {name}: " + ", ".join(x for x, _, _ in methods), i, j))
            out += [("method", x, _comment(lines, a), name, None, "\n".join(lines[a : b + 1]), a, b) for x, a, b in methods]
        else:
            out.append((kind, name, _comment(lines, i), None, None, "\n".join(lines[i : j + 1]), i, j))
        i = j + 1
    if rest:
        out.insert(0, ("global", None, None, None, None, "\n".join(lines[k] for k in rest), rest[0], rest[-1]))
    return out


def _statements(text: str, language: str) -> list[tuple[int, int]]:
    """First and last line of each statement in the body of the definition ``text``."""
    lines = text.split("\n")
    if language == "python":
        inner = ast.parse("\n".join(x[len(lines[0]) - len(lines[0].lstrip()) :] if x.strip() else "" for x in lines)).body
        body = inner[0].body if len(inner) == 1 and hasattr(inner[0], "body") else inner
        first = lambda s: min([s.lineno, *(d.lineno for d in getattr(s, "decorator_list", []))]) - 1
        return [(first(s), (s.end_lineno or s.lineno) - 1) for s in body]
    out: list[tuple[int, int]] = []
    bare = bare_lines(text, language)
    i = next((k for k, x in enumerate(bare) if "{" in x), len(lines)) + 1
    while i < len(lines) - 1:
        if lines[i].strip():
            depth, j = 0, i
            while j < len(lines) - 1:
                depth += sum(bare[j].count(x) for x in "{([") - sum(bare[j].count(x) for x in "})]")
                if depth <= 0:
                    break
                j += 1
            out.append((i, min(j, len(lines) - 2)))
            i = out[-1][1]
        i += 1
    return out


def chunks_of(language: str | None, code: str | None, limit: int = 450) -> list[tuple[object, ...]]:
    """SCHEMA fields and part of every chunk of a file."""
    code = code or ""
    try:
        found = python_chunks(code) if language == "python" else brace_chunks(code, language) if language in _OPENERS else []
    except (SyntaxError, ValueError, RecursionError):
        found = []
    found = found or [("text", None, None, None, None, code, 0, code.count("\n"))]
    rows: list[tuple[object, ...]] = []
    for kind, name, comment, cls, fn, text, a, b in found:
        body: list[tuple[int, int]] = []
        if kind in ("function", "method") and count_tokens(text) > limit:
            try:
                body = _statements(text, language or "")
            except (SyntaxError, ValueError, RecursionError):
                body = []
        parts = split_definition(text, body, limit)
        whole = len(parts) == 1
        rows += [(kind, name if whole or not name else f"{name} (part {i + 1})", comment, cls, fn, p, a if whole or not body else a + x, b if whole or not body else a + y, i) for i, (p, x, y) in enumerate(parts)]
    return rows


def code_chunks(files: DataFrame, limit: int = 450, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys..., SCHEMA, part) for ``files`` (keys..., language, content): definitions, cut to ``limit`` tokens between statements (name (part n)).

    Files that don't parse, or have no definition, come as one chunk of kind text.
    """

    @F.udf(f"array<struct<{SCHEMA},part:int>>", useArrow=True)
    def chunks(language: str | None, content: str | None) -> list[tuple[object, ...]]:
        return chunks_of(language, content, limit)

    return files.select(*keys, F.inline(chunks("language", "content")))


def global_variables(files: DataFrame, keys: tuple[str, ...] = ("path",), keep_all: bool = False) -> DataFrame:
    """(keys..., name, value) of the assignments in the first column of ``files`` (keys..., content) that are significant()."""
    lines = files.select(*keys, F.explode(F.split("content", "\n")).alias("line"))
    pattern = r"^(?:(?:export|const|let|var|final|static|public)\s+)*([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=(?!=)\s*(.+)$"
    found = lines.where(F.col("line").rlike(pattern)).select(*keys, F.regexp_extract("line", pattern, 1).alias("name"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))
    return found.where(significant(F.col("name"), F.col("value"), keep_all))
