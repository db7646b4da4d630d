"""Readers: repositories, notebooks, tables, office files; and pluggable models."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest


def repository(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, path, ext, size, content, category, language) of a folder's files, without ignored folders and lock files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.sub(r"^\w+:/*", "/", path.rstrip("/"))
    rows = rows.select(F.lit(repo).alias("repo"), F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(root) + "/", "").alias("path"), F.col("length").alias("size"), "content")
    rows = rows.where(ingest.wanted(F.col("path"))).withColumn("ext", ingest.extension(F.col("path")))
    return rows.withColumn("category", ingest.category(F.col("ext"), F.col("content"))).withColumn("language", ingest.language(F.col("ext")))


def notebook_cells(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys..., cell_index, cell_type, id, execution_count, source, outputs) of notebooks in ``files`` (keys..., content string).

    source may be a text or a list of lines; outputs is a cell's JSON list of them, null where it has none.
    """
    kind = "struct<cells:array<struct<cell_type:string,id:string,execution_count:int,source:string,outputs:string>>>"
    cells = files.select(*keys, F.posexplode(F.from_json("content", kind)["cells"]).alias("cell_index", "cell"))
    lines = F.from_json("cell.source", "array<string>")
    source = F.when(F.col("cell.source").startswith("["), F.coalesce(F.array_join(lines, ""), F.col("cell.source"))).otherwise(F.col("cell.source"))
    return cells.select(*keys, "cell_index", "cell.cell_type", "cell.id", "cell.execution_count", source.alias("source"), "cell.outputs")


def golden_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries (query_id, query, ground_truth_answer), relevant (query_id, id)) of a JSON array of {query, relevant_embed_ids, ground_truth_answer}; query_id is the place in the array, from 0."""
    kind = "array<struct<query:string,relevant_embed_ids:array<string>,ground_truth_answer:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("query_id", "item"))
    return rows.select("query_id", "item.query", "item.ground_truth_answer"), rows.select("query_id", F.explode("item.relevant_embed_ids").alias("id"))


def table_preview(spark: SparkSession, path: str, rows: int = 6) -> tuple[DataFrame, dict[str, str], bool]:
    """(first rows, column types, whether that is all) of a csv or tsv file."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep="\t" if path.lower().endswith(".tsv") else ",")
    head = df.limit(rows)
    return head, dict(df.dtypes), head.count() < rows


def _sheet(data: bytes) -> list[list[str | None]]:
    """Cells of the first sheet of an OOXML or ODF spreadsheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        tag = lambda e: e.tag.rpartition("}")[2]
        if "content.xml" in names:
            sheet = next(e for e in ET.fromstring(z.read("content.xml")).iter() if tag(e) == "table")
            repeat = lambda c: next((int(v) for k, v in c.attrib.items() if k.endswith("number-columns-repeated")), 1)
            rows = [[("".join(c.itertext()) or None) for c in r if tag(c) == "table-cell" for _ in range(min(repeat(c), 1000))] for r in sheet.iter() if tag(r) == "table-row"]
            return [r for r in rows if any(r)]
        shared = [("".join(t.text or "" for t in s.iter() if tag(t) == "t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        out = []
        for r in (e for e in ET.fromstring(z.read(min(n for n in names if n.startswith("xl/worksheets/sheet")))).iter() if tag(e) == "row"):
            cells: dict[int, str | None] = {}
            for c in r:
                col = 0
                for ch in re.match("[A-Z]*", c.get("r", "A"))[0]:
                    col = col * 26 + ord(ch) - 64
                text = "".join(t.text or "" for t in c.iter() if tag(t) in ("v", "t"))
                cells[col - 1] = shared[int(text)] if c.get("t") == "s" else text or None
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def spreadsheet_rows(files: DataFrame) -> DataFrame:
    """(path, row_no, values map<string,string>) of the first sheet of each spreadsheet in ``files`` (path, content binary); row 0 holds the names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    head, *body = _sheet(bytes(data)) or [[]]
                except (zipfile.BadZipFile, KeyError, ValueError, StopIteration, ET.ParseError):
                    continue
                rows += [(path, i, {str(k): v for k, v in zip(head, r, strict=False) if k is not None}) for i, r in enumerate(body)]
            yield pd.DataFrame(rows, columns=["path", "row_no", "values"])

    return files.select("path", "content").mapInPandas(run, "path string, row_no int, values map<string,string>")


def _office(data: bytes) -> tuple[str, list[str], list[tuple[str, str, str, float]]]:
    """Markdown, embedded images and charts (chart, series, category, value) of a docx, pptx or odt file."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        number = lambda n: int((re.findall(r"\d+", n) or ["0"])[-1])
        bodies = [n for n in ("word/document.xml", "content.xml") if n in names] or sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        out: list[str] = []
        for n in bodies:
            root = ET.fromstring(z.read(n))
            inside = {id(p) for t in root.iter() if tag(t) in ("tbl", "table") for p in t.iter() if p is not t}
            for e in root.iter():
                if tag(e) in ("tbl", "table") and id(e) not in inside:
                    rows = [["".join(x for x in c.itertext()).strip() for c in r if tag(c) in ("tc", "table-cell")] for r in e.iter() if tag(r) in ("tr", "table-row")]
                    if rows and rows[0]:
                        lines = ["| " + " | ".join(r) + " |" for r in rows]
                        out.append("\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]]))
                elif tag(e) in ("p", "h") and id(e) not in inside:
                    text = "".join(t.text or "" for t in e.iter() if tag(t) == "t") or ("".join(e.itertext()) if n == "content.xml" else "")
                    style = next((v for s in e.iter() if tag(s) == "pStyle" for v in s.attrib.values()), "")
                    level = next((int(v) for k, v in e.attrib.items() if k.endswith("outline-level")), 0) or (int(m[1]) if (m := re.match(r"Heading(\d)", style)) else 0)
                    if text.strip():
                        out.append("#" * level + " " * bool(level) + text.strip())
        images = sorted(n for n in names if n.startswith(("word/media/", "ppt/media/", "Pictures/")))
        charts: list[tuple[str, str, str, float]] = []
        for n in (n for n in names if re.search(r"charts/chart\d*\.xml$", n)):
            for s in (e for e in ET.fromstring(z.read(n)).iter() if tag(e) == "ser"):
                part = lambda k: [v.text or "" for c in s if tag(c) == k for v in c.iter() if tag(v) == "v"]  # noqa: B023, E731
                name = (part("tx") or [""])[0]
                charts += [(n, name, c, float(v)) for c, v in zip(part("cat"), part("val"), strict=False)]
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(out)), images, charts


def office_documents(files: DataFrame, pdf_to_markdown: Callable[[bytes], str] | None = None, carry: tuple[str, ...] = (), show_charts: bool = False) -> DataFrame:
    """(carry..., path, markdown, images, charts) of ``files`` (carry..., path, content binary); pdf files need the callable, without which they give null.

    show_charts: charts follow the text as markdown tables.  Files that can't be read give null and no images.
    """

    @F.udf("struct<markdown:string,images:array<string>,charts:array<struct<chart:string,series:string,category:string,value:double>>>", useArrow=True)
    def read(path: str, data: bytes | None) -> tuple[str | None, list[str], list[tuple[str, str, str, float]]]:
        try:
            if data is None:
                return None, [], []
            if path.lower().endswith(".pdf"):
                return pdf_to_markdown(bytes(data)) if pdf_to_markdown else None, [], []
            if path.lower().endswith(".rtf"):
                return rtf_text(bytes(data)), [], []
            text, images, charts = _office(bytes(data))
            return "\n\n".join(filter(None, [text, *(chart_tables(charts) if show_charts else [])])), images, charts
        except (zipfile.BadZipFile, KeyError, ET.ParseError):
            return None, [], []

    return files.select(*carry, "path", read("path", "content").alias("_d")).select(*carry, "path", "_d.*")


def chart_tables(charts: list[tuple[str, str, str, float]]) -> list[str]:
    """A markdown table for each chart: a row for each category, a column for each series."""
    out = []
    for name in dict.fromkeys(c[0] for c in charts):
        cells = {(cat, s): v for n, s, cat, v in charts if n == name}
        series, cats = list(dict.fromkeys(s for _, s in cells)), list(dict.fromkeys(c for c, _ in cells))
        show = lambda v: "" if v is None else f"{v:g}"
        rows = [["Category", *series], *[[c, *[show(cells.get((c, s))) for s in series]] for c in cats]]
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        out.append("\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]]))
    return out


def rtf_text(data: bytes) -> str:
    """The text of an rtf file: control words and groups without text go, paragraphs stay."""
    text = data.decode("latin-1")
    text = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\par[d]?\b ?|\\line\b ?", "\n", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\([{}\\])|\\[a-zA-Z]+-?\d* ?|[{}]|\r?\n(?=\\)", lambda m: m[1] or "", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def embedded_images(files: DataFrame) -> DataFrame:
    """(path, member, content) of the pictures inside the office files of ``files`` (path, content binary)."""

    @F.udf("array<struct<member:string,content:binary>>", useArrow=True)
    def members(data: bytes | None) -> list[tuple[str, bytes]]:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as z:
                return [(n, z.read(n)) for n in sorted(z.namelist()) if n.startswith(("word/media/", "ppt/media/", "Pictures/"))]
        except zipfile.BadZipFile:
            return []

    return files.select("path", F.inline(members("content")))


def _hashes(text: str) -> list[int]:
    """A number for each word; letters are lower-cased one by one, as SQL does: none becomes two, or another at the end of a word."""
    return [int(hashlib.md5(w.encode("utf-8", "replace")).hexdigest()[:8], 16) for w in re.findall(r"[^ \t\n\r\f]+", text.replace("İ", "i").replace("Σ", "σ").lower())]


def _of_length_1(v: list[float]) -> list[float]:
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def signed_embedder(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Signed hashed words, scaled to length 1; zeros where there are no words or all signs cancel out.  Deterministic and offline."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for h in _hashes(t):
            v[(h >> 1) % dim] += 1.0 if h & 1 else -1.0
        out.append(_of_length_1(v))
    return out


def hashing_embedder(texts: list[str], dim: int = 64) -> list[list[float]]:
    """The default embedder: signed_embedder(); where all signs cancel out, the words are counted without."""
    out = signed_embedder(texts, dim)
    for i, v in enumerate(out):
        if not any(v):
            for h in _hashes(texts[i]):
                v[(h >> 1) % dim] += 1.0
            out[i] = _of_length_1(v)
    return out


def embed(df: DataFrame, text: str = "text", to: str = "embedding", embedder: Callable[[list[str]], list[list[float]]] = hashing_embedder, batch: int = 32) -> DataFrame:
    """``df`` with the embedding of ``text``; ``embedder`` gets ``batch`` texts at a time and must return as many vectors."""

    @F.pandas_udf("array<float>")  # type: ignore[call-overload]
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        items = texts.fillna("").tolist()
        for i in range(0, len(items), batch):
            got = embedder(items[i : i + batch])
            if len(got) != len(items[i : i + batch]):
                raise ValueError("the embedder returned another number of vectors than texts")
            out += got
        return pd.Series(out)

    return df.withColumn(to, run(text))
