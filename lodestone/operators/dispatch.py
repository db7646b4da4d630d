"""From the files of repositories to chunks that are ready to be embedded: every category goes its own way, and all come together again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions import text as X
from ..sources import files as sources
from . import chunking, code, markdown

#: What every way returns, after the keys.
CHUNK = ("chunk_no", "kind", "name", "chunk", "start_line", "end_line", "meta", "embedding_text")
MARKDOWN = ("md", "markdown", "mdx", "rst")


def _shown(chunks: DataFrame, keys: list[str], order: list[str], embedding_text: Column, **columns: Column) -> DataFrame:
    kinds = {"kind": "string", "name": "string", "chunk": "string", "start_line": "int", "end_line": "int", "meta": "string"}
    shown = [columns.get(c, F.col(c) if c in chunks.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    return chunks.select(*keys, F.array(*[F.col(c).cast("long") for c in order]).alias("place"), *shown, embedding_text.alias("embedding_text"))


def code_way(files: DataFrame, keys: list[str], limit: int = 450, meta: str | None = None) -> DataFrame:
    """Definitions of source files (keys..., path, language, content)."""
    more = [meta, "meta_order"] if meta else []
    given = list(dict.fromkeys([*keys, "path", *more]))
    found = code.code_chunks(files.withColumn("_language", F.col("language")), limit, tuple([*given, "_language"])).where(F.trim("content") != "")
    c = F.col
    text = E.code_text(c("path"), c("_language"), c("content"), kind=c("kind"), name=c("name"), comment=c("comment"), parent_class=c("parent_class"), parent_function=c("parent_function"), meta=c(meta) if meta else None)
    order = [*(["meta_order"] if meta else []), "start_line", "part"]
    return _shown(found, keys, order, text, chunk=c("content"), **({"meta": c(meta)} if meta else {}))


def markdown_way(files: DataFrame, keys: list[str], meta: str | None = None, **limits: int) -> DataFrame:
    """Sections of markdown (keys..., path, language, content), merged up to a token budget that counts what their embedding texts say before the content."""
    by = list(dict.fromkeys([*keys, "path", "language", *([meta, "meta_order"] if meta else [])]))
    c = F.col
    context = lambda **more: E.markdown_context(c("path"), c("language"), headings=c("headings"), is_image=c("is_image"), is_table=c("is_table"), is_code=c("is_code"), meta=c(meta) if meta else None, **more)
    found = markdown.sections(files, by)
    found = found.withColumn("context_tokens", X.token_count(E.markdown_text(F.lit("x"), context())) - 1)
    chunks = chunking.section_chunks(found, by, "ord", **limits)
    alts = F.when(c("is_image"), F.transform(X.markdown_images(c("chunk")), lambda x: x["alt"]))
    covered = F.create_map(F.lit("h1"), c("h1"), F.lit("h2"), c("h2"))
    text = E.markdown_text(c("chunk"), context(sections=covered, alts=alts, fragment=c("fragment")))
    kind = F.when(c("is_image"), "image").when(c("is_table"), "table").otherwise("markdown")
    order = [*(["meta_order"] if meta else []), "chunk_no"]
    return _shown(chunks, keys, order, text, kind=kind, **({"meta": c(meta)} if meta else {}))


def notebook_way(files: DataFrame, keys: list[str], **limits: int) -> DataFrame:
    """Notebooks (keys..., path, content): markdown cells as markdown and code cells as Python, each with its cell's id, place and count as meta."""
    by = tuple(dict.fromkeys([*keys, "path"]))
    cells = sources.notebook_cells(files, by).where(F.col("source") != "").withColumn("meta_order", F.col("cell_index"))
    ids = [F.col("id").alias("cell_id"), "cell_index"]
    text = cells.where("cell_type = 'markdown'").select(*by, "meta_order", F.lit("markdown").alias("language"), F.to_json(F.struct(*ids)).alias("meta"), F.col("source").alias("content"))
    program = cells.where("cell_type = 'code'").select(*by, "meta_order", F.lit("python").alias("language"), F.to_json(F.struct(*ids, "execution_count")).alias("meta"), F.col("source").alias("content"))
    both = [markdown_way(text, keys, "meta", **limits), code_way(program, keys, limits.get("most", 450), "meta")]
    return both[0].unionByName(both[1])


def text_way(files: DataFrame, keys: list[str], target: int = 300, overlap: int = 50) -> DataFrame:
    """Any other text (keys..., path, language, content): words up to ``target`` tokens, with an overlap."""
    given = list(dict.fromkeys([*keys, "path", "language"]))
    rows = files.select(F.struct(*given).alias("_file"), "content")
    chunks = chunking.token_chunks(rows, "_file", "content", target, overlap).select("_file.*", "chunk_no", "chunk")
    return _shown(chunks, keys, ["chunk_no"], E.general_text(F.col("path"), F.col("language"), F.col("chunk"), name=X.file_name(F.col("path"))), kind=F.lit("text"))


def chunk_files(files: DataFrame, keys: list[str], *, documents: Callable[[bytes], str] | None = None, limit: int = 450, **limits: int) -> DataFrame:
    """(keys..., CHUNK) of the chunks of ``files`` (keys..., path, ext, category, language, content binary), whose ``keys`` are unique.

    Code is cut into definitions, markdown and office documents into merged sections, notebooks cell by
    cell, JSON and other text into words; images, data tables and binary files give no chunks.  documents: makes
    markdown of a pdf file's bytes.  chunk_no counts a file's chunks from 0 in the order of the file.
    """
    c = F.col
    files = files.withColumn("_text", F.when(c("category").isin("code", "text"), X.decode(c("content"))))
    by = list(dict.fromkeys([*keys, "path", "language"]))
    as_text = lambda rows: rows.select(*by, c("_text").alias("content"))
    notebook, marked = c("ext") == "ipynb", c("ext").isin(*MARKDOWN)
    text = files.where(c("category") == "text")
    office = files.where(c("category") == "document").select(F.struct(*by).alias("_file"), "path", "content")
    ways = [
        code_way(as_text(files.where(c("category") == "code")), keys, limit),
        markdown_way(as_text(text.where(marked)).withColumn("language", F.lit("markdown")), keys, **limits),
        notebook_way(as_text(text.where(notebook)), keys, **limits),
        text_way(as_text(text.where(~notebook & ~marked & (c("ext") != "json"))), keys),
        text_way(as_text(text.where(c("ext") == "json")), keys, target=450),
    ]
    made = sources.office_documents(office, documents, carry=("_file",), show_charts=True).where(c("markdown").isNotNull())
    ways.append(markdown_way(made.select("_file.*", c("markdown").alias("content")), keys, **limits))
    numbered = [w.withColumn("chunk_no", F.row_number().over(Window.partitionBy(*keys).orderBy("place")) - 1).drop("place") for w in ways]
    return reduce(DataFrame.unionByName, numbered).select(*keys, *CHUNK)
