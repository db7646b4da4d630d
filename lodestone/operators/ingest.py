"""Corpus ingestion: classify files, find what changed, keep snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .access import upsert

IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "ico", "tiff")
DOCUMENTS = ("pdf", "docx", "pptx", "odt", "rtf", "doc", "ppt")
DATA = ("csv", "tsv", "xls", "xlsx", "xlsm", "ods", "parquet")
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "swift": "swift", "dart": "dart", "lua": "lua", "r": "r", "pl": "perl", "hs": "haskell", "ex": "elixir", "exs": "elixir", "sh": "bash", "bash": "bash", "ps1": "powershell", "sql": "sql", "css": "css", "scss": "scss", "html": "html", "vue": "vue", "mjs": "javascript", "cjs": "javascript", "pyi": "python"}
TEXTS = ("md", "txt", "rst", "json", "yaml", "yml", "toml", "xml", "ini", "cfg", "ipynb", "mod")
# Folders and lock files that hold nothing written by hand.
IGNORED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", ".target", "build")
IGNORED_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "deno.lock", "uv.lock", "poetry.lock", "Pipfile.lock", "pdm.lock", "go.sum",
    "gradle.lockfile", "pom.xml.tag", "Cargo.lock", "Gemfile.lock", "composer.lock", "mix.lock",
)
IGNORED_EXTENSIONS = ("lock", "lockfile")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def wanted(path: Column) -> Column:
    """False for files in ignored folders and for lock files."""
    lock = file_name(path).isin(*IGNORED_NAMES) | extension(path).isin(*IGNORED_EXTENSIONS)
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_FOLDERS))) & ~lock


def language(ext: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


# First bytes of formats, in hexadecimal, and names of files that say a language without an extension.
IMAGE_MAGIC = ("89504E47", "FFD8FF", "47494638", "00000100", "49492A00", "4D4D002A")
DOCUMENT_MAGIC = ("25504446", "7B5C727466", "D0CF11E0A1B11AE1")
DATA_MAGIC = ("50415231",)
BYTE_ORDER_MARKS = ("EFBBBF", "FFFE", "FEFF")
NAMES = {
    "dockerfile": "docker", "containerfile": "docker", "makefile": "make", "gnumakefile": "make", "cmakelists.txt": "cmake", "gemfile": "ruby", "rakefile": "ruby", "vagrantfile": "ruby", "podfile": "ruby", "jenkinsfile": "groovy",
    "build.bazel": "python", "workspace": "python", "sconstruct": "python", ".bashrc": "bash", ".bash_profile": "bash", ".profile": "bash", ".zshrc": "bash",
}
SHEBANGS = {"python": "python", "bash": "bash", "sh": "bash", "zsh": "bash", "node": "javascript", "deno": "typescript", "ruby": "ruby", "perl": "perl", "php": "php", "lua": "lua", "Rscript": "r"}


def language_of(path: Column, content: Column | None = None) -> Column:
    """language() of a file by its extension, else by its name, else by the interpreter that its first line of ``content`` (bytes) names."""
    one_of = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    found = F.coalesce(language(extension(path)), one_of(NAMES, F.lower(file_name(path))), F.when(F.lower(file_name(path)).startswith("dockerfile."), "docker"))
    if content is None:
        return found
    first = F.regexp_extract(F.substring(content, 1, 128).cast("string"), r"^#![ \t]*\S*?/(?:env[ \t]+(?:-S[ \t]+)?)?([A-Za-z]+)[0-9.]*(?:\s|$)", 1)
    return F.coalesce(found, one_of(SHEBANGS, first))


def category(ext: Column, content: Column | None = None) -> Column:
    """image, document, data, code, text or binary, in that precedence; the bytes of ``content`` decide where the extension doesn't.

    A zip archive is what the names of its first members say; text may begin with a byte order mark, and is an image if it is SVG.
    """
    found = F.when(ext.isin(*IMAGES), "image").when(ext.isin(*DOCUMENTS), "document").when(ext.isin(*DATA), "data").when(ext.isin(*LANGUAGES), "code").when(ext.isin(*TEXTS), "text")
    if content is None:
        return found.otherwise("binary")
    head = F.hex(F.substring(content, 1, 1024))
    begins = lambda *marks: reduce(lambda a, b: a | b, [head.startswith(m) for m in marks])
    members = F.when(begins("504B0304"), F.decode(F.substring(content, 1, 4096), "ISO-8859-1"))
    shown = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    svg = shown.rlike(r"(?is)^(?:\xEF\xBB\xBF)?\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*(?:<!DOCTYPE\s+svg[^>]*>\s*)?<svg[\s>]")
    found = found.when(begins(*IMAGE_MAGIC) | (begins("52494646") & (F.substring(head, 17, 8) == "57454250")) | svg, "image").when(begins(*DOCUMENT_MAGIC), "document").when(begins(*DATA_MAGIC), "data")
    found = found.when(members.rlike(r"word/|ppt/|opendocument\.(?:text|presentation)"), "document").when(members.rlike(r"xl/|opendocument\.spreadsheet"), "data")
    return found.when(begins(*BYTE_ORDER_MARKS), "text").when(head.rlike("^(?:..)*?00"), "binary").otherwise("text")


def meaningful_image(width: Column, height: Column) -> Column:
    """At least 120 on each side, 25000 in area, and no longer than 5 times its breadth."""
    return (width >= 120) & (height >= 120) & (width * height >= 25_000) & (F.greatest(width, height) <= 5 * F.least(width, height))


def with_hash(files: DataFrame, content: str = "content", to: str = "file_hash") -> DataFrame:
    return files.withColumn(to, F.sha2(F.coalesce(F.col(content), F.lit("")), 256))


def changes(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str = "file_hash") -> DataFrame:
    """(keys..., status): new, changed, same or deleted, by key and hash."""
    a = old.select(*keys, F.col(hash_col).alias("_old"))
    b = new.select(*keys, F.col(hash_col).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def ingest(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str = "file_hash") -> tuple[DataFrame, DataFrame]:
    """(changed files, next snapshot): only the first need parsing again, and files that went leave the second."""
    status = changes(old, new, keys, hash_col)
    changed = new.join(status.where(F.col("status").isin("new", "changed")).select(*keys), keys, "left_semi")
    kept = old.join(status.where("status = 'deleted'").select(*keys), keys, "left_anti")
    return changed, upsert(kept, changed, keys)
