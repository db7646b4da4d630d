"""The texts that are embedded for chunks, as Column expressions; what is null leaves no gap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _labelled(label: str, value: Column | None) -> list[Column]:
    return [] if value is None else [F.concat(F.lit(label), value.cast("string"))]


def _source(path: Column, language: Column) -> Column:
    return F.concat(F.lit("File: "), path, F.lit(" | Language: "), F.coalesce(language, F.lit("")))


def code_text(
    path: Column, language: Column, content: Column, *, kind: Column | None = None, name: Column | None = None, comment: Column | None = None,
    parent_class: Column | None = None, parent_function: Column | None = None, meta: Column | None = None,
) -> Column:
    """Where a piece of code stands, what it is called, then its comment and its lines."""
    code = F.concat_ws("\n", *[c for c in (comment, content) if c is not None])
    return F.concat_ws(
        " | ", _source(path, language), *_labelled("Kind: ", kind), *_labelled("Name: ", name), *_labelled("Parent class: ", parent_class), *_labelled("Parent function: ", parent_function),
        *_labelled("Meta Information: ", meta), F.when(code != "", F.concat(F.lit("Code: "), code)),
    )


def general_text(path: Column, language: Column, content: Column, *, name: Column | None = None, file_type: Column | None = None) -> Column:
    return F.concat_ws(" | ", _source(path, language), *_labelled("Name: ", name), *_labelled("File Type: ", file_type), F.concat(F.lit("Content: \n"), F.coalesce(content, F.lit(""))))


def _block(title: str, lines: Column) -> Column:
    """A titled list; null without lines."""
    full = F.filter(lines, lambda x: F.trim(x) != "")
    return F.when(F.size(full) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(full, "\n")))


def markdown_context(
    path: Column, language: Column, *, headings: Column, is_image: Column, is_table: Column, is_code: Column, sections: Column | None = None,
    alts: Column | None = None, fragment: Column | None = None, meta: Column | None = None,
) -> Column:
    """All of markdown_text() but the content.  headings: map of level to title; sections: map of h1 and h2 to their titles."""
    types = F.concat_ws(", ", F.when(is_image, "image"), F.when(is_table, "table"), F.when(is_code, "code"))
    levels = F.transform(F.array_sort(F.map_entries(headings)), lambda x: F.concat(F.lit("H"), x["key"].cast("string"), F.lit(": "), F.trim(x["value"])))
    parts = [
        F.concat(F.lit("File: "), path), F.concat(F.lit("Language: "), F.coalesce(language, F.lit(""))), *_labelled("Meta Information: ", meta),
        F.concat(F.lit("Content type: "), F.when(types == "", "text").otherwise(types)), _block("Section context", levels),
    ]
    if sections is not None:
        covered = F.flatten(F.transform(F.array_sort(F.map_keys(sections)), lambda k: F.transform(F.element_at(sections, k), lambda s: F.concat(F.upper(k), F.lit(": "), F.trim(s)))))
        parts.append(_block("Sections covered", covered))
    if alts is not None:
        parts.append(_block("Image descriptions", alts))
    if fragment is not None:
        parts.append(F.concat(F.lit("Content fragment: "), fragment.cast("string")))
    return F.concat_ws("\n\n", *parts)


def markdown_text(content: Column, context: Column) -> Column:
    """A chunk of markdown behind its context."""
    return F.concat_ws("\n\n", context, F.when(F.trim(content) != "", F.concat(F.lit("Content:\n"), F.trim(content))))
