"""Scalar text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda x: x != "")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


# The usual English stop words of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: (pattern, replacement) in order: plurals, then -ed and -ing after a vowel, then a final y or e.  A light stemmer, the same in any SQL.
STEMS = (("sses$", "ss"), ("ies$", "i"), ("([^s])s$", "$1"), ("([aeiouy].*)(?:ed|ing)$", "$1"), ("y$", "i"), ("([a-z]{2})e$", "$1"))


def stem(term: Column) -> Column:
    """The stem of a lower-cased English term of four letters or more."""
    out = term
    for pattern, to in STEMS:
        out = F.regexp_replace(out, pattern, to)
    return F.when(F.length(term) > 3, out).otherwise(term)


def english(text: Column) -> Column:
    """terms() without stop words, as stems."""
    return F.transform(F.filter(terms(text), lambda x: ~x.isin(*STOP_WORDS)), stem)


def token_count(text: Column) -> Column:
    """Default token estimate: runs of letters, runs of digits, and single other marks.  Additive over words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\w+")), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct three-letter grams of each term, padded by two spaces before and one after.  Repeated terms are looked at once."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3)))
    padded = F.transform(F.array_distinct(terms(text)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, grams)))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two distinct arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return overlap(trigrams(a), trigrams(b))


def overlap_with(grams: Column, wanted: list[str]) -> Column:
    """overlap() of a distinct array and a list of distinct texts that is known when the plan is made."""
    both = F.size(F.array_intersect(grams, F.array(*map(F.lit, wanted)).cast("array<string>")))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(grams) + len(wanted) - both).cast("double")), F.lit(0.0))


def clean(text: Column) -> Column:
    """Without NUL characters, and with no more than one blank line in a row."""
    return F.regexp_replace(F.translate(text, "\0", ""), "\n{3,}", "\n\n")


def repair_headings(markdown: Column) -> Column:
    """List marks before a heading go, as do headings without a title."""
    return F.regexp_replace(F.regexp_replace(markdown, r"(?m)^[ \t]*[-*+][ \t]+(?=#{1,6}[ \t])", ""), r"(?m)^#{1,6}[ \t]*$\n?", "")


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#+)", 1))


def markdown_images(text: Column) -> Column:
    """array<struct<alt, url>> of ![alt](url)."""
    pattern = F.lit(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("alt"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("url"))


def html_images(text: Column) -> Column:
    """array<struct<src, alt>> of img tags that have both attributes, in any order."""
    tags = F.regexp_extract_all(text, F.lit(r"(?is)(<img\b(?=[^>]*\bsrc\s*=)(?=[^>]*\balt\s*=)[^>]*>)"), F.lit(1))
    attribute = lambda t, name: F.regexp_extract(t, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    return F.transform(tags, lambda t: F.struct(attribute(t, "src").alias("src"), attribute(t, "alt").alias("alt")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def duration_seconds(text: Column) -> Column:
    """Seconds in texts like 1h12m4.2s; 0 where nothing matches."""
    pattern = F.lit(r"([\d.]+)(h|m|s)")
    factor = lambda u: F.when(u == "h", 3600.0).when(u == "m", 60.0).otherwise(1.0)
    parts = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda n, u: F.coalesce(n.try_cast("double"), F.lit(0.0)) * factor(u))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def requirement(text: Column) -> Column:
    """struct<name, version> split before the first comparison operator; version * if there is none."""
    pattern = r"(?s)^(.*?)(===|==|>=|<=|~=|=~|!=|<|>|=)(.*)$"
    found = text.rlike(pattern)
    version = F.trim(F.concat(F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3)))
    return F.struct(F.when(found, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(F.trim(text)).alias("name"), F.when(found, version).otherwise("*").alias("version"))


def import_alias(item: Column) -> Column:
    """struct<name, alias> of ``name as alias``; alias is null without one."""
    return F.struct(
        F.trim(F.regexp_extract(item, r"^\s*(.*?)(?:\s+as\s+\S+)?\s*$", 1)).alias("name"),
        F.nullif(F.regexp_extract(item, r"\s+as\s+(\S+)\s*$", 1), F.lit("")).alias("alias"),
    )


def retry_after(reset_ms: Column, now_ms: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil((reset_ms - now_ms) / 1000.0)).cast("long")


def seconds_to_midnight(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """Seconds from the instant ``ts`` (timestamp) to the next midnight in ``zone``, to two places."""
    local = F.from_utc_timestamp(ts, zone)
    midnight = F.to_utc_timestamp(F.date_add(F.to_date(local), 1).cast("timestamp"), zone)
    return F.round((F.unix_micros(midnight) - F.unix_micros(ts)) / 1e6, 2)


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def is_email(text: Column) -> Column:
    """One @ between a local part without dots at its ends or in a row, and a domain of two labels or more."""
    return F.coalesce(text.rlike(r"(?i)^(?!\.)(?!.*\.\.)[a-z0-9_'+\-.]*[a-z0-9_+\-]@(?:[a-z0-9][a-z0-9\-]*\.)+[a-z]{2,}$"), F.lit(False))


def is_new_password(text: Column) -> Column:
    """At least 8 characters, with an upper-case and a lower-case letter, a digit and another character."""
    return F.coalesce((F.length(text) >= 8) & text.rlike("[A-Z]") & text.rlike("[a-z]") & text.rlike("[0-9]") & text.rlike("[^A-Za-z0-9]"), F.lit(False))


def repo_of(url: Column) -> Column:
    """struct<owner, name> of a repository's address."""
    path = F.split(F.regexp_replace(F.parse_url(url, F.lit("PATH")), r"^/|/$", ""), "/")
    return F.struct(path[0].alias("owner"), F.regexp_replace(path[1], r"\.git$", "").alias("name"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def decode(content: Column) -> Column:
    """Bytes as UTF-8, without NUL characters; what isn't valid is replaced."""
    return F.translate(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.make_valid_utf8(content.cast("string"))), "\0", "")


def replace_image_sources(text: Column, mapping: Column) -> Column:
    """Markdown with the addresses of its images replaced by those that ``mapping`` (map<string,string>) has for them."""
    urls = F.array_distinct(F.transform(markdown_images(text), lambda x: x["url"]))
    known = F.filter(urls, lambda u: F.map_contains_key(mapping, u))
    return F.aggregate(known, text, lambda t, u: F.replace(t, F.concat(F.lit("]("), u), F.concat(F.lit("]("), F.element_at(mapping, u))))


def token_cost(texts: Column) -> Column:
    """Tokens of an array of texts, null ones at no cost."""
    return F.aggregate(F.transform(texts, token_count), F.lit(0), lambda s, n: s + n)


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def title(text: Column, length: int = 150) -> Column:
    """Trimmed and cut; null if nothing is left."""
    return F.nullif(F.substring(F.trim(text), 1, length), F.lit(""))


def embedding_text(*parts: Column, sep: str = " | ") -> Column:
    """Whole parts joined as they are; null and blank ones leave no gap."""
    return F.concat_ws(sep, *[F.when(F.trim(p) != "", p) for p in parts])
