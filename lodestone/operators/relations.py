"""What files of a repository have to do with each other: which import which, where the names come from, and what can be reached.

All of it is joins within repositories.  A name is looked for where it was imported from, then wherever that file has it
from, and so on, in each place once; a closure grows from its last steps.  Both end when a round brings nothing new, cycles included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def file_edges(resolved: DataFrame) -> DataFrame:
    """(repo, path, target, is_external, symbols) of the imports that resolve_imports() returns: one edge for two files, with the distinct names in order, or * for the whole.

    The target of what isn't in the repository is its source as written.
    """
    names = F.when(F.col("is_wildcard") | (F.size("symbols") == 0), F.array(F.lit("*"))).otherwise(F.transform("symbols", lambda s: s["name"]))
    rows = resolved.select("repo", "path", F.coalesce("resolved_path", "source").alias("target"), F.col("resolved_path").isNull().alias("is_external"), F.explode(names).alias("name"))
    return rows.groupBy("repo", "path", "target", "is_external").agg(F.array_sort(F.collect_set("name")).alias("symbols"))


def given_names(resolved: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """(repo, path, outer, target, inner): names that a file hands on from another.

    In Python all that a module imports is its own; in JavaScript what it exports from elsewhere: ``exports`` (repo, path, name, kind,
    source, resolved_path).  * stands for all names.
    """
    python = resolved.where((F.col("language") == "python") & F.col("resolved_path").isNotNull())
    named = python.select("repo", "path", F.explode("symbols").alias("s"), "resolved_path").select("repo", "path", F.coalesce("s.alias", "s.name").alias("outer"), F.col("resolved_path").alias("target"), F.col("s.name").alias("inner"))
    stars = python.where("is_wildcard").select("repo", "path", F.lit("*").alias("outer"), F.col("resolved_path").alias("target"), F.lit("*").alias("inner"))
    found = named.unionByName(stars)
    if exports is not None:
        found = found.unionByName(exports.where("source is not null and resolved_path is not null").select("repo", "path", F.col("name").alias("outer"), F.col("resolved_path").alias("target"), F.col("name").alias("inner")))
    return found.distinct()


def symbol_edges(resolved: DataFrame, defined: DataFrame, given: DataFrame) -> DataFrame:
    """(repo, path, name, local, target, kind, hops): where each imported name is defined, by the fewest files it is handed on through; of several such files the first by path.

    defined: (repo, path, name, kind) of definitions.  Names that nothing in the repository defines have no row.
    """
    asked = resolved.where("resolved_path is not null").select("repo", "path", "resolved_path", F.explode("symbols").alias("s"))
    place = ["repo", "at", "looked"]
    asked = staged(asked.select("repo", "path", F.col("s.name").alias("name"), F.coalesce("s.alias", "s.name").alias("local"), F.col("resolved_path").alias("at"), F.col("s.name").alias("looked")).distinct(), "symbols-asked")
    own = defined.select("repo", F.col("path").alias("at"), F.col("name").alias("looked"), "kind").groupBy(*place).agg(F.min("kind").alias("kind"))
    onward = given.select("repo", F.col("path").alias("at"), "outer", F.col("target").alias("next"), "inner")
    # the places where a name is looked for, each once however many files ask there, and the steps between them
    here = staged(asked.select(*place).distinct(), "symbols-places")
    seen, found, steps = here, None, None
    while True:
        hit = here.join(own, place).select(*place, F.struct(F.col("at").alias("target"), "kind").alias("t"), F.lit(0).alias("hops"))
        more = here.join(own, place, "left_anti").join(onward, ["repo", "at"]).where((F.col("outer") == F.col("looked")) | (F.col("outer") == "*"))
        more = staged(more.select(*place, "next", F.when(F.col("inner") == "*", F.col("looked")).otherwise(F.col("inner")).alias("then")).distinct(), "symbols-steps")
        found, steps = (hit, more) if found is None else (found.unionByName(hit), steps.unionByName(more))
        here = staged(more.select("repo", F.col("next").alias("at"), F.col("then").alias("looked")).distinct().join(seen, place, "left_anti"), "symbols-places")
        if here.isEmpty():
            break
        seen = seen.unionByName(here)
    # answers go back over the steps, the nearest first; who has one asks no more
    last = found = staged(found, "symbols-found")
    hops = 0
    while not last.isEmpty():
        hops += 1
        steps = staged(steps.join(last, place, "left_anti"), "symbols-steps") if hops > 1 else steps
        after = last.select("repo", F.col("at").alias("next"), F.col("looked").alias("then"), "t")
        step = steps.join(after, ["repo", "next", "then"]).groupBy(*place).agg(F.min("t").alias("t")).withColumn("hops", F.lit(hops))
        last = staged(step, "symbols-found")
        found = found.unionByName(last)
    return asked.join(found, place).select("repo", "path", "name", "local", "t.target", "t.kind", "hops")


def reachable(edges: DataFrame, source: str = "path", target: str = "target", by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """(by..., source, target, distance): all that can be reached over ``edges`` (by..., source, target), with the fewest steps; a node on a cycle reaches itself.

    What is just so many steps away as are known goes on, over all that is known where that is in proportion to it, and so
    twice as far in a round; else over single edges.
    """
    last = staged(edges.select(*by, F.col(source).alias("_from"), F.col(target).alias("_to")).distinct().withColumn("distance", F.lit(1)), "edges")
    edge = all_ = last
    known, n = 1, None
    while True:
        n = all_.count() if n is None else n
        ways = last.groupBy(*by, "_to").agg(F.count("*").alias("a")).join(all_.groupBy(*by, F.col("_from").alias("_to")).agg(F.count("*").alias("b")), [*by, "_to"])
        far = known if known == 1 or (ways.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) <= 4 * n else 1
        onward = (all_ if far == known else edge).select(*by, F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("distance").alias("_more"))
        step = last.join(onward, [*by, "_to"]).groupBy(*by, "_from", F.col("_next").alias("_to")).agg((F.min("_more") + known).cast("int").alias("distance"))
        new = staged(step.join(all_, [*by, "_from", "_to"], "left_anti"), "reached")
        if not (more := new.count()):
            return all_.select(*by, F.col("_from").alias(source), F.col("_to").alias(target), "distance")
        known, n, all_ = known + far, n + more, all_.unionByName(new)
        last = new.where(F.col("distance") == known)
