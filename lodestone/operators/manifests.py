"""Dependency manifests as rows (name, version, type, language)."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

Row = tuple[str, str, str]
_OPERATOR = re.compile(r"===|==|>=|<=|~=|=~|!=|<|>|=")


def split_requirement(text: str) -> tuple[str, str]:
    m = _OPERATOR.search(text)
    return (text[: m.start()].strip(), text[m.start() :].strip()) if m else (text.strip(), "*")


def requirement_type(path: str) -> str:
    name = path.rpartition("/")[2].lower() + " " + path.rpartition("/")[0].rpartition("/")[2].lower()
    return next((kind for kind in ("dev", "test", "docs") if kind in name), "prod")


def package_json(text: str) -> list[Row]:
    """Five sections; bundled names have no version of their own."""
    data = json.loads(text)
    kinds = {"dependencies": "prod", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional", "bundledDependencies": "bundled"}
    out: list[Row] = []
    for section, kind in kinds.items():
        found = data.get(section) or {}
        out += [(n, str(v), kind) for n, v in found.items()] if isinstance(found, dict) else [(n, "*", kind) for n in found]
    return out


def pyproject(text: str) -> list[Row]:
    """PEP 621 with extras, dependency groups, and Poetry's tables (its python entry is no dependency)."""
    data = tomllib.loads(text)
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    out = [(*split_requirement(d), "prod") for d in project.get("dependencies", [])]
    out += [(*split_requirement(d), f"optional:{g}") for g, ds in project.get("optional-dependencies", {}).items() for d in ds]
    out += [(*split_requirement(d), f"group:{g}") for g, ds in data.get("dependency-groups", {}).items() for d in ds if isinstance(d, str)]
    tables = [(poetry.get("dependencies", {}), "prod"), (poetry.get("dev-dependencies", {}), "dev"), *((g.get("dependencies", {}), f"group:{n}") for n, g in poetry.get("group", {}).items())]
    version = lambda v: v if isinstance(v, str) else str(v.get("version", "*")) if isinstance(v, dict) else "*"
    return out + [(n, version(v), kind) for t, kind in tables for n, v in t.items() if n.lower() != "python"]


def requirements_txt(text: str, path: str = "requirements.txt") -> list[Row]:
    lines = (re.split(r"\s#|;", x, maxsplit=1)[0].strip() for x in text.splitlines() if not x.strip().startswith(("#", "-")))
    return [(*split_requirement(x), requirement_type(path)) for x in lines if x]


def environment_yml(text: str) -> list[Row]:
    """The dependencies list of a conda environment, and the pip list inside it."""
    out: list[Row] = []
    inside, pip_depth = False, -1
    for line in text.splitlines():
        depth, body = len(line) - len(line.lstrip()), line.strip()
        if not body or body.startswith("#"):
            continue
        if not body.startswith("-"):
            if depth == 0:
                inside, pip_depth = body.startswith("dependencies:"), -1
            continue
        if not inside:
            continue
        item = body[1:].split(" #")[0].strip().strip("'\"")
        if item == "pip:":
            pip_depth = depth
        elif pip_depth >= 0 and depth > pip_depth:
            out.append((*split_requirement(item), "pip"))
        else:
            pip_depth = -1
            out.append((*split_requirement(item), "conda"))
    return out


def pom_xml(text: str) -> list[Row]:
    """Maven: properties are filled in until nothing changes; scope defaults to compile, version to managed."""
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    get = lambda e, name: (e.findtext(name) or "").strip()
    values = {e.tag: (e.text or "").strip() for e in root.findall("properties/*")}
    parent = root.find("parent")
    for name in ("groupId", "artifactId", "version"):
        own = get(root, name) or (get(parent, name) if parent is not None else "")
        values |= {f"project.{name}": own, name: own}

    def fill(s: str, open_: frozenset[str] = frozenset()) -> str:
        """``s`` with its properties filled in, and theirs; what is unknown, or defined by itself, stays as it is written."""
        put = lambda m: fill(values[m[1]], open_ | {m[1]}) if m[1] in values and m[1] not in open_ else m[0]
        return re.sub(r"\$\{([^}]+)\}", put, s)

    rows = lambda at, kind: [(f"{fill(get(d, 'groupId'))}:{fill(get(d, 'artifactId'))}", fill(get(d, "version")) or "managed", kind or get(d, "scope") or "compile") for d in root.findall(at)]
    return rows("dependencies/dependency", "") + rows("dependencyManagement/dependencies/dependency", "management")


def go_mod(text: str) -> list[Row]:
    out: list[Row] = []
    inside = False
    for raw in text.splitlines():
        line = raw.strip()
        if line.startswith("require ("):
            inside = True
        elif line == ")":
            inside = False
        elif inside or line.startswith("require "):
            parts = line.removeprefix("require ").split("//")
            words = parts[0].split()
            if len(words) >= 2:
                out.append((words[0], words[1], "indirect" if len(parts) > 1 and "indirect" in parts[1] else "direct"))
    return out


def pipfile(text: str) -> list[Row]:
    """Two tables; a version is a text or the version of a table."""
    data = tomllib.loads(text)
    version = lambda v: v if isinstance(v, str) else str(v.get("version", "*")) if isinstance(v, dict) else "*"
    return [(n, version(v), kind) for table, kind in (("packages", "prod"), ("dev-packages", "dev")) for n, v in data.get(table, {}).items()]


def deno_json(text: str) -> list[Row]:
    """Imports of packages: npm:name@version and jsr:@scope/name@version; other addresses have no version."""
    out: list[Row] = []
    for name, target in json.loads(text).get("imports", {}).items():
        m = re.match(r"(?:npm|jsr):/?(@?[^@]+)(?:@([^/]+))?", target)
        out.append((m[1], m[2] or "*", "prod") if m else (name, target, "url"))
    return out


def gradle_build(text: str) -> list[Row]:
    """Configurations followed by group:name:version, with variables that the file defines filled in."""
    values = dict(re.findall(r"""(?m)^\s*(?:def\s+|val\s+|ext\.|set\(["'])?([\w.]+)["']?\s*[=,]\s*["']([^"'$]+)["']""", text))
    fill = lambda s: re.sub(r"\$\{?([\w.]+)\}?", lambda m: values.get(m[1], m[0]), s)
    kinds = {"testImplementation": "test", "testRuntimeOnly": "test", "androidTestImplementation": "test", "compileOnly": "compile", "annotationProcessor": "compile", "kapt": "compile", "runtimeOnly": "runtime"}
    found = re.findall(r"""(?m)^\s*(api|implementation|\w+Implementation|compile|compileOnly|runtimeOnly|testRuntimeOnly|annotationProcessor|kapt)\s*\(?\s*(?:platform\()?["']([^"':]+):([^"':]+)(?::([^"']+))?["']""", text)
    return [(f"{fill(g)}:{fill(n)}", fill(v) or "managed", kinds.get(c, "prod")) for c, g, n, v in found]


def version_catalog(text: str) -> list[Row]:
    """Gradle's libs.versions.toml: libraries as text or table, with versions by reference."""
    data = tomllib.loads(text)
    out: list[Row] = []
    for lib in data.get("libraries", {}).values():
        if isinstance(lib, str):
            group, name, version = (lib.split(":") + ["managed"])[:3]
        else:
            group, _, name = lib["module"].partition(":") if "module" in lib else (lib.get("group", ""), "", lib.get("name", ""))
            v = lib.get("version", "managed")
            version = v if isinstance(v, str) else str(data.get("versions", {}).get(v.get("ref"), "managed"))
        out.append((f"{group}:{name}", version, "prod"))
    return out


def route(path: str) -> tuple[str, Callable[[str], list[Row]]] | None:
    """Language and parser for a manifest's path; None for other files."""
    name = path.rpartition("/")[2]
    if re.search(r"requirement[^/]*\.(txt|in)$", name) or re.search(r"requirements?/[^/]+\.txt$", path):
        return "python", lambda s: requirements_txt(s, path)
    return {"package.json": ("javascript", package_json), "pyproject.toml": ("python", pyproject), "environment.yml": ("python", environment_yml), "environment.yaml": ("python", environment_yml), "pom.xml": ("java", pom_xml), "go.mod": ("go", go_mod),
            "Pipfile": ("python", pipfile), "deno.json": ("javascript", deno_json), "build.gradle": ("java", gradle_build), "build.gradle.kts": ("java", gradle_build), "libs.versions.toml": ("java", version_catalog)}.get(name)


def _without(data: dict[str, Any], *names: str) -> dict[str, Any]:
    return {k: v for k, v in data.items() if k not in names}


def package_details(text: str) -> dict[str, Any]:
    return _without(json.loads(text), "dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "bundledDependencies")


def pyproject_details(text: str) -> dict[str, Any]:
    """What isn't a list of dependencies; of Poetry's, the python version stays."""
    data = _without(tomllib.loads(text), "dependency-groups")
    if "project" in data:
        data["project"] = _without(data["project"], "dependencies", "optional-dependencies")
    if poetry := data.get("tool", {}).get("poetry"):
        python = poetry.get("dependencies", {}).get("python")
        kept = _without(poetry, "dependencies", "dev-dependencies", "group") | ({"python": python} if python is not None else {})
        data["tool"] = data["tool"] | {"poetry": kept}
    return data


def environment_details(text: str) -> dict[str, Any]:
    """Top-level entries but the dependencies: a text, or a list of texts."""
    out: dict[str, Any] = {}
    name = ""
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if not line[0].isspace() and not body.startswith("-"):
            name, _, value = (x.strip() for x in body.partition(":"))
            out[name] = value.strip("'\"") or []
        elif body.startswith("-") and isinstance(out.get(name), list):
            out[name].append(body[1:].strip().strip("'\""))
    return _without(out, "dependencies")


def pom_details(text: str) -> dict[str, Any]:
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    texts = lambda at: {e.tag: (e.text or "").strip() for e in root.findall(at) if not len(e)}
    parent, values = texts("parent/*"), texts("properties/*")
    own = {k: v for k, v in texts("*").items() if v}
    own = {k: parent[k] for k in ("groupId", "version") if k in parent} | own
    return own | ({"properties": values} if values else {}) | ({"parent": parent} if parent else {})


def go_details(text: str) -> dict[str, Any]:
    names = {"module": "name", "go": "goVersion", "toolchain": "toolchain"}
    found = (re.match(r"(module|go|toolchain)\s+([^\s/]\S*)", line.strip()) for line in text.splitlines())
    return {names[m[1]]: m[2] for m in found if m}


DETAILS: dict[Callable[[str], list[Row]], Callable[[str], dict[str, Any]]] = {package_json: package_details, pyproject: pyproject_details, environment_yml: environment_details, pom_xml: pom_details, go_mod: go_details}


def dependencies_of(path: str, content: str | None) -> list[tuple[str, str, str, str]]:
    """(name, version, type, language) of a manifest; none for other files and those that don't parse."""
    if content is None or not (found := route(path)):
        return []
    try:
        return [(*r, found[0]) for r in found[1](content)]
    except (ValueError, ET.ParseError, AttributeError):
        return []


def details_of(path: str, content: str | None) -> str | None:
    """What else a manifest says, as JSON; null for other files and those that don't parse."""
    if content is None or not (found := route(path)):
        return None
    try:
        return json.dumps(DETAILS.get(found[1], lambda _: {})(content), sort_keys=True, default=str)
    except (ValueError, ET.ParseError, AttributeError):
        return None


def dependencies(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys..., name, version, type, language) of the manifests among ``files`` (keys..., path, content); files that don't parse give none."""
    rows = F.udf(dependencies_of, "array<struct<name:string,version:string,type:string,language:string>>", useArrow=True)
    return files.where(is_manifest(F.col("path"))).select(*keys, F.inline(rows("path", "content")))


def manifest_details(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys..., details): one row for each manifest among ``files`` (keys..., path, content) that parses, with all but its dependencies as JSON."""
    found = F.udf(details_of, "string", useArrow=True)
    return files.where(is_manifest(F.col("path"))).select(*keys, found("path", "content").alias("details")).where(F.col("details").isNotNull())


def is_manifest(path: Column) -> Column:
    """Files that route() may take, by name, so that no other content reaches Python."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return name.isin("package.json", "pyproject.toml", "environment.yml", "environment.yaml", "pom.xml", "go.mod", "Pipfile", "deno.json", "build.gradle", "build.gradle.kts", "libs.versions.toml") | path.rlike(r"requirement[^/]*\.(txt|in)$|requirements?/[^/]+\.txt$")


def requirement_lines(files: DataFrame) -> DataFrame:
    """(path, name, version) of requirements files without leaving the JVM, for corpora with very many of them."""
    line = F.trim(F.regexp_replace("line", r"(\s#|;).*$", ""))
    rows = files.select("path", F.explode(F.split("content", r"\r?\n")).alias("line")).where(~F.trim("line").rlike("^[#-]")).select("path", line.alias("line")).where("line <> ''")
    return rows.select("path", X.requirement(F.col("line")).alias("r")).select("path", "r.name", "r.version")


def go_requirements(files: DataFrame) -> DataFrame:
    """(path, name, version, type) of go.mod files by windows over their lines: inside a block, the last block line opened it."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    edge = F.when(F.col("line").startswith("require ("), True).when(F.col("line") == ")", False)
    inside = F.last(edge, True).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    entry = r"^(?:require\s+)?(\S+)\s+(v\S+)"
    rows = lines.withColumn("inside", F.coalesce(inside, F.lit(False))).where((F.col("inside") | F.col("line").rlike(r"^require\s+[^(]")) & F.col("line").rlike(entry))
    kind = F.when(F.col("line").rlike("//.*indirect"), "indirect").otherwise("direct")
    return rows.select("path", F.regexp_extract("line", entry, 1).alias("name"), F.regexp_extract("line", entry, 2).alias("version"), kind.alias("type"))
