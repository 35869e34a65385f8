"""Import resolution: the first of an import's candidate paths that is a known file.

Candidates are an array expression; they are exploded with their order, joined with the files on the
path, and the first that exists is kept.  Imports without one are external and resolve to null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analyze import normalize_path, parent
from lodestone.operators.imports import JS
from lodestone.runtime import by_rows

#: Orders in which names are tried.
JS_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
PHP_ROOTS = ("", "src/", "app/", "lib/")
RUST_MODULE_FILES = ("mod.rs", "main.rs", "lib.rs")


def _join(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _up(folder: Column, times: Column) -> Column:
    """The folder that many levels up; null above the root."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.when(times <= F.size(parts), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - times), "/"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _rust(spec: Column, source: Column, crate_root: str) -> Column:
    folder, name = parent(source), F.element_at(F.split(source, "/"), -1)
    supers = (F.length(F.regexp_extract(spec, r"^((?:super::)*)", 1)) / 7).cast("int")
    up = F.when(name.isin(*RUST_MODULE_FILES), supers).otherwise(supers - 1)
    base = (
        F.when(F.startswith(spec, F.lit("crate::")), F.lit(crate_root)).when(F.startswith(spec, F.lit("self::")), folder)
        .when(F.startswith(spec, F.lit("super::")), _up(folder, up))
    )
    rest = F.split(F.regexp_replace(spec, r"^(?:crate::|self::|(?:super::)+)", ""), "::")

    def of(length: Column) -> Column:
        path, last = _join(base, F.array_join(F.slice(rest, F.lit(1), length), "/")), F.get(rest, length - 1)
        return F.when((last == "*") | F.startswith(last, F.lit("{")), _none()).otherwise(F.array(F.concat(path, F.lit(".rs")), F.concat(path, F.lit("/mod.rs"))))

    return F.when(base.isNotNull(), F.flatten(F.transform(F.sequence(F.size(rest), F.lit(1), F.lit(-1)), of))).otherwise(_none())


def _js(spec: Column, source: Column) -> Column:
    path = normalize_path(_join(parent(source), spec))
    return F.when(F.startswith(spec, F.lit(".")), F.array(*(F.concat(path, F.lit(e)) for e in JS_ENDINGS))).otherwise(_none())


def _python(spec: Column, source: Column) -> Column:
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(spec, r"^\.*", ""), F.lit("."), F.lit("/"))
    base = _up(parent(source), dots - 1)
    inner = _join(base, rest)
    relative = (
        F.when(base.isNull(), _none()).when(rest == "", F.array(_join(base, F.lit("__init__.py"))))
        .otherwise(F.array(F.concat(inner, F.lit(".py")), F.concat(inner, F.lit("/__init__.py"))))
    )
    absolute = F.array(F.concat(rest, F.lit(".py")), F.concat(rest, F.lit("/__init__.py")), F.concat(F.lit("src/"), rest, F.lit(".py")))
    return F.when(dots > 0, relative).otherwise(absolute)


def _go(spec: Column) -> Column:
    """Folders, longest first; they are joined with folders that hold Go files."""
    parts = F.split(spec, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("go:"), F.array_join(F.slice(parts, k, F.size(parts)), "/")))


def _php(spec: Column, source: Column) -> Column:
    file = F.array(F.when(F.startswith(spec, F.lit(".")), normalize_path(_join(parent(source), spec))).otherwise(spec))
    parts = F.split(F.replace(spec, F.lit("\\"), F.lit("/")), "/")
    whole, tail = F.array_join(parts, "/"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/")
    named = F.array(*(F.concat(F.lit(root), p, F.lit(".php")) for root in PHP_ROOTS for p in (whole, F.when(F.size(parts) > 1, tail).otherwise(whole))))
    return F.when(F.endswith(spec, F.lit(".php")), file).otherwise(named)


def candidates(extension: Column, spec: Column, source: Column, crate_root: str = "src") -> Column:
    return (
        F.when(extension == "rs", _rust(spec, source, crate_root)).when(extension.isin(*JS), _js(spec, source))
        .when(extension == "py", _python(spec, source)).when(extension == "go", _go(spec)).when(extension == "php", _php(spec, source)).otherwise(_none())
    )


def known_targets(files: DataFrame) -> DataFrame:
    """(candidate, target): every file under its path, and every Go folder under its first file."""
    paths = files.select(F.col("relative_path").alias("candidate"), F.col("relative_path").alias("target")).distinct()
    go = files.where(F.endswith("relative_path", F.lit(".go")) & F.contains("relative_path", F.lit("/"))).groupBy(F.concat(F.lit("go:"), parent(F.col("relative_path"))).alias("candidate"))
    return paths.unionByName(go.agg(F.min("relative_path").alias("target")))


def tried_paths(imports: DataFrame, crate_root: str = "src") -> DataFrame:
    """(candidate, relative_path): whatever each file's imports would resolve to if it were there."""
    each = F.explode(candidates(F.col("extension"), F.col("specifier"), F.col("relative_path"), crate_root))
    return imports.select(each.alias("candidate"), "relative_path").distinct()


def woken_importers(tries: DataFrame, changes: DataFrame) -> DataFrame:
    """Files (relative_path) whose imports may resolve otherwise after ``changes`` (relative_path, change): those that
    try a path that came or went.  What a file holds does not matter to its importers."""
    moved = changes.where("change in ('added', 'deleted')").select("relative_path")
    folder = F.when(F.endswith("relative_path", F.lit(".go")) & F.contains("relative_path", F.lit("/")), F.concat(F.lit("go:"), parent(F.col("relative_path"))))
    names = moved.select(F.explode(F.array_compact(F.array(F.col("relative_path"), folder))).alias("candidate")).distinct()
    return tries.join(by_rows(names), "candidate", "left_semi").select("relative_path").distinct()


def resolve_imports(imports: DataFrame, files: DataFrame, crate_root: str = "src") -> DataFrame:
    """``imports`` with ``target``, null for external ones.  Size decides the join: files are shuffled if large."""
    return resolve_among(imports, known_targets(files), crate_root)


def resolve_among(imports: DataFrame, known: DataFrame, crate_root: str = "src") -> DataFrame:
    """``imports`` with ``target``, from the (candidate, target) rows that are known."""
    keys = ["relative_path", "extension", "specifier"]
    asked = imports.select(*keys).distinct()
    tried = asked.select(*keys, F.posexplode(candidates(F.col("extension"), F.col("specifier"), F.col("relative_path"), crate_root)).alias("turn", "candidate"))
    first = tried.join(known, "candidate").groupBy(*keys).agg(F.min_by("target", "turn").alias("target"))
    return imports.join(first, keys, "left")


def edges(files: DataFrame, imports: DataFrame, crate_root: str = "src") -> DataFrame:
    """Distinct (src, dst) between different files."""
    return edges_to(known_targets(files), imports, crate_root)


def edges_to(known: DataFrame, imports: DataFrame, crate_root: str = "src") -> DataFrame:
    """Distinct (src, dst) between different files, from the (candidate, target) rows that are known."""
    resolved = resolve_among(imports, known, crate_root)
    return resolved.where(F.col("target").isNotNull() & (F.col("target") != F.col("relative_path"))).select(F.col("relative_path").alias("src"), F.col("target").alias("dst")).distinct()
