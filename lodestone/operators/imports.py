"""Imports in source files: (relative_path, extension, specifier, kind, pos) rows.

Order and duplicates follow each language's rules: JavaScript, Go and PHP list a specifier once, as first
met; Rust and Python list every statement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rowlocal import blank_rust_source

JS = ("ts", "tsx", "js", "jsx", "mjs")

#: The import statements of each language, and the kind of import each makes.
RUST_USE = r"(?mdU)^\s*use\s+((?:crate|super|self|[a-zA-Z_]\w*)(?:::\w+)*(?:::\{[^}]+\}|::\*)?)"
JS_PATTERNS = (
    (r"""(?msdU)^\s*import\s+.*?from\s+["']([^"']+)["']""", "from"),
    (r"""(?mdU)^\s*import\s+["']([^"']+)["']""", "from"),
    (r"""(?U)require\s*\(\s*["']([^"']+)["']\s*\)""", "require"),
    (r"""(?mdU)^\s*export\s+.*?\s+from\s+["']([^"']+)["']""", "from"),
    (r"""(?U)import\s*\(\s*["']([^"']+)["']\s*\)""", "require"),
)
PY_PATTERNS = ((r"(?mdU)^\s*import\s+([\w.]+)", "use"), (r"(?mdU)^\s*from\s+(\.{0,3}[\w.]*)[\s]+import", "from"))
GO_BLOCK, GO_QUOTED = r"(?msd)import\s*\((.*?)\)", r'(?U)(?:\w+\s+)?"([^"]+)"'
GO_SINGLE = r'(?mdU)^\s*import\s+(?:\w+\s+)?"([^"]+)"'
PHP_PATTERNS = (
    (r"(?mdU)^\s*use\s+([\w\\]+)", "use"),
    (r"""(?mdU)(?:require|require_once|include|include_once)\s*[\(]?\s*["']([^"']+)["']""", "require"),
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _found(specifiers: Column, kind: str) -> Column:
    return F.transform(specifiers, lambda s: F.struct(s.alias("specifier"), F.lit(kind).alias("kind")))


def _once(found: Column) -> Column:
    """The first of each specifier, in order."""
    return F.filter(found, lambda x, k: F.array_position(F.transform(found, lambda y: y["specifier"]), x["specifier"]) == k + 1)


def _rust(content: Column) -> Column:
    """``use`` paths of blanked source; groups in braces are written out."""

    def expand(spec: Column) -> Column:
        prefix = F.substring_index(spec, "::{", 1)
        inner = F.regexp_replace(F.substring(spec, F.length(prefix) + 4, F.length(spec)), r"\}+$", "")
        items = F.transform(F.split(inner, ","), lambda x: F.trim(F.element_at(F.split(F.trim(x, F.lit(" \t\r\n")), " as ", 2), 1), F.lit(" \t\r\n")))
        kept = F.filter(items, lambda x: ~x.isin("", "*"))
        named = F.transform(kept, lambda x: F.when(x == "self", prefix).otherwise(F.concat(prefix, F.lit("::"), x)))
        return F.when(F.contains(spec, F.lit("::{")), named).otherwise(F.array(spec))

    return _found(F.flatten(F.transform(_all(content, RUST_USE), expand)), "use")


def _go(content: Column) -> Column:
    blocks = F.flatten(F.transform(_all(content, GO_BLOCK), lambda b: _all(b, GO_QUOTED)))
    return _once(_found(F.concat(blocks, _all(content, GO_SINGLE)), "use"))


def _patterns(content: Column, patterns: tuple) -> Column:
    return reduce(lambda a, b: F.concat(a, b), [_found(_all(content, p), kind) for p, kind in patterns])


def extract_imports(files: DataFrame, content: str = "content", extension: str = "extension") -> DataFrame:
    """All imports of all files; other extensions have none.  Only Rust files pass through Python."""
    c, e = F.coalesce(F.col(content), F.lit("")), F.col(extension)
    rust = files.where(e == "rs").withColumn("__found", _rust(blank_rust_source(c)))
    found = (
        F.when(e.isin(*JS), _once(_patterns(c, JS_PATTERNS))).when(e == "py", _patterns(c, PY_PATTERNS))
        .when(e == "go", _go(c)).when(e == "php", _once(_patterns(c, PHP_PATTERNS)))
    )
    other = files.where(e.isin(*JS, "py", "go", "php")).withColumn("__found", found)
    rows = rust.unionByName(other).select("relative_path", e.alias("extension"), F.posexplode("__found").alias("pos", "f"))
    return rows.select("relative_path", "extension", "f.specifier", "f.kind", "pos")
