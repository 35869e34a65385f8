"""Analyzers and other scalar functions, as column expressions.

All stay in the JVM.  Patterns use Java's Unicode classes; ``(?d)`` makes line anchors match line feeds only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that fold to ASCII, and the ligatures that fold to two letters.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyy"
FOLD_PAIRS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))

#: Tokens of this many bytes or more are not indexed.
LONG_TOKEN_BYTES = 40

#: What a line that defines something begins with.
BLOCK_STARTERS = (
    "fn ", "pub fn ", "pub(crate) fn ", "async fn ", "pub async fn ",
    "struct ", "pub struct ", "enum ", "pub enum ",
    "impl ", "trait ", "pub trait ",
    "class ", "export class ", "export default class ",
    "function ", "export function ", "export default function ", "async function ",
    "const ", "let ", "export const ", "export let ",
    "def ", "async def ",
    "func ",
)
STARTERS_PATTERN = "(?:" + "|".join(s.replace("(", "\\(").replace(")", "\\)") for s in BLOCK_STARTERS) + ")"

#: Field boosts (symbols, basename, content) by kind of query.
BOOSTS = {"symbol": (12.0, 4.0, 1.0), "path": (4.0, 9.0, 1.0), "general": (8.0, 6.0, 1.0)}

#: Extensions of documents; all other files are code.
DOC_EXTENSIONS = ("md", "txt", "rst", "org")


def simple_tokens(text: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))


def fold(text: Column) -> Column:
    out = F.translate(text, FOLD_FROM, FOLD_TO)
    for letter, pair in FOLD_PAIRS:
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def content_tokens(text: Column) -> Column:
    """Analyzer of contents: runs shorter than 40 bytes, lower case, folded to ASCII."""
    short = F.filter(simple_tokens(text), lambda t: F.octet_length(t) < LONG_TOKEN_BYTES)
    plain = lambda t: F.octet_length(t) == F.char_length(t)  # noqa: E731  # ASCII has nothing to fold
    return F.transform(short, lambda t: F.when(plain(t), F.lower(t)).otherwise(fold(F.lower(t))))


def path_tokens(text: Column) -> Column:
    """Analyzer of path names: runs in lower case, of any length."""
    return F.transform(simple_tokens(text), F.lower)


def identifier_parts(text: Column) -> Column:
    """Split at separators, where lower case meets upper, and where letters meet digits; case is kept."""
    borders = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{IsAlphabetic})(?=\p{N})|(?<=\p{N})(?=\p{IsAlphabetic})"
    parts = F.split(F.regexp_replace(text, borders, " "), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(parts, lambda p: p != "")


def identifier_tokens(text: Column) -> Column:
    """Analyzer of symbols."""
    return F.transform(identifier_parts(text), F.lower)


def ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams in lower case; none for shorter texts."""
    low = F.lower(text)
    return F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda k: F.substring(low, k, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line feed ends the last line and begins none."""
    body = F.regexp_replace(text, r"\n\z", "")
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(lines)


def skip_generics(text: Column) -> Column:
    """A text that begins with ``<`` without its balanced ``<...>``, nested to any depth; any other text as it is."""
    chars = F.split(text, "")
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(chars, state, step)["end"]
    return F.when(F.startswith(text, F.lit("<")), F.substring(text, end + 1, F.length(text))).otherwise(text)


def symbols(content: Column) -> Column:
    """Names after a definition's first words: sorted, distinct, of 2 bytes or more, joined by spaces.

    One balanced ``<...>`` before the name is skipped.
    """
    starts = F.filter(lines_of(content), lambda x: F.rlike(x, F.lit(r"(?U)^\s*" + STARTERS_PATTERN)))
    rests = F.transform(starts, lambda x: F.regexp_replace(x, r"(?U)^\s*" + STARTERS_PATTERN + r"\s*", ""))
    names = F.transform(rests, lambda x: F.regexp_extract(skip_generics(x), r"(?U)^\s*([\p{IsAlphabetic}\p{N}_]*)", 1))
    found = F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda s: F.octet_length(s) >= 2))), " ")
    # most texts define nothing, which one search tells
    return F.when(F.rlike(content, F.lit(r"(?mU)^\s*" + STARTERS_PATTERN)), found).when(content.isNotNull(), "")


def kind_of(extension: Column) -> Column:
    return F.when(F.lower(extension).isin(*DOC_EXTENSIONS), "docs").otherwise("code")


def intent(query: Column) -> Column:
    """path, symbol or general."""
    single = ~F.contains(query, F.lit(" "))
    dotted = F.contains(query, F.lit(".")) & ~F.endswith(query, F.lit("."))
    named = F.contains(query, F.lit("_")) | F.rlike(query, F.lit(r"\p{Lu}"))
    return (
        F.when(F.contains(query, F.lit("/")) | F.contains(query, F.lit("\\")), "path")
        .when(F.contains(query, F.lit("::")), "symbol")
        .when(single & (dotted | named), "symbol")
        .otherwise("general")
    )


def intent_of(query: str) -> str:
    """The same for a query in hand."""
    if "/" in query or "\\" in query:
        return "path"
    if "::" in query:
        return "symbol"
    if " " not in query and (("." in query and not query.endswith(".")) or "_" in query or any(c.isupper() for c in query)):
        return "symbol"
    return "general"


def normalize_path(path: Column) -> Column:
    """Without empty and ``.`` parts; ``..`` removes a part, and nothing at the root."""
    parts = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(parts, "/")


def parent(path: Column) -> Column:
    """The folder of a path, '' at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def file_stem(path: Column) -> Column:
    """The last part without its last extension; a leading dot begins no extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def filename_boost(path: Column, words: list[str]) -> Column:
    """2.0 for the first word within the file's stem, 1.3 if it is a part of the path; then it stops."""
    stem, parts = F.lower(file_stem(path)), F.split(F.lower(path), "/")
    out = F.lit(1.0)
    for word in reversed(words):
        out = F.when(F.contains(stem, F.lit(word)), 2.0).when(F.array_contains(parts, word), 1.3).otherwise(out)
    return out


def rotate_cycle(cycle: Column) -> Column:
    """The same cycle from its least node on."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1))


def estimated_tokens(text: Column) -> Column:
    """A token for every 4 bytes."""
    return (F.octet_length(text) / 4).cast("long")


def byte_range(content: Column, off: Column, length: Column) -> Column:
    """The text of a byte range; cut at the end of the content, and its first 500 characters for a range beyond it."""
    raw = F.encode(content, "UTF-8")
    cut = F.decode(F.substring(raw, (off + 1).cast("int"), length.cast("int")), "UTF-8")
    return F.when(off < F.octet_length(content), cut).otherwise(F.substring(content, 1, 500))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(vector: Column, query: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, null for another size."""
    dot = F.aggregate(F.zip_with(vector, query, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    size = norm(vector) * norm(query)
    return F.when(F.size(vector) != F.size(query), None).when(size > 0, dot / size).otherwise(0.0)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """The same for a query that is known: its length is worked out once and not for each row."""
    length = math.sqrt(math.fsum(x * x for x in query))
    dot = F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in query)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    size = norm(vector) * length
    return F.when(F.size(vector) != len(query), None).when(size > 0, dot / size).otherwise(0.0)


def snippet(content: Column, query: str, context: int = 5, most: int = 15) -> Column:
    """Up to 15 lines around the line that holds most of the query's words.

    The first such line counts.  The excerpt begins at the nearest definition up to 11 lines above it, or
    else ``context`` lines above.
    """
    words = query.lower().split()
    lines = lines_of(content)
    hits = F.transform(lines, lambda x: sum((F.when(F.contains(F.lower(x), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)))
    best = F.greatest(F.coalesce(F.array_position(hits, F.array_max(hits)), F.lit(1)).cast("int") - 1, F.lit(0))
    above = F.filter(
        F.when(best > 0, F.sequence(F.greatest(best - 11, F.lit(0)), best - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.rlike(F.get(lines, k), F.lit(r"^\s*" + STARTERS_PATTERN)),
    )
    start = F.coalesce(F.array_max(above), F.greatest(best - context, F.lit(0)))
    return F.array_join(F.slice(lines, start + 1, most), "\n")
