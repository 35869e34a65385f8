"""The engine's registered queries over the driver's tables, and the same in SQL.

``documents`` plays the corpus (paths and extensions are derived from its columns), ``embeddings`` the
vectors, consecutive parts of an order the dependency edges, ``events`` the file events.  Code, specifiers and
query strings are made of the documents: patterns into which each document's id and first word are set, the same in
both engines.  Doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import analyze
from lodestone.functions.rowlocal import chunk_bytes, paragraphs
from lodestone.operators import graph, incremental, resolve, search, vectors
from lodestone.operators.imports import extract_imports
from lodestone.plans.engine import readiness, status_row
from lodestone.runtime import Scratch, read_table
from lodestone.streaming.watch import quiet_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- The corpus ------------------------------------------------------------------------------------

PATH = "concat('src/', source, '/', lang, '/doc_', cast(doc_id as string), case doc_id % 4 when 0 then '.rs' when 1 then '.py' when 2 then '.md' else '.txt' end)"
CORPUS_SQL = f"select {PATH.replace('string', 'varchar')} as path, case when doc_id % 4 < 2 then 'code' else 'docs' end as kind, text as content, doc_id from documents"
TOKENS_SQL = (
    "list_transform(list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) < 40), "
    f"lambda t: replace(replace(replace(translate(lower(t), '{analyze.FOLD_FROM}', '{analyze.FOLD_TO}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))"
)
RUNS_SQL = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda t: lower(t))"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path, kind, content, doc_id."""
    return read_table(spark, sf_dir, "documents").select(
        F.expr(PATH).alias("relative_path"), F.when(F.col("doc_id") % 4 < 2, "code").otherwise("docs").alias("kind"), F.col("text").alias("content"), "doc_id"
    )


WORDS = ("the", "keit", "ionea")


def _bm25_sql(where: str = "", limit: int = 30) -> str:
    words = ", ".join(f"('{w}')" for w in WORDS)
    return f"""
with docs as ({CORPUS_SQL}), tokens as (select path, kind, {TOKENS_SQL.format('content')} as toks from docs),
words(w) as (values {words}), stats as (select count(*) as n, avg(len(toks)) as mean from tokens),
tf as (select path, kind, len(toks) as len, w, len(list_filter(toks, lambda t: t = w)) as tf from tokens cross join words),
df as (select w, count(*) as df from tf where tf > 0 group by w)
select path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score
from tf join df using (w) cross join stats where tf > 0 {where} group by path order by score desc, path limit {limit}"""


def _scan(spark: SparkSession, sf_dir: str, scope: str | None = None) -> DataFrame:
    scores = search.scan_scores(corpus(spark, sf_dir), {"content": list(WORDS)}, {"content": 1.0}, scope)
    return search.top(scores.select("relative_path", F.round("score", 6).alias("score")), 30).withColumnRenamed("relative_path", "path")


@query(_bm25_sql())
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over contents, straight from the documents."""
    return _scan(spark, sf_dir)


@query(_bm25_sql("and kind = 'code'"))
def bm25_scope_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among code alone; statistics are of all documents."""
    return _scan(spark, sf_dir, "code")


@query(_bm25_sql())
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through postings and field statistics."""
    docs, scratch = corpus(spark, sf_dir), Scratch(spark, "postings")
    # each is read twice, for a statistic and for the scores, and is analysed once
    post = scratch.table(search.postings(docs, ("content",)).where(F.col("token").isin(*WORDS)), "postings")
    stats = scratch.table(search.field_stats(docs, ("content",)), "stats")
    scores = search.index_scores(post, stats, {"content": list(WORDS)}, {"content": 1.0})
    return search.top(scores.select("relative_path", F.round("score", 6).alias("score")), 30).withColumnRenamed("relative_path", "path")


MULTI = {"basename": ["doc", "7", "rs"], "content": ["the", "ea"]}
MULTI_BOOST = {"basename": 6.0, "content": 1.0}


@query(f"""
with docs as ({CORPUS_SQL}), fields as (
  select path, 'content' as f, 1.0 as boost, {TOKENS_SQL.format('content')} as toks from docs
  union all select path, 'basename', 6.0, {RUNS_SQL.format("split_part(path, '/', 4)")} from docs),
words(f, w) as (values ('basename', 'doc'), ('basename', '7'), ('basename', 'rs'), ('content', 'the'), ('content', 'ea')),
stats as (select f, count(*) as n, avg(len(toks)) as mean from fields group by f),
tf as (select path, f, boost, len(toks) as len, w, len(list_filter(toks, lambda t: t = w)) as tf from fields join words using (f)),
df as (select f, w, count(*) as df from tf where tf > 0 group by f, w)
select path, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score
from tf join df using (f, w) join stats using (f) where tf > 0 group by path order by score desc, path limit 30""")
def bm25_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted fields: a name counts six times a content."""
    docs = corpus(spark, sf_dir).withColumn("basename", F.element_at(F.split("relative_path", "/"), -1))
    scores = search.scan_scores(docs, MULTI, MULTI_BOOST)
    return search.top(scores.select("relative_path", F.round("score", 6).alias("score")), 30).withColumnRenamed("relative_path", "path")


@query(f"""
with docs as ({CORPUS_SQL}), tokens as (select path, unnest({TOKENS_SQL.format('content')}) as token, generate_subscripts({TOKENS_SQL.format('content')}, 1) as p from docs)
select a.path as path, count(*) as matches from tokens a join tokens b on a.path = b.path and b.p = a.p + 1 where a.token = 'the' and b.token = 'and' group by a.path""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two words side by side, by positions."""
    post = search.postings(corpus(spark, sf_dir), ("content",)).where(F.col("token").isin("the", "and"))
    return search.phrase_matches(post, "content", ["the", "and"]).select(F.col("relative_path").alias("path"), F.col("matches").cast("long").alias("matches"))


PHRASES = (("the", "anea", "eriner"), ("the", "the", "the"), ("is", "the", "is"), ("attion", "to"))


def _phrase_sql(tokens: tuple[str, ...]) -> str:
    same = " and ".join(f"toks[i + {k}] = '{t}'" for k, t in enumerate(tokens))
    return f"select '{' '.join(tokens)}' as phrase, path, len(toks) as len, len(list_filter(range(1, len(toks) - {len(tokens) - 2}), lambda i: {same})) as tf from tokens"


@query(f"""
with docs as ({CORPUS_SQL}), tokens as (select path, {TOKENS_SQL.format('content')} as toks from docs), stats as (select count(*) as n, avg(len(toks)) as mean from tokens),
hits as (select * from ({" union all ".join(_phrase_sql(p) for p in PHRASES)}) where tf > 0), df as (select phrase, count(*) as df from hits group by phrase)
select phrase, path, tf as matches, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)), 6) as score from hits join df using (phrase) cross join stats""")
def phrase_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of sequences of tokens as terms of their own: two and three tokens, and repeated ones."""
    docs = corpus(spark, sf_dir)
    scratch = Scratch(spark, "phrases")
    asked = {t for p in PHRASES for t in p}
    post = scratch.table(search.postings(docs, ("content",)).where(F.col("token").isin(*asked)), "postings")
    stats = scratch.table(search.field_stats(docs, ("content",)), "stats")
    out = [
        search.phrase_scores(post, stats, "content", list(p)).join(search.phrase_matches(post, "content", list(p)), "relative_path").withColumn("phrase", F.lit(" ".join(p)))
        for p in PHRASES
    ]
    both = reduce(DataFrame.unionByName, out)
    return both.select("phrase", F.col("relative_path").alias("path"), F.col("matches").cast("long").alias("matches"), F.round("score", 6).alias("score"))


@query(f"select lang, count(*) as n_docs, sum(len({TOKENS_SQL.format('text')})) as n_tokens, round(avg(len({TOKENS_SQL.format('text')})), 6) as mean_tokens from documents group by lang")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("lang", F.size(analyze.content_tokens(F.col("text"))).alias("n"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("long").alias("n_tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"))


@query(f"select token, count(*) as df from (select unnest(list_distinct({TOKENS_SQL.format('text')})) as token from documents) group by token")
def df_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every token."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.explode(F.array_distinct(analyze.content_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query("""select gram, count(*) as n from (select unnest(list_transform(range(1, length(w) - 1), lambda k: substr(lower(w), k, 3))) as gram
from (select p_name as w from part)) group by gram""")
def ngram3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character trigrams of part names."""
    parts = read_table(spark, sf_dir, "part")
    return parts.select(F.explode(analyze.ngrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _values(rows: list[tuple]) -> str:
    """An inline table for both engines: quotes doubled, control characters through chr()."""

    def text(x) -> str:
        if not isinstance(x, str):
            return str(x)
        parts = x.replace("'", "''").split("\n")
        return "concat(" + ", chr(10), ".join(f"'{p}'" for p in parts) + ")" if len(parts) > 1 else f"'{parts[0]}'"

    return ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in rows)


def _made(spark: SparkSession, sf_dir: str, rows: list[tuple], names: str) -> DataFrame:
    """doc_id, k and the columns ``names``: each pattern of ``rows`` with @ as the document's id and # as its first word."""
    columns = names.split()
    word = F.concat(F.lit("w"), F.coalesce(F.regexp_extract("text", "[a-z]{2,}", 0), F.lit("")))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("_id"), word.alias("_word"))
    patterns = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(x).alias(c) for c, x in zip(columns, r, strict=True))) for k, r in enumerate(rows)))
    each = docs.select("doc_id", "_id", "_word", F.inline(patterns))
    return each.select("doc_id", "k", *(F.replace(F.replace(F.col(c), F.lit("@"), F.col("_id")), F.lit("#"), F.col("_word")).alias(c) for c in columns))


def _made_sql(rows: list[tuple], names: str) -> str:
    """The same as a subquery."""
    columns = names.split()
    made = ", ".join(f"replace(replace(t.{c}, '@', d.id), '#', d.word) as {c}" for c in columns)
    docs = "select doc_id, doc_id::varchar as id, 'w' || coalesce(regexp_extract(text, '[a-z]{2,}'), '') as word from documents"
    return f"(select d.doc_id, t.k, {made} from ({docs}) d cross join (values {_values([(k, *r) for k, r in enumerate(rows)])}) t(k, {', '.join(columns)}))"


INTENTS = [("src/#@.rs",), ("a\\#",), ("crate::#",), ("#.io@",), ("#.",), ("snake_#",), ("Camel#",), ("retry #",), ("Retry #",), ("#",), ("#@",), ("",)]


@query(f"""select doc_id, k, q, intent, case intent when 'symbol' then 12.0 when 'path' then 4.0 else 8.0 end::double as symbols_boost,
case intent when 'symbol' then 4.0 when 'path' then 9.0 else 6.0 end::double as basename_boost from (select doc_id, k, q, case when contains(q, '/') or contains(q, '\\') then 'path' when contains(q, '::') then 'symbol'
when not contains(q, ' ') and ((contains(q, '.') and not ends_with(q, '.')) or contains(q, '_') or regexp_matches(q, '\\p{{Lu}}')) then 'symbol' else 'general' end as intent
from {_made_sql(INTENTS, "q")} t)""")
def intent_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a query's form sets the field boosts."""
    df = _made(spark, sf_dir, INTENTS, "q").withColumn("intent", analyze.intent(F.col("q")))
    of = {k: F.create_map(*(x for kind, b in analyze.BOOSTS.items() for x in (F.lit(kind), F.lit(b[n])))) for n, k in enumerate(search.FIELDS)}
    return df.select("doc_id", "k", "q", "intent", of["symbols"][F.col("intent")].alias("symbols_boost"), of["basename"][F.col("intent")].alias("basename_boost"))


@query(f"""
with hits as ({_bm25_sql(limit=90)}), stems as (select *, regexp_replace(lower(split_part(path, '/', 4)), '\\.[^.]*$', '') as stem, string_split(lower(path), '/') as parts from hits)
select path, round(score * case when contains(stem, 'doc_1') then 2.0 when list_contains(parts, 'doc_1') then 1.3
when contains(stem, 'en') then 2.0 when list_contains(parts, 'en') then 1.3 else 1.0 end, 6) as score from stems""")
def filename_boost_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits re-ranked by how the query's words meet their paths."""
    scores = search.scan_scores(corpus(spark, sf_dir), {"content": list(WORDS)}, {"content": 1.0})
    hits = search.top(scores.select("relative_path", F.round("score", 6).alias("score")), 90)
    boosted = search.rerank_by_name(hits, "Doc_1 en")
    return boosted.select(F.col("relative_path").alias("path"), F.round("score", 6).alias("score"))


@query("""
with l as (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as lines from documents where text <> ''),
s as (select doc_id, lines, list_transform(lines, lambda x: (case when contains(lower(x), 'the') then 1 else 0 end) + (case when contains(lower(x), 'ing.') then 1 else 0 end)) as hits from l),
b as (select doc_id, lines, list_position(hits, list_max(hits)) - 1 as best from s)
select doc_id, array_to_string(lines[greatest(best - 5, 0) + 1 : greatest(best - 5, 0) + 15], chr(10)) as snippet from b
union all select doc_id, '' from documents where text = ''""")
def snippet_best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts around the line with most of the query's words."""
    return read_table(spark, sf_dir, "documents").select("doc_id", analyze.snippet(F.col("text"), "the ing.").alias("snippet"))


IDENTIFIERS = [("get#Name@",), ("HTTP_#_CODE@",), ("parse#2XML",), ("#",), ("XML#Parser",), ("a1#b@",), ("",), ("__#__@",), ("#A@B",)]


@query(f"""select doc_id, k, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(id, '([a-z])([A-Z])', '\\1 \\2', 'g'),
'([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x)), ' ') as tokens from {_made_sql(IDENTIFIERS, "id")} t""")
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers split where case and kind of sign change."""
    return _made(spark, sf_dir, IDENTIFIERS, "id").select("doc_id", "k", F.array_join(analyze.identifier_tokens(F.col("id")), " ").alias("tokens"))


SNIPPETS = [
    ("pub struct Config@ {\n    port: u16,\n}\nimpl Config@ {\n  pub fn load_#() {}\n}",), ("def run_#(self):\n    pass\nclass Job@:\n  async def go(self): pass",),
    ("export default class App@ {}\nconst fn zed\nlet mut # = 1\nfunction a() {}",), ("no symbols of # here",), ("func <T> Map#(x)\nfn bar_@<T>(x)\nenum E1 {}",), ("",),
    ("impl <T: Into<Vec<Option<Box<u8>>>>> Deep#<T> {}\nfn <A<B> unbalanced\n  struct <> Empty@\npub(crate) fn shown_#() {}",),
]
_STARTERS_SQL = "(?:" + "|".join(s.replace("(", "\\(").replace(")", "\\)") for s in analyze.BLOCK_STARTERS) + ")"


_GENERICS_SQL = "[^<>]*"
for _ in range(6):  # deep enough for the rows above
    _GENERICS_SQL = f"[^<>]*(?:<{_GENERICS_SQL}>[^<>]*)*"


@query(f"""with made as {_made_sql(SNIPPETS, "src")}, l as (select doc_id, k, unnest(string_split(src, chr(10))) as line from made),
n as (select distinct doc_id, k, regexp_extract(line, '^\\s*{_STARTERS_SQL}\\s*(?:<{_GENERICS_SQL}>\\s*)?([A-Za-z0-9_]*)', 1) as name from l),
g as (select doc_id, k, string_agg(name, ' ' order by name) as symbols from n where strlen(name) >= 2 group by doc_id, k)
select m.doc_id, m.k, coalesce(g.symbols, '') as symbols from made m left join g on g.doc_id = m.doc_id and g.k = m.k""")
def symbols_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names defined in pieces of code."""
    return _made(spark, sf_dir, SNIPPETS, "src").select("doc_id", "k", analyze.symbols(F.col("src")).alias("symbols"))


CODE = {
    "rust": ("rs", [("a@.rs", "use crate::fs_#::walk;\n  use super::x@;\nuse std::io::*;\npub use crate::no;\nmod y;\n// use crate::#;"), ("b@.rs", "use self::deep@::A;\nfn #() {}\nuse serde::Deserialize;")]),
    "js": ("ts", [("a@.ts", "import a from './#';\nconst q = require(\"./q@\");\nexport { z } from './z@';"), ("b@.ts", "import 'side-#';\nconst m = import('./lazy@');")]),
    "py": ("py", [("a@.py", "import #, sys\nfrom . import n\nfrom .n@ import y"), ("b@.py", "  import a.#.c@\nfrom ..top@ import z\nimport a.#.c@")]),
    "go": ("go", [("a@.go", 'import (\n  "fmt"\n  u "ex.com/#/util@"\n)'), ("b@.go", 'import "os"\nimport x "ex.com/x@"')]),
    "php": ("php", [("a@.php", "use App\\#\\User@;\nrequire_once 'b@.php';"), ("b@.php", "include('c@.php');\nuse App\\#\\User as U;")]),
}
#: The patterns of lodestone.operators.imports once more, without what DuckDB's regular expressions lack.
_EXTRACT_SQL = {
    "rust": ["(?m)^\\s*use\\s+((?:crate|super|self|[a-zA-Z_]\\w*)(?:::\\w+)*(?:::\\*)?)"],
    "js": [
        "(?m)^\\s*import\\s+.*?from\\s+[\"'']([^\"'']+)[\"'']", "(?m)^\\s*import\\s+[\"'']([^\"'']+)[\"'']", "require\\s*\\(\\s*[\"'']([^\"'']+)[\"'']\\s*\\)",
        "(?m)^\\s*export\\s+.*?\\s+from\\s+[\"'']([^\"'']+)[\"'']", "import\\s*\\(\\s*[\"'']([^\"'']+)[\"'']\\s*\\)",
    ],
    "py": ["(?m)^\\s*import\\s+([\\w.]+)", "(?m)^\\s*from\\s+(\\.{0,3}[\\w.]*)[\\s]+import"],
    "go": ["(?:\\w+\\s+)?\"([^\"]+)\""],
    "php": ["(?m)^\\s*use\\s+([\\w\\\\]+)", "(?:require|require_once|include|include_once)\\s*[(]?\\s*[\"'']([^\"'']+)[\"'']"],
}


def _imports_query(language: str) -> None:
    extension, rows = CODE[language]
    parts = " union all ".join(f"select path, unnest(regexp_extract_all(src, '{p}', 1)) as specifier from made" for p in _EXTRACT_SQL[language])
    once = "" if language in ("rust", "py") else "distinct "
    bare = "regexp_replace(src, '//[^\n]*', '', 'g')" if language == "rust" else "src"  # comments hold no imports

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _made(spark, sf_dir, rows, "path src").select(F.col("path").alias("relative_path"), F.col("src").alias("content"), F.lit(extension).alias("extension"))
        return extract_imports(files).select(F.col("relative_path").alias("path"), "specifier")

    run.__name__ = f"imports_{language}"
    run.__doc__ = f"Import specifiers of {language} code."
    query(f"with made as (select path, {bare} as src from {_made_sql(rows, 'path src')}) select {once}path, specifier from ({parts})")(run)


for _language in CODE:
    _imports_query(_language)

#: Files that may be there: of document d, the k-th is unless (d + k) % 4 = 0.
FILES = {
    "rust": ("rs", ["src/main@.rs", "src/fs_#@.rs", "src/search/mod.rs", "src/search/index@.rs", "src/search/query@.rs", "src/search@/mod.rs"]),
    "js": ("ts", ["web/a@.ts", "web/#@.tsx", "web/dir@/index.ts", "lib/c@.js", "web/#@.jsx"]),
    "py": ("py", ["pkg/__init__.py", "pkg/#@.py", "top@.py", "src/deep/x@.py", "pkg/#@/__init__.py"]),
    "go": ("go", ["util@/a.go", "util@/b.go", "svc@/h.go", "p/util@/c.go"]),
    "php": ("php", ["app/Models/User@.php", "Models/#@.php", "lib/y@.php", "src/Models/User@.php"]),
}
SPECIFIERS = {
    "rust": [("src/search/index@.rs", "crate::fs_#@::walk"), ("src/search/index@.rs", "super::query@::Parser"), ("src/main@.rs", "crate::search@"), ("src/main@.rs", "std::io"), ("src/search/mod.rs", "self::index@::Doc"), ("src/search/mod.rs", "self::none@")],
    "js": [("web/a@.ts", "./#@"), ("web/a@.ts", "./dir@"), ("web/a@.ts", "../lib/c@"), ("web/a@.ts", "react"), ("lib/c@.js", "../web/a@.ts")],
    "py": [("pkg/m@.py", "."), ("pkg/m@.py", "pkg.#@"), ("top@.py", ".pkg.#@"), ("pkg/m@.py", "..top@"), ("top@.py", "deep.x@"), ("top@.py", "os")],
    "go": [("svc@/h.go", "ex.com/p/util@"), ("svc@/h.go", "fmt"), ("util@/a.go", "svc@")],
    "php": [("lib/y@.php", "App\\Models\\User@"), ("lib/y@.php", "App\\Models\\#@"), ("Models/#@.php", "lib/y@.php"), ("lib/y@.php", "./y@.php"), ("lib/y@.php", "No\\#")],
}
#: The candidates that each specifier has, in order, for the SQL form.
_CANDIDATES_SQL = {
    "rust": """case when starts_with(spec, 'crate::') then list_concat(['src/' || replace(spec[8:], '::', '/') || '.rs', 'src/' || replace(spec[8:], '::', '/') || '/mod.rs'],
      case when contains(spec[8:], '::') then ['src/' || split_part(spec[8:], '::', 1) || '.rs', 'src/' || split_part(spec[8:], '::', 1) || '/mod.rs'] else [] end)
      when starts_with(spec, 'self::') then ['src/search/' || replace(spec[7:], '::', '/') || '.rs', 'src/search/' || replace(spec[7:], '::', '/') || '/mod.rs',
      'src/search/' || split_part(spec[7:], '::', 1) || '.rs', 'src/search/' || split_part(spec[7:], '::', 1) || '/mod.rs']
      when starts_with(spec, 'super::') then ['src/search/' || replace(spec[8:], '::', '/') || '.rs', 'src/search/' || replace(spec[8:], '::', '/') || '/mod.rs',
      'src/search/' || split_part(spec[8:], '::', 1) || '.rs', 'src/search/' || split_part(spec[8:], '::', 1) || '/mod.rs'] else [] end""",
    "js": """case when starts_with(spec, './') then list_transform(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'], lambda e: split_part(source, '/', 1) || '/' || spec[3:] || e)
      when starts_with(spec, '../') then list_transform(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'], lambda e: spec[4:] || e) else [] end""",
    "py": """case when spec = '.' then ['pkg/__init__.py'] when starts_with(spec, '..') then [replace(spec[3:], '.', '/') || '.py', replace(spec[3:], '.', '/') || '/__init__.py']
      when starts_with(spec, '.') then [replace(spec[2:], '.', '/') || '.py', replace(spec[2:], '.', '/') || '/__init__.py']
      else [replace(spec, '.', '/') || '.py', replace(spec, '.', '/') || '/__init__.py', 'src/' || replace(spec, '.', '/') || '.py'] end""",
    "go": "list_transform(range(1, len(string_split(spec, '/')) + 1), lambda k: array_to_string(string_split(spec, '/')[k:], '/') || '/')",
    "php": """case when ends_with(spec, '.php') and starts_with(spec, './') then [split_part(source, '/', 1) || '/' || spec[3:]] when ends_with(spec, '.php') then [spec]
      else flatten(list_transform(['', 'src/', 'app/', 'lib/'], lambda r: [r || replace(spec, '\\', '/') || '.php', r || array_to_string(string_split(spec, '\\')[2:], '/') || '.php'])) end""",
}


def _resolve_query(language: str) -> None:
    extension, paths = FILES[language]
    rows, patterns = SPECIFIERS[language], [(p,) for p in paths]
    there = f"(select path from {_made_sql(patterns, 'path')} where (doc_id + k) % 4 <> 0)"
    known = f"select distinct path as candidate, path as target from {there}" if language != "go" else f"select regexp_replace(path, '[^/]*$', '') as candidate, min(path) as target from {there} group by 1"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        imports = _made(spark, sf_dir, rows, "source spec").select(F.col("source").alias("relative_path"), F.lit(extension).alias("extension"), F.col("spec").alias("specifier"))
        files = _made(spark, sf_dir, patterns, "path").where("(doc_id + k) % 4 <> 0").select(F.col("path").alias("relative_path"))
        found = resolve.resolve_imports(imports, files)
        return found.select(F.col("relative_path").alias("source"), F.col("specifier").alias("spec"), "target")

    run.__name__ = f"resolve_{language}"
    run.__doc__ = f"Resolution of {language} specifiers against the files that are there."
    query(f"""with s as (select source, spec from {_made_sql(rows, 'source spec')}), c as (select source, spec, {_CANDIDATES_SQL[language]} as cand from s),
e as (select distinct source, spec, unnest(cand) as candidate, generate_subscripts(cand, 1) as turn from c), k as ({known}),
r as (select source, spec, arg_min(k.target, e.turn) as target from e join k using (candidate) group by source, spec)
select s.source, s.spec, r.target from s left join r on r.source = s.source and r.spec = s.spec""")(run)


for _language in FILES:
    _resolve_query(_language)

# --- Vectors and fusion ----------------------------------------------------------------------------


def _query_vector(embeddings: DataFrame) -> DataFrame:
    """One row: the vector of the least id."""
    return embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("target"))


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    scored = e.crossJoin(F.broadcast(_query_vector(e)))  # one row
    return scored.select("vec_id", "label", F.round(analyze.cosine(F.col("embedding"), F.col("target")), 6).alias("score"))


_COSINE_SQL = """q as (select embedding as target from embeddings order by vec_id limit 1),
cosines as (select vec_id, label, round(list_cosine_similarity(embedding::double[], target::double[]), 6) as score from embeddings cross join q)"""


@query(f"with {_COSINE_SQL} select vec_id, score from cosines order by score desc, vec_id limit 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors."""
    return _cosines(spark, sf_dir).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(20)


@query("""with s as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score
from embeddings q cross join embeddings e where q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10""")
def cosine_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors of many queries at once."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.batch_top_k(e, asked, 10, digits=6)


@query(f"with {_COSINE_SQL}, r as (select *, row_number() over (partition by label order by score desc, vec_id) as k from cosines) select label, score, vec_id from r where k = 1")
def best_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vector of each label, as of each file's chunks."""
    return vectors.best_per_key(_cosines(spark, sf_dir), "label", "vec_id")


@query(f"""with bm as ({_bm25_sql(limit=60)}), {_COSINE_SQL}, docs as ({CORPUS_SQL}),
a as (select path, row_number() over (order by score desc, path) as r from bm),
v as (select path, score from cosines join docs on vec_id = doc_id order by score desc, path limit 60), b as (select path, row_number() over (order by score desc, path) as r from v)
select path, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) as score from a full join b using (path) order by score desc, path limit 20""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and vectors fused by reciprocal ranks."""
    docs = corpus(spark, sf_dir)
    scores = search.scan_scores(docs, {"content": list(WORDS)}, {"content": 1.0})
    words = search.top(scores.select("relative_path", F.round("score", 6).alias("score")), 60)
    near = _cosines(spark, sf_dir).join(docs.select("doc_id", "relative_path"), F.col("vec_id") == F.col("doc_id")).select("relative_path", "score")
    fused = search.fuse(words, search.top(near, 60), 1 << 30).select(F.col("relative_path").alias("path"), F.round("score", 6).alias("score"))
    return search.top(fused, 20, "path")


# --- The graph -------------------------------------------------------------------------------------


def part_edges(spark: SparkSession, sf_dir: str, least: float = 45) -> DataFrame:
    """src, dst: a part and the next of its order, where the first was bought in quantity."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.lead("l_partkey").over(order).alias("dst"))
    return rows.where((F.col("l_quantity") >= least) & F.col("dst").isNotNull() & (F.col("l_partkey") != F.col("dst"))).select(F.col("l_partkey").alias("src"), "dst").distinct()


def _edges_sql(least: int = 45) -> str:
    return f"""edges as (select distinct src, dst from (select l_partkey as src, l_quantity as q, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as dst from lineitem)
where q >= {least} and dst is not null and src <> dst)"""


def _stored_edges(spark: SparkSession, sf_dir: str, least: float = 45) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark, "graph")
    return scratch.table(part_edges(spark, sf_dir, least), "edges"), scratch


@query(f"with {_edges_sql()} select dst from edges where src = (select min(src) from edges)")
def graph_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _stored_edges(spark, sf_dir)
    return graph.deps(edges, edges.agg(F.min("src")).first()[0])


@query(f"with {_edges_sql()} select src from edges where dst = (select min(dst) from edges)")
def graph_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _stored_edges(spark, sf_dir)
    return graph.dependents(edges, edges.agg(F.min("dst")).first()[0])


@query(f"with {_edges_sql()} select (select count(*) from edges) as n_edges, (select count(*) from (select src from edges union select dst from edges)) as n_nodes")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(part_edges(spark, sf_dir))


_IMPACT_SQL = f"""with recursive {_edges_sql()}, start as (select max(dst) as node from edges), reach(path, depth) as (
select node, 0 from start union select e.src, r.depth + 1 from reach r join edges e on e.dst = r.path where r.depth < 10),
d as (select path, min(depth)::int as depth from reach where path <> (select node from start) group by path)"""


@query(_IMPACT_SQL + " select path, depth from d")
def graph_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within ten steps upstream of a part."""
    edges, scratch = _stored_edges(spark, sf_dir)
    return graph.impact(edges, edges.agg(F.max("dst")).first()[0], scratch=scratch)


@query(_IMPACT_SQL + " select count(*) as total, count(*) filter (where depth = 1) as direct, count(*) filter (where depth > 1) as indirect from d")
def graph_impact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, scratch = _stored_edges(spark, sf_dir)
    return graph.impact_totals(graph.impact(edges, edges.agg(F.max("dst")).first()[0], scratch=scratch))


@query(f"""with recursive {_edges_sql()}, start as (select min(src) as node from edges), reach(node, d) as (
select node, 0 from start union select e.dst, r.d + 1 from reach r join edges e on e.src = r.node where r.d < 10),
dist as (select node, min(d) as d from reach group by node), goal as (select node, d from dist order by d desc, node limit 1),
walk(node, trail, d) as (select node, [node], 0 from start union all
select e.dst, list_append(w.trail, e.dst), w.d + 1 from walk w join edges e on e.src = w.node join dist on dist.node = e.dst and dist.d = w.d + 1 where w.d < (select d from goal)),
best as (select trail from walk where node = (select node from goal) order by trail limit 1)
select generate_subscripts(trail, 1)::int - 1 as step, unnest(trail) as node from best""")
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least shortest path from the first part to the one farthest from it, ten steps at most."""
    edges, scratch = _stored_edges(spark, sf_dir)
    start = edges.agg(F.min("src")).first()[0]
    goal = graph.impact(graph.reverse(edges), start, scratch=scratch).orderBy(F.desc("depth"), "path").first()
    return graph.shortest_path(edges, start, goal.path if goal else start, scratch=Scratch(spark, "path"))


@query(f"""with {_edges_sql()} select [a.src, a.dst] as cycle from edges a join edges b on b.src = a.dst and b.dst = a.src where a.src < a.dst
union all select [a.src, a.dst, b.dst] from edges a join edges b on b.src = a.dst join edges c on c.src = b.dst and c.dst = a.src where a.src < a.dst and a.src < b.dst and a.dst <> b.dst""")
def graph_cycles_len3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cycles of two or three parts."""
    edges, scratch = _stored_edges(spark, sf_dir)
    return graph.cycles(edges, 3, scratch)


@query(f"""with recursive {_edges_sql()}, reach(a, b) as (select src, dst from edges union select r.a, e.dst from reach r join edges e on e.src = r.b)
select x.a as node, min(x.b) as component from reach x join reach y on y.a = x.b and y.b = x.a group by x.a""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that reach one another, by the least of them."""
    edges, scratch = _stored_edges(spark, sf_dir)
    return graph.components(edges, scratch)


@query(f"with {_edges_sql()}, f as (select min(src) as node from edges) select src, dst from edges where src <> (select node from f) and dst <> (select node from f)")
def graph_remove_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _stored_edges(spark, sf_dir)
    return graph.remove_file(edges, edges.agg(F.min("src")).first()[0])


@query("""with links as (select page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as name from pages),
titles as (select regexp_extract(html, '<title>([^ <]*)', 1) as name, min(page_id) as target from pages group by 1)
select distinct page_id as src, target as dst from links join titles using (name) where name <> '' and page_id <> target""")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between pages, resolved by the first word of their titles."""
    pages = read_table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("name")).where("name <> ''").distinct()
    titles = pages.groupBy(F.regexp_extract("html", "<title>([^ <]*)", 1).alias("name")).agg(F.min("page_id").alias("dst"))
    return links.join(titles, "name").where("page_id <> dst").select(F.col("page_id").alias("src"), "dst").distinct()


# --- Maintenance, streams, status ------------------------------------------------------------------


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents")
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    path = F.expr(PATH)
    old = docs.where("doc_id % 11 <> 0").select(path.alias("relative_path"), digest.alias("content_hash"))
    new = docs.where("doc_id % 13 <> 0").select(path.alias("relative_path"), F.when(F.col("doc_id") % 7 == 0, F.sha2(F.encode(F.concat("text", F.lit("x")), "UTF-8"), 256)).otherwise(digest).alias("content_hash"))
    return old, new


_DIFF_SQL = f"""with d as (select {PATH.replace('string', 'varchar')} as path, doc_id, text from documents), a as (select path, sha256(text) as h from d where doc_id % 11 <> 0),
b as (select path, case when doc_id % 7 = 0 then sha256(text || 'x') else sha256(text) end as h from d where doc_id % 13 <> 0),
c as (select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted' when a.h = b.h then 'unchanged' else 'updated' end as change
from a full join b on a.path = b.path)"""


@query(_DIFF_SQL + " select path, change from c")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests compared by content hash."""
    return incremental.diff(*_manifests(spark, sf_dir)).withColumnRenamed("relative_path", "path")


@query(_DIFF_SQL + """ select count(*) filter (where change <> 'deleted') as total_files, count(*) filter (where change = 'added') as added, count(*) filter (where change = 'updated') as updated,
count(*) filter (where change = 'deleted') as deleted, count(*) filter (where change in ('added', 'updated')) as needs_embedding from c""")
def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.counters(incremental.diff(*_manifests(spark, sf_dir)))


@query("""with o as (select user_id, event_type, ts, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select *, sum(case when before is null or ts - before > interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_type rows unbounded preceding) as k from o)
select user_id, min(ts) as begin_ts, max(ts) + interval 30 minute as end_ts, array_to_string(list_sort(list_distinct(list(event_type))), ',') as paths, count(*) as n_events from s group by user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events that end with thirty quiet minutes."""
    events = read_table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    bursts = quiet_batches(events, "30 minutes", key="user_id", path="event_type")
    return bursts.select("user_id", F.col("begin").alias("begin_ts"), F.col("end").alias("end_ts"), F.array_join("paths", ",").alias("paths"), "n_events")


@query("""with o as (select user_id, event_type, ts, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select *, sum(case when before is null or ts - before > interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_type rows unbounded preceding) as k from o),
b as (select user_id, min(ts) as begin_ts, max(ts) + interval 30 minute as end_ts, array_to_string(list_sort(list_distinct(list(event_type))), ',') as paths, count(*) as n_events from s group by user_id, k)
select * from b where end_ts <= (select max(ts) from events)""")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the events: bursts that the watermark has closed."""
    source = read_table(spark, sf_dir, "events")
    # a pattern, as a stream's path may be a folder or a pattern, and the table may be one file
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/[e]vents.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    bursts = quiet_batches(stream, "30 minutes", delay="0 seconds", key="user_id", path="event_type")
    scratch = Scratch(spark, "bursts")
    flat = bursts.select("user_id", F.col("begin").alias("begin_ts"), F.col("end").alias("end_ts"), F.array_join("paths", ",").alias("paths"), "n_events")
    flat.writeStream.outputMode("append").option("checkpointLocation", f"{scratch.path}/state").trigger(availableNow=True).start(f"{scratch.path}/out", format="parquet").awaitTermination()
    found = spark.read.schema(flat.schema).parquet(f"{scratch.path}/out")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin_ts", "end_ts")})


#: Chunks in SQL, for texts without blank lines or space at their ends, as the documents are: short ones whole, others line by line.
_CHUNKS_SQL = f"""d as (select {PATH.replace('string', 'varchar')} as relative_path, text from documents where text <> ''),
l as (select relative_path, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from d where strlen(text) // 4 > 1024),
p as (select relative_path, k, strlen(line) as n, (sum(strlen(line) + 1) over (partition by relative_path order by k))::bigint - strlen(line) - 1 as o from l),
fold(relative_path, k, b, e, cut_b, cut_e) as (select relative_path, 1::bigint, 0::bigint, n, null::bigint, null::bigint from p where k = 1
  union all select p.relative_path, p.k, case when (e - b) // 4 + n // 4 > 1024 then o else b end, o + n, case when (e - b) // 4 + n // 4 > 1024 then b end, case when (e - b) // 4 + n // 4 > 1024 then e end
  from fold join p on p.relative_path = fold.relative_path and p.k = fold.k + 1),
spans as (select relative_path, 0::bigint as off, strlen(text) as stop from d where strlen(text) // 4 <= 1024
  union all select relative_path, cut_b, cut_e from fold where cut_b is not null
  union all select relative_path, max_by(b, k), max(e) from fold group by relative_path),
chunks as (select relative_path, (row_number() over (partition by relative_path order by off) - 1)::int as chunk_idx, off, stop - off as len from spans)"""


@query(f"with recursive {_CHUNKS_SQL} select relative_path, chunk_idx, off, len, len // 4 as tokens from chunks")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document with their byte spans."""
    docs = corpus(spark, sf_dir).select("relative_path", F.posexplode(chunk_bytes(F.col("content"))).alias("chunk_idx", "c"))
    return docs.select("relative_path", "chunk_idx", "c.off", "c.len", (F.col("c.len") / 4).cast("long").alias("tokens"))


@query("""with t as (select doc_id, replace(replace(text, chr(10), chr(10) || chr(10)), '. ', '.' || chr(10) || chr(10) || ' ') as text from documents),
p as (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as piece, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as i from t),
o as (select doc_id, i, piece, coalesce(sum(strlen(piece) + 2) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as off from p),
b as (select doc_id, i, off, regexp_replace(regexp_replace(piece, '^[\\s\\x0B\\x85\\p{Z}]+', ''), '[\\s\\x0B\\x85\\p{Z}]+$', '') as body from o)
select doc_id, off, strlen(body) as len, sha256(body) as sha from b where body <> ''""")
def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the documents, whose lines and sentences are set apart by empty lines first."""
    apart = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), F.lit(". "), F.lit(".\n\n "))
    each = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(paragraphs(apart)).alias("p"))
    return each.select("doc_id", "p.off", F.octet_length("p.text").cast("long").alias("len"), F.sha2(F.encode("p.text", "UTF-8"), 256).alias("sha"))


@query(f"with recursive {_CHUNKS_SQL} select relative_path, chunk_idx, sha256(decode(array_slice(encode(text), off + 1, off + len))) as sha from chunks join d using (relative_path)")
def chunk_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text read back from its document by byte range."""
    docs = corpus(spark, sf_dir).select("relative_path", "content", F.posexplode(chunk_bytes(F.col("content"))).alias("chunk_idx", "c"))
    return docs.select("relative_path", "chunk_idx", F.sha2(F.encode(analyze.byte_range(F.col("content"), F.col("c.off"), F.col("c.len")), "UTF-8"), 256).alias("sha"))


@query("""with h as (select doc_id, hex(encode(text)) as digits from documents)
select doc_id, printf('%016x', list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(0, len(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::int::hugeint)),
lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616)::ubigint) as fnv from h""")
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The FNV-1a hash of every whole document."""
    from lodestone.functions.rowlocal import fnv1a_hex

    return read_table(spark, sf_dir, "documents").select("doc_id", fnv1a_hex(F.col("text")).alias("fnv"))


@query("""with f as (select concat(case doc_id % 5 when 0 then 'node_modules/' when 1 then 'src/build/' when 2 then 'lib/building/' else '' end, 'n', doc_id,
case doc_id % 7 when 0 then '.RS' when 1 then '.py' when 2 then '.bin' when 3 then '' when 4 then '.Org' when 5 then '.tar.gz' else '.html' end) as p, text, (doc_id % 3) * 524288 + doc_id % 2 as n from documents)
select p as relative_path, lower(regexp_extract(p, '\\.([^./]*)$', 1)) as extension, lower(regexp_extract(p, '\\.([^./]*)$', 1)) not in ('md', 'txt', 'rst', 'org') as is_code, sha256(text) as content_hash
from f where not list_has_any(string_split(p, '/'), ['node_modules', 'build']) and lower(regexp_extract(p, '\\.([^./]*)$', 1)) in ('rs', 'py', 'org', 'html') and n <= 1048576""")
def scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan would keep of paths made from the documents, and what it derives: folders, sizes, extensions, kinds, hashes."""
    from lodestone.sources.files import derive, indexable

    folder = F.expr("case doc_id % 5 when 0 then 'node_modules/' when 1 then 'src/build/' when 2 then 'lib/building/' else '' end")
    ending = F.expr("case doc_id % 7 when 0 then '.RS' when 1 then '.py' when 2 then '.bin' when 3 then '' when 4 then '.Org' when 5 then '.tar.gz' else '.html' end")
    files = read_table(spark, sf_dir, "documents").select(
        F.concat(folder, F.lit("n"), F.col("doc_id").cast("string"), ending).alias("relative_path"), F.col("text").alias("content"), F.expr("(doc_id % 3) * 524288 + doc_id % 2").alias("n_bytes")
    )
    return derive(indexable(files)).select("relative_path", "extension", "is_code", "content_hash")


@query("select doc_id, unnest(['crate::m' || doc_id, 'crate::net::a', 'crate::net', 'super::s' || (doc_id % 9)]) as specifier from documents")
def rust_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of a Rust file made for each document, with others in comments, strings and raw strings."""
    source = F.concat(
        F.lit("use crate::m"), F.col("doc_id").cast("string"), F.lit(";\n// use crate::comment;\n/* use crate::block;\nuse crate::inner; */\nlet a = \"use crate::text;\\\" use crate::more;\";\nlet b = r#\"\nuse crate::raw;\n\"#;\n"),
        F.lit("use crate::net::{a as b, self, *};\n  use super::s"), (F.col("doc_id") % 9).cast("string"), F.lit(";\n/*\nuse crate::open"),
    )
    files = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), source.alias("content"), F.lit("rs").alias("extension"))
    return extract_imports(files).select(F.col("relative_path").cast("long").alias("doc_id"), "specifier")


@query(f"with {_edges_sql()} select dst as src, src as dst from edges")
def graph_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse(part_edges(spark, sf_dir))


# --- The engine end to end -------------------------------------------------------------------------


def _engine_files(docs: DataFrame, content=None) -> DataFrame:
    """The corpus as rows of a scan."""
    text = F.col("content") if content is None else content
    return docs.select("relative_path", text.alias("content")).select(
        "relative_path", "content", F.regexp_extract("relative_path", r"\.([a-z]+)$", 1).alias("extension"), (~F.col("relative_path").rlike(r"\.(md|txt)$")).alias("is_code"),
        F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash"),
    )


def _engine(spark: SparkSession, label: str, **more):
    from lodestone.plans.engine import Engine

    return Engine(spark, f"{Scratch(spark, label).path}/warehouse", **more)


def _two_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus before and after: some documents go, some come, some change."""
    docs = corpus(spark, sf_dir)
    later = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit(" x"))).otherwise(F.col("content"))
    return _engine_files(docs.where("doc_id % 11 <> 0")), _engine_files(docs.where("doc_id % 13 <> 0"), later)


@query(f"""with recursive {_CHUNKS_SQL}, n as ({CORPUS_SQL} where doc_id % 13 <> 0), t as (select path, doc_id, case when doc_id % 7 = 0 then content || ' x' else content end as content from n),
k as (select path, content, {TOKENS_SQL.format('content')} as toks, doc_id from t)
select 'manifest' as what, path, sha256(content) as value from k
union all select 'terms', path, (len(toks) + 3)::varchar from k
union all select 'length', path, len(toks)::varchar from k
union all select 'vectors', path, (select count(*) from chunks where relative_path = path)::varchar from k where doc_id % 11 <> 0 and doc_id % 7 <> 0 and content <> ''""")
def engine_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's tables after a build with embeddings and a refresh without a model, which drops what is stale."""
    from lodestone.plans.engine import Engine

    before, after = _two_states(spark, sf_dir)
    engine = _engine(spark, "refresh", provider=vectors.HashedWords)
    engine.refresh(before)
    Engine(spark, engine.warehouse.folder).refresh(after)
    read = engine.warehouse.read
    return (
        read("manifest").select(F.lit("manifest").alias("what"), F.col("relative_path").alias("path"), F.col("content_hash").alias("value"))
        .unionByName(read("postings").groupBy(F.col("relative_path").alias("path")).agg(F.sum("tf").cast("string").alias("value")).withColumn("what", F.lit("terms")))
        .unionByName(read("field_stats").where("field = 'content'").select(F.lit("length").alias("what"), F.col("relative_path").alias("path"), F.col("len").cast("string").alias("value")))
        .unionByName(read("vectors").groupBy(F.col("relative_path").alias("path")).agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("what", F.lit("vectors")))
    )


@query("""with n as (select concat('m/d', doc_id, '.ts') as path, case when doc_id % 7 = 0 then (doc_id * 5 + 1) % 997 else (doc_id * 7 + 3) % 997 end as t from documents where doc_id % 13 <> 0)
select distinct a.path as src, b.path as dst from n a join n b on b.path = concat('m/d', a.t, '.ts') where a.path <> b.path""")
def engine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependency edges of generated modules after a build, a refresh and an upsert; only changed files are parsed."""
    def state(where: str, target: str) -> DataFrame:
        body = F.concat(F.lit("import x from './d"), F.expr(target).cast("string"), F.lit("';\n"))
        docs = read_table(spark, sf_dir, "documents").where(where).select(F.concat(F.lit("m/d"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("relative_path"), body.alias("content"))
        return _engine_files(docs)

    engine, changed = _engine(spark, "edges"), "case when doc_id % 7 = 0 then (doc_id * 5 + 1) % 997 else (doc_id * 7 + 3) % 997 end"
    engine.refresh(state("doc_id % 11 <> 0", "(doc_id * 7 + 3) % 997"))
    engine.refresh(state("doc_id % 13 <> 0 and doc_id % 17 <> 0", changed))
    engine.apply(state("doc_id % 13 <> 0 and doc_id % 17 = 0", changed), state("doc_id % 13 = 0", changed).select("relative_path"))
    return engine.warehouse.read("edges")


def _content_score(words: tuple[str, ...]) -> str:
    """Tables for SQL: docs, and score (path, w, s) of each content word."""
    rows = ", ".join(f"('{w}')" for w in words)
    return f"""docs as ({CORPUS_SQL}), tokens as (select path, kind, content, doc_id, {TOKENS_SQL.format('content')} as toks from docs), words(w) as (values {rows}),
stats as (select count(*) as n, avg(len(toks)) as mean from tokens), tf as (select path, len(toks) as len, w, len(list_filter(toks, lambda t: t = w)) as tf from tokens cross join words),
df as (select w, count(*) as df from tf where tf > 0 group by w),
score as (select path, w, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) as s from tf join df using (w) cross join stats where tf > 0),
pairs as (select distinct path from (select path, unnest(toks) as t, generate_subscripts(toks, 1) as p from tokens) a join (select path, unnest(toks) as t, generate_subscripts(toks, 1) as p from tokens) b using (path) where b.p = a.p + 1 and a.t = 'the' and b.t = 'and')"""


@query(f"""with {_content_score(('the', 'and', 'keit', 'lich'))},
hits as (select path, sum(s) as score from (select path, s from score where w = 'keit' union all select path, s from score join pairs using (path) where w in ('the', 'and')) group by path),
top as (select path, score, content from hits join docs using (path) where kind = 'code' and path not in (select path from score where w = 'lich') order by score desc, path limit 10),
l as (select path, score, string_split(regexp_replace(content, '\n$', ''), chr(10)) as lines from top),
s as (select *, list_transform(lines, lambda x: (case when contains(lower(x), '"the') then 1 else 0 end) + (case when contains(lower(x), 'and"') then 1 else 0 end) + (case when contains(lower(x), 'keit') then 1 else 0 end)
  + (case when contains(lower(x), '-lich') then 1 else 0 end)) as found from l),
b as (select *, list_position(found, list_max(found)) - 1 as best from s)
select path, round(score, 6) as score, array_to_string(lines[greatest(best - 5, 0) + 1 : greatest(best - 5, 0) + 15], chr(10)) as snippet from b""")
def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine end to end: index the corpus, then search it with a query of several clauses."""
    engine = _engine(spark, "engine")
    engine.refresh(_engine_files(corpus(spark, sf_dir)))
    return engine.search('"the and" keit -lich', "code", 10).select("path", F.round("score", 6).alias("score"), "snippet")


@query(f"""with {_content_score(('the', 'keit', 'ionea', 'and'))}, names as (select path, {RUNS_SQL.format("split_part(path, '/', 4)")} as toks from docs),
nstats as (select count(*) as n, avg(len(toks)) as mean from names), ndf as (select count(*) as df from names where list_contains(toks, 'rs')),
nscore as (select path, 3 * 6 * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(toks) / mean)) as s from names cross join nstats cross join ndf where list_contains(toks, 'rs')),
grp as (select path, sum(s) as s from (select path, 2 * s as s from score where w = 'keit' union all select path, 2 * s from score where w = 'ionea' union all select path, s from nscore) group by path),
hits as (select path, sum(s) as score from (select path, s from score where w = 'the' union all select path, s from grp) group by path)
select path, round(score, 6) as score from hits join docs using (path) where path in (select path from score where w = 'the') and path in (select path from grp) and path not in (select path from pairs)
order by score desc, path limit 25""")
def engine_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required, excluded, grouped and boosted clauses over several fields."""
    engine = _engine(spark, "boolean")
    engine.refresh(_engine_files(corpus(spark, sf_dir)))
    hits = engine.bm25('the AND ((keit OR ionea)^2 basename:rs^3) -"the and"', None, 25)
    return hits.select(F.col("relative_path").alias("path"), F.round("score", 6).alias("score"))


@query(f"with {_edges_sql()} select (select count(*) from documents) as documents, (select count(*) from embeddings) as vectors, (select count(*) from edges) as edges, case when (select count(*) from documents) = 0 then 'empty' else 'hybrid' end as readiness")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = status_row(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "embeddings"), part_edges(spark, sf_dir))
    return row.withColumn("readiness", readiness(F.col("documents"), F.lit(True), F.lit(False)))


#: Paths and their normal form.
PATHS = [
    ("src/./a@//b/../#.rs", "src/a@/#.rs"), ("../../#@", "#@"), ("a@/#/../../..", ""), ("", ""), ("node_modules/r/#@.js", "node_modules/r/#@.js"), ("src/.git/#", "src/.git/#"),
    ("lib@/Utils#.TS", "lib@/Utils#.TS"), (".#@", ".#@"), ("x/target/#.rs", "x/target/#.rs"), ("./@/../#/./y.md", "#/y.md"), ("targets/#.tar.gz", "targets/#.tar.gz"),
]


@query(f"""select doc_id, k, p, list_has_any(string_split(p, '/'), ['node_modules', 'target', '.git', '.archive', '__pycache__', '.venv', 'vendor', 'dist', 'build', '.next', '.lodestone']) as skipped,
lower(regexp_extract(string_split(p, '/')[-1], '[^.].*\\.([^.]*)$', 1)) as ext from {_made_sql([(p,) for p, _ in PATHS], "p")} t""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped folders and extensions."""
    from lodestone.sources.files import extension_of, should_skip

    return _made(spark, sf_dir, [(p,) for p, _ in PATHS], "p").select("doc_id", "k", "p", should_skip(F.col("p")).alias("skipped"), extension_of(F.col("p")).alias("ext"))


@query(f"select doc_id, k, p, normal from {_made_sql(PATHS, 'p normal')} t")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without empty parts, dots and steps up."""
    return _made(spark, sf_dir, [(p,) for p, _ in PATHS], "p").select("doc_id", "k", "p", analyze.normalize_path(F.col("p")).alias("normal"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(analyze.norm(F.col("embedding")), 6).alias("norm"))


@query("select doc_id, sha256(text) as content_hash, strlen(text) // 4 as tokens from documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and estimated size of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), analyze.estimated_tokens(F.col("text")).alias("tokens"))
