"""One query for each operator of this subpackage, over whole tables.

A query takes (spark, sf_dir) and derives its columns from what its operator returns.  Null handling,
ties and empty inputs are those of the operators; a row whose id is null keeps its null id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.runtime import Scratch, read_table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 5-word shingle similarity of 0.8 or more."""
    from lodestone.llm import jaccard

    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete aligned line blocks that an earlier document has: doc_id, n_lines, n_removed, kept_sha256."""
    from lodestone.llm import lines

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.dedup_lines(documents, Scratch(spark, "op2"), every_holder=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives, read them back as chunk rows, and report each record."""
    from lodestone.llm import warc

    scratch = Scratch(spark, "op3")
    records = warc.plan_records(read_table(spark, sf_dir, "pages"))
    manifest = scratch.table(warc.write_archives(records, f"{scratch.path}/archives"), "manifest")
    chunks = warc.read_archives(manifest, with_data=False)
    return warc.record_digest(chunks)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every whole document: doc_id, n_tokens."""
    from lodestone.llm import unigram

    return unigram.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from lodestone.llm import mainhtml

    pages = mainhtml.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as a lossless image in archives, read them back, and describe the samples."""
    from lodestone.llm import media

    scratch = Scratch(spark, "op6")
    documents = read_table(spark, sf_dir, "documents")
    manifest = scratch.table(media.write_archives(documents, f"{scratch.path}/archives"), "manifest")
    return media.media_digest(media.read_archives(spark, manifest))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from labels outside the held-out fold."""
    from lodestone.llm import quality

    scored = quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE round trip of every document."""
    from lodestone.llm import bpe

    return bpe.round_trip_digest(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every word covered by a 20-word window that also starts earlier."""
    from lodestone.llm import substring

    kept = substring.remove_repeats(read_table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, bm25, question, answer."""
    from lodestone.llm import decontaminate

    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_session_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every session of the turns of conversations, with the version that retracts it."""
    from lodestone.llm import sessions

    turns = read_table(spark, sf_dir, "conversations").where("turn is not null").select("conv_id", "turn")
    checksum = lambda text: F.crc32(F.encode(text, "UTF-8"))
    turns = turns.withColumn("c", checksum(F.col("conv_id").cast("string"))).withColumn("h", checksum(F.concat("conv_id", F.lit(":"), "turn")))
    turns = turns.withColumn("second", F.expr("(c div 2) % 7200 + 300 * turn + h % 600")).withColumn("g", F.expr("h div 600"))
    user = F.expr("2 * ((conv_id - pmod(conv_id, 8L)) div 8) + c % 2").alias("user")
    batch = F.expr("(second - pmod(second, 1800L)) div 1800 + if(g % 3 = 0, g % 4, 0)").alias("batch")
    return sessions.session_versions(turns.select(user, "second", batch, "h"), Scratch(spark, "op11"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document; of every tenth, by a checksum of its id, the words are made periodic first."""
    from lodestone.llm import periodic

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")).alias("h"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # the words go through a lambda variable, so that they are split once and not again for each word
    numbers = F.transform(F.array(words), lambda ws: F.struct(ws.alias("ws"), F.size(ws).cast("long").alias("n"), F.expr("h div 10").alias("g")))
    places = F.transform(numbers, lambda x: F.struct(x["ws"].alias("ws"), x["n"].alias("n"), (x["g"] % x["n"]).alias("a"), F.floor((x["n"] - x["g"] % x["n"]) / (3 + x["g"] % 8) + 1).alias("p")))
    at = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: x["ws"][F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int")])
    made = F.transform(places, lambda x: F.array_join(at(x), " "))[0]
    wordless = ~F.coalesce(F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False))
    planted = documents.where("h % 10 = 0").select("doc_id", F.when(wordless, F.col("text")).otherwise(made).alias("text"))
    plain = documents.where("h % 10 <> 0 or h is null").select("doc_id", "text")
    found = periodic.find_runs(plain.union(planted))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return found.select(
        "doc_id", "n_runs", F.expr("-best.start").alias("start"), F.col("best.length").alias("length"), F.expr("-best.period").alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op13_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row whose vec_id is divisible by 20, among all other rows."""
    from lodestone.llm import forest

    return forest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scratch=Scratch(spark, "op13"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_html_extraction": op5_html_extraction,
    "op6_media": op6_media,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_session_merging": op11_session_merging,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hash_forest": op13_hash_forest,
}
_CRC32_SQL = """xor(4294967295, list_reduce(list_concat(list_value(4294967295::bigint), list_transform(range(8 * length({0})), lambda i: ((ascii({0}[(i // 8)::int + 1]) >> (i % 8)::int) & 1)::bigint)),
  lambda x, bit: xor(x >> 1, 3988292384 * (xor(x, bit) & 1))))"""
_WORDS_SQL = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Where SQL can express an operator.  The others are tested against brute force, the public library or exact round trips.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": f"""
with recursive w as (select doc_id, {_WORDS_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select distinct doc_id, shingle from (select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from w)),
n as (select doc_id, count(shingle) as n from documents left join s using (doc_id) group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from s a join s b using (shingle) join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b),
keys as (select doc_id, list_sort(list(shingle)) as ss from s group by doc_id), classes as (select ss, min(doc_id) as class_id from keys group by ss)
select n.doc_id, n.n as n_shingles, (select min(b) from reach where a = n.doc_id) as component_id, coalesce(c.class_id, n.doc_id) as class_id
from n left join keys k on k.doc_id = n.doc_id left join classes c on c.ss = k.ss""",
    "op3_warc": """
with p as (select page_id, coalesce(html, '') as html from pages), d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
k as (select payload_digest, max(page_id) as keeper from d where payload_bytes >= 1000 group by payload_digest),
j as (select d.*, case when k.keeper > d.page_id then k.keeper end as refers_to from d left join k on k.payload_digest = d.payload_digest and d.payload_bytes >= 1000)
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to,
case when refers_to is null then greatest(1, (payload_bytes + 262143) // 262144) else 1 end as n_chunks from j""",
    "op9_substring_dedup": f"""
with w as (select doc_id, {_WORDS_SQL.format("coalesce(text, '')")} as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from w, unnest(range(1, len(ws) - 18)) t(i)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from windows) where r > 1),
gone as (select distinct doc_id, i + o as p from again, range(0, 20) t(o)),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, len(ws)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (doc_id)""",
    "op11_session_merging": f"""
with t as (select conv_id, turn, {_CRC32_SQL.format("(conv_id::varchar)")} as c, {_CRC32_SQL.format("(conv_id::varchar || ':' || turn::varchar)")} as h from conversations where turn is not null and conv_id is not null),
s as (select 2 * floor(conv_id / 8.0)::bigint + c % 2 as user, (c // 2) % 7200 + 300 * turn + h % 600 as second, h // 600 as g, h from t),
e as (select user, second, floor(second / 1800.0)::bigint + case when g % 3 = 0 then g % 4 else 0 end as batch, h from s),
b as (select distinct user, batch as snap from e),
a as (select e.user, snap, second, batch, h, case when second - lag(second) over (partition by e.user, snap order by second) <= 240 then 0 else 1 end as opens from e join b on b.user = e.user and batch <= snap),
n as (select *, sum(opens) over (partition by user, snap order by second rows unbounded preceding) as k from a),
v as (select user, snap as batch, min(second) as start_s, max(second) as end_s, count(*) as n_events, count(*) filter (batch = snap) as n_new, sum(h)::bigint as h_sum from n group by user, snap, k having n_new > 0),
r as (select o.user, o.batch, o.start_s, min(w.batch) as retracted_batch, arg_min(w.start_s, w.batch) as retracted_start_s from v o join v w on w.user = o.user and w.batch > o.batch and w.start_s <= o.start_s and w.end_s >= o.end_s group by all)
select v.user, v.batch, v.start_s, v.end_s, v.n_events, v.n_new, (select count(*) from r x where x.user = v.user and x.retracted_batch = v.batch and x.retracted_start_s = v.start_s) as n_retracted,
v.h_sum, r.retracted_batch, r.retracted_start_s from v left join r on r.user = v.user and r.batch = v.batch and r.start_s = v.start_s""",
}
