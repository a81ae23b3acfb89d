"""The catalogue of registered queries and their SQL.

documents serve as pages (source as the book and category), conversations as
book rows, whose user turns start chapters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paginal.functions import text as T
from paginal.functions.query import parse
from paginal.operators import annotations, books, index, search, snippets
from paginal.operators.prefix import dense_number, dense_number_apart
from paginal.sources.sqlite_books import book_database, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, numbered by their ids."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "source", "text")


def _book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their sources, numbered by source, then id."""
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_number"), "text")
    return dense_number_apart(docs, "book_id", "page_number", "page_id")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.occurrences(_pages(spark, sf_dir))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.page_postings(_pages(spark, sf_dir))


def _book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _table(spark, sf_dir, "conversations")
    return talk.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("id"), F.floor(F.col("turn") / 2).alias("page"), F.col("text").alias("nass"))


def _turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _table(spark, sf_dir, "conversations").where(F.col("text") != "")
    pages = talk.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_number")).distinct()
    return dense_number(pages, "book_id", ["page_number"], "page_id")


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _table(spark, sf_dir, "conversations").where((F.col("text") != "") & (F.col("role") == "user"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    return talk.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("start_page"), F.row_number().over(order).alias("chapter_number"))


# Shared pieces of SQL.  DuckDB's classes start at \x01: NUL does not occur in its text.
NORM = r"translate(regexp_replace(text,'[\x{064B}-\x{065F}\x{06D6}-\x{06ED}]','','g'),'آأإٱىة','اااايه')"
SPLIT = r"list_filter(string_split_regex(%s,'[\x01-\x20,.;:!?" + '"' + r"''()\[\]{}\-_/\\+=*&%%$#@<>]+'), lambda x: x <> '')"
TOKENS, RAW_TOKENS = SPLIT % NORM, SPLIT % "text"
PAGES = f"tok as materialized (select doc_id page_id, source, text, {TOKENS} ws from documents where text <> '')"
OCC = f"{PAGES}, occ as materialized (select page_id, source, unnest(ws) term, generate_subscripts(ws, 1) - 1 pos from tok)"
BOOK_PAGES = "bp as materialized (select source book_id, doc_id page_number, text, row_number() over (order by source, doc_id) - 1 page_id from documents)"


def _hits_sql(terms: tuple[str, ...]) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""{OCC}, terms(idx, term) as (values {values}),
hit as materialized (select t.idx, o.page_id, o.source, o.pos from occ o join terms t on o.term = t.term),
post as (select idx, page_id, count(*) tf from hit group by idx, page_id)"""


def _rank_sql(line: str) -> str:
    q = parse(line)
    k = len(q.terms)
    both = q.mode == "and"
    bonus = "case when ph.page_id is not null then 5 else 0 end" if both and k > 1 else "0"
    return f"""{_hits_sql(q.terms)},
dfs as (select idx, count(*) df from post group by idx),
n as (select count(distinct page_id) n from post),
freq as (select p.page_id, sum(cast(n.n as double) / cast(d.df as double) * p.tf) f, count(*) nt
         from post p join dfs d on p.idx = d.idx cross join n group by p.page_id),
gap as (select a.page_id, a.idx, min(abs(a.pos - b.pos)) best from hit a join hit b on a.page_id = b.page_id and b.idx = a.idx + 1 group by a.page_id, a.idx),
prox as (select page_id, sum(1.0e0 / (1.0e0 + best)) p from gap group by page_id),
phr as (select distinct page_id from (select page_id from hit group by page_id, pos - idx having count(distinct idx) = {k}) x),
ranked as (select f.page_id, round(f.f + 2 * coalesce(p.p, 0) + {bonus}, 6) score
           from freq f left join prox p on f.page_id = p.page_id left join phr ph on f.page_id = ph.page_id {f"where f.nt = {k}" if both else ""})"""


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- text functions


@_register("normalize_documents", f"select doc_id, {NORM} as normalized from documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("normalized"))


LITERALS = ["آأإاىةَ", "آحمد يس", "والكتاب", "فالبيت", "كتابهما", "مدرسة", "ال", "يكتبون", "بالمدرسات", "سيكتبها", "ولد", "a,b-c D"]
_LITERAL_SQL = "(values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(LITERALS)) + ") v(id, text)"


def _literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LITERALS)), "id int, text string")


@_register("normalize_literals", f"select id, {NORM} as normalized from {_LITERAL_SQL}")
def normalize_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark).select("id", T.normalize("text").alias("normalized"))


def _stem_sql() -> str:
    size = "octet_length(encode({0}))"
    pre = " ".join(f"when starts_with(text,'{p}') and {size.format('text')} >= {len(p.encode()) + 4} then substr(text,{len(p) + 1})" for p in T.PREFIXES)
    suf = " ".join(f"when ends_with(b,'{s}') and {size.format('b')} >= {len(s.encode()) + 4} then left(b,length(b)-{len(s)})" for s in T.SUFFIXES)
    return f"select id, case when {size.format('text')} <= 4 then text else case {suf} else b end end as stem from (select id, text, case {pre} else text end b from {_LITERAL_SQL})"


@_register("light_stem_literals", _stem_sql())
def light_stem_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark).select("id", T.light_stem("text").alias("stem"))


@_register("tokenize_documents", f"with {OCC} select page_id, cast(pos as integer) as pos, term from occ")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occurrences(spark, sf_dir).select("page_id", "pos", "term")


@_register(
    "tokenize_raw",
    f"select doc_id page_id, cast(generate_subscripts(ws, 1) - 1 as integer) as pos, unnest(ws) as term from (select doc_id, {RAW_TOKENS} ws from documents where text <> '')",
)
def tokenize_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where(F.col("text") != "").select("page_id", F.posexplode(T.raw_tokens("text")).alias("pos", "term"))


_RAW_LITERALS = ["آحمد يَس", "ةَ,b-C", "  x  ", "", "«q»", "ال.كتاب"]
_RAW_SQL = "(values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_RAW_LITERALS)) + ") v(id, text)"


@_register("tokenize_raw_literals", f"select id, array_to_string({RAW_TOKENS}, '|') as raw, array_to_string({TOKENS}, '|') as folded from {_RAW_SQL}")
def tokenize_raw_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose raw and folded tokens differ."""
    rows = spark.createDataFrame(list(enumerate(_RAW_LITERALS)), "id int, text string")
    return rows.select("id", F.array_join(T.raw_tokens("text"), "|").alias("raw"), F.array_join(T.tokens("text"), "|").alias("folded"))


def _stem_words_sql() -> str:
    size = "octet_length(encode({0}))"
    listed = lambda words: ", ".join(f"('{w}')" for w in words)
    pre = " ".join(f"when starts_with(w,'{p}') and {size.format('w')} >= {len(p.encode()) + 4} then substr(w,{len(p) + 1})" for p in T.PREFIXES)
    suf = " ".join(f"when ends_with(b,'{s}') and {size.format('b')} >= {len(s.encode()) + 4} then left(b,length(b)-{len(s)})" for s in T.SUFFIXES)
    words = f"select p || m || s w from (values (''), {listed(T.PREFIXES)}) a(p), (values {listed(_STEMS)}) b(m), (values (''), {listed(T.SUFFIXES)}) c(s)"
    return f"select w as word, case when {size.format('w')} <= 4 then w else case {suf} else b end end as stem from (select w, case {pre} else w end b from ({words}))"


_STEMS = ["كتب", "ع", "مدرس", "ول", "x"]


@_register("light_stem_words", _stem_words_sql())
def light_stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix and suffix around stems of one to four letters."""
    words = [(p + m + s,) for p in ("", *T.PREFIXES) for m in _STEMS for s in ("", *T.SUFFIXES)]
    return spark.createDataFrame(words, "word string").select("word", T.light_stem("word").alias("stem"))


_BROWSER_WORDS = "list_filter(string_split_regex(text, '[" + T.BROWSER_SPACE + "]+'), lambda x: x <> '')"


@_register("browser_words", f"select doc_id as page_id, cast(len(ws) as integer) as n, array_to_string(ws, ' ') as words from (select doc_id, {_BROWSER_WORDS} ws from documents)")
def browser_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _pages(spark, sf_dir).select("page_id", T.browser_words("text").alias("w"))
    return words.select("page_id", F.when(F.col("w").isNotNull(), F.size("w")).alias("n"), F.array_join("w", " ").alias("words"))


# 64-bit FNV-1a needs wrapping products; SQL has them as 128-bit products cut by a modulus.
_M = "18446744073709551616::uhugeint"
HASH_SQL = f"""with {OCC}, w as (select distinct term from occ),
b as (select term, unnest(range(octet_length(encode(term)))) i from w),
bytes as (select term, i, cast('0x' || substr(hex(encode(term)), 2 * i + 1, 2) as utinyint) v from b),
l as (select term, list(v order by i) vs from bytes group by term),
f as (select term, list_reduce(list_prepend({T.FNV_OFFSET}::uhugeint, list_transform(vs, lambda v: v::uhugeint)),
      lambda h, v: (xor(h, v) * {T.FNV_PRIME}::uhugeint) % {_M}) h from l),
m1 as (select term, xor(h, h >> {T.FINAL_SHIFT}) h from f), m2 as (select term, ((h % 4294967296::uhugeint) * {T.FINAL_1}::uhugeint + ((((h >> 32) * {T.FINAL_1}::uhugeint) % 4294967296::uhugeint) << 32)) % {_M} h from m1),
m3 as (select term, xor(h, h >> {T.FINAL_SHIFT}) h from m2), m4 as (select term, ((h % 4294967296::uhugeint) * {T.FINAL_2}::uhugeint + ((((h >> 32) * {T.FINAL_2}::uhugeint) % 4294967296::uhugeint) << 32)) % {_M} h from m3)
select term, cast(xor(h, h >> {T.FINAL_SHIFT}) as decimal(20, 0)) as word_hash from m4"""


@_register("hash_terms", HASH_SQL)
def hash_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.vocabulary(index.page_terms(_pages(spark, sf_dir))).select("term", T.hash64("term").alias("word_hash"))


@_register("hash_collisions", "select cast(0 as decimal(20,0)) as word_hash, cast(0 as bigint) as n_terms where false")
def hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.hash_collisions(index.page_terms(_pages(spark, sf_dir))).select("word_hash", F.size("terms").cast("long").alias("n_terms"))


# --- index


@_register("vocabulary", f"with {OCC} select distinct term from occ")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.vocabulary(index.page_terms(_pages(spark, sf_dir)))


_POST = "post as (select term, page_id, cast(count(*) as integer) tf, list(cast(pos as integer) order by pos) positions from occ group by term, page_id)"


@_register("postings", f"with {OCC}, {_POST} select term, page_id, tf, array_to_string(positions, ',') as positions from post")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _postings(spark, sf_dir)
    return found.withColumn("positions", F.array_join("positions", ","))


@_register(
    "posting_deltas",
    f"""with {OCC}, {_POST}
select term, page_id, page_id - coalesce(lag(page_id) over (partition by term order by page_id), 0) as page_delta, tf,
       array_to_string(list_transform(range(1, len(positions) + 1), lambda i: positions[i] - case when i > 1 then positions[i - 1] else 0 end), ',') as position_deltas from post""",
)
def posting_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.encode_deltas(_postings(spark, sf_dir))
    return found.withColumn("position_deltas", F.array_join("position_deltas", ","))


@_register("posting_decode", SQL["postings"])
def posting_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.decode_deltas(index.encode_deltas(_postings(spark, sf_dir), starts=True))
    return found.withColumn("positions", F.array_join("positions", ","))


_DICT = "dict as (select term, count(*) cf, count(distinct page_id) df from occ group by term)"


@_register("dictionary_df_cf", f"with {OCC}, {_DICT} select term, cf, df from dict")
def dictionary_df_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.posting_dictionary(_postings(spark, sf_dir))


@_register(
    "stored_dictionary",
    f"""with hashed as ({HASH_SQL}), {OCC}, {_DICT}
select term, word_hash, cf, df, 4 + 8 * df + 4 * cf as block_bytes,
       cast(52 + coalesce(sum(8 + 8 * df + 4 * cf) over (order by word_hash rows between unbounded preceding and 1 preceding), 0) as bigint) as postings_offset
from dict join hashed using (term)""",
)
def stored_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stored_dictionary(index.posting_dictionary(_postings(spark, sf_dir))).drop("block_index")


@_register(
    "posting_blocks",
    f"""with hashed as ({HASH_SQL}), {OCC}, {_DICT}
select row_number() over (order by word_hash) - 1 as block_index, cast(52 + coalesce(sum(8 + 8 * df + 4 * cf) over (order by word_hash rows between unbounded preceding and 1 preceding), 0) as bigint) as postings_offset,
       4 + 8 * df + 4 * cf as stored_bytes, cast(0 as bigint) as plain_bytes, cast(1 as double) as ratio from dict join hashed using (term)""",
)
def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stored_blocks(index.stored_dictionary(index.posting_dictionary(_postings(spark, sf_dir))))


@_register("occurrence_postings", SQL["postings"])
def occurrence_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings from occurrences in any order, as incremental indexing has them."""
    found = index.postings(_occurrences(spark, sf_dir))
    return found.withColumn("positions", F.array_join("positions", ","))


@_register(
    "posting_block_stats",
    f"""with {OCC}, {_DICT} select count(*) as blocks, cast(sum(cf) as bigint) as occurrences, cast(sum(4 + 8 * df + 4 * cf) as bigint) as block_bytes,
cast(sum(8 + 8 * df + 4 * cf) as bigint) as stored_bytes, max(4 + 8 * df + 4 * cf) as largest_block from dict""",
)
def posting_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.block_stats(index.posting_dictionary(_postings(spark, sf_dir)))


@_register(
    "occurrence_sorted_rank",
    f"with {OCC} select term, page_id, cast(pos as integer) as pos, row_number() over (order by term, page_id, pos) as rank from occ",
)
def occurrence_sorted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sorted_occurrences(_postings(spark, sf_dir))


# --- books


@_register(
    "page_assembly",
    """select row_number() over (order by book_id, page_number) - 1 as page_id, book_id, page_number, text from (
select conv_id book_id, turn // 2 page_number, string_agg(text, chr(10) order by turn, text) || chr(10) as text from conversations where text <> '' group by conv_id, turn // 2)""",
)
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.assemble_pages(_book_rows(spark, sf_dir))


_LAYOUT = f"""{BOOK_PAGES}, lay as (select page_id, book_id, octet_length(encode(text)) length,
cast(coalesce(sum(octet_length(encode(text))) over (order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) text_offset from bp)"""


@_register("block_layout", f"with {_LAYOUT} select page_id, book_id, length, text_offset, text_offset // 65536 as block_id, text_offset % 65536 as offset_in_block from lay")
def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.block_layout(_book_pages(spark, sf_dir))


@_register(
    "book_summary",
    f"with {_LAYOUT} select book_id, count(*) as page_count, min(page_id) as first_page_id, min(text_offset) as text_start, max(text_offset + length) as text_end from lay group by book_id",
)
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.book_summary(_book_pages(spark, sf_dir))


_CHAPTERS = """r as (select conv_id book_id, turn page, role from conversations where text <> ''),
pg as (select book_id, page, row_number() over (order by book_id, page) - 1 page_id from (select distinct book_id, page from r)),
ttl as (select book_id, page st, row_number() over (partition by book_id order by page) cn from r where role = 'user'),
ch as (select book_id, cn, st, min(st) over (partition by book_id order by st range between 1 following and unbounded following) nx from ttl)"""


@_register(
    "chapter_assignment",
    f"""with {_CHAPTERS}, j as (select pg.book_id, pg.page, ch.cn, row_number() over (partition by pg.book_id, pg.page order by ch.cn desc nulls last) rn
from pg left join ch on ch.book_id = pg.book_id and pg.page >= ch.st and (ch.nx is null or pg.page < ch.nx))
select book_id, page as page_number, cast(coalesce(cn, 0) as integer) as chapter_number from j where rn = 1""",
)
def chapter_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.assign_chapters(_turn_pages(spark, sf_dir), _chapters(spark, sf_dir))


@_register(
    "chapter_ranges",
    f"""with {_CHAPTERS} select ch.book_id, cast(ch.cn as integer) as chapter_number, ch.st as start_page, min(page_id) as first_page_id, count(page_id) as page_count
from ch left join pg on ch.book_id = pg.book_id and pg.page >= ch.st and (ch.nx is null or pg.page < ch.nx) group by all""",
)
def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.chapter_ranges(_turn_pages(spark, sf_dir), _chapters(spark, sf_dir))


@_register(
    "chapter_numbering",
    """select row_number() over (order by conv_id, turn, text) - 1 as chapter_id, conv_id as book_id,
cast(row_number() over (partition by conv_id order by turn, text) as integer) as chapter_number, turn as start_page, text as title
from conversations where role = 'user' and text <> ''""",
)
def chapter_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    titles = talk.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("id"), F.col("text").alias("tit"), F.lit(1).alias("lvl"), F.lit(0).alias("sub"))
    return books.number_chapters(titles).select("chapter_id", "book_id", "chapter_number", "start_page", "title")


@_register(
    "next_page",
    f"with {BOOK_PAGES} select page_id, lead(page_id) over (partition by book_id order by page_id) as next_page_id, length(lead(text) over (partition by book_id order by page_id)) as next_length from bp",
)
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snippets.with_next_page(_book_pages(spark, sf_dir))
    size = F.length("next_text").cast("long")
    return found.select("page_id", F.when(size.isNotNull(), F.col("page_id") + 1).alias("next_page_id"), size.alias("next_length"))


@_register("book_author_bridge", "select distinct doc_id as book_id, quality as author_id from labels where quality <> 0")
def book_author_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return books.book_authors(labels.select(F.col("doc_id").alias("bkid"), F.col("quality").alias("authno")))


@_register(
    "book_meta_lookup",
    """select d.doc_id as book_id, case when l.doc_id is not null then 'q' || l.quality end as title, case when l.quality = 1 then 'toxic ' || l.toxic end as category
from documents d left join (select doc_id, min(quality) quality, min(toxic) toxic from labels group by doc_id) l on l.doc_id = d.doc_id""",
)
def book_meta_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books, labels as their metadata; only quality 1 names a category."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"))
    labels = _table(spark, sf_dir, "labels")
    none = F.lit(None).cast("string")
    meta = labels.select(
        F.col("doc_id").alias("bkid"), F.concat(F.lit("q"), "quality").alias("bk"), F.when(F.col("quality") == 1, F.col("toxic")).alias("cat"),
        none.alias("betaka"), none.alias("inf"), F.lit(None).cast("int").alias("authno"),
    )
    names = labels.select(F.col("toxic").alias("id"), F.concat(F.lit("toxic "), "toxic").alias("cat")).distinct()
    people = spark.createDataFrame([], "authid int, auth string")
    return books.book_metadata(docs, meta, names, people).select("book_id", "title", "category")


@_register(
    "book_meta_first",
    """select conv_id as book_id, arg_min(text, turn) as title, arg_min(role, turn) as category from conversations group by conv_id""",
)
def book_meta_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books with a row of metadata for each turn: the first one counts."""
    talk = _table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    kind = F.when(F.col("role") == "user", 1).otherwise(2)
    meta = talk.select(
        F.col("conv_id").alias("bkid"), F.col("text").alias("bk"), F.crc32("role").alias("cat"), none.alias("betaka"), none.alias("inf"), kind.alias("authno"), F.col("conv_id").alias("book_id"), F.col("turn").alias("seq")
    )
    names = talk.select(F.crc32("role").alias("id"), F.col("role").alias("cat")).distinct()
    people = spark.createDataFrame([], "authid int, auth string")
    found = books.book_metadata(talk.select(F.col("conv_id").alias("book_id")).distinct(), meta, names, people)
    return found.select("book_id", "title", "category")


@_register(
    "sqlite_book_rows",
    "select conv_id as book_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as seq, text as nass, cast(turn as integer) as id, cast(turn // 2 as integer) as page, role as part from conversations",
)
def sqlite_book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as one book database each, and read again."""
    talk = _table(spark, sf_dir, "conversations")
    rows = talk.select(F.col("conv_id").alias("book_id"), F.struct("turn", "role", "text").alias("row"))
    whole = rows.groupBy("book_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [book_database({"book": [(r["text"], r["turn"], r["turn"] // 2, r["role"]) for r in rows]}) for rows in batch["rows"]]
            yield pd.DataFrame({"book_id": batch["book_id"], "content": pd.Series(made, dtype=object)})

    files = whole.mapInPandas(pack, "book_id long, content binary")
    return read_table(files, "book").select("book_id", "seq", "nass", "id", "page", "part")


@_register("book_chapter_counts", "select conv_id as book_id, count(distinct turn) as page_count, count(distinct turn) filter (where role = 'user') as chapter_count from conversations where text <> '' group by conv_id")
def book_chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _turn_pages(spark, sf_dir).withColumn("text", F.lit("x"))
    return books.book_summary(pages, _chapters(spark, sf_dir)).select("book_id", "page_count", "chapter_count")


@_register("page_text_lookup", "select doc_id as page_id, text from documents where doc_id in (3, 57, 100, 999)")
def page_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.page_text(_pages(spark, sf_dir), [3, 57, 100, 999]).select("page_id", "text")


# --- search


def _matches(spark: SparkSession, sf_dir: str, terms: tuple[str, ...]) -> DataFrame:
    return search.matches_in_pages(_pages(spark, sf_dir).drop("source"), terms)


@_register("term_lookup", f"with {_hits_sql(('the',))} select page_id, cast(tf as integer) as tf from post")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_pages(_matches(spark, sf_dir, ("the",)))


@_register("and_two_terms", f"with {_hits_sql(('the', 'of'))} select page_id, cast(sum(tf) as bigint) as tf from post group by page_id having count(*) = 2")
def and_two_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.intersect(_matches(spark, sf_dir, ("the", "of")), ("the", "of"))


@_register("or_two_terms", f"with {_hits_sql(('the', 'of'))} select page_id, cast(sum(tf) as bigint) as tf from post group by page_id")
def or_two_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.union(_matches(spark, sf_dir, ("the", "of")), ("the", "of"))


@_register(
    "phrase_two_terms_tf",
    f"with {_hits_sql(('the', 'of'))} select a.page_id, count(*) as tf from hit a join hit b on a.idx = 0 and b.idx = 1 and a.page_id = b.page_id and b.pos = a.pos + 1 group by a.page_id",
)
def phrase_two_terms_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.adjacent(_matches(spark, sf_dir, ("the", "of")))


def _phrase_sql(terms: tuple[str, ...], by: str = "") -> str:
    return f"with {_hits_sql(terms)} select distinct {by} page_id from (select {by} page_id from hit group by {by} page_id, pos - idx having count(distinct idx) = {len(terms)})"


@_register("phrase_three_terms", _phrase_sql(("the", "of", "the")))
def phrase_three_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ("the", "of", "the")
    return search.phrase(_matches(spark, sf_dir, terms), terms)


@_register("phrase_by_category", _phrase_sql(("the", "of"), "source,").replace("select distinct source,", "select distinct source as category,"))
def phrase_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase_by_category(_pages(spark, sf_dir).withColumnRenamed("source", "category"), "the of", "category")


@_register(
    "term_weights",
    f"""with {_hits_sql(('the', 'of', 'zzzunknown'))} select cast(t.idx as integer) as idx, t.term, count(p.page_id) as df,
case when count(p.page_id) > 0 then cast((select count(distinct page_id) from post) as double) / count(p.page_id) else 0.0 end as weight
from terms t left join post p on p.idx = t.idx group by t.idx, t.term""",
)
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ("the", "of", "zzzunknown")
    return search.term_weights(_matches(spark, sf_dir, terms), terms)


@_register(
    "proximity",
    f"with {_hits_sql(('and', 'of'))} select a.page_id, cast(min(abs(a.pos - b.pos)) as integer) as distance from hit a join hit b on a.idx = 0 and b.idx = 1 and a.page_id = b.page_id group by a.page_id",
)
def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matches(spark, sf_dir, ("and", "of"))
    return found.select("page_id", search.nearest("p0", "p1").alias("distance")).where(F.col("distance").isNotNull())


def _rank_query(name: str, line: str) -> None:
    @_register(name, f"with {_rank_sql(line)} select page_id, score from ranked where score > 0")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.search_pages(_pages(spark, sf_dir).drop("source"), line)
        return found.select("page_id", F.round("score", 6).alias("score"))


for _name, _line in {
    "rank_and_2": "the of", "rank_and_3": "the of and", "rank_or_2": "in OR to", "rank_or_3": "the OR of OR and", "rank_one_term": "the",
    "rank_dup_term": "the the", "rank_unknown_term": "the zzzunknown", "rank_or_unknown": "the OR zzzunknown",
}.items():
    _rank_query(_name, _line)


@_register("rank_from_postings", SQL["rank_and_3"])
def rank_from_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_postings(_postings(spark, sf_dir), "the of and")
    return found.select("page_id", F.round("score", 6).alias("score"))


def _page_2_sql(line: str, offset: int, limit: int) -> str:
    return f"with {_rank_sql(line)} select page_id, score from ranked where score > 0 order by score desc, page_id limit {limit} offset {offset}"


@_register("rank_page_2", _page_2_sql("the of", 10, 10))
def rank_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_pages(_pages(spark, sf_dir).drop("source"), "the of").select("page_id", F.round("score", 6).alias("score"))
    return search.top(found, 10, 10)


@_register("candidate_pages", f"with {_hits_sql(('the', 'of'))} select distinct page_id from post")
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, ("the", "of")).select("page_id")


@_register("term_postings", f"with {OCC}, {_POST} select page_id, tf, array_to_string(positions, ',') as positions from post where term = 'of'")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.postings(_occurrences(spark, sf_dir).where(F.col("term") == "of"))
    return found.select("page_id", "tf", F.array_join("positions", ",").alias("positions"))


@_register("browser_phrase", _phrase_sql(("the", "of")))
def browser_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.browser_phrase(_postings(spark, sf_dir), " the\u2003of ")


@_register("result_lines", f"with {_rank_sql('the of')} select page_id || ' ' || printf('%.6f', score) as line from ranked where score > 0")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_pages(_pages(spark, sf_dir).drop("source"), "the of")
    return search.result_lines(found.select("page_id", F.round("score", 6).alias("score")))


# --- snippets


def _snippet_query(name: str, line: str, kinds: tuple[str, ...], exact_only: bool = False) -> None:
    """Kinds, places and contexts of all ranked pages for a line, over book pages."""
    q = parse(line)
    raw = line.replace("'", "''")
    words = ", ".join(f"'{w}'" for w in q.words)
    ranked = _rank_sql(line).replace("tok as materialized (select doc_id page_id, source, text,", f"{BOOK_PAGES}, tok as materialized (select page_id, book_id source, text,").replace(
        "ws from documents where text <> '')", "ws from bp where text <> '')"
    )
    wanted = ", ".join(f"'{k}'" for k in kinds)
    sql = f"""with {ranked},
near as (select b.page_id, b.book_id, b.text, n.text nt from bp b left join bp n on n.page_id = b.page_id + 1 and n.book_id = b.book_id),
hits as (select r.page_id, r.score, b.book_id, b.text, b.nt, strpos(b.text, '{raw}') own from ranked r join near b on b.page_id = r.page_id where r.score > 0),
tk as (select h.*, t.ws, list_position(list_transform(t.ws, lambda w: w in ({words})), true) first_word from hits h join tok t on t.page_id = h.page_id),
k as (select *, case when own > 0 then 'exact' when nt is not null and {_across_sql(raw)} then 'boundary'
      when first_word > 0 then 'token' else 'prefix' end kind from tk)
select page_id, score, kind, case when kind = 'boundary' then page_id + 1 else page_id end as last_page_id,
       case when kind = 'exact' then own when kind = 'token' then first_word else 0 end as place from k where kind in ({wanted})"""

    @_register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = _book_pages(spark, sf_dir)
        hits = search.search_pages(pages.select("page_id", "text"), line)
        found = snippets.snippets(hits, pages, line, exact_only, places=True)
        return found.where(F.col("kind").isin(list(kinds))).select("page_id", F.round("score", 6).alias("score"), "kind", "last_page_id", "place")


def _across_sql(raw: str) -> str:
    """Whether the line is in the last 200 bytes of text and the first 200 of nt, by bytes in hex."""
    needle = raw.replace("''", "'").encode().hex().upper()
    ends = "right(hex(encode(text)), 400) || left(hex(encode(nt)), 400)"
    # An even distance is a whole byte; a search by every start avoids odd ones.
    return f"len(list_filter(range(0, length({ends}) // 2), lambda i: substr({ends}, 2 * i + 1, {len(needle)}) = '{needle}')) > 0"


_snippet_query("snippet_exact", "the of", ("exact",))
_snippet_query("snippet_boundary", "of the", ("boundary",))
_snippet_query("snippet_token", "the OR zzzunknown", ("token",))
_snippet_query("snippet_kinds", "and the", ("exact", "boundary", "token", "prefix"))
_snippet_query("snippet_exact_only", "in the", ("exact", "boundary"), exact_only=True)


_CONTEXT_LINE = "the of"


@_register(
    "snippet_contexts",
    f"""with {BOOK_PAGES}, m as (select page_id, encode(text) raw, octet_length(encode(left(text, strpos(text, '{_CONTEXT_LINE}') - 1))) o from bp where strpos(text, '{_CONTEXT_LINE}') > 0),
x as (select page_id, hex(raw) h, o, greatest(o - 40, 0) l from m)
select page_id, substr(h, 2 * l + 1, 2 * (o - l)) as before_hex, substr(h, 2 * (o + {len(_CONTEXT_LINE)}) + 1, 80) as after_hex from x""",
)
def snippet_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-exact contexts of every page that holds the line."""
    pages = _book_pages(spark, sf_dir)
    hits = pages.where(F.col("text").contains(_CONTEXT_LINE)).select("page_id", F.lit(1.0).alias("score"))
    found = snippets.snippets(hits, pages, _CONTEXT_LINE)
    return found.select("page_id", F.hex("before").alias("before_hex"), F.hex("after").alias("after_hex"))


@_register(
    "snippet_missing",
    """select 2 * d.doc_id as page_id, case when b.doc_id is null or coalesce(b.text, '') = '' then '(failed to load text)' end as snippet
from documents d left join documents b on b.doc_id = 2 * d.doc_id""",
)
def snippet_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of which every other page does not exist."""
    pages = _pages(spark, sf_dir).select("page_id", F.lit(1).alias("book_id"), F.col("page_id").alias("page_number"), "text")
    hits = _pages(spark, sf_dir).select((2 * F.col("page_id")).alias("page_id"), F.lit(1.0).alias("score"))
    found = snippets.snippets(hits, pages, "the of")
    return found.select("page_id", F.when(F.col("kind") == snippets.MISSING, F.col("snippet")).alias("snippet"))


# --- annotations: made from labels, so that every page has some


_DOC = f"doc as (select doc_id g, len({TOKENS}) n from documents where text <> '')"
_FMT = """f as (select doc_id g, 1 i, doc_id % 7 a, doc_id % 7 + 5 + quality * 4 b, 1 + doc_id % 15 fl, quality ly, 0 pr from labels
union all select doc_id, 2, doc_id % 5 + 3, doc_id % 5 + 20 - 30 * toxic, 2 + doc_id % 3, 0, 1 from labels)"""
_HIL = "h as (select doc_id g, 1 i, doc_id % 11 a, doc_id % 11 + 6 b, (case when doc_id % 9 = 0 then 1 else 0 end) fl, 1 + doc_id % 4 co, quality ca from labels union all select doc_id, 2, doc_id % 6 + 2, doc_id % 6 + 9, 0, 7, 2 from labels)"


def _formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    one = labels.select(d.alias("page_id"), F.lit(1).alias("i"), (d % 7).alias("anchor_start"), (d % 7 + 5 + F.col("quality") * 4).alias("anchor_end"), (1 + d % 15).alias("flags"), F.col("quality").alias("layer"), F.lit(0).alias("priority"))
    two = labels.select(d, F.lit(2), d % 5 + 3, d % 5 + 20 - 30 * F.col("toxic"), 2 + d % 3, F.lit(0), F.lit(1))
    return one.union(two)


def _highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    one = labels.select(d.alias("page_id"), F.lit(1).alias("i"), (d % 11).alias("anchor_start"), (d % 11 + 6).alias("anchor_end"), F.when(d % 9 == 0, 1).otherwise(0).alias("flags"), (1 + d % 4).alias("color_id"), F.col("quality").alias("category_id"))
    two = labels.select(d, F.lit(2), d % 6 + 2, d % 6 + 9, F.lit(0), F.lit(7), F.lit(2))
    return one.union(two)


@_register(
    "anno_page_entries",
    f"with {_FMT}, n as (select g, count(*) n from f group by g) select g as page_id, n, cast(coalesce(sum(n) over (order by g rows between unbounded preceding and 1 preceding), 0) as bigint) as first_index from n",
)
def anno_page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.page_entries(_formatting(spark, sf_dir))


@_register("anno_page_counts", f"with {_FMT} select g as page_id, count(*) as n from f group by g")
def anno_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.page_counts(_formatting(spark, sf_dir))


ANNO_SQL = f"""with {_DOC}, {_FMT}, {_HIL},
fe as (select *, case when b > a then b else 2147483647 end e from f),
he as (select *, case when b > a then b else 2147483647 end e from h where fl % 2 = 0),
bp as (select g, 0 p from doc union select g, a from fe union select g, e from fe union select g, a from he union select g, e from he union select g, n from doc),
bb as (select bp.g, p from bp join doc on bp.g = doc.g where p >= 0 and p <= n),
seg as (select g, p s, lead(p) over (partition by g order by p) e from bb), sg as (select g, s, e from seg where e is not null),
tf as (select g, s, fl from (select sg.g, sg.s, fe.fl, row_number() over (partition by sg.g, sg.s order by ly desc, pr desc, fe.a, fe.i) rn
       from sg join fe on fe.g = sg.g and fe.a <= sg.s and sg.s < fe.e) x where rn = 1),
th as (select g, s, co, ca from (select sg.g, sg.s, he.co, he.ca, row_number() over (partition by sg.g, sg.s order by he.a desc, he.i desc) rn
       from sg join he on he.g = sg.g and he.a <= sg.s and sg.s < he.e) x where rn = 1),
st as (select sg.g, sg.s, sg.e, coalesce(tf.fl, 0) % 16 k, coalesce(th.co, 0) co, coalesce(th.ca, 0) ca from sg left join tf on sg.g = tf.g and sg.s = tf.s left join th on sg.g = th.g and sg.s = th.s),
ch as (select *, case when lag(k) over w = k and lag(co) over w = co and lag(ca) over w = ca then 0 else 1 end c from st window w as (partition by g order by s)),
gr as (select *, sum(c) over (partition by g order by s rows between unbounded preceding and current row) isl from ch)
select g as page_id, cast(min(s) as bigint) as "start", cast(max(e) as bigint) as "end", (k & 1) <> 0 as bold, (k & 2) <> 0 as italic, (k & 4) <> 0 as underline, (k & 8) <> 0 as small_caps,
       cast(co as bigint) as color_id, cast(ca as bigint) as category_id from gr group by g, isl, k, co, ca"""


@_register("anno_runs", ANNO_SQL)
def anno_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).where(F.col("text") != "").select("page_id", F.size(T.tokens("text")).alias("n_tokens"))
    runs = annotations.merge_runs(pages, _formatting(spark, sf_dir), _highlights(spark, sf_dir))
    return runs.withColumns({c: F.col(c).cast("long") for c in ("start", "end", "color_id", "category_id")})


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked two-word query over all documents, best first."""
    return search.top(search.search_pages(_pages(spark, sf_dir).drop("source"), "the of"))
