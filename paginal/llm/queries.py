"""The registered queries of this subpackage and their SQL.

Each query applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paginal.llm import idcoder, jaccard, langid, linededup, packing, pii, pseudolm, tiff, topk, unigram
from paginal.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.detect(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) c
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id query_id, v.vec_id,
         cast(list_sum(list_transform(generate_series(1, least(len(q.c), len(v.c))), lambda i: q.c[i] * v.c[i])) as bigint) score
  from v q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document, word for word, by a network and a spelling trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = F.col("log_prob") + F.col("spelling_log_prob")
    mean = F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens"))
    return pseudolm.score(docs, pseudolm.fit(docs)).select("doc_id", "n_tokens", whole.alias("log_prob"), mean.alias("mean_log_prob"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85."""
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as materialized (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) end) sh from w),
e as materialized (select doc_id, len(sh) n, unnest(sh) g from s),
met as (select a.doc_id x, b.doc_id y, any_value(a.n) nx, any_value(b.n) ny, count(*) common from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
link as materialized (select x, y from met where 100 * common >= 85 * (nx + ny - common)),
way as materialized (select x, y from link union all select y, x from link),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, way.y from reach r join way on r.other = way.x)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, c.component_id
from s join (select doc_id, min(other) component_id from reach group by doc_id) c on c.doc_id = s.doc_id
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the pattern spans, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        rank = F.create_map(*[x for i, k in enumerate(pii.KINDS) for x in (F.lit(k), F.lit(i))])
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *(count(k) for k in pii.BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = unigram.decode(unigram.encode(docs))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.crc32(F.array_join("ids", ",")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a TIFF, read back, and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tiff.media_digest(tiff.text_to_media(docs))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token-id files, read back, and summed up."""
    files = idcoder.write_files(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = idcoder.read_files(files).select(
        "part", "block", "doc_id", "before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    starts = idcoder.block_starts(files)
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_packing": op3_packing,
        "op4_line_dedup": op4_line_dedup,
        "op5_pseudo_likelihood": op5_pseudo_likelihood,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_pii": op7_pii,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_tiff": op9_tiff,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op4_line_dedup": linededup.oracle(), "op6_ngram_jaccard": OP6_SQL}
