"""Line deduplication by site-relative frequency.

A line is boilerplate on a host when more than ``ratio`` of the host's pages
hold it (and at least ``min_pages`` of them).  All of it is DataFrame
operations:

1. each page gives its distinct lines as pairs of 64-bit hashes, counted per
   (host, line) with map-side partial sums, so a hot host or line is summed
   before the shuffle;
2. the counts meet the host totals, and what exceeds the ratio is kept: a
   host has at most (mean lines of a page / ratio) such lines, so one row per
   host carries them all;
3. that table is measured: up to a bound it is broadcast, and no text moves.
   Beyond it, it meets the pages on (host, salt): hosts with more than a ten
   thousandth of all pages (so ten thousand at most, which is what is broadcast
   then) are spread over salts, and only their rows are repeated for each salt;
4. each page drops its lines in place by array functions.  The text of a page
   is never exploded, nor shuffled but in the join beyond the bound.

Lines are compared without outer blanks; blank lines are always kept.

Defined results
---------------
* Every row stays, with its lines in order; a null text stays null with zero
  counts, a page of boilerplate only becomes an empty text.
* A null host is a host of its own.
* Repeated rows count as pages of their own.
* Extra columns of any type pass through; a column that has the name of an
  added one (n_lines, n_dropped) is replaced, names of helper columns are free.
* A text of any length is one row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paginal.llm.common import spare_name, written

#: Share of a host's pages beyond which a line is boilerplate, and the least pages.
RATIO, MIN_PAGES = 0.1, 5
#: Boilerplate lines up to which their table is broadcast (some 30 bytes each).
BROADCAST_LINES = 500_000
#: Share of all pages from which on a host is salted, and pages of one salt.
HOT_SHARE, SALT_PAGES = 1e-4, 100_000


def line_key(line: Column) -> Column:
    """128 bits of a trimmed line, as two longs in an array."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, n_host, keys): pages and boilerplate lines of each host that has any such line."""
    host = F.col(host_col).cast("string").alias("host")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: F.trim(x) != ""), line_key))
    held = (
        pages.where(F.col(text_col).isNotNull())
        .select(host, F.explode(keys).alias("key"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    totals = pages.groupBy(host).agg(F.count("*").alias("n_host"))
    return (
        held.join(totals, held["host"].eqNullSafe(totals["host"]))
        .where(F.col("n_pages") > F.lit(ratio) * F.col("n_host"))
        .groupBy(held["host"], "n_host")
        .agg(F.collect_set("key").alias("keys"))
    )


def drop_boilerplate_lines(
    pages: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """The pages with boilerplate lines dropped, and n_lines, n_dropped.

    n_lines counts all lines of the text, blank ones too.
    """
    kept = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    names: list[str] = []
    for stem in ("host", "salt", "salts", "keys", "lines", "clean"):
        names.append(spare_name([*kept, *names, "n_lines", "n_dropped"], stem))
    host, salt, salts, keys, lines, clean = names
    # A null host is a host too: "=" before all others keeps them apart.
    key_of = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    bad = written(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    bad = bad.select(key_of(F.col("host")).alias(host), "n_host", F.col("keys").alias(keys))
    dealt = pages.select(*kept, key_of(F.col(host_col).cast("string")).alias(host))
    size = bad.agg(F.sum(F.size(keys)).alias("n")).first()["n"] or 0
    if size <= broadcast_lines:
        out = dealt.join(F.broadcast(bad.drop("n_host")), host, "left")
    else:
        least = max(SALT_PAGES, int(HOT_SHARE * pages.count()))
        parts = F.when(F.col("n_host") > least, F.ceil(F.col("n_host") / SALT_PAGES)).otherwise(1)
        hot = bad.where(F.col("n_host") > least).select(host, parts.alias(salts))
        salted = dealt.join(F.broadcast(hot), host, "left").withColumn(salt, F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.coalesce(salts, F.lit(1))))
        spread = bad.select(host, keys, F.explode(F.sequence(F.lit(0), parts - 1)).alias(salt))
        out = salted.join(spread, [host, salt], "left")
    dropped = F.col(keys)
    out = out.withColumn(lines, _lines(F.col(text_col)))
    out = out.withColumn(clean, F.when(dropped.isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: ~F.array_contains(dropped, line_key(x)))))
    text = F.array_join(clean, "\n").alias(text_col)
    gone = F.col(text_col).isNull()
    return out.select(
        *[text if c == text_col else F.col(c) for c in kept],
        F.when(gone, F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(gone, F.lit(0)).otherwise(F.size(lines) - F.size(clean)).cast("long").alias("n_dropped"),
    )


def oracle(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL for the query over documents, with source as the host."""
    return f"""
with line as (
  select doc_id, source, i, l
  from (select doc_id, source, unnest(string_split(text, chr(10))) l,
               generate_subscripts(string_split(text, chr(10)), 1) i
        from documents where text is not null)),
host as (select source, count(*) n from documents group by source),
held as (select source, trim(l) k, count(distinct doc_id) p from line where trim(l) <> '' group by source, trim(l)),
bad as (select held.source, held.k from held join host on held.source is not distinct from host.source
        where held.p >= {min_pages} and held.p > {ratio}::double * host.n),
marked as (select line.*, bad.k is not null as gone from line
           left join bad on line.source is not distinct from bad.source and trim(line.l) = bad.k),
agg as (select doc_id, string_agg(l, chr(10) order by i) filter (where not gone) t,
               count(*) n_lines, count(*) filter (where gone) n_dropped
        from marked group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(a.t, '') end as text,
       coalesce(a.n_lines, 0)::bigint n_lines, coalesce(a.n_dropped, 0)::bigint n_dropped
from documents d left join agg a on a.doc_id = d.doc_id
"""
