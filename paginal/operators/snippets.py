"""Snippets: where a hit's page shows the query line or one of its words.

Tried in turn: the raw line in the page; the raw line in the page's end joined
with the next page's beginning; the first token that is a query word; the
page's beginning.  Widths count bytes; the byte-exact contexts are binary
columns, the text columns replace what is cut inside a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paginal.functions.query import parse
from paginal.functions.text import tokens

# Bytes of context, of a page's end or beginning at a boundary, of a prefix.
CONTEXT, BOUNDARY, PREFIX = 40, 200, 80
EXACT, ACROSS, TOKEN, START, MISSING = "exact", "boundary", "token", "prefix", "missing"


def with_next_page(pages: DataFrame) -> DataFrame:
    """Adds next_text: the text of the page numbered one higher in the same book, else null."""
    order = Window.partitionBy("book_id").orderBy("page_id")
    follows = F.lead("page_id").over(order) == F.col("page_id") + 1
    return pages.withColumn("next_text", F.when(follows, F.lead("text").over(order)))


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _text(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def _around(text: Column, line: str) -> Column:
    """struct(before, match, after) in bytes of the first occurrence of line, null if none."""
    at = F.instr(text, line)
    start = F.octet_length(F.left(text, at - 1))
    raw, size = _bytes(text), len(line.encode())
    left = F.greatest(start - CONTEXT, F.lit(0))
    parts = F.struct(
        F.substring(raw, left + 1, start - left).alias("before"),
        F.substring(raw, start + 1, F.lit(size)).alias("match"),
        F.substring(raw, start + 1 + size, F.lit(CONTEXT)).alias("after"),
    )
    return F.when(at > 0, parts)


def _last_bytes(text: Column, n: int) -> Column:
    raw = _bytes(text)
    return F.substring(raw, F.greatest(F.octet_length(raw) - n, F.lit(0)) + 1, F.lit(n))


#: Hits up to which their page numbers are broadcast.
MOST_BROADCAST = 10_000


def looked_up(hits: DataFrame, pages: DataFrame, most: int | None) -> DataFrame:
    """The pages of the hits and those numbered one higher.

    With at most ``most`` hits, a bounded number, their page numbers are
    broadcast: the scan of pages drops all others, and no text is shuffled but
    that of the pages found.
    """
    if most is None or most > MOST_BROADCAST:
        return pages
    ids = hits.select(F.explode(F.array(F.col("page_id"), F.col("page_id") + 1)).alias("wanted")).distinct()
    return pages.join(F.broadcast(ids), F.col("page_id") == F.col("wanted"), "left_semi")


def snippets(hits: DataFrame, pages: DataFrame, line: str, exact_only: bool = False, most: int | None = None, places: bool = False) -> DataFrame:
    """Hits (page_id, score) with kind, last_page_id, before, match, after and snippet.

    pages: (page_id, book_id, page_number, text).  A hit without a page keeps
    its row, as ``missing``.  exact_only drops hits that do not show the line;
    it applies to the hits given, so it follows any offset and limit.  ``most``
    tells how many hits there can be at most, if that is known.  places adds
    place: the line's first character for ``exact``, the token's number for
    ``token``, from 1, else 0.
    """
    words = list(parse(line).words)
    pages = looked_up(hits, pages, most)
    kept = pages.select(F.col("page_id").alias("pid"), "book_id", "page_number", "text")
    near = pages.select(F.col("book_id").alias("nb"), F.col("page_id").alias("np"), F.substring(_bytes(F.col("text")), F.lit(1), F.lit(BOUNDARY)).alias("next_start"))
    found = hits.join(kept, F.col("page_id") == F.col("pid"), "left")
    found = found.join(near, (F.col("np") == F.col("page_id") + 1) & (F.col("nb") == F.col("book_id")), "left")
    text = F.col("text")
    own = _around(text, line)
    # The joined ends may cut a character; the raw line is sought in valid text.
    ends = F.concat(_text(_last_bytes(text, BOUNDARY)), _text(F.col("next_start")))
    across = F.when(F.col("next_start").isNotNull(), _around(ends, line))
    marked = F.col("__tokens")
    first = F.array_position(F.transform(marked, lambda t: t.isin(words)), F.lit(True))
    before = F.array_join(F.slice(marked, 1, F.greatest((first - 1).cast("int"), F.lit(0))), "")
    after = F.array_join(F.slice(marked, first.cast("int") + 1, F.size(marked)), "")
    by_token = F.when(
        first > 0,
        F.struct(
            _last_bytes(before, CONTEXT).alias("before"),
            _bytes(F.element_at(marked, F.when(first > 0, first.cast("int")))).alias("match"),
            F.substring(_bytes(after), F.lit(1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    nothing = F.lit(b"")
    start = F.struct(nothing.alias("before"), nothing.alias("match"), F.substring(_bytes(text), F.lit(1), F.lit(PREFIX)).alias("after"))
    out = found.withColumns({"__own": own, "__across": across, "__tokens": tokens("text")}).withColumn("__token", by_token)
    kind = (
        F.when(text.isNull() | (text == ""), MISSING)
        .when(F.col("__own").isNotNull(), EXACT)
        .when(F.col("__across").isNotNull(), ACROSS)
        .when(F.col("__token").isNotNull(), TOKEN)
        .otherwise(START)
    )
    out = out.withColumn("kind", kind).withColumn("__s", F.when(F.col("kind") != MISSING, F.coalesce("__own", "__across", "__token", start)))
    if exact_only:
        out = out.where(F.col("kind").isin(EXACT, ACROSS))
    shown = F.concat(_text(F.col("__s.before")), F.when(F.octet_length("__s.match") > 0, F.concat(F.lit("«"), _text(F.col("__s.match")), F.lit("»"))).otherwise(""), _text(F.col("__s.after")))
    place = F.when(F.col("kind") == EXACT, F.instr(text, line)).when(F.col("kind") == TOKEN, first).otherwise(0).cast("long")
    return out.select(
        *hits.columns, "book_id", "page_number", "kind",
        F.when(F.col("kind") == ACROSS, F.col("page_id") + 1).otherwise(F.col("page_id")).alias("last_page_id"),
        F.col("__s.before").alias("before"), F.col("__s.match").alias("match"), F.col("__s.after").alias("after"),
        F.when(F.col("kind") == MISSING, F.lit("(failed to load text)")).otherwise(shown).alias("snippet"),
        *([place.alias("place")] if places else []),
    )
