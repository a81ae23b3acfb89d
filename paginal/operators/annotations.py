"""Annotations of token ranges: lookup by page, and merging into display runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paginal.operators.prefix import prefix_sums

#: Page numbers that are summed up together.
PAGE_RANGE = 1 << 16
# Style bits of a formatting, the bit of a deleted highlight.
BOLD, ITALIC, UNDERLINE, SMALL_CAPS, DELETED = 1, 2, 4, 8, 1
#: An end that never comes: annotations that end at or before their start stay open.
NEVER = 2147483647


def page_counts(annotations: DataFrame) -> DataFrame:
    """(page_id, n) of one kind of annotation."""
    return annotations.groupBy("page_id").agg(F.count("*").alias("n"))


def page_entries(annotations: DataFrame) -> DataFrame:
    """(page_id, first_index, n) of one kind of annotation, when all are numbered from 0 in order of page.

    Pages are counted first; only their counts are summed up, by ranges of pages.
    """
    counted = page_counts(annotations).withColumn("range", F.floor(F.col("page_id") / PAGE_RANGE))
    return prefix_sums(counted, "range", ["page_id"], {"first_index": F.col("n")}).select("page_id", "first_index", "n")


def of_page(annotations: DataFrame, page_id: int) -> DataFrame:
    """One page's annotations; the filter reaches the scan."""
    return annotations.where(F.col("page_id") == page_id)


def style(flags: str) -> dict[str, object]:
    """The style columns of a flags column."""
    return {n: (F.col(flags).bitwiseAND(bit) != 0) for n, bit in (("bold", BOLD), ("italic", ITALIC), ("underline", UNDERLINE), ("small_caps", SMALL_CAPS))}


def merge_runs(pages: DataFrame, formatting: DataFrame, highlights: DataFrame) -> DataFrame:
    """Maximal runs of equal display on each page, unstyled ones too.

    pages: (page_id, n_tokens); formatting: (page_id, i, anchor_start,
    anchor_end, flags, layer, priority); highlights: (page_id, i, anchor_start,
    anchor_end, flags, color_id, category_id), i being the input order.  On a
    stretch the formatting of the highest layer, then priority, then earliest
    start, then order shows, and the latest highlight.  Deleted highlights do not count.

    One pass per page: marks are few, so each page's cuts and annotations meet
    in arrays of its own row, and neighbours are merged by a window.
    """
    end = F.when(F.col("anchor_end") > F.col("anchor_start"), F.col("anchor_end")).otherwise(NEVER).alias("e")
    start = F.col("anchor_start").alias("s")
    f = formatting.groupBy("page_id").agg(
        F.collect_list(F.struct(F.col("layer").alias("l"), F.col("priority").alias("p"), (-F.col("anchor_start")).alias("ns"), (-F.col("i")).alias("ni"), start, end, F.col("flags").bitwiseAND(15).alias("k"))).alias("f")
    )
    h = highlights.where(F.col("flags").bitwiseAND(DELETED) == 0).groupBy("page_id").agg(
        F.collect_list(F.struct(start, F.col("i"), end, F.col("color_id").alias("co"), F.col("category_id").alias("ca"))).alias("h")
    )
    empty_f, empty_h = F.array().cast(f.schema["f"].dataType), F.array().cast(h.schema["h"].dataType)
    own = pages.where(F.col("n_tokens") > 0).join(f, "page_id", "left").join(h, "page_id", "left")
    own = own.select("page_id", "n_tokens", F.coalesce("f", empty_f).alias("f"), F.coalesce("h", empty_h).alias("h"))
    ends = [F.col(f"{x}.{k}") for x in ("f", "h") for k in ("s", "e")]
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0), F.col("n_tokens")), *ends), lambda p: (p >= 0) & (p <= F.col("n_tokens")))))
    stretch = own.withColumn("cuts", cuts).select("page_id", "f", "h", "cuts", F.posexplode(F.slice("cuts", 1, F.size("cuts") - 1)).alias("k", "start"))
    stretch = stretch.withColumn("end", F.element_at("cuts", F.col("k") + 2))
    on = lambda a: (a["s"] <= F.col("start")) & (F.col("start") < a["e"])
    top_f, top_h = F.array_max(F.filter("f", on)), F.array_max(F.filter("h", on))
    shown = stretch.select(
        "page_id", "start", "end",
        F.coalesce(top_f["k"], F.lit(0)).alias("flags"), F.coalesce(top_h["co"], F.lit(0)).alias("color_id"), F.coalesce(top_h["ca"], F.lit(0)).alias("category_id"),
    )
    order = Window.partitionBy("page_id").orderBy("start")
    look = F.struct("flags", "color_id", "category_id")
    fresh = shown.withColumn("fresh", F.when(F.lag(look).over(order) == look, 0).otherwise(1))
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = fresh.withColumn("island", island).groupBy("page_id", "island", "flags", "color_id", "category_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.select("page_id", "start", "end", *(c.alias(n) for n, c in style("flags").items()), "color_id", "category_id")
