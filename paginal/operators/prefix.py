"""Prefix sums and dense numbers over a whole table without one ordered task.

The table is split into ordered groups.  Sums of the groups before come from a
table with a row per group; only that is ordered as a whole.  Both sides read
one exchange by group, so what leads to the table runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, group: str, order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the sum of its value over all rows before, in order of group, then order."""
    df = df.repartition(F.col(group))
    inside = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(F.col(group).alias("__group")).agg(*(F.sum(v).cast("long").alias(f"__{n}") for n, v in values.items()))
    starts = sums.select("__group", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__start_{n}") for n in values))
    own = df.withColumns({f"__inside_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    placed = own.join(starts, F.col(group).eqNullSafe(F.col("__group")))
    placed = placed.withColumns({n: (F.col(f"__start_{n}") + F.col(f"__inside_{n}")).cast("long") for n in values})
    return placed.drop("__group", *(f"__{part}_{n}" for n in values for part in ("start", "inside")))


def prefix_sum(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over all rows before, in order of group, then order."""
    return prefix_sums(df, group, order, {name: value})


def dense_number(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds numbers from 0 without gaps, in order of group, then order."""
    return prefix_sums(df, group, order, {name: F.lit(1)})


def dense_number_apart(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """dense_number for wide rows: only group and order are numbered, and each row moves once, to its number.

    group is a string, order a whole number; rows alike in both follow each other.
    """
    keys = ["__book", "__number", "__null"]
    # Nulls become values, so that plain equality joins them; group and order are made from these again.
    null = F.when(F.col(group).isNull(), 1).otherwise(0) + F.when(F.col(order).isNull(), 2).otherwise(0)
    keyed = df.withColumns({"__book": F.coalesce(group, F.lit("")), "__number": F.coalesce(order, F.lit(0)), "__null": null}).drop(group, order)
    book = F.when(F.col("__null") % 2 == 0, F.col("__book"))
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__whole", book)
    # Nulls come first in order of Spark: of the groups, and of the numbers of a group.
    starts = prefix_sums(sizes, "__whole", [F.col("__null") < 2, "__number"], {"__first": F.col("__n")}).select(*(F.col(k).alias(f"{k}_of") for k in keys), "__first")
    placed = keyed.join(starts, [F.col(k) == F.col(f"{k}_of") for k in keys])
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("__number"))
    placed = placed.withColumn(name, F.col("__first") + within - 1)
    rest = [c for c in df.columns if c not in (group, order)]
    return placed.select(book.alias(group), F.when(F.col("__null") < 2, F.col("__number")).alias(order), *rest, name)
