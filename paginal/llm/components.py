"""Connected components of a table of links, by least labels and jumps.

Every round gives each vertex the least label among its neighbours and then
the label of its label, which halves the distance to the root, and writes the
labels to the shared folder.  Nothing is collected but the count of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paginal.llm.common import written


def connected_components(links: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(v, c): every linked vertex and the least vertex that it reaches.

    Self-links and repeated links are harmless; null ends are ignored.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = pairs.select(F.col(a).alias("s"), F.col(b).alias("t")).union(pairs.select(F.col(b).alias("s"), F.col(a).alias("t")))
    edges = written(both, "edges")
    labels = written(edges.groupBy(F.col("s").alias("v")).agg(F.least(F.min("t"), F.first("s")).alias("c")), "labels")
    while True:
        near = edges.join(labels, edges["s"] == labels["v"]).groupBy(F.col("t").alias("u")).agg(F.min("c").alias("m"))
        lower = labels.join(near, labels["v"] == near["u"], "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        lower = written(lower, "lower")
        roots = lower.select(F.col("v").alias("r"), F.col("c").alias("rc"))
        jumped = written(
            lower.join(roots, lower["c"] == roots["r"], "left").select("v", F.least("c", F.coalesce("rc", "c")).alias("c"), "old"), "labels"
        )
        labels = jumped.select("v", "c")
        if jumped.where(F.col("c") != F.col("old")).isEmpty():
            return labels
