"""Connected components by alternating large-star and small-star steps on a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("child", "parent")
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")).first()
    return r.n, r.x, r.s


def components(edges: DataFrame) -> DataFrame:
    """(child, parent): each node that isn't the least of its component, and that least node.

    ``edges``: columns child and parent of one sortable type, in either order; loops and repeated
    edges do no harm, and null ends are dropped. Each step is written to the shared folder; only a count and two checksums of
    the edges come to the driver. A node's neighbours are aggregated before any exchange and joined
    on the node, so that a hub's edges can be split.
    """
    ends = [F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent")]
    now = materialise(edges.where("child <> parent").select(*ends).distinct(), "edges")
    state = _fingerprint(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        least = both.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("least")).withColumn("least", F.least("node", "least"))
        least = materialise(least, "least")  # a plain input of the join, so that Spark can split a hub's edges
        large = both.join(least, F.col("child") == F.col("node")).where(F.col("parent") > F.col("child")).select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        large = materialise(large.where("child <> parent").distinct(), "edges")
        least = materialise(large.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("least")), "least")
        small = large.join(least, F.col("child") == F.col("node")).select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        small = small.unionAll(least.select(F.col("node").alias("child"), F.col("least").alias("parent")))
        now = materialise(small.where("child <> parent").distinct(), "edges")
        after = _fingerprint(now)
        if after == state:
            break
        state = after
    return now
