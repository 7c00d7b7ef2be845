"""Connected components over a table of links, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, staged

#: Rounds after which something is wrong: they grow with the logarithm of a component's width.
MOST_ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """(id, label) of every end of a link (src, dst): label is the component's smallest id.

    Alternates two steps until no link changes: every larger neighbour of a node is
    linked to the smallest one it sees, then every smaller neighbour is. Minima are
    pre-aggregated before they are shuffled; a hub's links stand on one side of a join
    against its single row, which AQE may split. Each round is written to the
    shared folder, so a lost executor costs a round at most.
    """
    e = links.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct()
    e = staged(e, "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        last, e = e, staged(small, "links")
        forget(last)
        # xxhash64 of the link set: order-free, two sums.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    labels = e.select(F.col("a").alias("id"), F.col("b").alias("label"))
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    out = staged(labels.unionByName(roots), "labels")
    forget(e)
    return out
