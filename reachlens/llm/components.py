"""Connected components of an edge table by alternating large and small stars, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.runtime import discard, if_large, materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b) that isn't its component's smallest node, which is the root.

    Each round links the larger neighbours of a node to its smallest one, then all smaller neighbours to the smallest of
    them; the number of rounds grows with the logarithm of the longest path. Only counts come to the driver. Loops and
    repeated edges change nothing.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    sign, rows = None, now.count()
    while True:
        both = now.select("node", F.col("root").alias("other")).unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.filter("other > node").join(if_large(least, rows), "node").select(F.col("other").alias("node"), F.col("m").alias("root")).distinct()
        large = materialize(large)
        small = large.groupBy("node").agg(F.min("root").alias("m"))
        passed = large.join(if_large(small, rows), "node").filter("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        new = materialize(passed.unionByName(small.select("node", F.col("m").alias("root"))).distinct())
        discard(large)
        discard(now)
        got = tuple(new.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("node", "root"), F.lit(1 << 40)))).first())
        now = new
        if got == sign or not got[0]:
            return now
        sign, rows = got, got[0]
