"""Connected components of a graph that lies in tables, without collecting nodes or links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import spool, unspool


def components(links: DataFrame) -> DataFrame:
    """For links (a, b), a row (node, root) for each node that has a link to another: root is the least node it reaches.

    Each round hangs the larger neighbours of every node on the least node it sees, and then the smaller ones likewise; the
    number of rounds grows with the logarithm of the longest chain, and they go on until one changes nothing. Least neighbours are aggregated before they are joined, so a
    node with very many links is spread as any skewed join is. Links are written to the shared folder after each round.
    """
    pairs = lambda d: d.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = spool(pairs(links.select("a", "b")), "links"), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = pairs(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a")
        new = spool(pairs(hung.select("b", F.col("m")).toDF("a", "b").union(small.select("a", F.col("m").alias("b")))), "links")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unspool(now)
        now = new
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
