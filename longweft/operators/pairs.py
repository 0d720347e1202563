"""From mappings to oriented contig pairs with gap estimates, and to the edges of the scaffold graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import flip

PAIR = ["source", "source_ori", "target", "target_ori"]


def ends(mapped: DataFrame) -> DataFrame:
    """Of each mapping the hits that pairs need: the first (as a target) and the last (as a source)."""
    return mapped.select("read_id", "read_len", "map_idx", "contig", "length", "hit_count", F.element_at("hits", 1).alias("head"), F.element_at("hits", -1).alias("tail"))


def read_pairs(mapped: DataFrame, f: int = 10) -> DataFrame:
    """Pairs (a, b) of mappings of a read: all with a before b if the read has at most f contigs, else neighbours, and neighbours
    among those with two hits or more. Made inside the row of a read, so a read with few contigs makes f (f - 1) / 2 pairs at most."""
    one = F.struct("map_idx", "contig", "length", "hit_count", "head", "tail")
    reads = ends(mapped).groupBy("read_id").agg(F.first("read_len").alias("read_len"), F.array_sort(F.collect_list(one)).alias("m")).filter(F.size("m") > 1)
    after = lambda arr, i, n: F.slice(arr, i + 2, n)
    every = F.flatten(F.transform("m", lambda x, i: F.transform(after(F.col("m"), i, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    near = F.flatten(F.transform("m", lambda x, i: F.transform(after(F.col("m"), i, F.lit(1)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    strong = F.flatten(F.transform("s", lambda x, i: F.transform(after(F.col("s"), i, F.lit(1)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    skipping = F.filter(strong, lambda p: p["b"]["map_idx"] - p["a"]["map_idx"] > 1)
    reads = reads.withColumn("s", F.filter("m", lambda x: x["hit_count"] > 1))
    pairs = F.when(F.size("m") <= f, every).otherwise(F.concat(near, skipping))
    return reads.select("read_id", "read_len", F.explode(pairs).alias("p")).select("read_id", "read_len", "p.a", "p.b")


def ori(hit: str) -> Column:
    return F.when(F.col(f"{hit}.cstrand") == F.col(f"{hit}.rstrand"), "+").otherwise("-")


def before(hit: str, length: str, o: Column, k: int) -> Column:
    """Bases of an oriented contig before the hit's k-mer."""
    return F.when(o == "+", F.col(f"{hit}.cpos")).otherwise(F.col(length) - F.col(f"{hit}.cpos") - k)


def gap_estimates(pairs: DataFrame, k: int) -> DataFrame:
    """For each pair of a read: the pair, the smaller contig first, the gap estimate, and whether both sides have two hits or more.
    Estimates longer than the read go."""
    so, to = ori("a.tail"), ori("b.head")
    left = F.when(so == "+", F.col("a.length") - F.col("a.tail.cpos") - k).otherwise(F.col("a.tail.cpos"))
    gap = F.col("b.head.rpos") - F.col("a.tail.rpos") - left - before("b.head", "b.length", to, k)
    s, t = F.col("a.contig"), F.col("b.contig")
    keep = s < t
    return pairs.select(
        "read_id", F.when(keep, s).otherwise(t).alias("source"), F.when(keep, so).otherwise(flip(to)).alias("source_ori"), F.when(keep, t).otherwise(s).alias("target"),
        F.when(keep, to).otherwise(flip(so)).alias("target_ori"), gap.cast("int").alias("gap"), ((F.col("a.hit_count") > 1) & (F.col("b.hit_count") > 1)).alias("anchored"), "read_len",
    ).filter(F.abs("gap") <= F.col("read_len"))


def tally(estimates: DataFrame) -> DataFrame:
    """For each pair: n reads, d (the exact median gap, cut towards 0), anchor (reads with two hits or more on both sides)."""
    return estimates.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.median("gap").cast("int").alias("d"), F.count_if("anchored").alias("anchor"))


def edge_filters(pairs: DataFrame, lengths: DataFrame, min_anchor: int = 1, min_n: int = 1) -> DataFrame:
    """Pairs with enough anchors and reads whose overlap, if any, is shorter than either contig."""
    one = lambda side: lengths.select(F.col("contig").alias(side), F.col("length").alias(f"{side}_len"))
    kept = pairs.filter((F.col("anchor") >= min_anchor) & (F.col("n") >= min_n)).join(one("source"), "source").join(one("target"), "target")
    return kept.filter((F.col("d") > -F.col("source_len")) & (F.col("d") > -F.col("target_len"))).drop("source_len", "target_len")


def both_strands(pairs: DataFrame) -> DataFrame:
    """Directed edges (src, dst, d, e, n) between oriented contigs, each also from the other strand."""
    to = F.concat("source", "source_ori"), F.concat("target", "target_ori")
    back = F.concat("target", flip(F.col("target_ori"))), F.concat("source", flip(F.col("source_ori")))
    out = [pairs.select(a.alias("src"), b.alias("dst"), "d", F.lit(100).alias("e"), "n") for a, b in (to, back)]
    return out[0].union(out[1])


def vertices(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Both orientations of every contig of a pair: (v, length). Those whose edges are filtered by weight later stay."""
    named = pairs.select(F.col("source").alias("contig")).union(pairs.select(F.col("target").alias("contig"))).distinct().join(lengths, "contig")
    return named.select(F.explode(F.array(F.concat("contig", F.lit("+")), F.concat("contig", F.lit("-")))).alias("v"), "length")


def from_checkpoint(mapped: DataFrame) -> DataFrame:
    """Mappings read back from a file, which lacks read lengths: the largest read position of a first or last hit stands for it."""
    most = F.greatest(F.element_at("hits", 1)["rpos"], F.element_at("hits", -1)["rpos"])
    return mapped.withColumn("read_len", F.max(most).over(Window.partitionBy("read_id")))
