"""Mapped blocks of a read on a contig, as PAF rows.

Hits of a mapping are sorted by (cpos, rpos) and numbered i. A mapping whose read positions only rise or only fall is one block. Else,
if three quarters of the steps rise (or fall), single hits that break the order go and the mapping is broken where more than one does;
if neither, it has no block. Contig positions that occur twice never count as breaks. All of it are windows over one mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sorted_hits(mapped: DataFrame) -> DataFrame:
    """Hits of mappings in contig order: read_id, contig, i, n, cpos, rpos, same (strands), duplicate (cpos), untouched (no check)."""
    one = mapped.select("read_id", "read_len", "contig", "length", "hits", F.array_sort(F.transform("hits", lambda h: F.struct(h["cpos"].alias("cpos"), h["rpos"].alias("rpos"), (h["cstrand"] == h["rstrand"]).alias("same")))).alias("s"))
    given = F.transform("hits", lambda h: F.struct(h["cpos"].alias("cpos"), h["rpos"].alias("rpos")))
    ordered = F.transform("s", lambda h: F.struct(h["cpos"].alias("cpos"), h["rpos"].alias("rpos")))
    one = one.withColumn("untouched", (given == ordered) | (given == F.reverse(ordered)))
    out = one.select("read_id", "read_len", "contig", "length", "untouched", F.size("s").alias("n"), F.posexplode("s").alias("i", "h")).select("*", "h.*").drop("h")
    return out.withColumn("duplicate", F.count(F.lit(1)).over(Window.partitionBy("read_id", "contig", "cpos")) > 1)


def blocks(mapped: DataFrame, least: float = 0.75) -> DataFrame:
    """Hits that are left, with the number of their block."""
    key = ["read_id", "contig"]
    w, whole = Window.partitionBy(*key).orderBy("i"), Window.partitionBy(*key)
    rows = sorted_hits(mapped)
    for d in (-1, 1, 2):
        rows = rows.withColumn(f"r{d}", F.lead("rpos", d).over(w)).withColumn(f"d{d}", F.lead("duplicate", d).over(w))
    up, down = F.col("rpos") <= F.col("r1"), F.col("rpos") >= F.col("r1")
    rows = rows.withColumn("ups", F.count_if(up).over(whole)).withColumn("downs", F.count_if(down).over(whole)).withColumn("steps", F.col("n") - 1)
    whole_block = F.col("untouched") | (F.col("ups") == F.col("steps")) | (F.col("downs") == F.col("steps"))
    mode = F.when(whole_block, "all").when(F.col("ups") / F.col("steps") >= least, "up").when((F.col("steps") - F.col("ups")) / F.col("steps") >= least, "down")
    rows = rows.withColumn("mode", mode).filter(F.col("mode").isNotNull())

    def agree(a: str, da: str, b: str, db: str):
        return F.col(da) | F.col(db) | F.when(F.col("mode") == "up", F.col(a) <= F.col(b)).otherwise(F.col(a) >= F.col(b))

    step = F.when(F.col("mode") == "up", up).otherwise(down)
    bad = (F.col("mode") != "all") & F.col("r1").isNotNull() & ~step & ~(F.col("duplicate") | F.col("d1"))
    act = (
        F.when(~bad, None).when(F.col("i") + 2 >= F.col("steps"), "break next").when(agree("rpos", "duplicate", "r2", "d2"), "drop next")
        .when((F.col("i") > 0) & agree("r-1", "d-1", "r1", "d1"), "drop this").otherwise("break next")
    )
    rows = rows.withColumn("act", F.when(F.col("r1").isNotNull(), act)).withColumn("prev", F.lag("act").over(w))
    gone = F.coalesce(F.col("act") == "drop this", F.lit(False)) | F.coalesce(F.col("prev") == "drop next", F.lit(False))
    rows = rows.filter(~gone)
    return rows.withColumn("block", F.sum(F.coalesce((F.col("prev") == "break next").cast("int"), F.lit(0))).over(w))


def paf_rows(mapped: DataFrame, k: int) -> DataFrame:
    """PAF columns of each block: q, qlen, qs, qe, strand, t, tlen, ts, te, hits, span, mapq. Ends are those of the first and the last hit."""
    first = lambda c: F.min_by(c, "i")
    last = lambda c: F.max_by(c, "i")
    out = blocks(mapped).groupBy("read_id", "contig", "block").agg(
        F.first("read_len").alias("qlen"), F.least(first("rpos"), last("rpos")).alias("qs"), (F.greatest(first("rpos"), last("rpos")) + k).alias("qe"),
        F.when(F.avg(F.col("same").cast("int")) >= 0.5, "+").otherwise("-").alias("strand"), F.first("length").alias("tlen"),
        F.least(first("cpos"), last("cpos")).alias("ts"), (F.greatest(first("cpos"), last("cpos")) + k).alias("te"), F.count(F.lit(1)).alias("hits"),
    )
    return out.select(F.col("read_id").alias("q"), "qlen", "qs", "qe", "strand", F.col("contig").alias("t"), "tlen", "ts", "te", "hits", (F.col("te") - F.col("ts")).alias("span"), F.lit(255).alias("mapq"))
