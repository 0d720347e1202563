"""From sketches to mappings: unique index, hits, accepted runs of hits in each read.

Rows of a read are ordered by hit_idx; every window below is over one read, whose size is bounded by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HIT = ("cpos", "cstrand", "rpos", "rstrand")


def unique_minimizers(sketched: DataFrame, keep: list[str] = []) -> DataFrame:
    """The target index: hashes that occur once in the whole target, with contig, cpos, cstrand, and columns `keep` of the sketch. A
    sketch made with `twice` is enough, and keeps a hash that very many sequences have from coming to one task as often."""
    n = F.count(F.lit(1)).over(Window.partitionBy("hash"))
    one = sketched.withColumn("n", n).filter("n = 1")
    return one.select("hash", F.col("id").alias("contig"), F.col("pos").alias("cpos"), F.col("strand").alias("cstrand"), *keep)


def hits(read_sketch: DataFrame, index: DataFrame, min_length: int = 0) -> DataFrame:
    """Minimizers of reads (with read_len) that the index (with length) has, in read order: read_id, hit_idx, hash, contig, cpos,
    cstrand, rpos, rstrand, read_len, length (the contig's, at least min_length). Lengths come with the sketches, so rows are dealt
    by hash and then by read, and no more; all that follows up to mappings is over one read and deals nothing. The lookup is on a key that
    is unique on the index side, so the join neither multiplies rows nor needs a hint."""
    found = read_sketch.select(F.col("id").alias("read_id"), "hash", F.col("pos").alias("rpos"), F.col("strand").alias("rstrand"), "read_len").join(index.filter(F.col("length") >= min_length), "hash")
    return found.withColumn("hit_idx", F.row_number().over(Window.partitionBy("read_id").orderBy("rpos")) - 1)


def repeat_filter(found: DataFrame) -> DataFrame:
    """Drops all hits of a hash that a read has twice or more."""
    return found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("read_id", "hash"))).filter("n = 1").drop("n")


def noisy_contigs(found: DataFrame, k: int, x: float = 0) -> DataFrame:
    """(read, contig) with two hits or more whose span on the contig is longer than the read allows: read_len + k, or with x > 0
    the lesser of that and x times the distance on the read of the hits at its ends, plus k. Of equal positions the first hit counts."""
    both = found.groupBy("read_id", "contig").agg(
        F.count(F.lit(1)).alias("n"), (F.max("cpos") - F.min("cpos")).alias("span"), F.first("read_len").alias("read_len"),
        F.min_by("rpos", F.struct("cpos", "hit_idx")).alias("r0"), F.max_by("rpos", F.struct("cpos", -F.col("hit_idx"))).alias("r1"),
    )
    most = F.col("read_len") + k
    if x > 0:
        most = F.least(most, x * F.abs(F.col("r1") - F.col("r0")) + k)
    return both.filter((F.col("n") >= 2) & (F.col("span") > most)).select("read_id", "contig", "n", "span")


def contig_runs(found: DataFrame) -> DataFrame:
    """Adds run_idx: hits of one contig with no other contig's between them are a run."""
    w = Window.partitionBy("read_id").orderBy("hit_idx")
    new = F.coalesce((F.col("contig") != F.lag("contig").over(w)).cast("int"), F.lit(0))
    return found.withColumn("new", new).withColumn("run_idx", F.sum("new").over(w).cast("int")).drop("new")


def run_bounds(runs: DataFrame) -> DataFrame:
    """A row for each run: read_id, run_idx, contig, hit_count, first and last (runs of its contig in the read)."""
    one = runs.groupBy("read_id", "run_idx", "contig").agg(F.count(F.lit(1)).cast("int").alias("hit_count"))
    w = Window.partitionBy("read_id", "contig")
    return one.withColumn("first", F.min("run_idx").over(w)).withColumn("last", F.max("run_idx").over(w))


def subsumed_specific(bounds: DataFrame) -> DataFrame:
    """(read_id, contig) of which a run lies between the first and the last run of some contig, itself included.

    That a run j is inside such a pair means that a contig with a run before j also has one after j: the running maximum of `last`
    over the runs before j is greater than j. So no range join is needed."""
    w = Window.partitionBy("read_id").orderBy("run_idx").rowsBetween(Window.unboundedPreceding, -1)
    return bounds.withColumn("reach", F.max("last").over(w)).filter(F.col("reach") > F.col("run_idx")).select("read_id", "contig").distinct()


def subsumed_sensitive(bounds: DataFrame) -> DataFrame:
    """(read_id, run_idx) of runs that lie between the first and the last run of another contig.

    A contig with a run before j has one after it too if its `last` is greater. No two contigs of a read have the same `last`, so of
    the runs before j the largest one, or the next if that is the own contig's, tells. Both are running maxima: the next largest so
    far is the largest of what was, at some run, the lesser of its own and the largest before."""
    w = Window.partitionBy("read_id").orderBy("run_idx").rowsBetween(Window.unboundedPreceding, -1)
    top = bounds.withColumn("top", F.max("last").over(w))
    both = top.withColumn("next", F.max(F.when(F.col("top") != F.col("last"), F.least("top", "last"))).over(w))
    other = F.when(F.col("top") != F.col("last"), F.col("top")).otherwise(F.col("next"))
    return both.filter(other > F.col("run_idx")).select("read_id", "run_idx")


def quiet(found: DataFrame, k: int, x: float = 0) -> DataFrame:
    """Hits without those of noisy contigs."""
    if x > 0:
        return found.join(noisy_contigs(found, k, x).select("read_id", "contig"), ["read_id", "contig"], "left_anti")
    w = Window.partitionBy("read_id", "contig")
    span = F.max("cpos").over(w) - F.min("cpos").over(w)
    return found.withColumn("noisy", (F.count(F.lit(1)).over(w) >= 2) & (span > F.col("read_len") + k)).filter("NOT coalesce(noisy, false)").drop("noisy")


def left_runs(found: DataFrame, sensitive: bool = False) -> DataFrame:
    """Hits without subsumed runs (sensitive), or without contigs of which a run is subsumed; with run_idx. The same as leaving out what
    subsumed_sensitive() or subsumed_specific() has, by windows over rows of a read alone: a hit lies inside another contig's runs if
    of the hits before it one of another contig has that contig's last hit after it."""
    one = Window.partitionBy("read_id", "contig")
    before = Window.partitionBy("read_id").orderBy("hit_idx").rowsBetween(Window.unboundedPreceding, -1)
    on = contig_runs(found.withColumn("last", F.max("hit_idx").over(one))).withColumn("top", F.max("last").over(before))
    on = on.withColumn("next", F.max(F.when(F.col("top") != F.col("last"), F.least("top", "last"))).over(before))
    other = F.when(F.col("top") != F.col("last"), F.col("top")).otherwise(F.col("next"))
    on = on.withColumn("inside", F.coalesce(other > F.col("hit_idx"), F.lit(False)))
    if not sensitive:
        on = on.withColumn("inside", F.col("inside") | (F.col("run_idx") > F.min("run_idx").over(one)) & (F.col("run_idx") < F.max("run_idx").over(one)))
        on = on.withColumn("inside", F.max("inside").over(one))
    return on.filter("NOT inside").drop("last", "top", "next", "inside")


def accepted(found: DataFrame, k: int, x: float = 0, sensitive: bool = False) -> DataFrame:
    """Hits that are left after noisy contigs and subsumed runs, every contig now one run; with run_idx."""
    return left_runs(quiet(found, k, x), sensitive)


def mappings(kept: DataFrame) -> DataFrame:
    """A row for each contig of a read: read_id, map_idx, contig, hit_count, hits (in read order), read_len, length."""
    one = kept.groupBy("read_id", "contig").agg(
        F.min("hit_idx").alias("at"), F.count(F.lit(1)).cast("int").alias("hit_count"), F.first("read_len").alias("read_len"), F.first("length").alias("length"),
        F.transform(F.array_sort(F.collect_list(F.struct("hit_idx", F.struct(*HIT).alias("hit")))), lambda h: h["hit"]).alias("hits"),
    )
    return one.withColumn("map_idx", F.row_number().over(Window.partitionBy("read_id").orderBy("at")) - 1).drop("at")


def hit_text() -> Column:
    """Hits as text: `cpos:cstrand_rpos:rstrand`, joined by spaces."""
    one = lambda h: F.concat(h["cpos"].cast("string"), F.lit(":"), h["cstrand"], F.lit("_"), h["rpos"].cast("string"), F.lit(":"), h["rstrand"])
    return F.array_join(F.transform("hits", one), " ")
