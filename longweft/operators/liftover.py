"""Mappings carried over to the coordinates of the scaffolds that their contigs became part of, so that rounds need no new mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dna import flip
from . import mapping
from .gapfill import consistent


def lift_arrays(mapped: DataFrame, agp: DataFrame, k: int, lengths: DataFrame | None = None) -> DataFrame:
    """Mappings with their hits on the new objects: read_id, read_len, map_idx, contig (new), hits, and its length if lengths are given.
    Hits on bases that are no longer there go; contigs without an AGP row keep their name and lose all hits."""
    w = agp.filter("kind = 'W'").select(F.col("component").alias("contig"), "object", F.col("start").alias("s0"), F.col("from").cast("int").alias("c0"), F.col("to").cast("int").alias("c1"), F.col("ori").alias("o"))
    more = []
    if lengths is not None:
        w, more = w.join(lengths.select(F.col("contig").alias("object"), F.col("length").alias("new_length")), "object", "left"), [F.col("new_length").alias("length")]
    on = mapped.drop("length").join(w, "contig", "left")
    size = F.col("c1") - F.col("c0") + 1

    def move(h):
        adj = h["cpos"] - (F.col("c0") - 1)
        plus = (F.col("s0") - 1 + adj).cast("int")
        minus = (F.col("s0") - 1 + (size - adj) - k).cast("int")
        same = F.col("object") == F.col("contig")
        pos = F.when(same, h["cpos"]).when(F.col("o") == "+", plus).when(F.col("o") == "-", minus).otherwise(h["cpos"])
        strand = F.when(~same & (F.col("o") == "-"), flip(h["cstrand"])).otherwise(h["cstrand"])
        return F.struct(pos.alias("cpos"), strand.alias("cstrand"), h["rpos"].alias("rpos"), h["rstrand"].alias("rstrand"))

    inside = F.filter("hits", lambda h: (h["cpos"] >= F.col("c0") - 1) & (h["cpos"] <= F.col("c1") - k))
    hits = F.when(F.col("object").isNotNull(), F.transform(inside, move)).otherwise(F.expr("slice(hits, 1, 0)"))
    return on.select("read_id", "read_len", "map_idx", F.coalesce("object", "contig").alias("onto"), hits.alias("lifted"), *more).withColumnsRenamed({"onto": "contig", "lifted": "hits"})


def lift_hits(mapped: DataFrame, agp: DataFrame, k: int) -> DataFrame:
    """Hits on the new objects: read_id, map_idx, j (place in the mapping), contig (new), cpos, cstrand, rpos, rstrand; one row with
    nulls stands for a mapping that has none left."""
    return lift_arrays(mapped, agp, k).select("read_id", "read_len", "map_idx", "contig", F.posexplode_outer("hits").alias("j", "h")).select("read_id", "read_len", "map_idx", "contig", "j", "h.*")


def lift_mappings(mapped: DataFrame, agp: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """Mappings on the new objects, as mapping.mappings() makes them: neighbouring mappings to one object are joined, objects that lie
    inside another's (or their own) runs go, then those without hits, and those whose positions don't strictly rise or fall.
    Mappings without hits still count as runs. lengths: the new objects'. A mapping's hits stay in one row; rows are dealt by contig and
    then by read, and no more."""
    left = mapping.left_runs(lift_arrays(mapped, agp, k, lengths).withColumnRenamed("map_idx", "hit_idx")).filter((F.size("hits") > 0) & F.col("length").isNotNull())
    made = left.groupBy("read_id", "contig").agg(
        F.min("hit_idx").alias("at"), F.sum(F.size("hits")).cast("int").alias("hit_count"), F.first("read_len").alias("read_len"), F.first("length").alias("length"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hit_idx", "hits"))), lambda x: x["hits"])).alias("hits"),
    )
    made = made.withColumn("map_idx", F.row_number().over(Window.partitionBy("read_id").orderBy("at")) - 1).drop("at")
    steps = F.zip_with(F.slice("hits", 1, F.size("hits") - 1), F.slice("hits", 2, F.size("hits")), lambda a, b: F.signum(b["cpos"] - a["cpos"]))
    mono = (F.size("hits") < 2) | F.forall(steps, lambda s: s == 1) | F.forall(steps, lambda s: s == -1)
    return made.filter(mono)


__all__ = ["lift_hits", "lift_mappings", "consistent"]
