"""Overlaps of neighbours on a path: regions where they may overlap, cut points from shared minimizers, trims, AGP.

Paths here are rows (path_id, step, contig, ori, gap, d): gap as written in path files (one more than the real gap), d the graph's
estimate for the edge that follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def neighbours(paths: DataFrame) -> DataFrame:
    w = Window.partitionBy("path_id").orderBy("step")
    return paths.withColumn("target", F.lead("contig").over(w)).withColumn("target_ori", F.lead("ori").over(w)).filter("target IS NOT NULL").withColumnRenamed("contig", "source").withColumnRenamed("ori", "source_ori")


def valid_regions(paths: DataFrame, lengths: DataFrame, k: int, g: int = 20, f: float = 0.5) -> DataFrame:
    """For each pair of neighbours that the graph says overlap, and whose gap is the least one, the closed interval on either contig
    where the overlap may lie: path_id, step, side (source or target), contig, ori, start, stop."""
    pairs = neighbours(paths).filter((F.col("d") < 0) & (F.col("gap") <= g + 1))
    sides = F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("contig"), F.col("source_ori").alias("ori")), F.struct(F.lit("target").alias("side"), F.col("target").alias("contig"), F.col("target_ori").alias("ori")))
    one = pairs.select("path_id", "step", (-F.col("d")).alias("o"), F.explode(sides).alias("s")).select("path_id", "step", "o", "s.*").join(lengths, "contig")
    tail = ((F.col("side") == "source") & (F.col("ori") == "+")) | ((F.col("side") == "target") & (F.col("ori") == "-"))
    start = F.when(tail, F.col("length") - F.col("o") - k - F.floor(F.col("o") * f)).otherwise(0)
    stop = F.when(tail, F.col("length")).otherwise(F.floor(F.col("o") * (f + 1)))
    return one.select("path_id", "step", "side", "contig", "ori", "length", start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def region_sequences(contigs: DataFrame, regions: DataFrame) -> DataFrame:
    """Contigs that have a region: the filter that stands before the fine sketch."""
    return contigs.join(regions.select("contig").distinct(), "contig", "left_semi")


def region_minimizers(sketched: DataFrame, regions: DataFrame) -> DataFrame:
    """Minimizers inside any region of their contig, those that the contig has there twice or more left out. A contig has two regions
    at most, so the range condition meets few rows of each key."""
    r = regions.groupBy("contig").agg(F.collect_list(F.struct("start", "stop")).alias("r"))
    inside = sketched.select(F.col("id").alias("contig"), "hash", "pos").join(r, "contig").filter(F.exists("r", lambda x: (F.col("pos") >= x["start"]) & (F.col("pos") <= x["stop"])))
    return inside.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("contig", "hash"))).filter("n = 1").select("contig", "hash", "pos")


def shared_minimizers(found: DataFrame, regions: DataFrame) -> DataFrame:
    """Hashes that both neighbours have in their regions for one another: path_id, step, hash, spos, tpos."""
    at = regions.join(found, "contig").filter((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("stop")))
    side = lambda s, p: at.filter(F.col("side") == s).select("path_id", "step", "hash", F.col("pos").alias(f"{p}pos"), F.col("ori").alias(f"{p}ori"), F.col("length").alias(f"{p}len"))
    return side("source", "s").join(side("target", "t"), ["path_id", "step", "hash"])


def islands(shared: DataFrame) -> DataFrame:
    """Runs of shared minimizers that are neighbours on both contigs: rank on the source, rank on the target one apart."""
    w = Window.partitionBy("path_id", "step")
    r = shared.withColumn("rs", F.row_number().over(w.orderBy("spos"))).withColumn("rt", F.row_number().over(w.orderBy("tpos")))
    new = F.coalesce((F.abs(F.col("rt") - F.lag("rt").over(w.orderBy("rs"))) != 1).cast("int"), F.lit(0))
    return r.withColumn("new", new).withColumn("island", F.sum("new").over(w.orderBy("rs"))).drop("new")


def cut_points(shared: DataFrame) -> DataFrame:
    """For each pair of neighbours, the minimizer to cut at: the middle of the longest island, counted from the end whose hash, as
    text, is smaller; of equally long ones, the nearest to the contigs' ends, then the largest hash as text.
    Rows path_id, step, spos, tpos, hash."""
    key = ["path_id", "step", "island"]
    one = islands(shared).withColumn("t", F.col("hash").cast("string"))
    item = F.struct("rs", "t", "spos", "tpos")
    arr = F.array_sort(F.collect_list(item))
    g = one.groupBy(*key).agg(arr.alias("a"), F.first("sori").alias("sori"), F.first("tori").alias("tori"), F.first("slen").alias("slen"), F.first("tlen").alias("tlen"))
    g = g.withColumn("a", F.when(F.element_at("a", 1)["t"] > F.element_at("a", -1)["t"], F.reverse("a")).otherwise(F.col("a")))
    g = g.withColumn("mid", F.col("a")[F.floor(F.size("a") / 2).cast("int")])
    span = lambda c: F.abs(F.element_at("a", 1)[c] - F.element_at("a", -1)[c])
    ds = F.when(F.col("sori") == "+", F.col("mid.spos") - F.col("slen")).otherwise(-F.col("mid.spos"))
    dt = F.when(F.col("tori") == "-", F.col("mid.tpos") - F.col("tlen")).otherwise(-F.col("mid.tpos"))
    size = F.when(F.size("a") == 1, F.lit(1.0)).otherwise((span("spos") + span("tpos")) / 2)
    best = F.max(F.struct(size.alias("size"), ((ds + dt) / 2).alias("near"), F.col("mid.t").alias("t"), F.col("mid.spos").alias("spos"), F.col("mid.tpos").alias("tpos")))
    return g.groupBy("path_id", "step").agg(best.alias("b")).select("path_id", "step", "b.spos", "b.tpos", F.col("b.t").cast("long").alias("hash"))


def trims(paths: DataFrame, cuts: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """For each contig: ori, source_cut, target_cut, start, stop of what is left, omitted (both cuts, which cross)."""
    w = Window.partitionBy("path_id").orderBy("step")
    on = paths.join(cuts, ["path_id", "step"], "left").withColumn("target_cut", F.lag("tpos").over(w)).withColumnRenamed("spos", "source_cut")
    cut_any = F.col("source_cut").isNotNull() | F.col("target_cut").isNotNull()
    one = lengths.join(on.select("contig", F.when(cut_any, F.col("ori")).alias("ori"), "source_cut", "target_cut"), "contig", "left")
    start = F.when(F.col("ori") == "+", F.coalesce("target_cut", F.lit(0))).when(F.col("ori") == "-", F.coalesce(F.col("source_cut") + k, F.lit(0))).otherwise(0)
    stop = F.when(F.col("ori") == "+", F.coalesce("source_cut", "length")).when(F.col("ori") == "-", F.coalesce(F.col("target_cut") + k, F.col("length"))).otherwise(F.col("length"))
    both = F.col("source_cut").isNotNull() & F.col("target_cut").isNotNull()
    return one.select("contig", "ori", "source_cut", "target_cut", start.alias("start"), stop.alias("stop"), (both & ~(start < stop)).alias("omitted"))


def trimmed_paths(paths: DataFrame, cuts: DataFrame, trimmed: DataFrame, g: int = 20, outgap: int = 1) -> DataFrame:
    """Paths with the gap `outgap` where a cut was found, and without omitted contigs: the gap before one becomes the least gap, the
    one after it goes. Only contigs between two others can be omitted, any number in a row."""
    w = Window.partitionBy("path_id").orderBy("step")
    on = paths.join(cuts.select("path_id", "step", F.lit(True).alias("found")), ["path_id", "step"], "left").join(trimmed.select("contig", "omitted"), "contig")
    gap = F.when(F.col("gap").isNotNull(), F.when(F.lead("omitted").over(w), F.lit(g + 1)).when(F.col("found"), F.lit(outgap)).otherwise(F.col("gap")))
    kept = on.withColumn("gap", gap).filter("NOT omitted")
    return kept.select("path_id", (F.row_number().over(w) - 1).cast("long").alias("step"), "contig", "ori", "gap", "d")


def agp(paths: DataFrame, trimmed: DataFrame) -> DataFrame:
    """AGP rows (1-based, closed): object, start, stop, part, kind (W or N), component, from, to, ori. Gaps of no base have no row;
    contigs on no path follow as objects of their own, omitted ones don't."""
    on = paths.join(trimmed.select("contig", F.col("start").alias("c0"), F.col("stop").alias("c1")), "contig")
    parts = F.array(F.struct(F.lit(0).alias("second"), F.lit("W").alias("kind"), (F.col("c1") - F.col("c0")).cast("long").alias("size")), F.struct(F.lit(1).alias("second"), F.lit("N").alias("kind"), (F.col("gap") - 1).cast("long").alias("size")))
    rows = on.select("path_id", "step", "contig", "ori", "c0", "c1", F.explode(parts).alias("p")).select("*", "p.*").drop("p").filter("kind = 'W' OR size > 0")
    w = Window.partitionBy("path_id").orderBy("step", "second")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    is_w = F.col("kind") == "W"
    rows = rows.select(
        F.col("path_id").alias("object"), (before + 1).alias("start"), (before + F.col("size")).alias("stop"), F.row_number().over(w).alias("part"), "kind",
        F.when(is_w, F.col("contig")).otherwise(F.col("size").cast("string")).alias("component"), F.when(is_w, (F.col("c0") + 1).cast("string")).otherwise("scaffold").alias("from"),
        F.when(is_w, F.col("c1").cast("string")).otherwise("yes").alias("to"), F.when(is_w, F.col("ori")).otherwise("paired-ends").alias("ori"),
    )
    alone = trimmed.filter("NOT omitted").join(paths.select("contig"), "contig", "left_anti")
    one = F.lit(1)
    return rows.union(alone.select("contig", one.cast("long"), (F.col("stop") - F.col("start")).cast("long"), one, F.lit("W"), "contig", (F.col("start") + 1).cast("string"), F.col("stop").cast("string"), F.lit("+")))
