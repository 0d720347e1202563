"""Gaps between neighbours of a path, filled with the sequence of a read that spans them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import flip, oriented, revcomp
from ..functions.shared import stage
from . import mapping, overlap, sketch


def gap_pairs(paths: DataFrame, min_gap: int = 1) -> DataFrame:
    """Neighbours with a gap over min_gap + 1 as written: path_id, step, source, source_ori, target, target_ori, gap_size (real)."""
    return overlap.neighbours(paths).filter(F.col("gap") > min_gap + 1).select("path_id", "step", "source", "source_ori", "target", "target_ori", (F.col("gap") - 1).alias("gap_size"))


def consistent(mapped: DataFrame) -> DataFrame:
    """Mappings all of whose hits have one orientation, given as ori, and strictly rising or strictly falling contig positions."""
    same = F.transform("hits", lambda h: h["cstrand"] == h["rstrand"])
    steps = F.zip_with(F.slice("hits", 1, F.size("hits") - 1), F.slice("hits", 2, F.size("hits")), lambda a, b: F.when(b["cpos"] > a["cpos"], 1).when(b["cpos"] < a["cpos"], -1).otherwise(0))
    mono = (F.size("hits") < 2) | F.forall(steps, lambda s: s == 1) | F.forall(steps, lambda s: s == -1)
    ori = F.when(F.forall(same, lambda s: s), "+").when(F.forall(same, lambda s: ~s), "-")
    return mapped.withColumn("ori", ori).filter(F.col("ori").isNotNull() & mono)


def supporting_reads(mapped: DataFrame, gaps: DataFrame) -> DataFrame:
    """For each gap the reads that map consistently to both sides in its order, forward or as reverse complement, with both mappings
    (a: the source's, b: the target's), and read_span: the last read position of the read's last consistent mapping. Estimates and cuts
    look at the first and the last hit alone, so of `hits` these two are left, once for all that follows."""
    two = F.array(F.element_at("hits", 1), F.element_at("hits", -1)).alias("hits")
    good = stage(consistent(mapped).select("read_id", "map_idx", "contig", "ori", "hit_count", "length", two))
    last = good.groupBy("read_id").agg(F.element_at(F.max_by("hits", "map_idx"), -1)["rpos"].alias("read_span"))
    one = lambda p: good.select("read_id", F.struct("map_idx", "contig", "ori", "hit_count", "length", "hits").alias(p), F.col("contig").alias(f"{p}c"))
    both = gaps.join(one("a"), F.col("source") == F.col("ac")).join(one("b"), "read_id").filter((F.col("bc") == F.col("target")))
    order = F.col("a.map_idx") < F.col("b.map_idx")
    forward = order & (F.col("a.ori") == F.col("source_ori")) & (F.col("b.ori") == F.col("target_ori"))
    reverse = (F.col("a.map_idx") > F.col("b.map_idx")) & (F.col("a.ori") == flip(F.col("source_ori"))) & (F.col("b.ori") == flip(F.col("target_ori")))
    return both.filter(forward | reverse).join(last, "read_id").select("path_id", "step", "source", "source_ori", "target", "target_ori", "gap_size", "read_id", "a", "b", "read_span")


def estimate(k: int) -> Column:
    """The gap by the terminal hits of both sides, seen in the read's direction."""
    def one(first: str, second: str, o1: Column, o2: Column) -> Column:
        tail, head = F.element_at(f"{first}.hits", -1), F.element_at(f"{second}.hits", 1)
        left = F.when(o1 == "+", F.col(f"{first}.length") - tail["cpos"] - k).otherwise(tail["cpos"])
        right = F.when(o2 == "+", head["cpos"]).otherwise(F.col(f"{second}.length") - head["cpos"] - k)
        return head["rpos"] - tail["rpos"] - left - right

    forward = F.col("a.map_idx") < F.col("b.map_idx")
    return F.when(forward, one("a", "b", F.col("source_ori"), F.col("target_ori"))).otherwise(one("b", "a", flip(F.col("target_ori")), flip(F.col("source_ori"))))


def best_reads(supports: DataFrame, k: int) -> DataFrame:
    """For each gap the read with the largest (mean hits of both sides, id) whose estimate is no longer than the read's span."""
    ok = supports.withColumn("est", estimate(k)).filter(F.abs("est") <= F.col("read_span")).withColumn("mean_hits", (F.col("a.hit_count") + F.col("b.hit_count")) / 2)
    w = Window.partitionBy("path_id", "step").orderBy(F.desc("mean_hits"), F.desc("read_id"))
    return ok.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def cut_points(best: DataFrame, k: int) -> DataFrame:
    """Where contigs and read are cut: at the hit of either side that is next to the gap, a k-mer further where the cut is after it."""
    sa = F.when(F.col("a.ori") == F.col("source_ori"), F.element_at("a.hits", -1)).otherwise(F.element_at("a.hits", 1))
    sb = F.when(F.col("b.ori") == F.col("target_ori"), F.element_at("b.hits", 1)).otherwise(F.element_at("b.hits", -1))
    ctg = lambda pos, read, o: pos + F.when((read == o) & (o == "-"), k).otherwise(0)
    rd = lambda pos, read, o: pos + F.when((read != o) & (o == "+"), k).otherwise(0)
    ao, bo, so, to = F.col("a.ori"), F.col("b.ori"), F.col("source_ori"), F.col("target_ori")
    return best.select(
        "path_id", "step", "source", "source_ori", "target", "target_ori", "gap_size", "read_id", ao.alias("read_ori"), ctg(sa["cpos"], ao, so).alias("source_ctg_cut"),
        rd(sa["rpos"], ao, so).alias("source_read_cut"), ctg(sb["cpos"], bo, to).alias("target_ctg_cut"), rd(sb["rpos"], bo, to).alias("target_read_cut"),
    )


def keep_span(seq: Column, start: Column, stop: Column) -> Column:
    """A sequence of the same length with N outside [start, stop)."""
    start, stop = F.greatest(start, F.lit(0)), F.least(stop, F.length(seq))
    inside = F.greatest(stop - start, F.lit(0))
    return F.concat(F.repeat(F.lit("N"), F.least(start, F.length(seq))), F.substring(seq, start + 1, inside), F.repeat(F.lit("N"), F.greatest(F.length(seq) - F.greatest(stop, start), F.lit(0))))


def around(cuts: DataFrame, contigs: DataFrame, reads: DataFrame) -> DataFrame:
    """Sequences around each gap and what is kept of them, [start, stop): path_id, step, role (source, target, read), name, seq, start,
    stop. Only reads that were chosen are looked up."""
    zero, whole = F.lit(0), F.length("seq")
    one = lambda role, start, stop: (F.lit(role).alias("role"), F.col("read_id" if role == "read" else role).alias("name"), "seq", start.alias("start"), stop.alias("stop"))
    plus = lambda side: F.col(f"{side}_ori") == "+"
    src = cuts.join(contigs.select(F.col("contig").alias("source"), "seq"), "source")
    src = src.select("path_id", "step", *one("source", F.when(plus("source"), F.col("source_ctg_cut")).otherwise(zero), F.when(plus("source"), whole).otherwise(F.col("source_ctg_cut"))))
    tgt = cuts.join(contigs.select(F.col("contig").alias("target"), "seq"), "target")
    tgt = tgt.select("path_id", "step", *one("target", F.when(plus("target"), zero).otherwise(F.col("target_ctg_cut")), F.when(plus("target"), F.col("target_ctg_cut")).otherwise(whole)))
    read = cuts.join(reads.select("read_id", "seq"), "read_id").select("path_id", "step", *one("read", F.least("source_read_cut", "target_read_cut"), F.greatest("source_read_cut", "target_read_cut")))
    return src.union(tgt).union(read)


def masked(cuts: DataFrame, contigs: DataFrame, reads: DataFrame) -> DataFrame:
    """Sequences around each gap, N elsewhere: path_id, step, role (source, target, read), name, seq."""
    return around(cuts, contigs, reads).select("path_id", "step", "role", "name", keep_span(F.col("seq"), F.col("start"), F.col("stop")).alias("seq"))


def remapped(cuts: DataFrame, contigs: DataFrame, reads: DataFrame, k: int = 20, w: int = 10, stringent: bool = False, scheme: str = "modular") -> DataFrame:
    """Cut points again, from a finer sketch of the sequences around gaps: hashes that both contigs of a gap have once in all, runs and
    subsumption as in mapping, exactly both contigs left, each consistent and in the orientation expected. Gaps where that fails keep
    the coarse cuts (old_anchor_used), or none if stringent. No k-mer has an N, so what is kept of a sequence is sketched alone, and its
    place added."""
    gap = F.concat_ws("|", "path_id", F.col("step").cast("string"))
    kept = around(cuts, contigs, reads).withColumn("from", F.greatest("start", F.lit(0)))
    kept = stage(kept.select(gap.alias("gap"), "role", "from", F.length("seq").alias("size"), F.expr("substring(seq, from + 1, greatest(least(stop, length(seq)) - from, 0))").alias("seq")))
    sk = sketch.sketch(kept, k, w, "gap", scheme=scheme, keep=["role", "from", "size"]).withColumnRenamed("id", "gap").withColumn("pos", F.col("pos") + F.col("from"))
    ctg = sk.filter("role <> 'read'").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gap", "hash"))).filter("n = 1")
    hits = sk.filter("role = 'read'").select("gap", "hash", F.col("pos").alias("rpos"), F.col("strand").alias("rstrand"), F.col("size").alias("read_len")).join(ctg.select("gap", "hash", F.col("role").alias("contig"), F.col("pos").alias("cpos"), F.col("strand").alias("cstrand")), ["gap", "hash"])
    hits = hits.withColumnRenamed("gap", "read_id").withColumn("hit_idx", F.row_number().over(Window.partitionBy("read_id").orderBy("rpos")) - 1)
    fine = consistent(mapping.mappings(mapping.accepted(hits.withColumn("length", F.lit(None).cast("int")), k)))
    side = lambda role, p: fine.filter(F.col("contig") == role).select(F.col("read_id").alias("gap"), F.struct("ori", "hits").alias(p))
    both = cuts.withColumn("gap", gap).join(side("source", "a"), "gap").join(side("target", "b"), "gap")
    agree = (F.col("a.ori") == F.col("source_ori")) == (F.col("b.ori") == F.col("target_ori"))
    new = cut_points(both.filter(agree), k).withColumn("old_anchor_used", F.lit(False))
    if stringent:
        return new
    return new.union(cuts.join(new.select("path_id", "step"), ["path_id", "step"], "left_anti").withColumn("old_anchor_used", F.lit(True)).select(*new.columns))


def final_trims(trimmed: DataFrame, cuts: DataFrame) -> DataFrame:
    """What is left of each contig: the overlap stage's trims and the cuts of the gaps on either side, whichever cuts more."""
    five = cuts.select(F.when(F.col("source_ori") == "-", F.struct(F.col("source").alias("contig"), F.col("source_ctg_cut").alias("five"), F.lit(None).cast("int").alias("three"))).otherwise(F.struct(F.col("source").alias("contig"), F.lit(None).cast("int").alias("five"), F.col("source_ctg_cut").alias("three"))).alias("s"))
    three = cuts.select(F.when(F.col("target_ori") == "+", F.struct(F.col("target").alias("contig"), F.col("target_ctg_cut").alias("five"), F.lit(None).cast("int").alias("three"))).otherwise(F.struct(F.col("target").alias("contig"), F.lit(None).cast("int").alias("five"), F.col("target_ctg_cut").alias("three"))).alias("s"))
    c = five.union(three).select("s.*").groupBy("contig").agg(F.max("five").alias("five"), F.min("three").alias("three"))
    t = trimmed.join(c, "contig", "left")
    return t.select("contig", F.greatest("start", F.coalesce("five", F.lit(0))).alias("start"), F.least("stop", F.coalesce("three", "stop")).alias("stop"))


def layout(paths: DataFrame, gaps: DataFrame, cuts: DataFrame, spans: DataFrame) -> DataFrame:
    """What stands where: for each step its contig's span, and what follows: a read's span (fill), or N (left)."""
    p = paths.join(spans, "contig")
    p = p.join(gaps.select("path_id", "step", F.lit(True).alias("is_pair")), ["path_id", "step"], "left")
    fill = cuts.select("path_id", "step", "read_id", F.when(F.col("read_ori") == F.col("source_ori"), "+").otherwise("-").alias("read_strand"), F.least("source_read_cut", "target_read_cut").alias("r0"), F.greatest("source_read_cut", "target_read_cut").alias("r1"))
    crossed = F.when(F.col("read_strand") == "+", F.col("source_read_cut") > F.col("target_read_cut")).otherwise(F.col("target_read_cut") > F.col("source_read_cut"))
    fill = cuts.select("path_id", "step", "source_read_cut", "target_read_cut").join(fill, ["path_id", "step"]).withColumn("r1", F.when(crossed, F.col("r0")).otherwise(F.col("r1"))).drop("source_read_cut", "target_read_cut")
    return p.join(fill, ["path_id", "step"], "left").withColumn("left", F.when(F.col("read_id").isNull(), F.greatest(F.coalesce(F.col("gap") - 1, F.lit(0)), F.lit(0))).otherwise(0))


def filled(placed: DataFrame, contigs: DataFrame, reads: DataFrame, soft_mask: bool = False) -> DataFrame:
    """Sequences (id, seq) of paths with gaps filled, and of contigs on no path, whole. The first base of a contig right after a join
    without a gap is lower-case."""
    w = Window.partitionBy("path_id").orderBy("step")
    p = placed.withColumn("joined", F.coalesce((F.lag("gap").over(w) == 1), F.lit(False))).join(contigs.select("contig", "seq"), "contig")
    cut = oriented(F.expr("substring(seq, start + 1, greatest(stop - start, 0))"), F.col("ori"))
    p = p.withColumn("piece", cut).withColumn("piece", F.when(F.col("joined"), F.concat(F.lower(F.substring("piece", 1, 1)), F.expr("substring(piece, 2)"))).otherwise(F.col("piece"))).drop("seq")
    p = p.join(reads.select("read_id", F.col("seq").alias("read_seq")), "read_id", "left")
    part = F.expr("substring(read_seq, r0 + 1, greatest(r1 - r0, 0))")
    part = F.when(F.col("read_strand") == "-", revcomp(part)).otherwise(part)
    after = F.coalesce(F.lower(part) if soft_mask else part, F.repeat(F.lit("N"), F.col("left").cast("int")))
    arr = F.array_sort(F.collect_list(F.struct("step", F.concat("piece", after).alias("x"))))
    made = p.groupBy("path_id").agg(F.array_join(F.transform(arr, lambda s: s["x"]), "").alias("seq"))
    alone = contigs.join(placed.select("contig"), "contig", "left_anti").select("contig", "seq")
    return made.select(F.col("path_id").alias("id"), "seq").union(alone)


def fill_stats(paths: DataFrame, gaps: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row: num_gaps, small_gaps (no pair), potential_fills, filled_gaps, new_anchors, old_anchors, unfilled."""
    n = paths.agg(F.count_if(F.col("gap").isNotNull()).alias("num_gaps"))
    p = gaps.agg(F.count(F.lit(1)).alias("potential_fills"))
    old = "old_anchor_used" in cuts.columns
    c = cuts.agg(F.count(F.lit(1)).alias("filled_gaps"), (F.count_if(F.col("old_anchor_used")) if old else F.count(F.lit(1))).alias("old_anchors"))
    one = n.crossJoin(p).crossJoin(c)  # one row each
    return one.select("num_gaps", (F.col("num_gaps") - F.col("potential_fills")).alias("small_gaps"), "potential_fills", "filled_gaps", (F.col("filled_gaps") - F.col("old_anchors")).alias("new_anchors"), "old_anchors", (F.col("potential_fills") - F.col("filled_gaps")).alias("unfilled"))


def agp(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """AGP rows with kind P for pieces of reads. Every written row counts as a part, eroded pieces have no row, and objects that are
    one contig begin at 1."""
    none = F.lit(None).cast("string")
    kinds = F.array(
        F.struct(F.lit(0).alias("second"), F.lit("W").alias("kind"), (F.col("stop") - F.col("start")).cast("long").alias("size"), F.col("contig").alias("component"), (F.col("start") + 1).cast("string").alias("from"), F.col("stop").cast("string").alias("to"), F.col("ori").alias("o")),
        F.struct(F.lit(1).alias("second"), F.lit("P").alias("kind"), (F.col("r1") - F.col("r0")).cast("long").alias("size"), F.col("read_id").alias("component"), (F.col("r0") + 1).cast("string").alias("from"), F.col("r1").cast("string").alias("to"), F.col("read_strand").alias("o")),
        F.struct(F.lit(2).alias("second"), F.lit("N").alias("kind"), F.col("left").cast("long").alias("size"), F.col("left").cast("string").alias("component"), F.lit("scaffold").alias("from"), F.lit("yes").alias("to"), F.coalesce(none, F.lit("paired-ends")).alias("o")),
    )
    rows = placed.select("path_id", "step", F.explode(kinds).alias("p")).select("path_id", "step", "p.*").filter("size > 0")
    w = Window.partitionBy("path_id").orderBy("step", "second")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select(F.col("path_id").alias("object"), (before + 1).alias("start"), (before + F.col("size")).alias("stop"), F.row_number().over(w).alias("part"), "kind", "component", "from", "to", F.col("o").alias("ori"))
    alone = spans.join(placed.select("contig"), "contig", "left_anti").select("contig", F.lit(1).cast("long"), (F.col("stop") - F.col("start")).cast("long"), F.lit(1), F.lit("W"), F.col("contig").alias("c"), (F.col("start") + 1).cast("string"), F.col("stop").cast("string"), F.lit("+"))
    return rows.union(alone)
