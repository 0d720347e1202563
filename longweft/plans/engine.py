"""The engine's entry points: pair, scaffold, gap_fill, each_round, run_rounds, over contigs (contig, seq) and reads (read_id, seq)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..functions.shared import stage
from ..operators import assembly, gapfill, layout, liftover, mapping, overlap, pairs, sketch
from ..sources.formats import largest_number


@dataclass(frozen=True)
class Params:
    """What a user can set; defaults are the production ones."""

    k: int = 32
    w: int = 100
    n: int = 1
    max_n: int = 10
    g: int = 20
    max_gap: int = -1
    f: int = 10
    a: int = 1
    z: int = 1000
    x: float = 0
    sensitive: bool = False
    repeats: bool = False
    overlap: bool = True
    merge_gap: int = 0
    conservative: bool = True
    transitive: bool = False
    soft_mask: bool = False
    stringent: bool = False
    small_k: int = 15
    small_w: int = 5
    gap_k: int = 20
    gap_w: int = 10
    min_gap: int = 1
    prefix: str = layout.PREFIX
    scheme: str = "modular"


@dataclass
class Result:
    contigs: DataFrame
    mappings: DataFrame
    edges: DataFrame
    graph: DataFrame
    paths: DataFrame
    plain_paths: DataFrame
    trims: DataFrame
    agp: DataFrame
    scaffolds: DataFrame


def lengths_of(contigs: DataFrame) -> DataFrame:
    return contigs.select("contig", F.length("seq").alias("length"))


def map_reads(contigs: DataFrame, reads: DataFrame, p: Params) -> DataFrame:
    """Mappings of all reads, written once: every later stage starts from them."""
    made = sketch.sketch(contigs.withColumn("length", F.length("seq")), p.k, p.w, "contig", scheme=p.scheme, keep=["length"], twice=True)
    sized = sketch.sketch(reads.withColumn("read_len", F.length("seq")), p.k, p.w, "read_id", scheme=p.scheme, keep=["read_len"])
    found = mapping.hits(sized, mapping.unique_minimizers(made, ["length"]), p.z)
    if p.repeats:
        found = mapping.repeat_filter(found)
    return stage(mapping.mappings(mapping.accepted(found, p.k, p.x, p.sensitive)))


def pair(contigs: DataFrame, mapped: DataFrame, p: Params) -> DataFrame:
    """Filtered contig pairs of mappings; mappings without read lengths are taken for a checkpoint's."""
    estimates = pairs.gap_estimates(pairs.read_pairs(mapped, p.f), p.k)
    return stage(pairs.edge_filters(pairs.tally(estimates), lengths_of(contigs), p.a, p.n))


def best_edges(edges: DataFrame, p: Params) -> DataFrame:
    """Layout edges of every threshold w."""
    return stage(layout.unambiguous(layout.transitive_reduction(layout.weight_sweep(edges, p.n, p.max_n), ["w"]), ["w"]))


def stitched(edges: DataFrame, best: int, p: Params, chosen: DataFrame | None = None) -> DataFrame:
    """Layout edges of the best threshold and, unless conservative, those that other thresholds' layouts add to it. With
    `transitive`, an added edge stays only where the graph, and what the other layouts' paths add to it, spans it.
    chosen: best_edges(), where they are there already."""
    chosen = best_edges(edges, p) if chosen is None else chosen
    mine = chosen.filter(F.col("w") == best).select("src", "dst", "d", "n")
    if p.conservative:
        return mine
    others = chosen.filter(F.col("w") != best)
    new = layout.stitch_candidates(mine, others.withColumn("file", F.col("w")))
    both = mine.withColumn("new", F.lit(False)).union(new.select("src", "dst", "d", "n", F.lit(True)))
    linear = layout.linearize(both)
    if p.transitive:
        laid = layout.one_strand(layout.chains(others, ["w"]), ["w"])
        paths = stage(laid.select(F.concat_ws(":", "w", "start").alias("path_id"), "step", F.expr("left(node, length(node) - 1)").alias("contig"), F.expr("right(node, 1)").alias("ori")))
        linear = stage(linear)
        linear = layout.transitive_filter(linear, edges.select("src", "dst").union(layout.window_edges(paths, mine, edges)))
    return linear.drop("new")


def scaffold(contigs: DataFrame, reads: DataFrame | None, p: Params = Params(), mapped: DataFrame | None = None) -> Result:
    """One round: mappings (given ones are not made again), pairs, the best layout, overlaps trimmed, scaffolds."""
    lengths = lengths_of(contigs)
    mapped = map_reads(contigs, reads, p) if mapped is None else mapped
    edges = pair(contigs, mapped, p)
    graph = stage(pairs.both_strands(edges))
    by_weight = best_edges(graph, p)
    weights = layout.optimal_of(by_weight, lengths, p.g).filter("best").collect()  # one row
    chosen = stitched(graph, weights[0]["w"] if weights else p.n, p, by_weight)
    chained = layout.one_strand(layout.chains(chosen))
    laid = chained.select("start", "step", F.expr("left(node, length(node) - 1)").alias("contig"), F.expr("right(node, 1)").alias("ori"), layout.written_gap("gap_after", p.g).alias("gap"), F.col("gap_after").alias("d"))
    used = largest_number(contigs, p.prefix)  # ids of earlier rounds stay unique
    plain = stage(layout.cap_gap(layout.named_paths(laid, 0 if used is None else used + 1, p.prefix), p.max_gap))
    if p.overlap:
        regions = stage(overlap.valid_regions(plain, lengths, p.small_k, p.g))
        fine = sketch.sketch(overlap.region_sequences(contigs, regions), p.small_k, p.small_w, "contig", scheme=p.scheme)
        cuts = stage(overlap.cut_points(overlap.shared_minimizers(overlap.region_minimizers(fine, regions), regions)))
        trims = stage(overlap.trims(plain, cuts, lengths, p.small_k))
        paths = stage(overlap.trimmed_paths(plain, cuts, trims, p.g, p.merge_gap + 1))
    else:
        none = F.lit(None).cast("int")
        trims = lengths.select("contig", F.lit(None).cast("string").alias("ori"), none.alias("source_cut"), none.alias("target_cut"), F.lit(0).alias("start"), F.col("length").alias("stop"), F.lit(False).alias("omitted"))
        paths = plain
    made = assembly.merge(paths, assembly.trimmed_sequences(contigs, trims))
    return Result(contigs, mapped, edges, graph, paths, plain, trims, overlap.agp(paths, trims), made)


def scaffold_chunks(r: Result, size: int = assembly.CHUNK) -> DataFrame:
    """A round's scaffolds as rows (id, offset, chunk), for those that are too long for one string."""
    return assembly.merge_chunks(r.paths, assembly.trimmed_sequences(r.contigs, r.trims), size)


def gap_fill(r: Result, reads: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gaps of a round's paths filled from reads: sequences (id, seq), AGP rows, statistics."""
    gaps = stage(gapfill.gap_pairs(r.paths, p.min_gap))
    coarse = stage(gapfill.cut_points(gapfill.best_reads(gapfill.supporting_reads(r.mappings, gaps), p.k), p.k))
    cuts = stage(gapfill.remapped(coarse, r.contigs, reads, p.gap_k, p.gap_w, p.stringent, p.scheme))
    spans = gapfill.final_trims(r.trims, cuts)
    placed = stage(gapfill.layout(r.paths, gaps, cuts, spans))
    return gapfill.filled(placed, r.contigs, reads, p.soft_mask), gapfill.agp(placed, spans), gapfill.fill_stats(r.paths, gaps, cuts)


def each_round(contigs: DataFrame, reads: DataFrame, p: Params = Params(), rounds: int = 5, fill_gaps: bool = False, mapped: DataFrame | None = None) -> Iterator[tuple[Result, DataFrame, DataFrame]]:
    """Rounds, each on the sequences (id, seq) of the one before: its result, sequences and AGP. Reads are mapped once, or not at all
    where mappings are given; later rounds lift the mappings over."""
    for i in range(rounds):
        r = scaffold(contigs, reads, p, mapped)
        seqs, agp = (r.scaffolds.select("id", "seq"), r.agp)
        if fill_gaps:
            seqs, agp, _ = gap_fill(r, reads, p)
        seqs = stage(seqs)
        yield r, seqs, agp
        if i < rounds - 1:
            contigs = seqs.select(F.col("id").alias("contig"), "seq")
            mapped = stage(liftover.lift_mappings(r.mappings, agp, lengths_of(contigs), p.k))


def run_rounds(contigs: DataFrame, reads: DataFrame, p: Params = Params(), rounds: int = 5, fill_gaps: bool = False) -> DataFrame:
    """The sequences (id, seq) of the last round."""
    for _, contigs, _ in each_round(contigs, reads, p, rounds, fill_gaps):
        pass
    return contigs


__all__ = ["Params", "Result", "each_round", "gap_fill", "map_reads", "pair", "replace", "run_rounds", "scaffold", "scaffold_chunks"]
