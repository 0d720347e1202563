"""From files to files: what a command line would call. Sequences are read from FASTA or FASTQ, and each round's results are written
below one folder, every file as a folder of part files (see sources.formats)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.shared import stage
from ..operators import paf, pairs
from ..sources import formats
from ..sources.sequences import read_sequences, write_fasta
from . import engine

#: The least value of each number; the k-mer sizes have a largest one too, which is what the hash takes.
LEAST = {"k": 2, "w": 1, "n": 1, "max_n": 1, "g": 0, "max_gap": -1, "f": 1, "a": 0, "z": 0, "x": 0, "merge_gap": 0, "small_k": 2, "small_w": 1, "gap_k": 2, "gap_w": 1, "min_gap": 1}
MOST_K = 512


def check(p: engine.Params, target: str | list[str] = "-", reads: str | list[str] = "-", rounds: int = 1) -> None:
    """Raises ValueError, which names the parameter, for values that no run can have."""
    for name, given in (("target", target), ("reads", reads)):
        if not given or not all([given] if isinstance(given, str) else given):
            raise ValueError(f"{name} must be set")
    for name, least in LEAST.items():
        value = getattr(p, name)
        if isinstance(value, bool) or not isinstance(value, (int, float) if name == "x" else int) or value < least:
            raise ValueError(f"{name} must be a number of {least} or more, not {value!r}")
    for name in ("k", "small_k", "gap_k"):
        if getattr(p, name) > MOST_K:
            raise ValueError(f"{name} must be {MOST_K} or less, not {getattr(p, name)}")
    if p.max_n < p.n:
        raise ValueError(f"max_n ({p.max_n}) must not be less than n ({p.n})")
    if p.transitive and p.conservative:
        raise ValueError("transitive judges what other layouts add, so it needs conservative=False")
    if rounds < 1:
        raise ValueError(f"rounds must be 1 or more, not {rounds}")


def write_round(r: engine.Result, sequences: DataFrame, agp: DataFrame, out: str, p: engine.Params, paf_too: bool = False) -> None:
    """mappings.tsv, pairs.tsv, graph.dot, layout.path, trimmed.path, trims.tsv, scaffolds.agp, scaffolds.fa and, if asked, mappings.paf."""
    lengths = engine.lengths_of(r.contigs)
    formats.write_mappings(r.mappings, f"{out}/mappings.tsv")
    formats.write_pairs(pairs.gap_estimates(pairs.read_pairs(r.mappings, p.f), p.k), f"{out}/pairs.tsv")
    formats.write_dot(pairs.vertices(r.edges, lengths), r.graph, f"{out}/graph.dot", formats.largest_number(r.contigs, p.prefix))
    formats.write_paths(r.plain_paths, f"{out}/layout.path")
    formats.write_paths(r.paths, f"{out}/trimmed.path")
    formats.write_trims(r.trims, f"{out}/trims.tsv")
    formats.write_agp(agp, f"{out}/scaffolds.agp")
    write_fasta(sequences, f"{out}/scaffolds.fa")
    if paf_too:
        formats.write_paf(paf.paf_rows(r.mappings, p.k), f"{out}/mappings.paf")


def run(spark: SparkSession, target: str | list[str], reads: str | list[str], out: str, p: engine.Params = engine.Params(), rounds: int = 1, fill_gaps: bool = False, paf_too: bool = False, mappings: str | None = None) -> DataFrame:
    """Scaffolds the target by the reads and writes `<out>/round<i>` for each round; returns the last round's sequences (id, seq).

    mappings: the mapping file of an earlier run over the same target; reads are then not mapped again. That file lacks read
    lengths, so the largest read position of a read's hits stands for its length."""
    check(p, target, reads, rounds)
    contigs = stage(read_sequences(spark, target).selectExpr("id AS contig", "seq"))
    read = stage(read_sequences(spark, reads).selectExpr("id AS read_id", "seq"))
    mapped = pairs.from_checkpoint(formats.read_mappings(spark, mappings, engine.lengths_of(contigs))) if mappings else None
    for i, (r, sequences, agp) in enumerate(engine.each_round(contigs, read, p, rounds, fill_gaps, mapped)):
        write_round(r, sequences, agp, f"{out}/round{i + 1}", p, paf_too)
    return sequences
