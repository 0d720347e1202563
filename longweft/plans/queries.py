"""Queries by name over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dna import flip, revcomp
from ..functions.shared import shared_folder, stage
from ..operators import assembly, gapfill, layout, liftover, mapping, overlap, paf, pairs, sketch
from ..sources.formats import largest_number
from ..streaming import pair_tally
from . import engine, sql
from .fixture import FINE_K, K, MOST, W, Z, Assembly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def q(name: str, select: str | None, build: Callable[[Assembly], DataFrame], overlapping: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Assembly(spark, sf_dir, overlapping))
    if select:
        ORACLE_SQL[name] = sql.query(select)


q("flagship_scaffold_edges", "SELECT source, source_ori, target, target_ori, n, d, anchor FROM edges", lambda a: a.edges)
# sequences
q("revcomp", f"SELECT doc_id, {sql.rc('seq')} AS rc FROM s_dna", lambda a: a.dna.select("doc_id", revcomp(F.col("seq")).alias("rc")))
q("orientation_flip", f"SELECT src, {sql.flip('src')} AS dst_rc FROM graph", lambda a: a.graph.select("src", flip(F.col("src")).alias("dst_rc")))
q("contig_lengths", "SELECT contig, length FROM contigs", lambda a: a.lengths)
q("max_numbered_id", "SELECT max(regexp_extract(path_id, '^scaffold_(\\d+)$', 1)::INT) AS largest FROM named", lambda a: a.spark.createDataFrame([(largest_number(a.paths.select(F.col("path_id").alias("contig")), "scaffold_"),)], "largest int"))
# sketches
q("kmer_enumerate", "SELECT id, pos::INT AS pos, hash, strand FROM target_kmers", lambda a: sketch.kmers(a.cut_contigs, K, "contig", whole=True))
q("canonical_kmers", "SELECT hash, count(*) AS n FROM target_kmers GROUP BY hash", lambda a: sketch.kmers(a.cut_contigs, K, "contig", whole=True).groupBy("hash").agg(F.count(F.lit(1)).alias("n")))
q("minimizer_sketch", "SELECT id, pos::INT AS pos, hash, strand FROM target_mx", lambda a: a.target)
q("read_sketch_with_length", "SELECT id, pos::INT AS pos, hash, strand, read_len FROM read_mx JOIN reads ON read_id = id", lambda a: a.read_sketch)
q("minimizer_density", "SELECT id, count(*) AS n_minimizers, avg(step) AS mean_spacing, max(step)::INT AS max_spacing FROM (SELECT id, pos - lag(pos) OVER (PARTITION BY id ORDER BY pos) AS step FROM target_mx) GROUP BY id", lambda a: sketch.density(a.target))
sql.STEPS["fine_kmers"] = sql.kmers("contigs", "contig", 15)
sql.STEPS["fine_mx"] = sql.minimizers("fine_kmers", 5)
q("sketch_fine_kw", "SELECT id, pos::INT AS pos, hash, strand FROM fine_mx", lambda a: sketch.sketch(a.cut_contigs, 15, 5, "contig", whole=True))
q("sketch_lines", "SELECT id, string_agg(hash || ':' || pos || ':' || strand, ' ' ORDER BY pos) AS minimizers FROM target_mx GROUP BY id", lambda a: sketch.as_line(a.target))
# index and hits
q("unique_minimizers", "SELECT hash, contig, cpos, cstrand FROM target_index", lambda a: a.index.drop("length"))
HITS = "read_id, hit_idx, hash, rpos, rstrand, contig, cpos, cstrand, length, read_len"
q("read_hits", f"SELECT {HITS} FROM hits", lambda a: a.hits.select(*HITS.split(", ")))
# hashes cut short, so that a read has some twice
q("repeat_filter", f"SELECT {HITS} FROM (SELECT * REPLACE (hash % 4096 AS hash) FROM hits) QUALIFY count(*) OVER (PARTITION BY read_id, hash) = 1", lambda a: mapping.repeat_filter(a.hits.withColumn("hash", F.col("hash") % 4096)).select(*HITS.split(", ")))
q("length_filter", "SELECT hash, contig, cpos FROM target_index JOIN contigs USING (contig) WHERE length >= 1200", lambda a: a.index.filter(F.col("length") >= 1200).select("hash", "contig", "cpos"))
NOISY = f"SELECT read_id, contig, count(*) AS n, max(cpos) - min(cpos) AS span FROM hits GROUP BY read_id, contig HAVING count(*) >= 2 AND max(cpos) - min(cpos) > least(min(read_len) + {K}, 0.9 * abs(arg_max(rpos, cpos * 100000 - hit_idx) - arg_min(rpos, cpos * 100000 + hit_idx)) + {K})"
q("noisy_contigs", NOISY, lambda a: mapping.noisy_contigs(a.hits, K, 0.9))
# runs
q("contig_runs", "SELECT read_id, hit_idx, contig, run_idx FROM run_hits", lambda a: mapping.contig_runs(mapping.quiet(a.hits, K)).select("read_id", "hit_idx", "contig", "run_idx"))
# every third contig's hits under one name, so that runs lie inside others
sql.STEPS["mixed"] = sql.runs("(SELECT * REPLACE (CASE WHEN substr(hash::VARCHAR, length(hash::VARCHAR), 1) IN ('3', '7') THEN 'shared' ELSE contig END AS contig) FROM hits)")
sql.STEPS["mixed_bounds"] = sql.STEPS["bounds"].replace("run_hits", "mixed")


def mixed(a: Assembly) -> DataFrame:
    return mapping.contig_runs(a.hits.withColumn("contig", F.when(F.substring(F.col("hash").cast("string"), -1, 1).isin("3", "7"), "shared").otherwise(F.col("contig"))))


q("subsumed_specific", sql.STEPS["specific"].replace("bounds", "mixed_bounds"), lambda a: mapping.subsumed_specific(mapping.run_bounds(mixed(a))))
q("subsumed_sensitive", "SELECT b.read_id, b.run_idx FROM mixed_bounds b WHERE EXISTS (SELECT 1 FROM mixed_bounds c WHERE b.read_id = c.read_id AND c.contig <> b.contig AND c.first < b.run_idx AND b.run_idx < c.last)", lambda a: mapping.subsumed_sensitive(mapping.run_bounds(mixed(a))))
q("verbose_mapping", "SELECT read_id, map_idx, contig, hit_count, hit_text AS hits FROM mapped", lambda a: a.mappings.select("read_id", "map_idx", "contig", "hit_count", mapping.hit_text().alias("hits")))
# pairs
EST = "read_id, source, source_ori, target, target_ori, gap, anchored, read_len"
q("gap_estimates", f"SELECT {EST} FROM estimates", lambda a: a.estimates)
q("pairs_transitive", f"SELECT read_id, ac AS a, bc AS b FROM ({sql.pair_rows('mapped', MOST).format(cols='a.contig AS ac, b.contig AS bc')})", lambda a: pairs.read_pairs(a.mappings, MOST).select("read_id", "a.contig", F.col("b.contig").alias("b")).withColumnRenamed("contig", "a"))
q("pairs_adjacent_over_f", f"SELECT read_id, ac AS a, bc AS b FROM ({sql.pair_rows('mapped', 2).format(cols='a.contig AS ac, b.contig AS bc')})", lambda a: pairs.read_pairs(a.mappings, 2).select("read_id", "a.contig", F.col("b.contig").alias("b")).withColumnRenamed("contig", "a"))
PAIR = "source, source_ori, target, target_ori, n, d, anchor"
q("pair_tally", f"SELECT {PAIR} FROM tally", lambda a: a.tally)
q("edge_filters", f"SELECT {', '.join('t.' + c for c in PAIR.split(', '))} FROM tally t JOIN contigs s ON s.contig = source JOIN contigs u ON u.contig = target WHERE anchor >= 2 AND n >= 2 AND d > -s.length AND d > -u.length", lambda a: pairs.edge_filters(a.tally, a.lengths, 2, 2))
q("graph_both_strands", "SELECT src, dst, d, e, n FROM graph", lambda a: a.graph)
q("graph_vertices", "SELECT contig || o AS v, length FROM contigs, (VALUES ('+'), ('-')) t(o) WHERE contig IN (SELECT source FROM edges UNION SELECT target FROM edges)", lambda a: pairs.vertices(a.edges, a.lengths))
sql.STEPS["checkpoint"] = "SELECT * REPLACE (max(greatest(hr, tr)) OVER (PARTITION BY read_id) AS read_len) FROM mapped"
sql.STEPS["checkpoint_estimates"] = sql.estimates("checkpoint")
q("pairs_from_checkpoint", sql.TALLY.format("checkpoint_estimates"), lambda a: pairs.tally(pairs.gap_estimates(pairs.read_pairs(pairs.from_checkpoint(a.mappings), MOST), K)))

# mapped blocks
q("paf_blocks", "SELECT read_id, contig, block, cpos, rpos FROM paf_blocks", lambda a: paf.blocks(a.mappings).select("read_id", "contig", "block", "cpos", "rpos"))
q("paf_rows", sql.PAF, lambda a: paf.paf_rows(a.mappings, K))
# hits moved, so that single ones are out of order, blocks break, contig positions occur twice and some mappings have no block
ODD = {"cpos": "(cpos - cpos % 4)::INT", "rpos": "(CASE WHEN cpos % 17 = 3 THEN rpos + 997 WHEN cpos % 600 >= 300 THEN rpos + 5000 WHEN length < 1200 AND cpos % 3 = 0 THEN rpos * 7 % 1000 ELSE rpos END)::INT"}
sql.STEPS["accepted_odd"] = f"SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in ODD.items())}) FROM accepted"
sql.renamed("_odd", ["paf_sorted", "paf_flags", "paf_mode", "paf_act", "paf_left", "paf_blocks"], {"accepted": "accepted_odd"})


def moved(mapped: DataFrame, cpos: Callable[..., Column], rpos: Callable[..., Column]) -> DataFrame:
    """Mappings with other positions of their hits, in the same order."""
    return mapped.withColumn("hits", F.transform("hits", lambda h: F.struct(cpos(h).cast("int").alias("cpos"), h["cstrand"].alias("cstrand"), rpos(h).cast("int").alias("rpos"), h["rstrand"].alias("rstrand"))))


def odd(a: Assembly) -> DataFrame:
    rpos = lambda h: F.when(h["cpos"] % 17 == 3, h["rpos"] + 997).when(h["cpos"] % 600 >= 300, h["rpos"] + 5000).when((F.col("length") < 1200) & (h["cpos"] % 3 == 0), h["rpos"] * 7 % 1000).otherwise(h["rpos"])
    return moved(a.mappings, lambda h: h["cpos"] - h["cpos"] % 4, rpos)


q("paf_blocks_broken", "SELECT read_id, contig, block, cpos, rpos FROM paf_blocks_odd", lambda a: paf.blocks(odd(a)).select("read_id", "contig", "block", "cpos", "rpos"))
q("paf_rows_broken", sql.PAF.replace("paf_blocks", "paf_blocks_odd"), lambda a: paf.paf_rows(odd(a), K))
# layout
q("n_sweep_edges", "SELECT w, count(*) AS edges FROM graph_w GROUP BY w", lambda a: layout.weight_sweep(a.graph).groupBy("w").agg(F.count(F.lit(1)).alias("edges")))
q("transitive_reduction", "SELECT src, dst, d, n FROM reduced", lambda a: layout.transitive_reduction(a.graph).select("src", "dst", "d", "n"))
q("unambiguous_edges", "SELECT src, dst, d, n FROM best", lambda a: layout.unambiguous(layout.transitive_reduction(a.graph)).select("src", "dst", "d", "n"))
q("path_layout", "SELECT start, step, contig, ori, gap, d FROM paths", lambda a: layout.layout(a.graph))
q("optimal_n", "SELECT w, n50, row_number() OVER (ORDER BY n50 DESC, w) = 1 AS best FROM n50_w", lambda a: layout.optimal_weight(a.graph, a.lengths))
q("normalized_paths", "SELECT path_id, string_agg(contig || ori || CASE WHEN gap IS NULL THEN '' ELSE ' ' || gap || 'N' END, ' ' ORDER BY step) AS path FROM named GROUP BY path_id", lambda a: layout.path_lines(a.paths))
q("path_nodes", "SELECT path_id, step, contig, ori, gap FROM named", lambda a: layout.parse_path_lines(layout.path_lines(a.paths)))
q("gap_cap", "SELECT path_id, step, contig, CASE WHEN gap IS NOT NULL THEN least(gap, 151) END AS gap FROM named", lambda a: layout.cap_gap(a.paths, 150).select("path_id", "step", "contig", "gap"))
PATH_EDGES = """SELECT source || source_ori AS src, target || target_ori AS dst, gap - 1 AS d FROM nexts UNION ALL SELECT target || translate(target_ori, '+-', '-+'), source || translate(source_ori, '+-', '-+'), gap - 1 FROM nexts"""
sql.STEPS["nexts"] = "SELECT * FROM (SELECT path_id, step, contig AS source, ori AS source_ori, gap, d, lead(contig) OVER w AS target, lead(ori) OVER w AS target_ori FROM named WINDOW w AS (PARTITION BY path_id ORDER BY step)) WHERE target IS NOT NULL"
sql.STEPS["path_edges"] = PATH_EDGES
q("path_graph", "SELECT src, dst, d FROM path_edges", lambda a: layout.path_edges(a.paths))
# stitching: the layouts of all thresholds but 4 mend that of 4
sql.STEPS["best_4"] = "SELECT src, dst FROM best_w WHERE w = 4"
STITCH = """SELECT src, dst, trunc(median(d))::INT AS d, count(DISTINCT w) AS n FROM best_w WHERE w <> 4 AND (src, dst) NOT IN (SELECT (src, dst) FROM best_4) AND src NOT IN (SELECT src FROM best_4) AND dst NOT IN (SELECT dst FROM best_4) GROUP BY src, dst"""


def stitch(a: Assembly) -> DataFrame:
    best = layout.unambiguous(layout.transitive_reduction(layout.weight_sweep(a.graph), ["w"]), ["w"])
    return layout.stitch_candidates(best.filter("w = 4"), best.filter("w <> 4").withColumn("file", F.col("w")))


q("stitch_candidates", STITCH, stitch)
sql.STEPS["lin0"] = "SELECT src, dst, n, n < 3 AS new FROM reduced"
for _i, _end in ((1, "dst"), (2, "src")):
    sql.STEPS[f"lin{_i}"] = f"""SELECT src, dst, n, new FROM (SELECT *, count(*) OVER w AS c, count(*) FILTER (WHERE NOT new) OVER w AS old, count(*) FILTER (WHERE n = top) OVER w AS ties FROM (SELECT *, max(n) OVER (PARTITION BY {_end}) AS top FROM lin{_i - 1}) WINDOW w AS (PARTITION BY {_end}))
WHERE c = 1 OR CASE WHEN old > 0 THEN NOT new ELSE n = top AND ties = 1 END"""
q("linearized_edges", "SELECT src, dst, n, new FROM lin2", lambda a: layout.linearize(layout.transitive_reduction(a.graph).select("src", "dst", "n", (F.col("n") < 3).alias("new"))))
sql.STEPS["near"] = "SELECT a.path_id, a.contig || a.ori AS src, b.contig || b.ori AS dst, (b.step - a.step)::INT AS apart, a.step FROM named a JOIN named b ON a.path_id = b.path_id AND b.step > a.step AND b.step <= a.step + 4"
q("neighbourhood_edges", "SELECT path_id, src, dst, apart FROM near", lambda a: layout.neighbourhood_edges(a.paths))
sql.STEPS["spanning"] = "SELECT a.path_id, unnest(range(a.step, b.step)) AS step FROM graph JOIN named a ON a.contig || a.ori = src JOIN named b ON b.contig || b.ori = dst AND b.path_id = a.path_id WHERE b.step - a.step > 1"
q("transitive_support", "SELECT path_id, step, source || source_ori AS src, target || target_ori AS dst, coalesce(c, 0) AS support FROM nexts LEFT JOIN (SELECT path_id, step, count(*) AS c FROM spanning GROUP BY ALL) USING (path_id, step)", lambda a: layout.transitive_support(a.paths, a.graph))
# what the stitching engine calls: edges around steps that fewer than 3 reads support, and new edges that the graph doesn't span
sql.STEPS["bare"] = "SELECT path_id, step FROM nexts WHERE (source || source_ori, target || target_ori) NOT IN (SELECT (src, dst) FROM graph WHERE n >= 3)"
sql.STEPS["around"] = """SELECT DISTINCT a.contig AS c1, a.ori AS o1, b.contig AS c2, b.ori AS o2 FROM bare x JOIN named a ON a.path_id = x.path_id AND a.step BETWEEN x.step - 4 AND x.step JOIN named b ON b.path_id = x.path_id AND b.step BETWEEN x.step + 1 AND x.step + 5
WHERE b.step - a.step > 1 AND (a.contig || a.ori, b.contig || b.ori) NOT IN (SELECT (src, dst) FROM graph)"""
q("window_edges", f"SELECT c1 || o1 AS src, c2 || o2 AS dst FROM around UNION SELECT c2 || {sql.flip('o2')}, c1 || {sql.flip('o1')} FROM around", lambda a: layout.window_edges(a.paths, a.graph.filter("n >= 3"), a.graph))
sql.STEPS["spans"] = "SELECT a.start, a.step AS s0, b.step AS s1 FROM (SELECT DISTINCT src, dst FROM graph) JOIN chain a ON a.node = src JOIN chain b ON b.node = dst AND b.start = a.start WHERE b.step - a.step > 1"
sql.STEPS["held"] = """SELECT node FROM chain c WHERE EXISTS (FROM spans s WHERE s.start = c.start AND s0 < step AND s1 > step + 1)
OR EXISTS (FROM spans s WHERE s.start = c.start AND s0 = step AND s1 > step + 1) AND EXISTS (FROM spans s WHERE s.start = c.start AND s0 < step AND s1 = step + 1)"""
q("transitive_filter", "SELECT src, dst, d, n, n < 5 AS new FROM best WHERE n >= 5 OR src IN (SELECT node FROM held)", lambda a: layout.transitive_filter(layout.unambiguous(layout.transitive_reduction(a.graph)).select("src", "dst", "d", "n", (F.col("n") < 5).alias("new")), a.graph))
# overlaps: contigs whose neighbours overlap
q("valid_regions", "SELECT path_id, step, side, contig, ori, length, start, stop FROM regions_ov", lambda a: a.regions, True)
q("shared_minimizers", "SELECT path_id, step, hash, spos, tpos FROM shared_ov", lambda a: a.shared.select("path_id", "step", "hash", "spos", "tpos"), True)
q("overlap_islands", "SELECT path_id, step, hash, island FROM islands_ov", lambda a: overlap.islands(a.shared).select("path_id", "step", "hash", F.col("island").cast("int").alias("island")), True)
q("overlap_cuts", "SELECT path_id, step, spos, tpos, hash FROM cuts_ov", lambda a: a.cuts, True)
q("trim_coordinates", "SELECT contig, ori, source_cut, target_cut, start, stop, omitted FROM trims_ov", lambda a: a.trims, True)
q("trimmed_paths", "SELECT path_id, step, contig, ori, gap FROM trimmed_ov", lambda a: a.trimmed_paths.drop("d"), True)
q("agp_scaffold", 'SELECT object, start, stop, part, kind, component, "from", "to", ori FROM agp_ov', lambda a: overlap.agp(a.trimmed_paths, a.trims), True)
# cuts at fixed shares of contigs, so that many cross and contigs go
sql.STEPS["cuts_x"] = "SELECT path_id, step, (s.length * ((step * 53 + 31) % 100) // 100)::INT AS spos, (t.length * ((step * 37 + 11) % 100) // 100)::INT AS tpos FROM nexts JOIN contigs s ON s.contig = source JOIN contigs t ON t.contig = target"
sql.renamed("_x", ["cut_paths", "trims_ov", "trimmed_ov"], {"named_ov": "named", "cuts_ov": "cuts_x", "contigs_ov": "contigs"})


def crossing(a: Assembly) -> DataFrame:
    one = lambda side: a.lengths.select(F.col("contig").alias(side), F.col("length").alias(f"{side}_len"))
    both = overlap.neighbours(a.paths).join(one("source"), "source").join(one("target"), "target")
    at = lambda side, k, b: F.floor(F.col(f"{side}_len") * ((F.col("step") * k + b) % 100) / 100).cast("int")
    return both.select("path_id", "step", at("source", 53, 31).alias("spos"), at("target", 37, 11).alias("tpos"), F.lit(0).cast("long").alias("hash"))


q("trims_crossing", "SELECT contig, ori, source_cut, target_cut, start, stop, omitted FROM trims_ov_x", lambda a: overlap.trims(a.paths, crossing(a), a.lengths, FINE_K))
q("trimmed_paths_crossing", "SELECT path_id, step, contig, ori, gap FROM trimmed_ov_x", lambda a: overlap.trimmed_paths(a.paths, crossing(a), overlap.trims(a.paths, crossing(a), a.lengths, FINE_K)).drop("d"))
# assembly
q("trimmed_sequences", "SELECT contig, header, seq FROM cut_seqs", lambda a: assembly.trimmed_sequences(a.contigs, a.trims), True)
q("merged_scaffolds", "SELECT id, members, seq FROM merged", lambda a: assembly.merge(a.trimmed_paths, assembly.trimmed_sequences(a.contigs, a.trims)), True)
q("merged_chunks", 'SELECT id, unnest(range(0, length(seq), 700))::BIGINT AS "offset", substr(seq, unnest(range(0, length(seq), 700)) + 1, 700) AS chunk FROM merged', lambda a: assembly.merge_chunks(a.trimmed_paths, assembly.trimmed_sequences(a.contigs, a.trims), 700), True)
q("assembly_stats", sql.stats("merged"), lambda a: assembly.stats(assembly.merge(a.trimmed_paths, assembly.trimmed_sequences(a.contigs, a.trims))), True)

# gap filling
q("gap_pairs", "SELECT path_id, step, source, source_ori, target, target_ori, gap_size FROM gap_pairs", lambda a: a.gaps)
q("supporting_reads", "SELECT path_id, step, read_id, ao, bo, est, mean_hits FROM gap_est", lambda a: a.gap_reads.select("path_id", "step", "read_id", F.col("a.ori").alias("ao"), F.col("b.ori").alias("bo"), gapfill.estimate(K).cast("int").alias("est"), ((F.col("a.hit_count") + F.col("b.hit_count")) / 2).alias("mean_hits")))
q("best_gap_read", "SELECT path_id, step, read_id, est, mean_hits FROM best_reads", lambda a: gapfill.best_reads(a.gap_reads, K).select("path_id", "step", "read_id", F.col("est").cast("int").alias("est"), "mean_hits"))
CUTS = "path_id, step, source, source_ori, target, target_ori, gap_size, read_id, read_ori, source_ctg_cut, source_read_cut, target_ctg_cut, target_read_cut"
q("cut_points", f"SELECT {CUTS} FROM gap_cuts", lambda a: a.gap_cuts)
q("masked_sequences", "SELECT path_id, step, role, name, seq FROM masked", lambda a: gapfill.masked(a.gap_cuts, a.contigs, a.reads))
q("gap_fill_sequences", "SELECT id, seq FROM filled", lambda a: gapfill.filled(a.placed(a.gap_cuts)[0], a.contigs, a.reads))
q("fill_stats", "SELECT num_gaps, num_gaps - p AS small_gaps, p AS potential_fills, f AS filled_gaps, 0 AS new_anchors, f AS old_anchors, p - f AS unfilled FROM (SELECT count(gap) AS num_gaps FROM named), (SELECT count(*) AS p FROM gap_pairs), (SELECT count(*) AS f FROM gap_cuts)", lambda a: gapfill.fill_stats(a.paths, a.gaps, a.gap_cuts))
# reads of an odd number that begin late, so that they are too short for their gaps
LATE = "CASE WHEN right(read_id, 1) IN ('1', '3', '5', '7', '9') THEN 2900 ELSE 0 END"
sql.STEPS["mapped_late"] = f"SELECT * REPLACE ((hr - {LATE})::INT AS hr, (tr - {LATE})::INT AS tr) FROM mapped"
sql.renamed("_late", ["good", "supports", "gap_est", "best_reads", "gap_cuts"], {"mapped": "mapped_late"})


def late(a: Assembly) -> DataFrame:
    by = F.when(F.substring("read_id", -1, 1).isin(*"13579"), 2900).otherwise(0)
    return gapfill.supporting_reads(moved(a.mappings, lambda h: h["cpos"], lambda h: h["rpos"] - by), a.gaps)


q("best_gap_read_short", "SELECT path_id, step, read_id, est, mean_hits FROM best_reads_late", lambda a: gapfill.best_reads(late(a), K).select("path_id", "step", "read_id", F.col("est").cast("int").alias("est"), "mean_hits"))
q("fill_stats_unfilled", "SELECT num_gaps, num_gaps - p AS small_gaps, p AS potential_fills, f AS filled_gaps, 0 AS new_anchors, f AS old_anchors, p - f AS unfilled FROM (SELECT count(gap) AS num_gaps FROM named), (SELECT count(*) AS p FROM gap_pairs), (SELECT count(*) AS f FROM gap_cuts_late)", lambda a: gapfill.fill_stats(a.paths, a.gaps, stage(gapfill.cut_points(gapfill.best_reads(late(a), K), K))))
q("agp_gapfill", 'SELECT object, start, stop, part, kind, component, "from", "to", ori FROM fill_agp', lambda a: gapfill.agp(*a.placed(a.gap_cuts)))
q("gap_fill_remapped", None, lambda a: gapfill.remapped(a.gap_cuts, a.contigs, a.reads))
# liftover and rounds
q("liftover_hits", "SELECT read_id, map_idx, contig, j, cpos, cstrand, rpos, rstrand FROM lifted", lambda a: liftover.lift_hits(a.mappings, a.plain_agp, K).drop("read_len"))
# hits moved towards the ends of their contigs and off them
sql.STEPS["accepted_far"] = "SELECT * REPLACE ((cpos + 150)::INT AS cpos) FROM accepted"
sql.renamed("_far", ["lifted"], {"accepted": "accepted_far"})
q("liftover_hits_off_the_end", "SELECT read_id, map_idx, contig, j, cpos, cstrand, rpos, rstrand FROM lifted_far", lambda a: liftover.lift_hits(moved(a.mappings, lambda h: h["cpos"] + 150, lambda h: h["rpos"]), a.plain_agp, K).filter("j IS NOT NULL").drop("read_len"))
q("liftover_mappings", "SELECT read_id, map_idx, contig, hit_count, hits FROM lift_mapped SEMI JOIN lift_mono USING (read_id, contig)", lambda a: a.lifted.select("read_id", "map_idx", "contig", "hit_count", mapping.hit_text().alias("hits")))


def rounds_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Assembly(spark, sf_dir)
    p = engine.Params(k=K, w=W, z=Z, max_n=3)
    out = engine.run_rounds(stage(a.cut_contigs.select("contig", "seq")), stage(a.reads.select("read_id", "seq")), p, rounds=2)
    return out.select("id", F.length("seq").alias("length"), F.md5("seq").alias("digest"))


QUERIES["rounds_two"] = rounds_two


def streaming_pair_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = pair_tally.per_read(Assembly(spark, sf_dir).mappings).repartition(6)
    path = f"{shared_folder(spark)}/longweft/reads-{uuid.uuid4().hex}"
    reads.write.parquet(path)
    return pair_tally.run(path, reads, K, MOST)


QUERIES["streaming_pair_tally"] = streaming_pair_tally
ORACLE_SQL["streaming_pair_tally"] = sql.query(f"SELECT {PAIR} FROM tally")
