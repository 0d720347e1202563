"""Scaffold sequences from paths, and assembly statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dna import oriented


def trimmed_sequences(contigs: DataFrame, trimmed: DataFrame) -> DataFrame:
    """Contigs (contig, seq) cut to their trims; an empty one is `N`, omitted ones go. With the header that trimmed FASTA has."""
    t = trimmed.filter("NOT omitted").select("contig", "start", "stop", "source_cut", "target_cut")
    header = F.concat_ws(" ", "contig", F.concat(F.coalesce(F.col("source_cut").cast("string"), F.lit("None")), F.lit("-"), F.coalesce(F.col("target_cut").cast("string"), F.lit("None"))))
    piece = F.expr("substring(seq, start + 1, greatest(stop - start, 0))")
    return contigs.join(t, "contig").select("contig", header.alias("header"), F.when(F.length(piece) == 0, "N").otherwise(piece).alias("seq"))


def merge(paths: DataFrame, seqs: DataFrame) -> DataFrame:
    """A scaffold (id, members, seq) for each path: oriented sequences with gap - 1 N between them. Where nothing is between two, the
    first base of the second is lower-case. Sequences on no path are scaffolds of their own."""
    w = Window.partitionBy("path_id").orderBy("step")
    piece = oriented(F.col("seq"), F.col("ori"))
    joined = F.lag("gap").over(w) == 1
    piece = F.when(joined, F.concat(F.lower(F.substring(piece, 1, 1)), F.expr("substring(piece, 2)"))).otherwise(F.col("piece"))
    on = paths.join(seqs.select("contig", "seq"), "contig").withColumn("piece", oriented(F.col("seq"), F.col("ori"))).withColumn("piece", piece)
    on = on.withColumn("piece", F.concat("piece", F.repeat(F.lit("N"), F.greatest(F.coalesce(F.col("gap"), F.lit(1)) - 1, F.lit(0)))))
    name = F.concat("contig", "ori", F.coalesce(F.concat(F.lit(","), (F.col("gap") - 1).cast("string"), F.lit("N")), F.lit("")))
    all_of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("step", c.alias("x")))), lambda s: s["x"])
    made = on.groupBy("path_id").agg(F.array_join(all_of(name), ",").alias("members"), F.array_join(all_of(F.col("piece")), "").alias("seq"))
    alone = seqs.join(paths.select("contig"), "contig", "left_anti").select(F.col("contig").alias("id"), F.col("contig").alias("members"), "seq")
    return made.select(F.col("path_id").alias("id"), "members", "seq").union(alone)


#: Letters of a chunk.
CHUNK = 1 << 16


def merge_chunks(paths: DataFrame, seqs: DataFrame, size: int = CHUNK) -> DataFrame:
    """merge() for scaffolds of any length: rows (id, offset, chunk), a chunk `size` letters long but for a scaffold's last. What comes
    before a contig is a sum of lengths, made without the sequences; each contig, and the N after it, is cut where chunks end, and a
    chunk is put together from what lies in it. So no row, and no group, holds more than one contig or one chunk."""
    w = Window.partitionBy("path_id").orderBy("step")
    on = paths.join(seqs.select("contig", F.length("seq").cast("long").alias("length")), "contig")
    on = on.withColumn("left", F.greatest(F.coalesce(F.col("gap"), F.lit(1)) - 1, F.lit(0)).cast("long")).withColumn("joined", F.coalesce(F.lag("gap").over(w) == 1, F.lit(False)))
    on = on.withColumn("start", F.coalesce(F.sum(F.col("length") + F.col("left")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = on.select("contig", F.col("path_id").alias("id"), "start", "length", "ori", "joined").join(seqs.select("contig", "seq"), "contig").withColumn("piece", oriented(F.col("seq"), F.col("ori")))
    parts = parts.withColumn("piece", F.when(F.col("joined"), F.concat(F.lower(F.substring("piece", 1, 1)), F.expr("substring(piece, 2)"))).otherwise(F.col("piece"))).select("id", "start", "length", "piece")
    alone = seqs.join(paths.select("contig"), "contig", "left_anti").select(F.col("contig").alias("id"), F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("length"), F.col("seq").alias("piece"))
    gaps = on.filter("left > 0").select(F.col("path_id").alias("id"), (F.col("start") + F.col("length")).alias("start"), F.col("left").alias("length"), F.lit(None).cast("string").alias("piece"))
    parts = parts.union(alone).union(gaps).filter("length > 0")
    cut = parts.withColumn("k", F.explode(F.sequence(F.expr(f"start DIV {size}"), F.expr(f"(start + length - 1) DIV {size}"))))
    cut = cut.withColumn("from", F.greatest("start", F.col("k") * size)).withColumn("n", F.least(F.col("start") + F.col("length"), (F.col("k") + 1) * size) - F.col("from"))
    cut = cut.select("id", "k", "from", F.coalesce(F.expr("substring(piece, CAST(from - start + 1 AS INT), CAST(n AS INT))"), F.repeat(F.lit("N"), F.col("n").cast("int"))).alias("x"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "x"))), lambda c: c["x"]), "")
    return cut.groupBy("id", "k").agg(whole.alias("chunk")).select("id", (F.col("k") * size).alias("offset"), "chunk")


def stats(seqs: DataFrame, seq_col: str = "seq", least: int = 500) -> DataFrame:
    """One row of assembly statistics over sequences of `least` bases or more, N left out: n, n_500, l50, min, n75, n50, n25, e_size,
    max, sum. Running sums are made over the distinct lengths."""
    length = F.length(F.regexp_replace(seq_col, "[^ACGTacgt]", "")).cast("long")
    each = seqs.select(length.alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("c"))
    used = each.filter(F.col("length") >= least)
    w = Window.orderBy(F.desc("length"))  # over distinct lengths
    run = used.withColumn("s", F.sum(F.col("length") * F.col("c")).over(w)).withColumn("k", F.sum("c").over(w)).withColumn("total", F.sum(F.col("length") * F.col("c")).over(Window.partitionBy()))
    at = lambda share: F.max(F.when(F.col("s") >= F.col("total") * share, F.col("length")))
    rest = F.col("total") * 0.5 - (F.col("s") - F.col("length") * F.col("c"))
    half = F.col("s") >= F.col("total") * 0.5
    l50 = F.min_by(F.col("k") - F.col("c") + F.ceil(rest / F.col("length")), F.when(half, F.col("s")))
    out = run.agg(
        F.sum("c").alias("n_500"), l50.alias("l50"), F.min("length").alias("min"), at(0.75).alias("n75"), at(0.5).alias("n50"), at(0.25).alias("n25"),
        F.floor(F.sum(F.col("length").cast("double") * F.col("length") * F.col("c")) / F.sum(F.col("length") * F.col("c"))).alias("e_size"), F.max("length").alias("max"), F.sum(F.col("length") * F.col("c")).alias("sum"),
    )
    return each.agg(F.sum("c").alias("n")).crossJoin(out)  # one row and one row
