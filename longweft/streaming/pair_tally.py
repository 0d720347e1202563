"""The pair tally over a stream of mapped reads.

A read's mappings arrive in one row, so pairs and gap estimates are made row by row without state. The state is a count for each pair and
distinct gap, a sorted count map dealt over rows: it grows with the gaps that occur and not with the reads, and no pair's state lies in
one row. Each batch writes the counts that it changed, and only those; the tally, with the exact median, is read from the last ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.shared import shared_folder
from ..operators import pairs


def per_read(mapped: DataFrame) -> DataFrame:
    """A row for each read with all its mappings, as the stream carries them."""
    one = F.struct("map_idx", "contig", "length", "hit_count", "hits")
    return mapped.groupBy("read_id").agg(F.first("read_len").alias("read_len"), F.array_sort(F.collect_list(one)).alias("m"))


def estimates(reads: DataFrame, k: int, f: int) -> DataFrame:
    """Gap estimates of a stream of reads, row by row."""
    ends = F.transform("m", lambda x: F.struct(x["map_idx"].alias("map_idx"), x["contig"].alias("contig"), x["length"].alias("length"), x["hit_count"].alias("hit_count"), F.element_at(x["hits"], 1).alias("head"), F.element_at(x["hits"], -1).alias("tail")))
    after = lambda c, i, n: F.slice(F.col(c), i + 2, n)
    join = lambda c, n: F.flatten(F.transform(c, lambda x, i: F.transform(after(c, i, n), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    reads = reads.withColumn("m", ends).withColumn("s", F.filter("m", lambda x: x["hit_count"] > 1))
    apart = F.filter(join("s", F.lit(1)), lambda p: p["b"]["map_idx"] - p["a"]["map_idx"] > 1)
    pair = F.when(F.size("m") <= f, join("m", F.size("m"))).otherwise(F.concat(join("m", F.lit(1)), apart))
    return pairs.gap_estimates(reads.select("read_id", "read_len", F.explode(pair).alias("p")).select("read_id", "read_len", "p.a", "p.b"), k)


def counts(found: DataFrame) -> DataFrame:
    """How often each gap of each pair was seen, and how often anchored. It streams in update mode."""
    return found.groupBy(*pairs.PAIR, "gap").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchored").cast("long")).alias("anchor"))


def tally(counted: DataFrame) -> DataFrame:
    """As pairs.tally(), from counts(): the median is the mean of the gaps at which half of all, and more than half, are reached."""
    of = Window.partitionBy(*pairs.PAIR)
    run = counted.withColumn("reached", F.sum("n").over(of.orderBy("gap"))).withColumn("total", F.sum("n").over(of))
    low, high = (F.min(F.when(c, F.col("gap"))) for c in (F.col("reached") * 2 >= F.col("total"), F.col("reached") * 2 > F.col("total")))
    return run.groupBy(*pairs.PAIR).agg(F.sum("n").alias("n"), ((low + high) / 2).cast("int").alias("d"), F.sum("anchor").alias("anchor"))


def last_counts(changes: DataFrame) -> DataFrame:
    """The counts that stand, of those that batches have written."""
    last = F.max_by(F.struct("n", "anchor"), "batch")
    return changes.groupBy(*pairs.PAIR, "gap").agg(last.alias("c")).select(*pairs.PAIR, "gap", "c.n", "c.anchor")


def run(path: str, like: DataFrame, k: int, f: int = 10, files_per_batch: int = 2, out: str | None = None) -> DataFrame:
    """Tallies all reads in the folder `path`, some files a batch, and returns the tally. State, progress and changed counts are kept in
    the folder `out`, a new one in the shared folder unless it is given; a run with the `out` of an earlier one goes on from there. A
    batch that is done again overwrites its own changes."""
    spark = like.sparkSession
    out = out or f"{shared_folder(spark)}/longweft/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    q = counts(estimates(stream, k, f)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return tally(last_counts(spark.read.parquet(f"{out}/changes")))
