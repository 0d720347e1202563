"""Stage outputs as tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that an execution deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set, else the context's checkpoint folder; one is made where there is none (one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="longweft-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get()


def stage(df: DataFrame) -> DataFrame:
    """Writes df as Parquet and reads it back. Lineage ends there: later plans read it as often as they like, with its true size known
    to the optimizer, and losing an executor costs nothing that was finished. What was shuffled for it is deleted then, not when the
    driver's garbage is collected, so that a query's stages don't add up on disk."""
    path, conf = f"{shared_folder(df.sparkSession)}/longweft/{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes tables of stage() that no later plan reads."""
    for df in tables:
        session = df.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
