"""Shared pieces of the training-data operators: shared-folder tables, bounded caches, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, in every contract that speaks of words.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: A-Z only, so that no other letter changes and lengths stay.
LOWER_AZ = {c: c + 32 for c in range(65, 91)}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else a folder of our own (one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        found = "file://" + tempfile.mkdtemp(prefix="longweft-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(_remove, spark, found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/longweft/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spool_path = path
    return out


def unspool(df: DataFrame) -> None:
    """Deletes the table of a spool() that no later plan reads."""
    remove(df.sparkSession, df._spool_path)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % F.lit(modulus)


class Cache(dict):
    """A dict that makes what it lacks and holds at most `limit` entries and as many of the generation before."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        old = self.old
        value = old[key] if key in old else self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def give_back() -> None:
    """Returns freed memory to the system at the end of a task, as workers live on and share their machine with the JVM."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Cuts a text after white space into pieces of about `size` characters, so that a very long text is never held as one list of words."""
    if len(text) <= size:
        yield text
        return
    at, space = 0, re.compile(r"[\x20\x09-\x0D](?=[^\x20\x09-\x0D])")
    while at < len(text):
        m = space.search(text, at + size)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end
