"""Token ids as flat files of unsigned integers with 64-bit document offsets, and memory-mapped reading.

A folder holds, for each shard, `<shard>.ids` (little-endian unsigned ids, 16 bits where the vocabulary allows, else 32),
`<shard>.off` (64-bit offsets into it, one more than documents) and `<shard>.doc` (64-bit document ids and a flag for null).
Shards follow one another in ascending document id. A shard's base, the number of ids in the shards before it, comes from
prefix sums over the shards' counts, which the driver writes to `manifest.json` (one line a shard).

The folder must be one that driver and executors share and that is mounted as a path: memory mapping needs files. Shards are
written under a name of their own for each attempt and then renamed, so that a task that is run again, after an executor was
lost, replaces what it wrote before.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .bpe import encoder
from .common import new_path

ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def local(path: str) -> str:
    """A file:// URI or plain path as a path of the operating system."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a mounted folder, not {path}")
    return path


def write_token_files(df: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of every text, each followed by `end_id`, in ascending id order (nulls first; equal ids by text), and
    returns the folder. Null texts are empty: they have the end id alone. An empty table gives a folder without shards.

    One shuffle: texts are dealt by range of (id, hash of text), so that many rows with one id still spread.
    """
    spark = df.sparkSession
    folder = local(folder or new_path(spark, "tokens"))
    os.makedirs(folder, exist_ok=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = texts.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        e, shard = encoder(vocabulary, fast=True), f"{TaskContext.get().partitionId():06d}"
        kind, tail = ("<u2", 16) if max(e.size - 1, end_id) < 1 << 16 else ("<u4", 32)
        end, own, offsets, docs, nulls, at = np.array([end_id], dtype=kind).tobytes(), f"{folder}/.{shard}.{uuid.uuid4().hex}", [0], [], [], 0
        with open(f"{own}.ids", "wb", buffering=1 << 20) as out:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for block in e.blocks(text.as_py()):
                        ids = np.frombuffer(block, dtype="<u4")
                        out.write(ids.astype(kind).tobytes())
                        at += len(ids)
                    out.write(end)
                    at += 1
                    offsets.append(at)
                    docs.append(doc or 0)
                    nulls.append(doc is None)
        if docs:
            np.array(offsets, dtype="<i8").tofile(f"{own}.off")
            np.array([docs, nulls], dtype="<i8").tofile(f"{own}.doc")
            for kind_of in ("ids", "off", "doc"):
                os.replace(f"{own}.{kind_of}", f"{folder}/{shard}.{kind_of}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(docs)], "ids": [at], "bits": [tail]})
        else:
            os.remove(f"{own}.ids")

    # one small row a shard comes to the driver
    shards = sorted((r.asDict() for r in texts.drop("h").mapInArrow(write, "shard string, docs long, ids long, bits long").collect()), key=lambda r: r["shard"])
    base = 0
    with open(f"{folder}/manifest.tmp", "w") as f:
        for s in shards:
            f.write(json.dumps(s | {"base": base}) + "\n")
            base += s["ids"]
    os.replace(f"{folder}/manifest.tmp", f"{folder}/manifest.json")
    return folder


def manifest(folder: str) -> list[dict]:
    with open(f"{local(folder)}/manifest.json") as f:
        return [json.loads(line) for line in f]


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of a folder: its id, start (ids of all documents before it), n_tokens, crc32 of its ids as
    little-endian unsigned 32-bit integers and, if asked for, the ids. Shards are memory-mapped where they are read."""
    folder = local(folder)
    shards = manifest(folder)
    schema = ROWS + (", ids array<long>" if with_ids else "")
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, base, bits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.memmap(f"{folder}/{shard}.ids", dtype=f"<u{bits // 8}", mode="r")
                offsets = np.fromfile(f"{folder}/{shard}.off", dtype="<i8")
                docs, nulls = np.fromfile(f"{folder}/{shard}.doc", dtype="<i8").reshape(2, -1)
                for first in range(0, len(docs), 4096):
                    span = range(first, min(first + 4096, len(docs)))
                    out = {
                        "doc_id": pa.array(docs[first : span.stop], mask=nulls[first : span.stop].astype(bool)), "start": base + offsets[first : span.stop],
                        "n_tokens": np.diff(offsets[first : span.stop + 1]), "ids_crc32": pa.array([_crc(ids[offsets[i] : offsets[i + 1]]) for i in span], type=pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([ids[offsets[i] : offsets[i + 1]].astype("int64") for i in span], type=pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    table = spark.createDataFrame([(s["shard"], s["base"], s["bits"]) for s in shards], "shard string, base long, bits int")
    return table.repartition(len(shards), "shard").mapInArrow(read, T._parse_datatype_string(schema))


def _crc(ids: np.ndarray, block: int = 1 << 18) -> int:
    c = 0
    for i in range(0, len(ids), block):
        c = zlib.crc32(ids[i : i + block].astype("<u4").tobytes(), c)
    return c
