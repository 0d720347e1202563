"""FASTA and FASTQ, plain or gzipped, one file or many.

Plain FASTA is read by Spark's text reader with a record separator, so large files are split and any store that Spark reads will do.
FASTQ, plain or in block gzip, and block gzipped FASTA are read by ranges of bytes: a task finds the first record that begins in its range
and reads on to the end of the last one. Other gzipped files can't be split: their lines come in order, a file in a partition, and
are parsed as they come; so is FASTQ with sequences over several lines, and FASTQ in stores that only Spark knows.

Rows: id (the first token of the header), seq, bx (the barcode of a BX:Z: comment, else null), qual (null for FASTA). A last line without
line feed is read whole.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, seq string, bx string, qual string"


def parse(lines: Iterable[str]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """Records of FASTA or FASTQ lines, sequences and qualities over any number of lines."""
    head, seq, it = None, [], iter(lines)
    for line in it:
        line = line.rstrip("\r\n")
        if line[:1] == ">":
            if head is not None:
                yield (*header(head), "".join(seq), None)
            head, seq = line[1:], []
        elif line[:1] == "@" and head is None:
            name, parts = line[1:], []
            for line in it:
                if line[:1] == "+":
                    break
                parts.append(line.rstrip("\r\n"))
            bases, qual = "".join(parts), ""
            while len(qual) < len(bases) and (line := next(it, None)) is not None:
                qual += line.rstrip("\r\n")
            yield (*header(name), bases, qual)
        elif head is not None:
            seq.append(line)
    if head is not None:
        yield (*header(head), "".join(seq), None)


def header(text: str) -> tuple[str, str | None]:
    name, _, comment = text.partition(" ") if " " in text else text.partition("\t")
    return name, comment[5:].split()[0] if comment.startswith("BX:Z:") and comment[5:].split() else None


def _row(record):
    name, bx, seq, qual = record
    return name, seq, bx, qual


#: Bytes of a range, of one read, and lines that must look like records where a range begins.
RANGE, READ, LOOK = 64 << 20, 1 << 20, 12
#: First bytes of a gzip block with an extra field, and the name of the extra field that holds the block's size (fixed values).
BLOCK_MAGIC, BLOCK_FIELD = b"\x1f\x8b\x08\x04", b"BC"


def opened(path: str):
    """A file of a store that Arrow knows (a path, file://, hdfs://, s3:// and so on), to be read from any place."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(inner)


def block_size(head: bytes) -> int:
    """The size of the gzip block whose first bytes are given, or 0 if they begin none that says."""
    if head[:4] != BLOCK_MAGIC or len(head) < 18:
        return 0
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == BLOCK_FIELD and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return 0


def plain_lines(f, start: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin at `start` or later."""
    at = max(0, start - 1)  # a line begins after the line feed before it
    f.seek(at)
    left, skip = b"", start > 0
    while data := f.read(READ):
        parts = (left + data).split(b"\n")
        left = parts.pop()
        for line in parts:
            if not skip:
                yield at, line.decode()
            skip, at = False, at + len(line) + 1
    if left and not skip:
        yield at, left.decode()


def block_lines(f, start: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of lines in block gzip: the offset is that of the block that holds the byte before the line, so that a line on the
    border of two blocks belongs to the first. The line that begins with the first block of a range belongs to the range before."""
    size, at = f.size(), start
    while at < size:  # the first block from here on: one that another or the end follows
        f.seek(at)
        data = f.read(READ)
        found = data.find(BLOCK_MAGIC)
        if found < 0:
            at += max(1, len(data) - 3)
            continue
        at += found
        f.seek(at)
        if n := block_size(f.read(64)):
            f.seek(at + n)
            if at + n == size or block_size(f.read(64)):
                break
        at += 1
    left, skip, before, began = [], start > 0, at, at
    while at < size:
        f.seek(at)
        n = block_size(f.read(64))
        f.seek(at)
        text = zlib.decompress(f.read(n), 31)
        parts = text.split(b"\n")
        for i, part in enumerate(parts[:-1]):
            line = b"".join([*left, part])
            left = []
            if not skip:
                yield began, line.decode()
            skip, began = False, at
        left.append(parts[-1])
        at += n
    if any(left) and not skip:
        yield began, b"".join(left).decode()


def is_record(four: list[str]) -> bool:
    """Whether four lines are a FASTQ record."""
    return len(four) == 4 and four[0][:1] == "@" and four[2][:1] == "+" and len(four[1].rstrip("\r")) == len(four[3].rstrip("\r"))


def range_records(lines: Iterator[tuple[int, str]], start: int, stop: int, fastq: bool) -> Iterator[tuple[str, str | None, str, str | None]]:
    """Records whose header begins in a range. A FASTQ quality may look like a header, but the line two after it is no `+` line, so
    the first line from which on all that is looked at are records begins one."""
    if not fastq:
        group: list[str] = []
        for at, line in lines:
            if line[:1] == ">":
                if group:
                    yield from parse(group)
                group = []
                if at >= stop:
                    return
                group.append(line)
            elif group:
                group.append(line)
        yield from parse(group)
        return
    look = [x for _, x in zip(range(LOOK), lines)]
    if start:
        texts = [t for _, t in look]
        first = next((i for i in range(len(texts)) if is_record(texts[i : i + 4]) and all(is_record(texts[j : j + 4]) for j in range(i, len(texts) - 3, 4))), len(look))
        look = look[first:]
    lines = itertools.chain(look, lines)
    for at, top in lines:
        if at >= stop:
            return
        if top.strip():
            yield from parse([top, *(t for _, t in itertools.islice(lines, 3))])


class FastxSource(DataSource):
    """spark.read.format("fastx").option("paths", <JSON list>).load(): FASTQ, and block gzipped FASTA, by ranges of bytes."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastxReader(json.loads(self.options["paths"]), int(self.options.get("range", RANGE)))


class FastxReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self):
        out = []
        for path in self.paths:
            with opened(path) as f:
                n, blocked = f.size(), block_size(f.read(64)) > 0
                lines = (t for _, t in (block_lines if blocked else plain_lines)(f, 0))
                head = list(itertools.islice(lines, 4))
            fastq = bool(head) and head[0][:1] == "@"
            whole = fastq and not is_record(head)  # sequences over several lines: no place to begin at can be told
            out += [InputPartition((path, at, n if whole else min(n, at + self.size), blocked, fastq, whole)) for at in range(0, 1 if whole else max(n, 1), self.size)]
        return out

    def read(self, partition):
        path, start, stop, blocked, fastq, whole = partition.value
        with opened(path) as f:
            lines = (block_lines if blocked else plain_lines)(f, start)
            yield from map(_row, parse(t for _, t in lines) if whole else range_records(lines, start, stop, fastq))


def _by_ranges(path: str) -> bool:
    """Whether Arrow can open a file, and it is FASTQ or in block gzip."""
    try:
        with opened(path) as f:
            head = f.read(64)
    except (OSError, ValueError, ImportError):
        return False
    return head[:1] == b"@" or block_size(head) > 0


def read_sequences(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE) -> DataFrame:
    """Sequences of one or many FASTA or FASTQ files, plain, gzipped or block gzipped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    ranged = [p for p in paths if p.lower().endswith((".fq", ".fastq", ".gz", ".bgz")) and _by_ranges(p)]
    packed = [p for p in paths if p.lower().endswith((".gz", ".bgz", ".fq", ".fastq")) and p not in ranged]
    plain = [p for p in paths if p not in ranged and p not in packed]
    out = []
    if plain:
        record = spark.read.option("lineSep", "\n>").text(plain).select(F.regexp_replace("value", "^>", "").alias("r")).filter(F.trim("r") != "")
        head, body = F.rtrim(F.substring_index("r", "\n", 1)), F.expr("substring(r, length(substring_index(r, '\n', 1)) + 1)")
        bx = F.regexp_extract(head, r"^\S+\s+BX:Z:(\S+)", 1)
        out.append(record.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.regexp_replace(body, "[\r\n]", "").alias("seq"), F.when(bx != "", bx).alias("bx"), F.lit(None).cast("string").alias("qual")))
    if packed:

        def run(batches):
            import pyarrow as pa

            def lines():
                for b in batches:
                    yield from b.column(0).to_pylist()

            rows = []
            for r in map(_row, parse(lines())):
                rows.append(r)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["id", "seq", "bx", "qual"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["id", "seq", "bx", "qual"])

        out += [spark.read.text(p).coalesce(1).mapInArrow(run, SCHEMA) for p in packed]  # lines of a file in order
    if ranged:
        spark.dataSource.register(FastxSource)
        out.append(spark.read.format("fastx").option("paths", json.dumps(ranged)).option("range", str(range_bytes)).load())
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


def write_fasta(df: DataFrame, path: str, header_col: str = "id", seq_col: str = "seq") -> None:
    """A part file a partition, each whole records."""
    df.select(F.concat(F.lit(">"), F.col(header_col), F.lit("\n"), F.col(seq_col)).alias("value")).write.text(path)


def write_fasta_chunks(chunks: DataFrame, path: str) -> None:
    """Rows (id, offset, chunk) as FASTA, a chunk a line. Lines are dealt by range, so a long sequence goes on from one part file to the
    next; the part files in the order of their names are the FASTA file."""
    line = F.when(F.col("offset") == 0, F.concat(F.lit(">"), "id", F.lit("\n"), "chunk")).otherwise(F.col("chunk"))
    chunks.repartitionByRange("id", "offset").sortWithinPartitions("id", "offset").select(line.alias("value")).write.text(path)
