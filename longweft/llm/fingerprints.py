"""Document fingerprints by a quartile bucket digest.

Every byte triplet (i, i + a, i + b) of a text's UTF-8 form, for six pairs of distances up to four, is hashed into one of 256 buckets.
A bucket's count is written as the quartile of all counts that it lies in, two bits each. Before them stand the length, in quarters of
an octave, and the lower two quartiles as sixteenths of the upper one. A fingerprint is 132 hexadecimal digits for a text of any
length. Two of them differ by a bounded score: likeness is 1 for equal ones and 0 for those as far apart as random ones are.

Counts are sums over a text's bytes, so a text is worked on in blocks and its length doesn't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import give_back, spool

BUCKETS = 256
#: Distances of a triplet's second and third byte from its first.
DISTANCES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
FACTOR = 0x9E3779B1
#: Bytes that are counted at a time.
BLOCK = 1 << 18
#: Rows that a task holds results of.
ROWS = 512
#: Cost of two codes 0 to 3 apart, of a step of length, of a sixteenth of a quartile, and the largest cost of each of the two.
APART, STEP, SIXTEENTH, MOST = (0, 1, 2, 6), 4, 1, 32
#: The mean cost of two random digests' buckets, from which on the score says nothing more.
BOUND = BUCKETS * 26 / 16
_COST = np.array([[APART[abs(x - y)] for y in range(4)] for x in range(4)])
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of some bytes fall into each bucket."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), BLOCK):
        x = np.frombuffer(data, dtype=np.uint8, offset=at, count=min(BLOCK + 4, len(data) - at)).astype(np.uint32)
        for k, (a, b) in enumerate(DISTANCES):
            n = min(BLOCK, len(x) - b)
            if n > 0:
                mixed = (x[:n] | x[a : n + a] << np.uint32(8) | x[b : n + b] << np.uint32(16) | np.uint32(k << 24)) * np.uint32(FACTOR)
                out += np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    return out


def length_code(n: int) -> int:
    """0 for nothing, else quarters of an octave from 1 on."""
    e = n.bit_length() - 1
    return 4 * e + (4 * n >> e) - 3 if n else 0


def digest(counts: np.ndarray, n_bytes: int) -> str:
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    of = lambda q: min(15, 16 * q // q3) if q3 else 0
    return f"{length_code(n_bytes):02x}{of(q1):x}{of(q2):x}" + _HEX[codes[0::2] * 4 + codes[1::2]].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text; a null text has that of the empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return digest(bucket_counts(data), len(data))


def codes_of(mark: str) -> np.ndarray:
    digits = np.array([int(c, 16) for c in mark[4:]], dtype=np.int8)
    return np.stack([digits >> 2, digits & 3], axis=1).ravel()


def likeness(a: str, b: str) -> float:
    """From 0 to 1 for two fingerprints: 1 less the share that their difference has of BOUND."""
    cost = int(_COST[codes_of(a), codes_of(b)].sum())
    cost += min(MOST, STEP * abs(int(a[:2], 16) - int(b[:2], 16)))
    cost += min(MOST, SIXTEENTH * sum(abs(int(a[i], 16) - int(b[i], 16)) for i in (2, 3)))
    return 1.0 - min(1.0, cost / BOUND)


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep` and the fingerprint of each whole text, in place and without a shuffle. Null texts count as empty; repeated
    rows and null ids are kept as they are; a column of `keep` called fingerprint is replaced."""
    keep = tuple(c for c in keep if c != "fingerprint")
    schema = df.select(*keep).withColumn("fingerprint", F.lit("")).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[*keep, "fingerprint"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def edit_end(text: str, following: str) -> str:
    """A text whose last third of code points gives way to as many from the start of the following one, or to all that it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OPEN = "part int, kind string, text string, " + ROW


def _compared(doc_id: int | None, text: str, mark: str, following: str, following_mark: str) -> tuple:
    edited = edit_end(text, following)
    edited_mark = mark if edited == text else fingerprint(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, following_mark)


def compared_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its text with the end edited by edit_end() from the next row, and the likeness of its
    fingerprint to the edited text's and to the next row's. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Rows follow one another by descending id, null ids last, and after the last comes the first; rows of one id by a hash of their
    text, equal rows in any order. A null text is an empty one; an only row is its own next. An empty table gives no rows.

    Rows are dealt by range of that order and each task compares neighbours as they come by, holding two. A part's last row meets the
    first row of the next part that has rows in a join of one row a part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = (F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(F.desc_nulls_last("doc_id"), F.xxhash64("text"))

    def walk(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), None

        def open_row(kind, doc_id, text, mark):
            return (part, kind, text, doc_id, len(text), None, mark, None, None, None)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out, some = [], batch.slice(at, ROWS)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1)):
                    text = text.as_py()
                    mark = fingerprint(text)
                    if before is None:
                        out.append(open_row("first", doc_id, text, mark))
                    else:
                        out.append((part, None, None, *_compared(*before, text, mark)))
                    before = (doc_id, text, mark)
                yield _to_arrow(out, OPEN)
            del batch, some  # before the next one is read
        if before is not None:
            yield _to_arrow([open_row("last", *before)], OPEN)
        give_back()

    seen = spool(dealt.mapInArrow(walk, OPEN), "fingerprints")
    first = seen.filter("kind = 'first'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("following_mark"))
    parts = first.select("part")
    order = Window.orderBy("part")  # a row for each part that has rows
    onward = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part"))
    pairs = seen.filter("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(onward, "part")
    pairs = pairs.join(first.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "fingerprint", "following", "following_mark")

    def close(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield _to_arrow([_compared(*(c[i].as_py() for c in batch.columns)) for i in range(at, min(at + ROWS, batch.num_rows))], ROW)

    return seen.filter("kind IS NULL").select(*_names(ROW)).unionByName(pairs.mapInArrow(close, ROW))




def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _to_arrow(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds: dict[str, Callable] = {"long": pa.int64, "int": pa.int32, "double": pa.float64, "string": pa.string}
    types = [kinds[c.split()[1]]() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=_names(schema))


_WALKS = " UNION ALL ".join(f"SELECT r, k, ((b0 + 256 * b{a} + 65536 * b{b} + {i << 24}::BIGINT) * {FACTOR} % 4294967296) // 16777216 AS bucket FROM near WHERE b{b} IS NOT NULL" for i, (a, b) in enumerate(DISTANCES))
_LIKE = f"""1 - least(1.0, (list_sum(list_transform(list_zip({{x}}.codes, {{y}}.codes), lambda z: ({list(APART)})[1 + abs(z[1] - z[2])]))
  + least({MOST}, {STEP} * abs({{x}}.length - {{y}}.length)) + least({MOST}, {SIXTEENTH} * (abs({{x}}.f1 - {{y}}.f1) + abs({{x}}.f2 - {{y}}.f2)))) / {BOUND})"""
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
e AS MATERIALIZED (SELECT d.r, d.r % d.n + 1 AS following, d.doc_id, d.text, left(d.text, length(d.text) - length(d.text) // 3) || left(x.text, length(d.text) // 3) AS edited FROM d JOIN d x ON x.r = d.r % d.n + 1),
t AS MATERIALIZED (SELECT r, 0 AS k, text AS t FROM e UNION ALL SELECT r, 1, edited FROM e),
bytes AS (SELECT r, k, unnest(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)) AS b0, generate_subscripts(regexp_extract_all(hex(encode(t)), '..'), 1) AS i FROM t),
near AS MATERIALIZED (SELECT r, k, b0, lead(b0, 1) OVER w AS b1, lead(b0, 2) OVER w AS b2, lead(b0, 3) OVER w AS b3, lead(b0, 4) OVER w AS b4 FROM bytes WINDOW w AS (PARTITION BY r, k ORDER BY i)),
counts AS (SELECT r, k, bucket, count(*) AS c FROM ({_WALKS}) GROUP BY ALL),
lists AS (SELECT r, k, list(coalesce(c, 0) ORDER BY bucket) AS cs FROM (SELECT r, k, unnest(range(0, {BUCKETS})) AS bucket FROM t) LEFT JOIN counts USING (r, k, bucket) GROUP BY r, k),
quartiles AS (SELECT *, list_sort(cs)[{BUCKETS // 4}] AS q1, list_sort(cs)[{BUCKETS // 2}] AS q2, list_sort(cs)[{3 * BUCKETS // 4}] AS q3, octet_length(encode(t)) AS n, length(bin(n)) - 1 AS e FROM lists JOIN t USING (r, k)),
codes AS (SELECT r, k, list_transform(cs, lambda c: (c > q1)::INT + (c > q2)::INT + (c > q3)::INT) AS codes, CASE WHEN n > 0 THEN 4 * e + ((4 * n) >> e) - 3 ELSE 0 END AS length,
  CASE WHEN q3 > 0 THEN least(15, 16 * q1 // q3) ELSE 0 END AS f1, CASE WHEN q3 > 0 THEN least(15, 16 * q2 // q3) ELSE 0 END AS f2 FROM quartiles),
marks AS MATERIALIZED (SELECT *, printf('%02x%x%x', length, f1, f2) || array_to_string(list_transform(range(1, {BUCKETS}, 2), lambda i: printf('%x', 4 * codes[i] + codes[i + 1])), '') AS mark FROM codes)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, a.mark AS fingerprint, b.mark AS edited_fingerprint,
  ({_LIKE.format(x="a", y="b")})::DOUBLE AS near_edited, ({_LIKE.format(x="a", y="c")})::DOUBLE AS near_next
FROM e JOIN marks a ON a.r = e.r AND a.k = 0 JOIN marks b ON b.r = e.r AND b.k = 1 JOIN marks c ON c.r = e.following AND c.k = 0
"""
