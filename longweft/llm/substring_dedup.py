"""Exact removal of passages that an earlier document has, by super-k-mer partitioning.

A window is `size` consecutive words. Its minimiser is the least hash among its 3-word grams, so neighbouring windows mostly share
it; a run of windows with one minimiser, a super-k-mer, is sent as one packed string of words to the minimiser's bucket, where
equal windows meet whatever document they are in. There, windows are sorted by 128-bit fingerprint, and each whose fingerprint also
has a smaller document id is reported by its place.

Before anything is sent, equal windows of one batch of documents are resolved: only those of the batch's smallest id travel. So a
passage or text that a third of all documents share is sent once a batch, however many have it. Buckets are worked through in
passes of bounded memory, over packed strings that lie on disk beyond 64 MB. Places of repeats go to shards of documents in packs,
where they meet the texts.
"""

from __future__ import annotations

import struct
import tempfile

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WORD_RE, give_back

GRAM = 3
#: Characters of text worked on together before sending, and windows sorted together in a bucket.
BATCH_CHARS, PASS_WINDOWS = 12 << 20, 4 << 20
MULTIPLIERS = np.random.default_rng(13).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: A packed string for a bucket, or (places) packed places for the shard of documents that has the number `bucket`.
SENT = "bucket int, places boolean, packed binary"
PRIME = 1_000_003


def word_hashes(words: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each word, as two rows."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), dtype="<u8").reshape(-1, 2).T


def sums(h: np.ndarray, size: int) -> np.ndarray:
    """A fingerprint of each `size` consecutive hashes: a sum with a multiplier for each place."""
    n = len(h) - size + 1
    out = h[:n] * MULTIPLIERS[0]
    for j in range(1, size):
        out += h[j : n + j] * MULTIPLIERS[j]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers from each start on, as many as size says."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1]) if len(end) else np.zeros(0, np.int64)


def later(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document id has the same fingerprint (a, b)."""
    out = np.zeros(len(a), dtype=bool)
    order = np.argsort(a, kind="stable")
    same = a[order[1:]] == a[order[:-1]]
    many = np.zeros(len(a), dtype=bool)
    many[1:] |= same
    many[:-1] |= same
    order = order[many]
    if len(order):
        order = order[np.lexsort((b[order], a[order]))]
        new = np.append(True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))
        group = np.cumsum(new) - 1
        out[order] = doc[order] > np.minimum.reduceat(doc[order], np.flatnonzero(new))[group]
    return out


class Batch:
    """Documents worked on together: their words as numbers of a common vocabulary."""

    def __init__(self, size: int, buckets: int):
        self.size, self.buckets = size, buckets
        self.clear()

    def clear(self):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.docs, self.chars = [], [], 0

    def add(self, doc: int, mark: int, text: str):
        words, known = WORD_RE.findall(text), self.vocabulary
        self.chars += len(text)
        if len(words) < self.size:
            return
        self.ids.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int32))
        self.docs.append((doc, mark))

    def send(self):
        """Rows of SENT: packed super-k-mers by bucket, and places of windows known to be repeats."""
        if not self.docs:
            return
        words = sorted(self.vocabulary)  # in order, words of a packed string are much alike
        number = np.empty(len(words), dtype=np.int32)
        number[[self.vocabulary[w] for w in words]] = np.arange(len(words), dtype=np.int32)
        ids, size, k = number[np.concatenate(self.ids)], np.array([len(i) for i in self.ids]), self.size
        h = word_hashes(words)
        begin = np.cumsum(size) - size
        at = spans(begin, size - k + 1)  # where windows begin
        row = np.repeat(np.arange(len(size)), size - k + 1)
        docs = np.array(self.docs, dtype=np.int64)
        repeat = later(sums(h[0][ids], k)[at], sums(h[1][ids], k)[at], docs[row, 0])
        for shard, packed in pack_places(docs[row[repeat]], at[repeat] - begin[row[repeat]], self.buckets):
            yield shard, True, packed
        grams = mix(sums(h[1][ids], GRAM))
        least = np.lib.stride_tricks.sliding_window_view(grams, k - GRAM + 1).min(axis=1)[at[~repeat]]
        at, row = at[~repeat], row[~repeat]
        if not len(at):
            return
        new = np.append(True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]))
        head = np.flatnonzero(new)
        windows = np.diff(np.append(head, len(at)))
        bucket = (mix(least[head]) >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        for part, b in zip(np.split(order, cuts[1:]), bucket[order][cuts]):
            start, n, r = at[head[part]], windows[part], row[head[part]]
            used, number = np.unique(ids[spans(start, n + k - 1)], return_inverse=True)
            kind = "<u2" if len(used) < 1 << 16 else "<u4"
            own, of = np.unique(r, return_inverse=True)
            text = " ".join([words[i] for i in used.tolist()]).encode("utf-8", "surrogatepass")
            parts = [docs[own].astype("<i8"), steps(of), steps(start - begin[r]), n.astype("<u1" if n.max() < 256 else "<u4"), number.astype(kind)]
            parts = [x.tobytes() for x in parts] + [text]
            yield int(b), False, zstandard.compress(struct.pack("<8I", *map(len, parts), int(kind[2]), len(n)) + b"".join(parts), 3)


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype("<i4")


def pack_places(docs: np.ndarray, at: np.ndarray, shards: int):
    """(shard, packed places) for windows at places `at` of documents `docs`, rows of (id, mark)."""
    if not len(at):
        return
    shard = (docs[:, 0] % PRIME * 7919 + docs[:, 1] % PRIME) % shards
    order = np.lexsort((at, docs[:, 1], docs[:, 0], shard))
    docs, at, shard = docs[order], at[order], shard[order]
    for i, j in zip(c := np.flatnonzero(np.append(True, np.diff(shard) != 0)), [*c[1:], len(at)]):
        own = np.flatnonzero(np.append(True, (docs[i + 1 : j] != docs[i : j - 1]).any(axis=1)))
        parts = [docs[i:j][own].astype("<i8").tobytes(), np.diff(np.append(own, j - i)).astype("<u4").tobytes(), steps(at[i:j]).tobytes()]
        yield int(shard[i]), zstandard.compress(struct.pack("<2I", len(own), j - i) + b"".join(parts), 3)


def unpack_places(packed: bytes):
    """((id, mark), places) of each document of a pack."""
    raw = zstandard.decompress(packed)
    n, total = struct.unpack_from("<2I", raw)
    docs = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2).tolist()
    sizes = np.frombuffer(raw, "<u4", n, 8 + 16 * n)
    at = np.cumsum(np.frombuffer(raw, "<i4", total, 8 + 20 * n), dtype=np.int64)
    return zip(map(tuple, docs), np.split(at, np.cumsum(sizes)[:-1]))


def unpack(packed: bytes, size: int):
    """Of a packed string: the fingerprints of its windows, and for each window its (document id, mark) and place."""
    raw = zstandard.decompress(packed)
    *sizes, width, runs = struct.unpack_from("<8I", raw)
    ends = np.cumsum([32, *sizes])
    docs, of, start, n, number, text = (raw[a:b] for a, b in zip(ends, ends[1:]))
    docs, n = np.frombuffer(docs, "<i8").reshape(-1, 2), np.frombuffer(n, "<u1" if len(n) == runs else "<u4").astype(np.int64)
    of, start = np.cumsum(np.frombuffer(of, "<i4")), np.cumsum(np.frombuffer(start, "<i4"), dtype=np.int64)
    h = word_hashes(text.decode("utf-8", "surrogatepass").split(" "))[:, np.frombuffer(number, f"<u{width}")]
    at = spans(np.cumsum(n + size - 1) - (n + size - 1), n)
    return sums(h[0], size)[at], sums(h[1], size)[at], docs[np.repeat(of, n)], spans(start, n)


def places(df: DataFrame, shards: int, size: int = 13) -> DataFrame:
    """Of texts df (doc_id, mark, text): rows shard, packed (places of windows that a smaller doc_id also has)."""

    def send(batches):
        import pyarrow as pa

        batch = Batch(size, shards)

        def flush():
            rows = list(batch.send())
            batch.clear()
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows[i : i + 4096]), (pa.int32(), pa.bool_(), pa.binary()))], names=["bucket", "places", "packed"])

        for b in batches:
            for doc, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                batch.add(doc, mark, text.as_py())
                if batch.chars >= BATCH_CHARS:
                    yield from flush()
        yield from flush()
        batch = None
        give_back()

    def sort(batches):
        import pyarrow as pa

        def rows(shard, packed):
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(packed, pa.binary())], names=["shard", "packed"])

        with tempfile.SpooledTemporaryFile(64 << 20) as held:
            total = 0
            for b in batches:
                done = b.column(1).to_pylist()
                for packed, known in zip(b.column(2), done):
                    if not known:
                        raw = packed.as_py()
                        held.write(struct.pack("<I", len(raw)) + raw)
                        total += len(raw)
                if any(done):
                    b = b.filter(b.column(1))
                    yield rows(b.column(0), b.column(2))
            passes = max(1, -(-total // (8 * PASS_WINDOWS)))  # a window takes 8 bytes or so
            for one in range(passes):
                held.seek(0)
                found = []
                while head := held.read(4):
                    a, b, docs, at = unpack(held.read(struct.unpack("<I", head)[0]), size)
                    if passes > 1:
                        mine = mix(a) % np.uint64(passes) == one
                        a, b, docs, at = a[mine], b[mine], docs[mine], at[mine]
                    found.append((a, b, docs, at.astype(np.uint32)))
                if found:
                    a, b, docs, at = (np.concatenate(x) for x in zip(*found))
                    found = None
                    repeat = later(a, b, docs[:, 0])
                    if packs := list(pack_places(docs[repeat], at[repeat].astype(np.int64), shards)):
                        yield rows(*zip(*packs))
                    a = b = docs = at = repeat = None
        give_back()

    sent = df.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "mark", "text").mapInArrow(send, SENT)
    return sent.repartitionById(shards, F.col("bucket")).mapInArrow(sort, "shard int, packed binary")


def remove_repeats(df: DataFrame, size: int = 13, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", as_was: bool = False) -> DataFrame:
    """The columns `keep` with n_words, n_removed and kept_text: the words, joined by one space, that no window covers which also
    begins in a document with a smaller id. as_was: a text of which nothing is removed is kept with its white space.

    Windows are judged on the input, not on what is left. Null and empty texts have no words and an empty kept_text. Documents with
    fewer than `size` words have no window. Rows with one id don't repeat each other; of rows with a null id nothing is removed, and
    nothing is removed for them. A column of `keep` with the name of a new one is replaced.
    """
    made = {"n_words": "long", "n_removed": "long", "kept_text": "string"}
    keep = tuple(c for c in keep if c not in made)
    rows = df.select(*(F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(PRIME)) * 7919 + F.pmod("mark", F.lit(PRIME))) % shards
    texts = rows.withColumn("shard", at.cast("int")).withColumn("packed", F.lit(None).cast("binary"))
    found = places(rows, shards, size)
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), *(T.StructField(c, T._parse_datatype_string(t)) for c, t in made.items())])

    def cut(batches):
        import pyarrow as pa

        known: dict[tuple[int, int], list[np.ndarray]] = {}  # of this shard's documents; they come first
        for b in batches:
            for packed in b.column(b.num_columns - 1).drop_null():
                for doc, starts in unpack_places(packed.as_py()):
                    known.setdefault(doc, []).append(starts)
            b = b.filter(b.column(b.num_columns - 1).is_null())
            out, n, first = [], 0, 0
            for i, (doc, mark, text) in enumerate(zip(*(b.column(len(keep) + j) for j in range(3)))):
                starts = known.get((doc.as_py(), mark.as_py()))
                words = WORD_RE.findall(text.as_py() or "")
                removed = 0
                if starts:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    at = np.unique(np.concatenate(starts))
                    edge[at] += 1
                    edge[at + size] -= 1
                    free = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    removed = len(words) - len(free)
                    kept = " ".join([words[j] for j in free])
                else:
                    kept = (text.as_py() or "") if as_was else " ".join(words)
                out.append((len(words), removed, kept))
                n += len(kept)
                if n > 8 << 20 or i == b.num_rows - 1:
                    new = [pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(out)) for c in b.columns[: len(keep)]), *new], names=[*keep, *made])
                    out, n, first = [], 0, i + 1
        known.clear()
        b = None
        give_back()

    both = texts.unionByName(found, allowMissingColumns=True).select(*(f"k_{i}" for i in range(len(keep))), "doc_id", "mark", "text", "packed", "shard")
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.isnull("packed"))
    return dealt.drop("shard").mapInArrow(cut, schema)


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) WHERE len(w) >= 13),
rep AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
cov AS (SELECT DISTINCT r, i + k AS p FROM rep, (SELECT unnest(range(0, 13)) AS k)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN (SELECT r, count(*) AS c FROM cov GROUP BY r) USING (r) LEFT JOIN kept USING (r)
"""
