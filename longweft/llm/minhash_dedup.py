"""Near duplicates by b-bit MinHash.

1. Each text becomes the set of its shingles' 64-bit hashes. Texts with equal sets are one node, whatever their number.
2. A node has HASHES minima. BANDS bands of ROWS minima each make band keys; the low BITS bits of all minima are packed as its
   signature. Nodes with an equal band key are candidates.
3. Buckets are counted by key; those of one node go before signatures join. In each bucket of candidates, similarity is estimated from
   the count of equal b-bit values, corrected for the 2^-b that are equal by chance. Only a spanning forest of the estimated links
   leaves a comparison. The forests' components, families, are all that can be linked.
4. Inside a family full sets are compared exactly; the components of the true links are the classes.
5. A bucket or family of more than BLOCK nodes is dealt into blocks by hash, each of which is first compared with itself and one of
   them, so that rows grow with the group and not with its square. In a group of near copies that joins all but a few nodes; those
   outside the group's largest component are then compared with the whole group, block by block. So no pair is left out whose link
   could join two components, and no task holds a group.

An estimate MARGIN below the threshold still counts as a candidate. With 32 bands of 6, two sets at a similarity of 0.85 share no band
with a probability of 2.6e-7, and their estimate misses with 4.9e-8 by the binomial: 3.2e-7 at most in all (at 0.80: 6.1e-5).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER_AZ, Cache, give_back, slices, spool, unspool
from .components import components

BANDS, ROWS, BITS = 32, 6, 4
HASHES = BANDS * ROWS
MARGIN = 0.16
BLOCK = 512
_rng = np.random.default_rng(17)
FACTOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
PLACE = _rng.integers(1 << 62, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Rule:
    """Sets are linked if `over` * intersection >= `of` * union."""

    shingle: int = 5
    of: int = 80
    over: int = 100


class Shingler:
    """Sets of shingle hashes, with a bounded memory of word hashes."""

    def __init__(self, n: int):
        self.n, self.hash = n, Cache(lambda w: xxhash.xxh3_64_intdigest(w), 60_000)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct n-word shingles; of the whole sequence, with fewer words; none without words."""
        h = [np.fromiter(map(self.hash.__getitem__, WORD_RE.findall(part.translate(LOWER_AZ))), dtype=np.uint64) for part in slices(text or "")]
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        if not len(h):
            return h
        n = min(self.n, len(h))
        m = len(h) - n + 1
        out = h[:m] * PLACE[0] + np.uint64(n)
        for j in range(1, n):
            out += h[j : m + j] * PLACE[j]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique(out ^ (out >> np.uint64(29)))


def minima(hashes: np.ndarray, block: int = 4096) -> np.ndarray:
    """The least value of each of HASHES functions over a set."""
    x, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), block):
        np.minimum(out, (x[None, i : i + block] * FACTOR + SHIFT).min(axis=1), out=out)
    return out


def pack(low: np.ndarray) -> bytes:
    """BITS low bits of each minimum, two to a byte."""
    return (low[0::2] | (low[1::2] << 4)).astype(np.uint8).tobytes()


def band_keys(m: np.ndarray) -> np.ndarray:
    mixed = (m.reshape(BANDS, ROWS).astype(np.uint64) * PLACE[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACE[ROWS]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of each left with each right signature: the share of equal b-bit values, less those equal by chance."""
    out = np.empty((len(left), len(right)), dtype=np.float32)
    for i in range(0, len(left), 64):
        x = left[i : i + 64, None, :] ^ right[None, :, :]
        equal = ((x & 15) == 0).sum(axis=2, dtype=np.int32) + ((x >> 4) == 0).sum(axis=2, dtype=np.int32)
        out[i : i + 64] = equal
    chance = 2.0**-BITS
    return (out / HASHES - chance) / (1 - chance)


def true_links(left: list[np.ndarray], right: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose sets are linked: a merge join of all hashes counts the intersections."""
    flat = np.concatenate(right)
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], np.repeat(np.arange(len(right)), [len(r) for r in right])[order]
    size = np.array([len(r) for r in right])
    a, b = [], []
    for i, one in enumerate(left):
        lo, hi = np.searchsorted(values, one, "left"), np.searchsorted(values, one, "right")
        n = hi - lo
        ends = np.cumsum(n)
        hit = np.repeat(lo - (ends - n), n) + np.arange(ends[-1]) if len(ends) else np.zeros(0, np.int64)
        common = np.bincount(owner[hit], minlength=len(right))
        ok = np.flatnonzero(rule.over * common >= rule.of * (len(one) + size - common))
        a.append(np.full(len(ok), i))
        b.append(ok)
    return np.concatenate(a), np.concatenate(b)


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: list[int] | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Those of the links (a, b) that join what earlier ones don't, by union-find."""
    parent, out = parent or list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out, parent


def dealt_into(blocks: Column) -> Column:
    """The block of a node in a group of so many blocks: by hash, so that no task numbers a group."""
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def compare(pairs: DataFrame, links, joined: bool = True) -> DataFrame:
    """Links (a, b) of rows (group, i, j, side, node, payload), which make up pairs of blocks: a spanning forest inside a block, or of
    what joins two blocks that (joined) are each joined as far as they are alike. links(left, right): pairs of places of two lists of
    payloads. Pairs of blocks of one node in all are left out before they reach Python."""
    w = Window.partitionBy("group", "i", "j")
    dealt = pairs.withColumn("n", F.count(F.lit(1)).over(w)).filter("n > 1").drop("n").sortWithinPartitions("group", "i", "j")

    def run(batches):
        import pyarrow as pa

        def one(rows):
            left, right = [r for r in rows if not r[0]], [r for r in rows if r[0]]
            nodes = [r[1] for r in left + right]
            if not right:
                found, _ = forest(len(left), *inside([r[2] for r in left]))
            else:
                l, r = [x[2] for x in left], [x[2] for x in right]
                parent, (e, f) = None, links(l, r)
                if joined:
                    (a, b), (c, d) = inside(l), inside(r)
                    _, parent = forest(len(nodes), np.append(a, c + len(l)), np.append(b, d + len(l)))
                found, _ = forest(len(nodes), e, f + len(l), parent)
            return [(nodes[x], nodes[y]) for x, y in found]

        def inside(x):
            a, b = links(x, x)
            return a[a < b], b[a < b]

        key, rows, out = None, [], []
        for batch in batches:
            for g, i, j, side, node, value in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (g, i, j) != key:
                    if len(rows) > 1:
                        out += one(rows)
                    key, rows = (g, i, j), []
                rows.append((side, node, value))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])
                out = []
        if len(rows) > 1 and (out := one(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])
        rows = batch = None
        give_back()

    return dealt.mapInArrow(run, "a binary, b binary")


def link_groups(items: DataFrame, links, name: str) -> DataFrame:
    """(node, root) of all that links joins inside groups: items (group, block, blocks, node, payload) is a table.

    Each block of a group is compared with itself and block 0, so rows grow with the group and not with its square. Then the nodes that
    are not in what most of their group was joined to are compared with the whole group. So every link that could join two components
    is seen. Only where most of a large group is joined to nothing do rows grow with its square, divided by BLOCK.
    """

    def keyed_by(df, i, j, side):
        return df.select("group", i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"), "node", "payload")

    others = F.when(F.col("block") > 0, F.array("block")).when(F.col("blocks") > 1, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    found = components(compare(keyed_by(items.withColumn("j", F.explode(others)), F.lit(0), F.col("j"), 0), links))
    large = items.filter("blocks > 1")
    if large.isEmpty():
        return found
    found = spool(found, f"{name}-found")
    known = large.select("group", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    most = known.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = spool(known.join(spool(most, f"{name}-main"), "group").filter("root <> main").select("node", "group"), f"{name}-rest")
    if rest.isEmpty():
        return found
    sized = spool(rest.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("more")), f"{name}-rest-blocks")
    whole = large.join(sized, "group")
    every = keyed_by(whole.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("more") - 1))), F.col("i"), F.col("block"), 1)
    left = whole.join(rest, ["group", "node"], "left_semi").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    new = compare(keyed_by(left, dealt_into(F.col("more")), F.col("j"), 0).unionByName(every), links, joined=False)
    return components(new.union(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", mark: bool = False) -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, component_id (the least id that linked texts lead to), kept, and with `mark` the
    hash of the row's text, so that rows of one id can be told apart.

    Lower-cases A-Z only. Null and empty texts, and those without words, have an empty set and are linked with nothing, not even with
    one another. Rows with equal ids are judged by their own texts. A row with a null id is linked by an equal set only; it is no component_id where
    the component has another, and else `kept` is true.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))

    def sign(batches):
        import pyarrow as pa

        shingles = Shingler(rule.shingle)
        for batch in batches:
            out = []
            for value in batch.column(1):
                h = shingles(value.as_py())
                if len(h):
                    m = minima(h)
                    out.append((len(h), fingerprint(h), pack((m & 15).astype(np.uint8)), band_keys(m)))
                else:
                    out.append((0, None, None, None))
            types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, type=t) for c, t in zip(zip(*out), types))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), *types)], names=["doc_id", "mark", "n_shingles", "node", "signature", "bands"])
        shingles = None
        give_back()

    signed = spool(rows.mapInArrow(sign, "doc_id long, mark long, n_shingles long, node binary, signature binary, bands array<long>"), "signed")
    nodes = spool(signed.filter("node IS NOT NULL").groupBy("node").agg(F.first("signature").alias("signature"), F.first("bands").alias("bands")), "nodes")
    # buckets are counted and met by key alone; signatures join only those nodes that share one
    keyed = nodes.select("node", F.explode("bands").alias("group"))
    buckets = spool(keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    shared = keyed.join(buckets, "group").withColumn("block", dealt_into(F.col("blocks")))
    candidates = spool(shared.join(nodes.select("node", F.col("signature").alias("payload")), "node").select("group", "block", "blocks", "node", "payload"), "candidates")
    least = rule.of / rule.over - MARGIN

    def alike(left, right):
        x, y = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(len(v), -1) for v in (left, right))
        return np.nonzero(estimates(x, y) >= least)

    families = spool(link_groups(candidates, alike, "bands"), "families")
    for done in (nodes, buckets, candidates):
        unspool(done)
    # a node is compared by one row: of its least id, and of the least hash of a text where that id has several
    each = signed.filter("node IS NOT NULL").groupBy("node", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    members = spool(each.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("mark", "n"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("of")), "members")
    large = spool(families.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "large")
    placed = families.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", dealt_into(F.col("blocks")))
    wanted = placed.join(members.filter("doc_id IS NOT NULL"), "node").select("node", F.col("root").alias("group"), "block", "blocks", "doc_id", "of.mark", (F.col("of.n") > 1).alias("repeated"))
    schema = "node binary, group binary, block int, blocks int, payload binary"

    def sets(batches):
        import pyarrow as pa

        shingles = Shingler(rule.shingle)
        for batch in batches:
            found = [shingles(v.as_py()) for v in batch.column(4)]
            same = pa.array([node.as_py() == fingerprint(h) for node, h in zip(batch.column(0), found)], pa.bool_())  # else another text with the same id
            made = pa.array([h.tobytes() for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], made], names=["node", "group", "block", "blocks", "payload"]).filter(same)
        shingles = None
        give_back()

    def with_text(nodes):
        return rows.filter("doc_id IS NOT NULL").join(nodes, ["doc_id", "mark"]).select("node", "group", "block", "blocks", "text")

    texts = with_text(wanted.filter("NOT repeated"))
    if not members.filter("of.n > 1").isEmpty():  # equal rows come down to one, in each task first
        one = with_text(wanted.filter("repeated")).groupBy("node").agg(*(F.first(c).alias(c) for c in ("group", "block", "blocks", "text")))
        texts = texts.unionByName(one)
    full = spool(texts.mapInArrow(sets, schema), "full")  # read twice where there are large families

    def linked(left, right):
        x, y = ([np.frombuffer(h, dtype=np.uint64) for h in v] for v in (left, right))
        return true_links(x, y, rule)

    classes = link_groups(full, linked, "families")
    # a table for each step over classes: joins of tables alone are dealt anew where a key has very many rows
    named = members.join(classes.withColumnRenamed("root", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    named = spool(named, "classes")
    first = spool(named.groupBy("class").agg(F.min("doc_id").alias("component_id")), "first")
    labels = spool(named.join(first, "class").select("node", "component_id"), "labels")
    out = signed.select("doc_id", "mark", "node", "n_shingles").join(labels, "node", "left").select(*(["mark"] if mark else []), "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 2), ' ')) AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) AS i) WHERE len(w) >= 1),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
two AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, t.b FROM reach r JOIN two t ON t.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""
