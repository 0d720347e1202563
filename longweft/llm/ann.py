"""Largest inner products by score-aware, anisotropic product quantisation.

Vectors are dealt to leaves by k-means. A vector's residual from its leaf's centre is quantised, two dimensions at a time, to four
bits. For inner products an error along the vector itself costs more than one across it, so codes and codebooks are chosen by a loss
that weighs the parallel part of the error ETA times: codes by coordinate descent, codebooks by least squares. A query scans codes
by a table of its products with all code words, two codes (one byte) at a time, and the best of each shard are scored again exactly,
in double precision. How far codes err on a query is measured on them and on a spread of the shard's items, and whatever DEVIATIONS
times that could lift into the result is scored too, until nothing more could. So items that codes don't tell apart (many near copies,
norms of all sizes) cost time, not recall.

Leaves and codebooks are fitted on a bounded sample (SAMPLE vectors); every vector is indexed. Equal vectors are one item with its
smallest ids, more than enough for any query. Items are dealt by hash into shards of about ROWS, and queries into blocks of about
QUERIES; a block's queries stream past a shard, so a task holds one shard and never a leaf or all queries. A query is sent once to
each shard, however many leaves there are, and a shard once to each block. Vectors of floats travel as floats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import spool

SAMPLE = 20_000
#: Items of a shard, queries of a block, and the best of a shard that are scored exactly.
ROWS, QUERIES, RERANKED = 32_768, 8_192, 200
#: Standard deviations of a product by codes that are allowed for, and items of a shard on which they are measured.
DEVIATIONS, MEASURED = 4.0, 256
SEED = 3


@dataclass
class Index:
    centres: np.ndarray  # leaves x dimensions
    words: np.ndarray  # pairs of dimensions x 16 x 2
    scale: float = 1.0  # what vectors are multiplied by before all else, so that the largest component is about 1

    def leaf(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * x @ self.centres.T).argmin(axis=1)

    def codes(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        code, _ = descend(x, x - self.centres[leaf], self.words)
        return (code[:, 0::2] | (code[:, 1::2] << 4)).astype(np.uint8)

    def norms(self, x: np.ndarray, leaf: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector, the norm of what its codes miss, and those of its centre and of what codes add to it together."""
        code = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(x), -1)
        part = self.words[np.arange(code.shape[1]), code].reshape(len(x), -1)
        return np.linalg.norm(x - self.centres[leaf] - part, axis=1), np.linalg.norm(self.centres[leaf], axis=1) + np.linalg.norm(part, axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, its product with both code words of each byte."""
        one = np.einsum("qsd,scd->qsc", q.reshape(len(q), -1, 2), self.words)
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(q), one.shape[1] // 2, 256)


def eta(dims: int, threshold: float = 0.2) -> float:
    """Weight of the parallel error for products over `threshold` times the norms."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def directions(x: np.ndarray) -> np.ndarray:
    """Vectors of norm 1, whatever the size of the components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def descend(x: np.ndarray, r: np.ndarray, words: np.ndarray, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals r of vectors x by coordinate descent, and what is left of r."""
    n, pairs = len(x), words.shape[0]
    unit = directions(x).reshape(n, pairs, 2)
    r = r.reshape(n, pairs, 2)
    more = eta(2 * pairs) - 1
    code = np.stack([((words[s] ** 2).sum(axis=1) - 2 * r[:, s] @ words[s].T).argmin(axis=1) for s in range(pairs)], axis=1)
    rest = r - np.stack([words[s][code[:, s]] for s in range(pairs)], axis=1)
    along = np.einsum("nsd,nsd->n", rest, unit)
    for _ in range(sweeps):
        for s in range(pairs):
            off = r[:, s, None, :] - words[s][None]
            other = along - (rest[:, s] * unit[:, s]).sum(axis=1)
            part = np.einsum("ncd,nd->nc", off, unit[:, s])
            best = ((off**2).sum(axis=2) + more * (other[:, None] + part) ** 2).argmin(axis=1)
            code[:, s], rest[:, s] = best, off[np.arange(n), best]
            along = other + part[np.arange(n), best]
    return code, rest


def fit(x: np.ndarray, leaves: int, rounds: int = 8) -> Index:
    rng = np.random.default_rng(SEED)
    centres = x[rng.permutation(len(x))[:leaves]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        for k in range(len(centres)):
            if len(mine := x[near == k]):
                centres[k] = mine.mean(axis=0)
    near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
    r = x - centres[near]
    n, pairs, more = len(x), x.shape[1] // 2, eta(x.shape[1]) - 1
    words = np.stack([r.reshape(n, pairs, 2)[rng.permutation(n)[np.arange(16) % n], s] for s in range(pairs)])
    words = words + rng.normal(0, 1e-6 * float(np.sqrt((r**2).mean())), words.shape)
    unit = directions(x).reshape(n, pairs, 2)
    for _ in range(rounds):
        code, rest = descend(x, r, words, 1)
        along = np.einsum("nsd,nsd->n", rest, unit)
        for s in range(pairs):
            u, target = unit[:, s], r.reshape(n, pairs, 2)[:, s]
            other = along - (rest[:, s] * u).sum(axis=1)
            left = np.eye(2)[None] + more * u[:, :, None] * u[:, None, :]
            right = target + more * u * ((u * target).sum(axis=1) + other)[:, None]
            for c in range(16):
                mine = code[:, s] == c
                if mine.any():
                    words[s, c] = np.linalg.solve(left[mine].sum(axis=0), right[mine].sum(axis=0))
            new = target - words[s][code[:, s]]
            along += ((new - rest[:, s]) * u).sum(axis=1)
            rest[:, s] = new
    return Index(centres, words)


class Shard:
    """Items of a shard with their codes, and the search among them."""

    def __init__(self, index: Index, leaf: np.ndarray, codes: np.ndarray, x: np.ndarray, owners: list[list[int]]):
        self.index, self.leaf, self.codes, self.x, self.owners = index, leaf, np.ascontiguousarray(codes.T), x, owners
        missed = [index.norms(self.doubles(slice(at, at + 4096)) * index.scale, leaf[at : at + 4096], codes[at : at + 4096]) for at in range(0, len(x), 4096)]
        self.missed = np.concatenate([m for m, _ in missed])
        self.rounding = 2.0**-23 * (codes.shape[1] + 1) * np.concatenate([s for _, s in missed])  # of sums of floats
        self.spread = np.unique(np.linspace(0, len(x) - 1, min(len(x), MEASURED)).astype(np.int64))

    def doubles(self, rows) -> np.ndarray:
        """Vectors in double precision and of whole bytes of codes."""
        x = self.x[rows].astype(np.float64)
        return np.pad(x, ((0, 0), (0, self.index.centres.shape[1] - x.shape[1])))

    def best(self, rows: np.ndarray, score: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
        """The k best (-score, id) of rows with these scores, each id once."""
        found: dict[int, float] = {}
        last = None
        for j in np.argsort(-score, kind="stable").tolist():
            if last is not None and score[j] < last:
                break
            for o in self.owners[rows[j]]:
                if o != own:
                    found.setdefault(o, float(score[j]))
            if last is None and len(found) >= k:
                last = score[j]
        return sorted((-s, o) for o, s in found.items())[:k]

    def search(self, ids: list[int], queries: np.ndarray, k: int, reranked: int | None):
        """For each query, its k best (-score, id): all items scored, or the best `reranked` by codes and all that may be better yet."""
        n = len(self.leaf)
        if reranked is None or n <= reranked:
            rows, x = np.arange(n), self.doubles(slice(None))
            for own, q in zip(ids, queries):
                yield self.best(rows, (x * q).sum(axis=1), own, k)
            return
        unit = directions(queries)
        centre, tables = (unit @ self.index.centres.T).astype(np.float32), self.index.tables(unit).astype(np.float32)
        measured = (self.doubles(self.spread) * self.index.scale) @ unit.T
        for i, own in enumerate(ids):
            approx = centre[i][self.leaf]
            for words, mine in zip(tables[i], self.codes):
                approx += words[mine]
            norm = float(queries[i] @ unit[i]) / self.index.scale  # scores over it are what codes stand for
            squares = lambda rows, true: float((((true - approx[rows]) / np.maximum(self.missed[rows], self.rounding[rows] + 1e-300)) ** 2).mean())  # noqa: B023, E731
            error = squares(self.spread, measured[:, i])
            rows, score, more, done = np.zeros(0, np.int64), np.zeros(0), np.argpartition(-approx, reranked)[:reranked], np.zeros(n, bool)
            while len(more):
                done[more] = True
                new = np.concatenate([(self.doubles(more[at : at + 4096]) * queries[i]).sum(axis=1) for at in range(0, len(more), 4096)])
                error = max(error, squares(more, new / norm))
                rows, score = np.concatenate([rows, more]), np.concatenate([score, new])
                found = self.best(rows, score, own, k)
                least = -found[-1][0] / norm if len(found) == k else -np.inf
                more = np.flatnonzero((approx + min(1.0, DEVIATIONS * error**0.5) * self.missed + self.rounding >= least) & ~done)
            yield found


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and x (floats as they are, other numbers as doubles) of the rows that take part."""
    x = F.col(vec_col) if df.schema[vec_col].dataType.simpleString() == "array<float>" else F.transform(vec_col, lambda v: v.cast("double"))
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ok)


def nearest(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", reranked: int | None = RERANKED) -> DataFrame:
    """For each row whose id is divisible by `every`, the k other rows of largest inner product found: query_id, rank, vec_id, score.

    The best `reranked` items of each shard, by their codes, are scored exactly, and those whose codes may err by enough to be among
    the k; with None all are, and the result is the exact one.
    Rows with a null id, and vectors that are null, empty, zero, or hold null or non-finite components, take no part; nor do vectors
    of another length than most. Ties go to the smaller id. With fewer candidates than k, all are returned; rows with one id are
    candidates of one another only under other ids. An empty table gives no rows.
    """
    spark = df.sparkSession
    found = "query_id long, vec_id long, score double"
    rows = usable(df, id_col, vec_col)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, queries = lengths[0]["d"], lengths[0]["q"]
    rows = rows.filter(F.size("x") == dims)
    most = k + 1
    few = rows.groupBy("x", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("s")).agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, most).alias("ids"))
    items = few.groupBy("x").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))
    items = spool(items.withColumn("h", F.xxhash64("x")), "items")
    n, largest = items.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))))).first()
    scale = 2.0 ** -np.clip(np.frexp(largest or 1.0)[1], -1000, 1000)
    sample = items.filter(F.pmod("h", F.lit(1 << 20)) < int(min(1.0, SAMPLE / n) * (1 << 20))).select("x").limit(2 * SAMPLE).collect()
    x = sorted(r["x"] for r in sample) or [r["x"] for r in items.orderBy("h", "x").select("x").limit(1).collect()]  # the order of no layout
    x = np.array(x, dtype=np.float64)
    pad = dims % 4 and 4 - dims % 4  # to whole bytes
    index = fit(np.pad(x * scale, ((0, 0), (0, pad))), leaves=int(max(1, min(4096, round(n**0.5 / 8), len(x) // 8))))
    index.scale = scale
    shared = spark.sparkContext.broadcast(index)  # 4096 centres at most
    shards, blocks = -(-n // ROWS), max(1, -(-queries // QUERIES))

    def vectors(column):
        """Rows of doubles of whole bytes of codes."""
        return np.pad(np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1), ((0, 0), (0, pad))) if len(column) else np.zeros((0, dims + pad))

    def code(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            v, leaf, codes = vectors(b.column(0)) * scale, [], []
            for at in range(0, len(v), 4096):
                leaf.append(shared.value.leaf(v[at : at + 4096]))
                codes += [c.tobytes() for c in shared.value.codes(v[at : at + 4096], leaf[-1])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(leaf).astype(np.int32)), pa.array(codes, pa.binary())], names=["x", "ids", "h", "leaf", "codes"])

    def scan(batches):
        import pyarrow as pa

        index, cell, held, shard = shared.value, None, [], None

        def search(q, ids):
            out = ([], [], [])
            for i, pairs in zip(ids, shard.search(ids, q, k, reranked)):
                out[0].extend([i] * len(pairs))
                out[1].extend(o for _, o in pairs)
                out[2].extend(-s for s, _ in pairs)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            cells, side = np.asarray(b.column(0)), np.asarray(b.column(1))
            cut = np.flatnonzero(np.append(True, (np.diff(cells) != 0) | (np.diff(side) != 0))) if len(cells) else []
            for start, stop in zip(cut, [*cut[1:], len(cells)]):
                part = b.slice(start, stop - start)
                if cells[start] != cell:
                    cell, held, shard = cells[start], [], None
                if side[start] == 0:
                    x = part.column(3)
                    held.append((np.array(part.column(4)), np.frombuffer(b"".join(part.column(5).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1), np.array(x.flatten()).reshape(len(x), -1), part.column(6).to_pylist()))
                elif held or shard is not None:
                    if shard is None:
                        leaf, codes, v, owners = zip(*held)
                        shard, held = Shard(index, np.concatenate(leaf), np.concatenate(codes), np.concatenate(v), [o for each in owners for o in each]), []
                    for at in range(0, part.num_rows, 256):
                        piece = part.slice(at, 256)
                        yield search(vectors(piece.column(3)), piece.column(2).to_pylist())

    numbers = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    cell = (F.col("shard") * blocks + F.col("block")).alias("cell")
    lacks = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    indexed = items.select("x", "ids", "h").mapInArrow(code, f"x {items.schema['x'].dataType.simpleString()}, ids array<long>, h long, leaf int, codes binary")
    indexed = indexed.withColumn("shard", F.pmod("h", F.lit(shards))).withColumn("block", numbers(blocks))
    indexed = indexed.select(cell, F.lit(0).alias("side"), F.col("h").alias("id"), "x", "leaf", "codes", "ids")
    asked = rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", numbers(shards))
    asked = asked.select(cell, F.lit(1).alias("side"), F.col("vec_id").alias("id"), "x", *lacks(leaf="int", codes="binary", ids="array<long>"))
    parts = min(shards * blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards * blocks // 16))
    dealt = indexed.unionByName(asked).repartition(parts, "cell").sortWithinPartitions("cell", "side", "id")
    best = dealt.mapInArrow(scan, found)
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
