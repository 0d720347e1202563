"""Packing of token sequences: a configuration linear program over the histogram of lengths, solved by multiplicative weights.

A configuration is a multiset of lengths that fits into one sequence. The program asks for the fewest configurations that hold
every piece. A length's price is its share of a sequence times a weight that falls as it is covered; in each round a knapsack
dynamic program, bounded by the pieces that there are, finds the dearest configuration with each of a part of the lengths in it,
and these are used, fractions allowed, until their lengths are covered as far as the round says. The uses are rounded, fullest
configurations first, as far as pieces are there; what is left is a smaller program of the same kind, and so on until fewer
pieces are left than a sequence has places. Only those are packed best fit, longest first.

Only the histogram, at most `capacity` numbers, comes to the driver, whose work grows with the logarithm of the number of pieces.
The plan goes back as the configurations and how often each is used: at most TURNS * capacity a pass, and one for each sequence of
the rest. A piece's place follows from its rank among the pieces of its length: ranks are made of counts by (part of the table,
length), so no task holds a length as a whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import encoder
from .common import give_back, spool

#: How often each length has its turn in a program (more often with fewer lengths than 2048, for the same work), the rounds of a
#: turn, and how fast weights fall with what is covered too much.
TURNS, GROUPS, STEP = 6, 16, 3e-3
#: Programs that are solved at most, each over what rounding left of the one before; the last takes configurations of any fill.
PASSES = 24
#: Pieces that no more programs are made for.
LAST = 32
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def items_of(demand: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(length, copies): of each length as many pieces as there are and as fit into a sequence, in powers of two and a rest."""
    out = []
    for length in np.flatnonzero(demand).tolist():
        left, copies = int(min(demand[length], capacity // length)), 1
        while left > 0:
            copies = min(copies, left)
            out.append((length, copies))
            left -= copies
            copies *= 2
    return out


def knapsack(items: list[tuple[int, int]], price: np.ndarray, capacity: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """For each wanted length the dearest multiset of items that fits beside one piece of it, as rows (place in wanted, length,
    count) that include that piece; and the price of the dearest multiset of all."""
    best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), dtype=bool)
    for j, (length, copies) in enumerate(items):
        size = length * copies
        new = best[: capacity + 1 - size] + copies * price[length]
        np.greater(new, best[size:], out=took[j, size:])
        np.maximum(best[size:], new, out=best[size:])
    room, rows, lengths, counts = capacity - wanted, [np.arange(len(wanted))], [wanted], [np.ones(len(wanted), dtype=np.int64)]
    for j in range(len(items) - 1, -1, -1):
        hit = np.flatnonzero(took[j, room])
        if len(hit):
            length, copies = items[j]
            room[hit] -= length * copies
            rows.append(hit)
            lengths.append(np.full(len(hit), length))
            counts.append(np.full(len(hit), copies))
    return np.concatenate(rows), np.concatenate(lengths), np.concatenate(counts), float(best[capacity])


def solve(demand: np.ndarray, capacity: int, seed: int = 5) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], float]:
    """Configurations (lengths, counts) and how often each is used, fractions allowed, and a lower bound of the number of sequences.

    demand: pieces by length. Any prices are a dual solution once divided by that of the dearest configuration, so each round gives
    a lower bound; the best one is returned. The first prices, shares of a sequence, give the bound by volume."""
    lengths = np.flatnonzero(demand)[::-1].copy()
    share, weight, covered = np.arange(capacity + 1) / capacity, np.ones(capacity + 1), np.zeros(capacity + 1)
    turns, groups = TURNS * min(32, max(1, 2048 // max(1, len(lengths)))), GROUPS
    items, rng, uses, bound = items_of(demand, capacity), np.random.default_rng(seed), [], 0.0
    for k in range(turns * groups if len(lengths) else 0):
        if k % groups == 0:
            dealt = rng.permutation(len(lengths)) % groups
        mine, price = lengths[dealt == k % groups], share * weight
        if not len(mine):
            continue
        row, length, count, most = knapsack(items, price, capacity, mine)
        bound = max(bound, float((price * demand).sum() / most))
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(len(mine) + 1)).tolist()
        for i, one in enumerate(mine.tolist()):
            need = demand[one] * (k // groups + 1) / turns - covered[one]
            if need > 1e-9:
                at = order[cuts[i] : cuts[i + 1]]
                own, inverse = np.unique(length[at], return_inverse=True)
                counts = np.bincount(inverse, weights=count[at]).astype(np.int64)
                times = need / counts[own == one][0]
                covered[own] += counts * times
                uses.append((own, counts, float(times)))
        over = np.zeros(capacity + 1)
        over[lengths] = covered[lengths] / demand[lengths] - (k + 1) / (turns * groups)
        weight = weight * np.exp(-STEP * over)
    return uses, bound


def best_fit(demand: np.ndarray, capacity: int, begun: list[tuple[dict[int, int], int]] = []) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, into the free room of configurations that are `begun` and into new sequences: configurations (length:
    count) and how often each is used. Sequences are kept by free room, equal ones together, and `some` has a bit for each room of
    which there are any; pieces that begin a new sequence each are dealt with at once, so work doesn't grow with full sequences."""
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    some, done = 0, []

    def put(one: tuple[int, ...], free: int, n: int):
        nonlocal some
        room[free][one] = room[free].get(one, 0) + n
        some |= 1 << free

    for config, n in begun:
        free = capacity - sum(length * k for length, k in config.items())
        if free:
            put(tuple(length for length, k in sorted(config.items(), reverse=True) for _ in range(k)), free, n)
        else:
            done.append((dict(config), n))
    for length in range(capacity, 0, -1):
        left = int(demand[length])
        while left:
            fits = some >> length
            free = length + (fits & -fits).bit_length() - 1 if fits else capacity
            one, there = next(iter(room[free].items())) if fits else ((), left)
            k = min(left, free // length)  # a sequence that took one is the best fit for the next
            n = min(there, left // k)
            if fits:
                room[free][one] -= n
                if n == there:
                    del room[free][one]
                    if not room[free]:
                        some ^= 1 << free
            put((*one, *(length,) * k), free - k * length, n)
            left -= k * n
    return done + [(Counter(one), n) for found in room for one, n in found.items()]


@dataclass
class Plan:
    """Where the n-th piece of each length goes: slots[length] has rows (first rank, first sequence, copies in a sequence, first offset).
    by_program: pieces that are in configurations of the program, all others were packed best fit."""

    slots: dict[int, np.ndarray]
    sequences: int
    bound: float
    by_program: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for one in np.unique(length):
            at, rows = length == one, self.slots[int(one)]
            row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            n = rank[at] - row[:, 0]
            sequence[at], offset[at] = row[:, 1] + n // row[:, 2], row[:, 3] + n % row[:, 2] * one
        return sequence, offset


def rounded(left: np.ndarray, uses: list[tuple[np.ndarray, np.ndarray, float]], any_fill: bool) -> list[tuple[dict[int, int], int]]:
    """Whole uses of a program's configurations, fullest first, as far as pieces are left; what a fraction lacks, the next one
    gets. Those below the mean fill wait for the next program, where they may find better company. Takes its pieces from `left`."""
    fill, times = np.array([(own * counts).sum() for own, counts, _ in uses]), np.array([x for *_, x in uses])
    least, carried, chosen = 0 if any_fill else int((fill * times).sum() / times.sum()), 0.0, []
    for j in np.argsort(-fill, kind="stable").tolist():
        own, counts, x = uses[j]
        if fill[j] < least:
            break
        n = int(carried + x + 1e-9)
        carried += x - n
        n = min(n, int((left[own] // counts).min()))
        if n > 0:
            left[own] -= counts * n
            chosen.append((dict(zip(own.tolist(), counts.tolist())), n))
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Rounds the program's solution, then that over what is left, and so on; the last few pieces go best fit into the free room of its
    configurations and into new sequences. From `capacity` pieces on what this comes to is seen after each program, down to LAST
    pieces, and the fewest sequences are taken, of equal ones those with most pieces placed by the programs."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    total, full = int(left.sum()), int(left[capacity])
    chosen, lower = [({capacity: 1}, full)] if full else [], None  # a piece that fills a sequence is a configuration
    left[capacity] = 0
    tried, fewest = [], -(-sum(length * n for length, n in histogram.items()) // capacity)
    for k in range(PASSES):
        if not left.any():
            break
        if k and left.sum() <= capacity:
            made = best_fit(left, capacity, chosen)
            tried.append((sum(n for _, n in made), int(left.sum()), made))
            if left.sum() <= LAST or tried[-1][0] == fewest:  # no packing has less
                break
        uses, bound = solve(left, capacity)
        lower = full + bound if lower is None else lower
        chosen += rounded(left, uses, k == PASSES - 1)
    made = best_fit(left, capacity, chosen)
    _, rest, chosen = min([*tried, (sum(n for _, n in made), int(left.sum()), made)], key=lambda t: t[:2])
    by_program = total - rest
    slots: dict[int, list] = {}
    rank, sequence = np.zeros(capacity + 1, dtype=np.int64), 0
    for config, n in chosen:
        offset = 0
        for one, k in sorted(config.items(), reverse=True):
            slots.setdefault(one, []).append((int(rank[one]), sequence, k, offset))
            rank[one] += k * n
            offset += k * one
        sequence += n
    return Plan({k: np.array(v, dtype=np.int64) for k, v in slots.items()}, sequence, float(full) if lower is None else lower, by_program)


def pieces(df: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids and the end id, cut into pieces of `capacity` ids where there are more; the first may be shorter. With
    part and rank: the number of the task, and the rank of the piece among that task's pieces of its length."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        e, part, seen = encoder(vocabulary, fast=True), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join((*e.blocks(value.as_py()), end))
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, start in enumerate((0, *range(first, n, capacity))):
                    stop = first if not k else start + capacity
                    length = min(stop, n) - start
                    out.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * stop]), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]) if out else pa.RecordBatch.from_pylist([], schema=EMPTY())
        give_back()

    def EMPTY():
        import pyarrow as pa

        return pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES + ", part int, rank long")


def pack(df: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows and null ids are packed as rows of their own. An empty table gives
    no rows. Texts are tokenized once: the pieces, a few numbers each, are kept in the shared folder for the two passes.
    """
    cut = spool(pieces(df, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    shared = df.sparkSession.sparkContext.broadcast(plan(histogram, capacity))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = shared.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
