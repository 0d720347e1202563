"""K-mers and minimizer sketches.

A k-mer's canonical form is the smaller of itself and its reverse complement; its strand is + if that is itself. K-mers with a base
other than ACGT are left out, and windows span them. A minimizer is the k-mer of least (hash, position) of w consecutive k-mers.
A sequence with fewer than w k-mers has none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Bases of a piece of a long sequence that one task sketches.
CHUNK = 1 << 20
CODE = np.full(256, 255, dtype=np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i


def kmers(df: DataFrame, k: int, id_col: str = "id", seq_col: str = "seq", whole: bool = False) -> DataFrame:
    """A row for each k-mer: id, pos (from 0), hash, strand. It is the sketch whose windows are one k-mer long."""
    return sketch(df, k, 1, id_col, seq_col, whole=whole)


#: The hash is linear over words of WORD bits of the 2-bit code, modulo a prime, and then mixed once more over its own halves. No
#: product or sum reaches 2^63, so signed 64-bit integers of any SQL engine can compute it.
PRIME, WORD = (1 << 61) - 1, 21
FACTORS = np.random.default_rng(61).integers(1 << 39, 1 << 40, 64, dtype=np.int64).tolist()
HALVES = (1073741789, 982451653)


def _mod(x: np.ndarray) -> np.ndarray:
    """Modulo 2^61 - 1 of numbers below 2^63."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _hash(codes: list[np.ndarray], k: int) -> np.ndarray:
    h = np.zeros(len(codes[0]), dtype=np.uint64)
    for i, code in enumerate(codes):
        for j in range(0, 2 * min(32, k - 32 * i), WORD):
            h = _mod(h + ((code >> np.uint64(j)) & np.uint64((1 << WORD) - 1)) * np.uint64(FACTORS[i * 4 + j // WORD]))
    h ^= h >> np.uint64(29)
    return _mod((h >> np.uint64(31)) * np.uint64(HALVES[0]) + (h & np.uint64((1 << 31) - 1)) * np.uint64(HALVES[1]))


def _word(base: np.ndarray, k: int) -> np.ndarray:
    """The k bases (32 at most) from each place on as a 2-bit number, made of two halves."""
    if k == 1:
        return base
    half, h = _word(base, k // 2), k // 2
    code = half[:-h] << np.uint64(2 * h) | half[h:]
    return code[:-1] << np.uint64(2) | base[k - 1 :] if k % 2 else code


def _codes(base: np.ndarray, k: int) -> list[np.ndarray]:
    """K-mers as 2-bit numbers of 32 bases at most each, most significant first."""
    n = len(base) - k + 1
    return [_word(base, min(32, k - first))[first : first + n] for first in range(0, k, 32)]


#: Seed words of the published nucleotide hash for A, C, G, T, and the constants that make a second hash of a first (fixed values).
NUCLEOTIDE = (0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456)
SECOND, SECOND_SHIFT = 0x90B45D39FB6DA1FA, 27
#: A rotation of such a word turns its low and its high part each by itself.
LOW, HIGH = 33, 31


def _turned(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Words turned left by so many places each; by: any integers."""
    low, high = x & np.uint64((1 << LOW) - 1), x >> np.uint64(LOW)
    a, b = (by % LOW).astype(np.uint64), (by % HIGH).astype(np.uint64)
    low = (low << a | low >> (np.uint64(LOW) - a)) & np.uint64((1 << LOW) - 1)
    high = (high << b | high >> (np.uint64(HIGH) - b)) & np.uint64((1 << HIGH) - 1)
    return high << np.uint64(LOW) | low


def nucleotide_hashes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As hashes(), by the published strand-symmetric nucleotide hash: positions, the unsigned hashes that minimizers are chosen by,
    whether the strand is +, and the unsigned second hashes that name them in sketch files.

    A strand's hash is the exclusive or of its bases' words, each turned by its distance from the k-mer's end. All words are turned
    once by their place in the sequence instead, so that a k-mer's is the difference of two running values, turned back: work that
    doesn't grow with k. The k-mer's hash is the sum of both strands'."""
    base = CODE[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)]
    n = len(base) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    bad = np.concatenate([[0], np.cumsum(base == 255)])
    pos = np.flatnonzero(bad[k:] == bad[:-k])
    clean, words, at = np.where(base == 255, 0, base), np.array(NUCLEOTIDE, dtype=np.uint64), np.arange(len(base))
    run = lambda x: np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(x)])
    there, back = run(_turned(words[clean], -at)), run(_turned(words[3 - clean], at))
    forward, reverse = _turned(there[pos + k] ^ there[pos], pos + k - 1), _turned(back[pos + k] ^ back[pos], -pos)
    first = forward + reverse
    second = first * np.uint64((1 ^ k * SECOND) & (1 << 64) - 1)
    return pos, first, forward <= reverse, second ^ second >> np.uint64(SECOND_SHIFT)


def hashes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes (below 2^61) and whether the strand is + of the k-mers without other bases than ACGT."""
    base = CODE[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)]
    if len(base) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    bad = np.concatenate([[0], np.cumsum(base == 255)])
    pos = np.flatnonzero(bad[k:] == bad[:-k])
    clean = np.where(base == 255, 0, base).astype(np.uint64)
    fwd = _codes(clean, k)
    back = [c[::-1] for c in _codes((np.uint64(3) - clean)[::-1], k)]
    plus, tied = np.zeros(len(fwd[0]), dtype=bool), np.ones(len(fwd[0]), dtype=bool)
    for a, b in zip(fwd, back):
        plus |= tied & (a < b)
        tied &= a == b
    plus = (plus | tied)[pos]
    return pos, _hash([np.where(plus, a[pos], b[pos]) for a, b in zip(fwd, back)], k).astype(np.int64), plus


def window_minima(h: np.ndarray, w: int, of: np.ndarray | None = None) -> np.ndarray:
    """Places of the leftmost least value of each w consecutive ones, each once. Windows grow to twice their length at a time, the left
    one's minimum standing where both are equal, so the work grows with the logarithm of w. of: the sequence that each value is of;
    windows over two count for none."""
    n, size = len(h), 1
    if n < w:
        return np.zeros(0, np.int64)
    least, at = h, np.arange(n)
    while size < w:
        by = min(size, w - size)
        at = np.where(least[by:] < least[:-by], at[by:], at[:-by])
        least = np.minimum(least[by:], least[:-by])
        size += by
    chosen = np.zeros(n, dtype=bool)
    chosen[at if of is None else at[of[: n - w + 1] == of[w - 1 :]]] = True
    return np.flatnonzero(chosen)


#: Bases of the sequences that are sketched together, so that short ones don't cost a call each.
GROUP = 1 << 18


def _groups(sizes: list[int]) -> list[tuple[int, int]]:
    """Ranges of neighbours of GROUP bases together, or one alone that has more."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > GROUP:
            out.append((first, i))
            first, total = i, 0
        total += n
    return out + [(first, len(sizes))] if sizes else out


def sketch(df: DataFrame, k: int, w: int, id_col: str = "id", seq_col: str = "seq", chunk: int = CHUNK, scheme: str = "modular", keep: list[str] = [], whole: bool = False, twice: bool = False) -> DataFrame:
    """A row for each minimizer: id, pos, hash, strand, and the columns `keep` of its sequence. scheme: `modular`, a hash that SQL can
    compute too, or `nucleotide`, the published one, whose 64 bits are in `hash` as a signed number.

    Sequences longer than `chunk` are cut into pieces that overlap by w + k - 2 bases, so each window lies in a piece and one long
    sequence spreads over tasks (only such pieces are shuffled); a minimizer of two pieces' windows counts once. With bases other than ACGT the windows of a piece
    may reach less far back than the sequence's, so there pieces overlap by more. whole: no sequence is that long, and df is read once.
    twice: it is only asked whether a hash occurs once in all, so of rows of a hash that were made together two are enough.
    """
    if scheme not in ("modular", "nucleotide"):
        raise ValueError(f"scheme {scheme}")
    halo = 2 * (w + k) + 1000
    seqs = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), *keep).filter(F.col("seq").isNotNull())
    pieces = seqs.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(chunk))))
    pieces = pieces.select("id", "start", F.expr(f"substring(seq, start + 1, {chunk + halo})").alias("piece"), *keep, (F.length("seq") > chunk).alias("cut"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        strands = pa.array(["-", "+"])
        for batch in batches:
            starts = batch.column(1).to_numpy()
            for first, last in _groups(pc.utf8_length(batch.column(2)).to_pylist()):
                texts = batch.column(2).slice(first, last - first).to_pylist()
                text = "|".join(texts)  # no base, so no k-mer goes over it
                if scheme == "nucleotide":
                    pos, h, plus, named = nucleotide_hashes(text, k)
                else:
                    pos, h, plus = hashes(text, k)
                    named = h
                begin = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
                of = np.searchsorted(begin, pos, side="right") - 1
                at = window_minima(h, w, of)
                if twice:
                    order = np.argsort(named[at], kind="stable")
                    more = named[at][order]
                    at = at[np.sort(np.concatenate([order[:2], order[2:][more[2:] != more[:-2]]]))]
                of = of[at]
                row, place = pa.array(of + first), pos[at] - begin[of] + starts[first:last][of]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(place.astype(np.int32)), pa.array(named[at].view(np.int64)), strands.take(pa.array(plus[at].astype(np.int8))), *(batch.column(i).take(row) for i in range(3, batch.num_columns))], names=["id", "pos", "hash", "strand", *keep])

    schema = ", ".join(["id string, pos int, hash long, strand string", *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)])
    short = pieces if whole else pieces.filter("NOT cut")
    found = short.select("id", "start", "piece", *keep).mapInArrow(run, schema)
    if whole:
        return found
    return found.union(pieces.filter("cut").select("id", "start", "piece", *keep).repartition("id", "start").mapInArrow(run, schema).distinct())


def density(sketched: DataFrame) -> DataFrame:
    """For each sequence: minimizers, mean and largest distance between neighbours."""
    from pyspark.sql import Window

    step = (F.col("pos") - F.lag("pos").over(Window.partitionBy("id").orderBy("pos"))).alias("step")
    return sketched.select("id", step).groupBy("id").agg(F.count(F.lit(1)).alias("n_minimizers"), F.avg("step").alias("mean_spacing"), F.max("step").alias("max_spacing"))


def as_line(sketched: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Sketch lines: id, (length,) `hash:pos:strand` in order, joined by spaces. lengths: rows (id, length)."""
    bits = F.col("hash").cast("decimal(21,0)")
    unsigned = F.when(bits < 0, bits + F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(bits)
    mx = F.concat_ws(":", unsigned.cast("decimal(21,0)").cast("string"), F.col("pos").cast("string"), "strand")
    lines = sketched.groupBy("id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", mx.alias("mx")))), lambda x: x["mx"])).alias("minimizers"))
    return lines if lengths is None else lines.join(lengths, "id").select("id", "length", "minimizers")
