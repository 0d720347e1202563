import random

from longweft.operators import sketch
from longweft.operators.sketch import hashes, window_minima


def brute(seq, k, w):
    pos, h, plus = hashes(seq, k)
    rows = list(zip(h.tolist(), pos.tolist(), plus.tolist()))
    return sorted({min(rows[i : i + w])[1] for i in range(len(rows) - w + 1)})


def test_window_minima_leftmost_of_equal_values():
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        h = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        w = rng.randrange(1, 8)
        want = sorted({min((h[j], j) for j in range(i, i + w))[1] for i in range(len(h) - w + 1)})
        assert window_minima(np.array(h, dtype=np.int64), w).tolist() == want


def test_sketch_is_strand_neutral_and_matches_brute_force(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    other = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([("a", seq), ("b", other), ("n", seq[:500] + "N" + seq[501:900]), ("short", "ACGT"), ("none", None)], "id string, seq string")
    for k in (15, 21, 32, 40):
        rows = sketch.sketch(df, k, 10).collect()
        got = {i: sorted(r.pos for r in rows if r.id == i) for i in ("a", "b", "n", "short", "none")}
        assert got["a"] == brute(seq, k, 10) and got["a"] == sorted(3000 - k - p for p in got["b"])
        assert all(not p <= 500 < p + k for p in got["n"]) and not got["short"] and not got["none"]
        assert {r.hash for r in rows if r.id == "a"} == {r.hash for r in rows if r.id == "b"}


def test_hash_by_plain_integers():
    """The hash as its definition says, one k-mer at a time, and as hard to meet by chance as 61 bits are."""
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    for k in (5, 21, 33, 50):
        pos, h, plus = hashes(seq, k)
        for p, got, same in zip(pos.tolist(), h.tolist(), plus.tolist()):
            own = seq[p : p + k]
            other = own.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            assert same == (own <= other)
            want, canonical = 0, min(own, other)
            for i, part in enumerate(canonical[j : j + 32] for j in range(0, k, 32)):
                code = int("".join(str("ACGT".index(c)) for c in part), 4)
                for j in range(4):
                    want = (want + (code >> 21 * j & (1 << 21) - 1) * sketch.FACTORS[4 * i + j]) % sketch.PRIME
            want ^= want >> 29
            assert got == ((want >> 31) * sketch.HALVES[0] + (want & (1 << 31) - 1) * sketch.HALVES[1]) % sketch.PRIME
        assert len(set(h.tolist())) == len(h) or k == 5


def test_long_sequences_are_cut_without_a_trace(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("a", "".join(rng.choice("ACGT") for _ in range(9000)))], "id string, seq string")
    whole, cut = (sorted(map(tuple, sketch.sketch(df, 21, 10, chunk=c).collect())) for c in (1 << 20, 1000))
    assert whole == cut and whole


#: K-mers with the hash and the strand that the published nucleotide hash gives them (fixed values).
PUBLISHED = (("AAATTTCGAATTTAAAGGCGCATAGGTAGGAC", 3940627884194749360, "+"), ("ACGAAAAATTGTAGTTTAAAGGCGCATAGGTA", 18264252465449822990, "-"), ("AATTTTGAATTTTCAAGAAAAAATCACTCGAA", 2090929767303588684, "+"))


def turned(x, by):
    """A 64-bit word whose low 33 and high 31 bits are turned left by themselves."""
    low, high = x % (1 << 33), x >> 33
    for _ in range(by % 33):
        low = low * 2 % (1 << 33) + (low >> 32)
    for _ in range(by % 31):
        high = high * 2 % (1 << 31) + (high >> 30)
    return (high << 33) + low


def by_definition(kmer):
    """(first hash, second hash, strand) of a k-mer, base by base."""
    k, forward, reverse = len(kmer), 0, 0
    for i, c in enumerate(kmer):
        forward ^= turned(sketch.NUCLEOTIDE["ACGT".index(c)], k - 1 - i)
        reverse ^= turned(sketch.NUCLEOTIDE["TGCA".index(c)], i)
    first = (forward + reverse) % (1 << 64)
    second = first * ((1 ^ k * sketch.SECOND) % (1 << 64)) % (1 << 64)
    return first, second ^ second >> 27, "+" if forward <= reverse else "-"


def test_published_nucleotide_hash():
    for kmer, value, strand in PUBLISHED:
        assert by_definition(kmer)[1:] == (value, strand)
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGTacgtN" if i % 40 == 0 else "ACGT") for i in range(3000))
    for k in (2, 15, 32, 33, 70):
        pos, first, plus, second = sketch.nucleotide_hashes(seq, k)
        assert pos.tolist() == [i for i in range(len(seq) - k + 1) if "N" not in seq[i : i + k]]
        got = [(int(f), int(s), "+" if p else "-") for f, s, p in zip(first, second, plus)]
        assert got == [by_definition(seq[i : i + k].upper()) for i in pos]
    assert all(len(x) == 0 for x in sketch.nucleotide_hashes("ACG", 4))


def test_nucleotide_sketch_is_each_windows_least_and_survives_its_file(spark, tmp_path):
    from longweft.sources import formats

    rng = random.Random(11)
    seqs = {f"s{n}": "".join(rng.choice("ACGT") for _ in range(n)) for n in (20, 50, 900, 5000)}
    df = spark.createDataFrame(list(seqs.items()), "id string, seq string")
    want = set()
    for name, seq in seqs.items():
        marks = [(*by_definition(seq[i : i + 21]), i) for i in range(len(seq) - 20)]
        for i in range(len(marks) - 9):
            _, second, strand, at = min(marks[i : i + 10], key=lambda m: (m[0], m[3]))
            want.add((name, at, second - (1 << 64) * (second >> 63), strand))
    for chunk in (sketch.CHUNK, 700):
        made = sketch.sketch(df, 21, 10, chunk=chunk, scheme="nucleotide")
        assert {tuple(r) for r in made.select("id", "pos", "hash", "strand").collect()} == want
    formats.write_sketch(made, f"file://{tmp_path}/sketch.tsv")
    text = " ".join(r.value.split("\t")[1] for r in spark.read.text(f"file://{tmp_path}/sketch.tsv").collect())
    assert "-" not in text.replace(":-", "") and any(int(x.split(":")[0]) >= 1 << 63 for x in text.split())
    assert {tuple(r) for r in formats.read_sketch(spark, f"file://{tmp_path}/sketch.tsv").select("id", "pos", "hash", "strand").collect()} == want


def test_unknown_scheme_is_named(spark):
    import pytest

    with pytest.raises(ValueError, match="md5"):
        sketch.sketch(spark.createDataFrame([("a", "ACGT")], "id string, seq string"), 2, 1, scheme="md5")
