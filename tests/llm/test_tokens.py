import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from longweft.llm import bpe, packing, token_files
from longweft.llm.queries import BYTE_BPE, WORD_BPE

SCHEMA = "doc_id long, text string, n_tokens string, start string, sequence_id string"  # names that clash with results


def texts():
    rng = random.Random(4)
    letters = "".join(map(chr, range(1, 0x250))) + "ΣσςАбв中文한🙂é́ﬁ 　İß"
    out = ["", " ", "a" * 5000, "the " * 3000, "<|endoftext|>x <|startoftext|>y<|endoftext|", "don't we'll 12 3.5"]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)] + ["".join(rng.choice(" etaoinsh'.,1é\n") for _ in range(300)) for _ in range(100)]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
@pytest.mark.parametrize("kind", [bpe.Encoder, bpe.RankEncoder])
def test_ids_and_decoding_are_the_librarys(path, kind):
    ref, mine, whole = Tokenizer.from_file(path), kind(path), bpe.Encoder(path)
    for t in texts():
        ids = ref.encode(t, add_special_tokens=False).ids
        assert mine.encode(t).tolist() == ids, t
        assert whole.decode(ids) == ref.decode(ids, skip_special_tokens=False)
    assert b"".join(mine.blocks(("ab cd\n" * 50_000)[:-1], size=1000)) == mine.encode(("ab cd\n" * 50_000)[:-1]).tobytes()


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
@pytest.mark.parametrize("kind", [bpe.Encoder, bpe.RankEncoder])
def test_every_code_point_has_the_librarys_ids(path, kind):
    ref, mine = Tokenizer.from_file(path), kind(path)
    points = [chr(c) for c in [*range(1, 0x20000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for form in ("a{0}b 1{0}", "{0}", "{0}{0}A"):
        for i in range(0, len(points), 128):
            text = " ".join(form.format(c) for c in points[i : i + 128])
            assert mine.encode(text).tolist() == ref.encode(text, add_special_tokens=False).ids, (form, i)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_no_pair_of_tokens_is_merged_by_bytes_alone(path):
    assert bpe.Encoder(path).unsafe() == []


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


ROWS = [(3, "b c"), (1, None), (None, "null id"), (2, ""), (3, "b c"), (3, "a tie"), (7, "long " * 4000)]


def test_encode_texts(spark):
    ref = Tokenizer.from_file(WORD_BPE)
    got = bpe.encode_texts(frame(spark, ROWS), WORD_BPE, ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")).collect()
    assert len(got) == len(ROWS)
    for r, (i, t) in zip(got, ROWS):
        ids = ref.encode(t or "", add_special_tokens=False).ids
        text = ref.decode(ids, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (i, len(ids), ids, text)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_texts(frame(spark, []), WORD_BPE).count() == 0


def test_token_files(spark):
    ref = Tokenizer.from_file(WORD_BPE)
    folder = token_files.write_token_files(frame(spark, ROWS), WORD_BPE, end_id=1)
    got = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3, 7]
    at, want = 0, sorted((i or 0, tuple(ref.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 1 and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))
        at += r.n_tokens
    assert sorted((r.doc_id or 0, tuple(r.ids[:-1])) for r in got) == want
    assert token_files.read_token_files(spark, token_files.write_token_files(frame(spark, []), WORD_BPE, 1)).count() == 0


def test_packing(spark):
    rows = ROWS + [(100 + i, "w " * n) for i, n in enumerate(random.Random(1).choices(range(1, 700), k=200))]
    got = packing.pack(frame(spark, rows), BYTE_BPE, capacity=256).collect()
    seqs, docs = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and 0 < length <= 256
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert -(-total // 256) <= len(seqs) <= 1.02 * -(-total // 256) + 1
    ref = Tokenizer.from_file(BYTE_BPE)
    ids = ref.encode("long " * 4000, add_special_tokens=False).ids + [0]
    mine = sorted(docs[7], key=lambda r: r.piece)
    assert sum(r.length for r in mine) == len(ids) and all(r.length == 256 for r in mine[1:])
    assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in mine)
    assert packing.pack(frame(spark, []), BYTE_BPE).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(0)
    for histogram in ({}, {64: 5}, {1: 7}, {40: 1000, 20: 3}, dict(zip(range(1, 65), rng.integers(0, 3000, 64).tolist()))):
        histogram = {k: v for k, v in histogram.items() if v}
        p = packing.plan(histogram, 64)
        used = {}
        for length, n in histogram.items():
            s, o = p.place(np.full(n, length), np.arange(n))
            for a, b in zip(s.tolist(), o.tolist()):
                used.setdefault(a, []).append((b, length))
        assert len(used) == p.sequences
        for parts in used.values():
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 64
        demand = np.array([histogram.get(i, 0) for i in range(65)])
        assert p.bound <= p.sequences + 1e-6 and p.sequences <= sum(n for _, n in packing.best_fit(demand, 64))


def test_best_fit_of_equal_pieces_at_once_is_best_fit_of_each():
    rng = random.Random(5)
    for _ in range(200):
        pieces = sorted((rng.randrange(1, 31) for _ in range(rng.randrange(0, 60))), reverse=True)
        rooms = []
        for length in pieces:
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 30) - length)
        made = packing.best_fit(np.array([pieces.count(i) for i in range(31)]), 30)
        assert sum(n for _, n in made) == len(rooms) and sorted(30 - sum(k * v for k, v in c.items()) for c, n in made for _ in range(n)) == sorted(rooms)
        assert sorted(k for c, n in made for k, v in c.items() for _ in range(n * v)) == sorted(pieces)
    begun = packing.best_fit(np.array([0, 0, 0, 4, 1, 0, 0, 0, 0, 0, 0]), 10, [({6: 1}, 3), ({5: 2}, 1)])
    assert sum(n for _, n in begun) == 5 and sum(n * v for c, n in begun for v in c.values()) == 10


def test_the_program_places_the_pieces():
    rng = np.random.default_rng(3)
    n = np.minimum(rng.lognormal(6, 1.2, 9_000).astype(int) + 1, 2048)
    for times in (1, 30):
        lengths, counts = np.unique(n, return_counts=True)
        histogram = {int(k): int(c) if times == 1 else int(rng.poisson(c * times)) + 1 for k, c in zip(lengths, counts)}
        demand = np.array([histogram.get(i, 0) for i in range(2049)])
        p = packing.plan(histogram, 2048)
        assert p.by_program >= 0.9 * demand.sum() - (times == 1) * 0.2 * demand.sum()
        assert p.bound <= p.sequences <= sum(n for _, n in packing.best_fit(demand, 2048))


def fewest(pieces, capacity):
    """The least number of sequences by trying all ways."""
    best = len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in {*rooms}:
            if room >= pieces[i]:
                at = rooms.index(room)
                go(i + 1, (*rooms[:at], room - pieces[i], *rooms[at + 1 :]))
        go(i + 1, (*rooms, capacity - pieces[i]))

    go(0, ())
    return best


def test_small_plans_against_all_ways():
    rng, more = random.Random(2), 0
    for _ in range(60):
        pieces = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        made, least = packing.plan({k: pieces.count(k) for k in pieces}, 20).sequences, fewest(pieces, 20)
        assert least <= made <= least + 1
        more += made > least
    assert more <= 6
