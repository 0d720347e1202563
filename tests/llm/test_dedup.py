import math
import random
import re

from longweft.llm import minhash_dedup
from longweft.llm.components import components
from longweft.llm.minhash_dedup import Rule, near_duplicates
from longweft.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, kept string, component_id string"


def corpus(seed=2, n=120):
    """Texts with exact copies, near copies, shared passages and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    base = [[word() for _ in range(rng.randrange(5, 120))] for _ in range(n // 3)]
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 9))):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(10) :]
        rows.append((i, rng.choice((" ", "\n", "  ")).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "the same words " * 400), (n + 7, "The Same words " * 400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(5)


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, rule):
    sets = {i: shingles(t, rule.shingle) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= rule.of * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    for rule in (Rule(3, 85), Rule(5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows), rule).collect()}
        assert got == brute(rows, rule)


def test_a_large_group_of_near_copies_spans_blocks(spark, monkeypatch):
    from longweft.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows), Rule(3, 85)).collect()}
    assert got == brute(rows, Rule(3, 85))


def test_repeated_and_null_ids(spark):
    text = "some words that make a text of their own here"
    rows = [(5, text), (5, text), (3, text), (None, text), (None, "another text of quite other words in it"), (9, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, -1, True), (-1, 3, False), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_components_of_a_long_chain(spark):
    order = random.Random(3).sample(range(10_000), 3_000)
    got = components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")).collect()
    assert len(got) == 3_000 and {r.root for r in got} == {min(order)}


def removed(rows, size):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        cover = set()
        for p in range(len(w) - size + 1):
            if first.setdefault(tuple(w[p : p + size]), i) < i:
                cover.update(range(p, p + size))
        out[i] = (len(w), len(cover), " ".join(x for j, x in enumerate(w) if j not in cover))
    return out


def test_substrings_match_brute_force(spark, monkeypatch):
    from longweft.llm import substring_dedup

    rows = corpus(3) + [(1000, "x " * 300), (1001, "x " * 200 + "y"), (1002, "é ß 中 " * 20)]
    for chars, windows in ((12 << 20, 4 << 20), (2000, 50)):
        monkeypatch.setattr(substring_dedup, "BATCH_CHARS", chars)
        monkeypatch.setattr(substring_dedup, "PASS_WINDOWS", windows)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(frame(spark, rows), 13).collect()}
        assert got == removed(rows, 13)


def test_substrings_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(5, text), (5, text), (None, text), (7, text + " end")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(frame(spark, rows), 13).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (7, 20)]
    assert remove_repeats(frame(spark, []), 13).count() == 0
    as_was = remove_repeats(frame(spark, [(1, "a  b\nc")]), 13, as_was=True).first()
    assert as_was.kept_text == "a  b\nc"


def test_bands_and_estimate_together_miss_few_pairs():
    m, chance = minhash_dedup, 2.0**-minhash_dedup.BITS
    for similarity, most in ((0.85, 1e-6), (0.8, 1e-4)):
        p = similarity + (1 - similarity) * chance
        low = [c for c in range(m.HASHES + 1) if (c / m.HASHES - chance) / (1 - chance) < similarity - m.MARGIN]
        estimate = sum(math.comb(m.HASHES, c) * p**c * (1 - p) ** (m.HASHES - c) for c in low)
        assert estimate + (1 - similarity**m.ROWS) ** m.BANDS < most


def test_equal_rows_of_one_id_are_compared_once(spark, monkeypatch):
    """100,000 equal rows beside a near copy: what reaches the comparison of sets is two rows, and the classes are right."""
    seen = []
    whole = minhash_dedup.link_groups
    monkeypatch.setattr(minhash_dedup, "link_groups", lambda items, links, name: (seen.append((name, items.count())), whole(items, links, name))[1])
    words = [f"w{i}" for i in range(60)]
    near = [*words[:-1], "other"]
    copies = spark.range(100_000).selectExpr("5L AS doc_id", f"'{' '.join(words)}' AS text")
    rest = spark.createDataFrame([(9, " ".join(near)), (5, " ".join(near)), (5, "quite another text of one id"), (7, "alone here")], "doc_id long, text string")
    got = near_duplicates(copies.union(rest), Rule(3, 85)).groupBy("doc_id", "n_shingles", "component_id", "kept").count().collect()
    assert dict(seen)["families"] == 2
    assert {tuple(r) for r in got} == {(5, 58, 5, True, 100_001), (9, 58, 5, False, 1), (5, 4, 5, True, 1), (7, 1, 7, True, 1)}


def test_rules_over_another_base_than_a_hundred(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o q"), (3, "z y x w v u t s r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda rule: {r.doc_id: r.component_id for r in near_duplicates(df, rule).collect()}
    assert of(Rule(3, 4, 5)) == of(Rule(3, 80, 100)) == {1: 1, 2: 1, 3: 3}
