"""Spelling variants against all pairs, with hot groups dealt again, and on odd tables."""

import itertools
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from longweft.llm import spelling


def edits(x, y):
    """Edit distance by the usual table."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def brute_force(rows, damage=True, letters=6, least=5, times=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        if others and n[best := min(others, key=lambda o: (-n[o], o))] >= times * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def found(spark, rows, **k):
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def made_up(seed, n, alphabet="abé", length=(6, 9)):
    rng = random.Random(seed)
    words = ["".join(rng.choices(alphabet, k=rng.randint(*length))) for _ in range(n)]
    weight = [rng.choice([1, 1, 2, 8, 60]) for _ in words]
    return [(i if i % 9 else None, " ".join(rng.choices(words, weight, k=80))) for i in range(120)]


def test_one_edit_is_distance_one():
    some = ["".join(w) for n in (1, 2, 3, 4) for w in itertools.product("ab", repeat=n)]
    for x in some:
        for y in some:
            assert spelling.one_edit(x, y) == (edits(x, y) == 1), (x, y)


def test_each_pair_of_all_short_words_is_found_once(spark):
    rows = [(1, " ".join(" ".join(["".join(w)] * 5) for n in (6, 7) for w in itertools.product("ab", repeat=n)))]
    assert found(spark, rows, damage=False) == brute_force(rows, damage=False)


def test_equal_to_all_pairs_with_large_groups_dealt_again(spark, monkeypatch):
    rows = [*made_up(3, 400), (7, "planets " * 5 + "planetz " * 30 + "planekz " * 200 + "plamekz " * 2000)]
    want = brute_force(rows)
    assert len(want) > 100 and any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)
    assert found(spark, rows) == want
    monkeypatch.setattr(spelling, "GROUP", 3)
    assert found(spark, rows) == want
    assert found(spark, made_up(5, 60, "ab", (11, 14)), damage=False) == brute_force(made_up(5, 60, "ab", (11, 14)), damage=False)


def test_nulls_long_texts_ties_and_clashing_columns(spark):
    long = "Straße straßen STRASSE colour color, colour; " * 60_000
    rows = [(1, long), (1, long), (2, None), (3, ""), (None, "colours " * 30), (4, "ÀÉÎÕÜæ ÀÉÎÕÜß ÀÉÎÕÜæ×÷ " * 5), (5, "aaaaaab aaaaaac aaaaaad " * 40 + "aaaaaae " * 5), (6, "x" * 3_000_000)]
    assert found(spark, rows) == brute_force(rows)
    df = spark.createDataFrame(rows[2:], "doc_id long, text string")
    odd = df.withColumn("word", F.lit("colour")).withColumn("n", F.lit(3)).withColumn("key", F.lit(0)).withColumn("id", F.lit(1))
    assert {tuple(r) for r in spelling.variants(odd).collect()} == brute_force(rows[2:])
    assert spelling.variants(df.limit(0)).collect() == []
