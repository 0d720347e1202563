"""Conversation repair against a best-first search over all edits, cut into small blocks and pieces, and on odd tables."""

import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from longweft.llm import conversations as conv


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        mark = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        out += [(conv_id, turn, "user" if mark == 4 else role, text)] * (0 if mark == 0 else 2 if mark == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault), by best-first search with any number of insertions."""
    todo, number = [(0, "", 0, 0, ())], 0
    while True:
        cost, audit, _, at, made = heapq.heappop(todo)
        initials = "".join(r[:1] for r, _ in made)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, made
        steps = [(3, "I", at, (*made, (r, ""))) for r in ("user", "assistant")] if not audit.endswith("III") else []
        if at < len(rows):
            role, text, fault = rows[at]
            steps.append((4, "D", at + 1, made))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                steps += [(3 + more, "R", at + 1, (*made, (r, text))) for r in ("user", "assistant")]
                if role[:1] in ("s", "u", "a"):
                    steps.append((more, "K", at + 1, (*made, (role, text))))
        for c, letter, i, m in steps:
            if re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in m)):
                number += 1
                heapq.heappush(todo, (cost + c, audit + letter, number, i, m))


def brute_force(rows, already=False):
    out = []
    after = rows if already else damaged(rows)
    for conv_id in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv_id), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            kept = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not kept else "duplicate" if (role, text) in seen else None if kept[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, made = cheapest([(role, text, f) for (_, role, text), f in zip(mine, faults)])
        turns = {t for t, _, _ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def made_up(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(["Yes.", "No!", "cut of", " \t\n", "Why?  \n", "Same.", f"Text {t}."])))
    return rows


def summary(df):
    return sorted(map(tuple, conv.summaries(conv.repair(conv.damage(df))).collect()), key=repr)


def test_equal_to_a_search_over_all_edits(spark):
    rows = made_up(1, 150, 7)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got, want = summary(df), brute_force(rows)
    assert got == want
    assert {"D", "I", "K", "R"} <= {c for r in want for c in r[7]} and any(r[7].endswith("I") for r in want)


def test_pieces_and_portions_of_any_size_give_the_same(spark, monkeypatch):
    rows = made_up(2, 30, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = brute_force(rows)
    for name, value in (("BLOCK", 4), ("CUT", 2), ("PORTION", 3)):
        monkeypatch.setattr(conv, name, value)
    assert summary(df) == want


def test_one_long_conversation_among_many(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"No {t}.", "cut", ""])) for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = summary(df)
    for name, value in (("BLOCK", 256), ("CUT", 16), ("PORTION", 10)):
        monkeypatch.setattr(conv, name, value)
    assert summary(df) == whole and len(whole) == 1
    repaired = conv.repair(conv.damage(df)).orderBy("place", "slot").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.repaired_role[0] for r in repaired if r.repaired_role))
    assert "".join(r.edit for r in repaired if r.edit) == whole[0][7]


def test_nulls_ties_odd_roles_and_clashing_columns(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "No turn."), (1, 3, "user", "A."), (1, 3, "assistant", "B."), (1, 3, "assistant", "B."), (2, 0, "", "Empty role."), (2, 1, "User", "Upper."), (2, 5, "unknown", "Counts as u."),
        (None, 1, "user", "Whose?"), (None, 2, "assistant", "Nobody's."), (3, 0, "system", "Only me."), (4, 0, "assistant", "x" * 2_000_000), (4, 1, "user", " " * 300_000 + "."), (5, 9, "user", "same."), (5, 9, "user", "same."), (5, 9, "user", "same."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    odd = df.withColumn("place", F.lit(1)).withColumn("gone_by", F.lit(2)).withColumn("fault", F.lit("x")).withColumn("id", F.lit(0))
    assert summary(odd) == brute_force(rows)
    assert summary(df.limit(0)) == []


def test_a_conversation_of_which_nothing_is_left(spark):
    turn = next(t for t in range(500) if zlib.crc32(f"6:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(6, turn, "user", "Lost.")], "conv_id long, turn long, role string, text string")
    assert summary(df) == [(6, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_undamaged_conversations_can_be_repaired_as_they_are(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "More."), (2, 0, "system", "Be kind."), (2, 1, "user", "Hi."), (2, 2, "assistant", "Yes.")]
    got = conv.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place", "slot").collect()
    assert ["".join(r.edit for r in got if r.conv_id == c) for c in (1, 2)] == ["KKIK", "KKK"] and brute_force(rows, already=True)[0][7] == "KKIK"
