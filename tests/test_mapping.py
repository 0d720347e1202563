import random

import pytest

from longweft.operators import mapping, pairs

SCHEMA = "read_id string, hit_idx int, hash long, contig string, cpos int, cstrand string, rpos int, rstrand string, read_len int, length int"


def hits(spark, reads):
    """reads: id -> contigs in the order of hits."""
    rows = [(r, i, i, c, 10 * i, "+", 10 * i, "+", 100000, 100000) for r, cs in reads.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, SCHEMA)


def runs_of(cs):
    out = []
    for c in cs:
        if not out or out[-1] != c:
            out.append(c)
    return out


def specific(cs):
    """Contigs that are left: a run between the first and last run of a contig marks its own contig."""
    runs = runs_of(cs)
    ends = {c: (runs.index(c), len(runs) - 1 - runs[::-1].index(c)) for c in runs}
    return {c for c in runs} - {runs[j] for j in range(len(runs)) if any(a < j < b for a, b in ends.values())}


def sensitive(cs):
    runs = runs_of(cs)
    ends = {c: (runs.index(c), len(runs) - 1 - runs[::-1].index(c)) for c in runs}
    return {c for j, c in enumerate(runs) if not any(a < j < b for d, (a, b) in ends.items() if d != c)}


@pytest.mark.parametrize("mode", ["specific", "sensitive"])
def test_subsumed_runs(spark, mode):
    rng = random.Random(5)
    reads = {"aba": "ABA", "abab": "ABAB", "abaca": "ABACA", "one": "A"} | {f"r{i}": [rng.choice("ABCDE") for _ in range(rng.randrange(1, 9))] for i in range(60)}
    got = mapping.mappings(mapping.accepted(hits(spark, reads), 5, sensitive=mode == "sensitive")).collect()
    for r, cs in reads.items():
        assert {x.contig for x in got if x.read_id == r} == (specific if mode == "specific" else sensitive)(cs), (r, cs)
    assert [x.contig for x in sorted((x for x in got if x.read_id == "aba"), key=lambda x: x.map_idx)] == ["A"]


def test_empty_tables(spark):
    none = hits(spark, {})
    mapped = mapping.mappings(mapping.accepted(none, 5))
    assert mapped.count() == 0 and pairs.tally(pairs.gap_estimates(pairs.read_pairs(mapped), 5)).count() == 0


def test_repeat_filter_drops_all_copies(spark):
    df = spark.createDataFrame([("r", i, h, "A", i, "+", i, "+", 100, 100) for i, h in enumerate([1, 2, 1, 3])], SCHEMA)
    assert sorted(r.hash for r in mapping.repeat_filter(df).collect()) == [2, 3]


def test_pairs_over_f_and_even_medians(spark):
    one = "struct<cpos:int,cstrand:string,rpos:int,rstrand:string>"
    schema = f"read_id string, map_idx int, contig string, hit_count int, hits array<{one}>, read_len int, length int"
    rows = [("r", i, c, n, [(500, "+", 1000 * i, "+")] * n, 20000, 1000) for i, (c, n) in enumerate([("A", 2), ("B", 1), ("C", 2), ("D", 1)])]
    mapped = spark.createDataFrame(rows, schema)
    made = lambda f: {(r.a.contig, r.b.contig) for r in pairs.read_pairs(mapped, f).collect()}
    assert len(made(4)) == 6 and made(3) == {("A", "B"), ("B", "C"), ("C", "D"), ("A", "C")}
    est = spark.createDataFrame([("x", "A", "+", "B", "+", g, True, 900) for g in (-80, -79)], "read_id string, source string, source_ori string, target string, target_ori string, gap int, anchored boolean, read_len int")
    assert pairs.tally(est).first().d == -79  # -79.5 is cut towards 0


def test_sensitive_subsumption_is_a_search_over_all_spans(spark):
    import random

    rng = random.Random(5)
    rows = []
    for read in range(60):
        order = [rng.choice("ABCDEFG") for _ in range(rng.randint(1, 14))]
        order = [c for i, c in enumerate(order) if i == 0 or order[i - 1] != c]
        rows += [(read, i, c, 1, order.index(c), len(order) - 1 - order[::-1].index(c)) for i, c in enumerate(order)]
    df = spark.createDataFrame(rows, "read_id long, run_idx int, contig string, hit_count int, first int, last int")
    want = {(r, i) for r, i, c, *_ in rows if any(r2 == r and c2 != c and first < i < last for r2, _, c2, _, first, last in rows)}
    assert {tuple(r) for r in mapping.subsumed_sensitive(df).collect()} == want and len(want) > 50


def test_streamed_tally_keeps_counts_and_goes_on(spark, tmp_path):
    """Medians of odd and even numbers of gaps, negative ones too; a second run over more files adds to the first."""
    from longweft.streaming import pair_tally

    pair = dict(source="a", source_ori="+", target="b", target_ori="-")
    gaps = {"b": [5, -3, -3, 8], "c": [-160, 1], "d": [7], "e": [1, 2, 3, 100, 100]}
    rows = [(pair["source"], "+", t, "-", g, g > 2) for t, gs in gaps.items() for g in gs]
    df = spark.createDataFrame(rows, "source string, source_ori string, target string, target_ori string, gap int, anchored boolean")
    got = {r.target: (r.n, r.d, r.anchor) for r in pair_tally.tally(pair_tally.counts(df)).collect()}
    assert got == {"b": (4, 1, 2), "c": (2, -79, 0), "d": (1, 7, 1), "e": (5, 3, 3)}
    assert {r.target: (r.n, r.d, r.anchor) for r in pairs.tally(df).collect()} == got
    changes = pair_tally.counts(df).selectExpr("*", "1 AS batch").union(pair_tally.counts(df.filter("target = 'd'")).selectExpr("source", "source_ori", "target", "target_ori", "gap", "n + 4", "anchor", "2"))
    assert {r.target: r.n for r in pair_tally.tally(pair_tally.last_counts(changes)).collect()} == {"b": 4, "c": 2, "d": 5, "e": 5}


def test_hits_are_dealt_by_hash_and_by_read_and_no_more(spark, monkeypatch):
    """What follows hits needs no further shuffle and no table on disk (before: four more shuffles, contigs, reads and hits staged)."""
    from longweft.plans import fixture
    from longweft.plans.queries import QUERIES

    monkeypatch.setattr(fixture, "stage", lambda df: pytest.fail("a table is staged"))
    for name in ("kmer_enumerate", "read_hits", "repeat_filter", "noisy_contigs", "contig_runs", "subsumed_specific", "subsumed_sensitive"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 3, (name, plan)


def test_index_of_a_sketch_made_twice_at_most(spark):
    from longweft.operators import sketch

    rng = random.Random(8)
    seqs = [("".join(rng.choice("ACGT") for _ in range(200)) + "A" * rng.randrange(60)) for _ in range(40)]
    df = spark.createDataFrame([(f"c{i}", s, len(s)) for i, s in enumerate(seqs + seqs[:5])], "contig string, seq string, length int")
    every = sketch.sketch(df, 9, 5, "contig", keep=["length"])
    two = sketch.sketch(df, 9, 5, "contig", keep=["length"], whole=True, twice=True)
    rows = [tuple(r) for r in every.collect()]
    count = {}
    for r in rows:
        count[r[2]] = count.get(r[2], 0) + 1
    want = {(h, c, p, s, n) for c, p, h, s, n in rows if count[h] == 1}
    assert {tuple(r) for r in mapping.unique_minimizers(two, ["length"]).collect()} == want and len(want) > 100
    assert max(count.values()) > 20 and two.groupBy("hash").count().agg({"count": "max"}).first()[0] <= 2 * 4
    assert all(n == len((seqs + seqs[:5])[int(c[1:])]) for _, c, _, _, n in want)
