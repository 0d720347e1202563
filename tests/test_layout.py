import random

from longweft.operators import assembly, layout, overlap

EDGES = "src string, dst string, d int, n long"


def both(edges):
    flip = lambda v: v[:-1] + {"+": "-", "-": "+"}[v[-1]]
    return edges + [(flip(b), flip(a), d, n) for a, b, d, n in edges]


def lines(spark, edges):
    paths = layout.named_paths(layout.layout(spark.createDataFrame(both(edges), EDGES)))
    return {r.path_id: r.path for r in layout.path_lines(paths).collect()}


def test_chain_with_transitive_edges(spark):
    edges = [("a+", "b-", 89, 5), ("b-", "c+", -79, 4), ("a+", "c+", 900, 9), ("c+", "d+", 30, 1), ("b-", "d+", 800, 2)]
    assert lines(spark, edges) == {"scaffold_0": "a+ 90N b- 21N c+ 31N d+"}


def test_forks_ties_and_cycles(spark):
    assert lines(spark, [("a+", "b+", 1, 5), ("a+", "c+", 1, 3)]) == {"scaffold_0": "a+ 21N b+"}
    assert lines(spark, [("a+", "b+", 1, 5), ("a+", "c+", 1, 5)]) == {}
    assert lines(spark, [("a+", "b+", 1, 5), ("b+", "c+", 1, 5), ("c+", "a+", 1, 5)]) == {}


def test_paths_are_numbered_longest_first(spark):
    got = lines(spark, [("x+", "y+", 50, 1), ("a+", "b+", 50, 1), ("b+", "c+", 50, 1)])
    assert got == {"scaffold_0": "a+ 51N b+ 51N c+", "scaffold_1": "x+ 51N y+"}


def test_numbers_of_many_paths_go_over_all_parts(spark):
    rows = [(f"p{i:03d}", step, f"c{i:03d}", "+") for i in range(300) for step in range(2 + (i % 7 == 0) + (i == 5))]
    got = layout.named_paths(spark.createDataFrame(rows, "start string, step long, contig string, ori string"), first=3).select("path_id", "contig").distinct().collect()
    size = lambda i: 2 + (i % 7 == 0) + (i == 5)
    order = sorted(range(300), key=lambda i: (size(i), f"c{i:03d}"), reverse=True)
    assert {r.path_id: r.contig for r in got} == {f"scaffold_{k + 3}": f"c{i:03d}" for k, i in enumerate(order)}


def test_omitted_contigs_in_a_row(spark):
    paths = spark.createDataFrame([("p", i, c, "+", g, None) for i, (c, g) in enumerate([("a", 1), ("b", 1), ("c", 1), ("d", None)])], "path_id string, step long, contig string, ori string, gap int, d int")
    trims = spark.createDataFrame([(c, "+", None, None, 0, 10, c in "bc") for c in "abcd"], "contig string, ori string, source_cut int, target_cut int, start int, stop int, omitted boolean")
    cuts = spark.createDataFrame([], "path_id string, step long, spos int, tpos int, hash long")
    got = [(r.step, r.contig, r.gap) for r in sorted(overlap.trimmed_paths(paths, cuts, trims).collect(), key=lambda r: r.step)]
    assert got == [(0, "a", 21), (1, "d", None)]


def test_merge_and_stats(spark):
    paths = spark.createDataFrame([("p", 0, "a", "+", 1), ("p", 1, "b", "-", 4), ("p", 2, "c", "+", None)], "path_id string, step long, contig string, ori string, gap int")
    seqs = spark.createDataFrame([("a", "AACC"), ("b", "GATT"), ("c", "TTTT"), ("u", "ACGTN")], "contig string, seq string")
    made = {r.id: r.seq for r in assembly.merge(paths, seqs).collect()}
    assert made == {"p": "AACCaATCNNNTTTT", "u": "ACGTN"}
    s = assembly.stats(spark.createDataFrame([("A" * n,) for n in (800, 700, 600, 600, 10)] + [("N" * 900,)], "seq string")).first()
    assert (s.n, s.n_500, s.l50, s.min, s.n75, s.n50, s.n25, s.e_size, s.max, s.sum) == (6, 4, 2, 600, 600, 700, 800, 685, 800, 2700)


def test_chunks_are_the_merged_scaffolds_in_pieces(spark, tmp_path):
    from longweft.sources import sequences

    paths = spark.createDataFrame([("p", 0, "a", "+", 1), ("p", 1, "b", "-", 4), ("p", 2, "c", "+", None), ("q", 0, "d", "-", 30), ("q", 1, "e", "+", None)], "path_id string, step long, contig string, ori string, gap int")
    seqs = spark.createDataFrame([("a", "AACC"), ("b", "GATT"), ("c", "TTTT"), ("d", "ACG" * 40), ("e", "G"), ("u", "ACGTN"), ("v", "")], "contig string, seq string")
    whole = {r.id: r.seq for r in assembly.merge(paths, seqs).collect() if r.seq}
    for size in (1, 3, 4, 50, 1000):
        got = {}
        for r in assembly.merge_chunks(paths, seqs, size).orderBy("id", "offset").collect():
            assert r.offset == len(got.get(r.id, "")) and len(r.chunk) <= size
            got[r.id] = got.get(r.id, "") + r.chunk
        assert got == whole
        sequences.write_fasta_chunks(assembly.merge_chunks(paths, seqs, size), f"{tmp_path}/{size}")
        text = "".join(f.read_text() for f in sorted((tmp_path / str(size)).glob("part-*")))
        assert {name: "".join(body) for name, *body in (t.split("\n") for t in text.split(">")[1:])} == whole


def chain_of(spark, n):
    return spark.createDataFrame([("p", i, f"c{i:02d}", "+") for i in range(n)], "path_id string, step long, contig string, ori string")


def test_support_by_edges_over_many_steps(spark):
    graph = spark.createDataFrame([(f"c{i:02d}+", f"c{i + 1:02d}+") for i in range(11)] + [("c01+", "c10+"), ("c02+", "c04+"), ("c05-", "c00-")], "src string, dst string")
    got = {r.step: r.support for r in layout.transitive_support(chain_of(spark, 12), graph).collect()}
    assert got == {i: (1 <= i < 10) + (2 <= i < 4) for i in range(11)}


def test_window_edges_reach_both_sides_of_an_unsupported_step(spark):
    supported = spark.createDataFrame([(f"c{i:02d}+", f"c{i + 1:02d}+") for i in range(13) if i != 6], "src string, dst string")
    graph = supported.union(spark.createDataFrame([("c05+", "c08+")], "src string, dst string"))
    got = {(r.src, r.dst) for r in layout.window_edges(chain_of(spark, 14), supported, graph).collect()}
    want = {(a, b) for a in range(2, 7) for b in range(7, 12)} - {(6, 7), (5, 8)}
    assert got == {(f"c{a:02d}+", f"c{b:02d}+") for a, b in want} | {(f"c{b:02d}-", f"c{a:02d}-") for a, b in want | {(5, 8)}} - {("c08-", "c05-")}


def test_reduction_by_long_routes(spark):
    reduced = lambda e: {(r.src, r.dst) for r in layout.transitive_reduction(spark.createDataFrame([(*x, 1, 1) for x in e], EDGES)).collect()}
    chain = [(f"{a}+", f"{b}+") for a, b in zip("abcdefghi", "bcdefghij")]
    assert reduced([*chain, ("a+", "g+"), ("a+", "j+"), ("x+", "g+"), ("a+", "y+")]) == {*chain, ("x+", "g+"), ("a+", "y+")}
    ring = [*chain, ("j+", "a+")]  # a walk round the ring to an edge's own target is no other route
    assert reduced([*ring, ("x+", "c+"), ("x+", "z+")]) == {*ring, ("x+", "c+"), ("x+", "z+")}
    assert lines(spark, [(a, b, 1, 2) for a, b in chain] + [("a+", "g+", 900, 5)]) == {"scaffold_0": " 21N ".join(f"{c}+" for c in "abcdefghij")}


def brute_reduced(edges):
    """Edges without those whose target is reached by another way that doesn't come back to the source."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def other_way(s, t):
        todo, seen = [x for x in out[s] if x not in (s, t)], {s}
        while todo:
            at = todo.pop()
            if at == t:
                return True
            if at not in seen:
                seen.add(at)
                todo += out.get(at, ())
        return False

    return {(a, b) for a, b in edges if a == b or not other_way(a, b)}


def reduced(spark, edges):
    found = [(r.src, r.dst) for r in layout.transitive_reduction(spark.createDataFrame([(*x, 1, 1) for x in edges], EDGES)).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_reduction_of_odd_graphs(spark):
    """Many small graphs at once, some without cycles and some with, against a search from each edge."""
    rng, edges = random.Random(8), []
    for g in range(60):
        n = rng.randint(3, 9)
        for _ in range(rng.randint(n, 2 * n + 4)):
            a, b = rng.sample(range(n), 2)
            if g % 3:
                a, b = min(a, b), max(a, b)
            edges.append((f"{g}:{a}", f"{g}:{b}"))
    edges += [("loop", "loop"), ("loop", "x")] + [(a, b) for a in "PQR" for b in "PQR" if a != b]  # all ways round, both ways
    edges = sorted(set(edges))
    assert reduced(spark, edges) == brute_reduced(edges)


def test_reduction_of_ladders_and_tangles(spark):
    """Bubbles in a row, with an edge over all of them and one that leads elsewhere; and layers that are joined each with each."""
    edges = []
    for i in range(40):
        edges += [(f"j{i}", f"u{i}"), (f"j{i}", f"v{i}"), (f"u{i}", f"j{i + 1}"), (f"v{i}", f"j{i + 1}")]
    edges += [("j0", "j40"), ("j0", "y"), ("x", "y"), ("x", "j3")]
    edges += [(f"a{i}.{k}", f"a{i + 1}.{m}") for i in range(4) for k in range(3) for m in range(3)] + [("a0.0", "a4.2"), ("a1.1", "a3.0")]
    assert reduced(spark, edges) == brute_reduced(edges)


def test_a_chain_of_thousands_takes_few_rounds(spark, monkeypatch):
    """5,000 contigs in a row with edges over one, two and three of them, and some over very many: rounds and rows stay small."""
    n, rows = 5000, []
    whole = layout.stage
    monkeypatch.setattr(layout, "stage", lambda df: (lambda t: (rows.append(t), t)[1])(whole(df)))
    name = lambda i: f"c{i:05d}+"
    steps = [(name(i), name(i + 1)) for i in range(n - 1)]
    over = [(name(i), name(i + k)) for k in (2, 3, 4) for i in range(n - k)] + [(name(i), name(i + 2500)) for i in range(0, 2000, 100)] + [(name(0), name(n - 1))]
    assert reduced(spark, steps + over) == set(steps)
    assert len(rows) <= 30
