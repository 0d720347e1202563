import pytest

from longweft.operators import layout
from longweft.plans import engine, files
from longweft.plans.fixture import K, W, Z, Assembly
from longweft.sources import formats, sequences

SF = "/root/testdata/sf0.001"


def fasta(path, rows):
    path.write_text("".join(f">{name}\n{seq}\n" for name, seq in rows))
    return str(path)


def test_from_files_to_files(spark, tmp_path):
    a = Assembly(spark, SF)
    contigs, reads = ([tuple(r) for r in d.collect()] for d in (a.contigs.select("contig", "seq"), a.reads.select("read_id", "seq")))
    target = fasta(tmp_path / "contigs.fa", contigs)
    parts = [fasta(tmp_path / f"reads{i}.fa", reads[i::2]) for i in range(2)]
    p = engine.Params(k=K, w=W, z=Z, max_n=1)
    made = {r.id: r.seq for r in files.run(spark, target, parts, f"{tmp_path}/out", p, rounds=2, paf_too=True).collect()}
    one, two = f"{tmp_path}/out/round1", f"{tmp_path}/out/round2"
    assert made == {r.id: r.seq for r in sequences.read_sequences(spark, f"{two}/scaffolds.fa").collect()}
    first = {r.id: r.seq for r in sequences.read_sequences(spark, f"{one}/scaffolds.fa").collect()}
    assert 0 < len(made) <= len(first) < len(contigs)
    # the AGP says what the sequences are made of
    turned = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    known, placed = dict(contigs), 0
    for r in formats.read_agp(spark, f"{one}/scaffolds.agp").collect():
        piece = known[r.component][int(r["from"]) - 1 : int(r["to"])]
        assert first[r.object][int(r.start) - 1 : int(r.stop)].upper() == (piece if r.ori == "+" else turned(piece))
        placed += 1
    assert placed > len(first)
    vertices, edges = formats.read_dot(spark, f"{one}/graph.dot")
    assert vertices.count() > 0 and edges.count() > 0
    assert spark.read.text(f"{one}/mappings.paf").count() > 0 and spark.read.text(f"{one}/pairs.tsv").count() >= edges.count() / 2
    assert formats.read_trims(spark, f"{one}/trims.tsv").count() > 0
    again = files.run(spark, target, parts, f"{tmp_path}/again", engine.Params(k=K, w=W, z=Z, max_n=1, overlap=False), mappings=f"{one}/mappings.tsv")
    assert formats.read_paths(spark, f"{tmp_path}/again/round1/layout.path").count() == formats.read_paths(spark, f"{one}/layout.path").count()
    # untrimmed: no base of any contig is lost
    assert sum(sum(c in "ACGTacgt" for c in r.seq) for r in again.collect()) >= sum(len(s) for s in known.values())


@pytest.mark.parametrize(("change", "named"), [({"k": 1}, "k"), ({"k": 600}, "k"), ({"w": 0}, "w"), ({"n": 3, "max_n": 2}, "max_n"), ({"max_gap": -2}, "max_gap"), ({"z": "5"}, "z"), ({"transitive": True}, "transitive"), ({"a": True}, "a")])
def test_wrong_parameters_are_named(change, named):
    with pytest.raises(ValueError, match=rf"\b{named}\b"):
        files.check(engine.Params(**change))


def test_what_must_be_set():
    for given in ({"target": ""}, {"reads": []}, {"reads": ["a.fa", ""]}, {"rounds": 0}):
        with pytest.raises(ValueError, match=next(iter(given))):
            files.check(engine.Params(), **given)
    files.check(engine.Params())


def flip(v):
    return v[:-1] + {"+": "-", "-": "+"}[v[-1]]


def supported(chain, edges):
    """Steps of a chain that are supported, by brute force."""
    out = set()
    for i in range(len(chain) - 1):
        found = [(a, b) for a in range(i + 1) for b in range(i + 1, len(chain)) if (a, b) != (i, i + 1) and (chain[a], chain[b]) in edges]
        if any(a < i and b > i + 1 for a, b in found) or (any(a == i for a, _ in found) and any(b == i + 1 for _, b in found)):
            out.add((chain[i], chain[i + 1]))
    return out


def test_transitive_filter_is_the_brute_force_one(spark):
    import random

    rng = random.Random(5)
    chains = [[f"{c}{i:02d}+" for i in range(n)] for c, n in zip("abc", (9, 4, 2))]
    steps = [(x, y) for chain in chains for x, y in zip(chain, chain[1:])]
    graph = {(rng.choice(c), rng.choice(c)) for c in chains[:2] for _ in range(9)} | {("a00+", "b03+"), ("a01+", "zz+")}
    new = {s for i, s in enumerate(steps) if i % 3}
    edges = spark.createDataFrame([(*s, 5, 1, s in new) for s in steps], "src string, dst string, d int, n long, new boolean")
    got = {(r.src, r.dst) for r in layout.transitive_filter(edges, spark.createDataFrame(sorted(graph), "src string, dst string")).collect()}
    held = set().union(*(supported(c, graph) for c in chains))
    assert 0 < len(new & held) < len(new)
    assert got == (set(steps) - new) | (new & held)


def test_stitching_joins_what_the_best_layout_leaves_open(spark):
    # at w = 2 the weak step c-d is lost; at w = 1 the layout has it, and the graph spans it from b to e
    chain = [("a+", "b+", 9), ("b+", "c+", 9), ("c+", "d+", 1), ("d+", "e+", 9), ("x+", "y+", 1), ("b+", "e+", 1)]
    graph = spark.createDataFrame([(a, b, 30, n) for a, b, n in chain] + [(flip(b), flip(a), 30, n) for a, b, n in chain], "src string, dst string, d int, n long")
    found = lambda **k: {(r.src, r.dst) for r in engine.stitched(graph, 2, engine.Params(max_n=2, **k)).collect() if r.src.endswith("+")}
    strong = {("a+", "b+"), ("b+", "c+"), ("d+", "e+")}
    assert found() == strong
    assert found(conservative=False) == strong | {("c+", "d+"), ("x+", "y+")}
    assert found(conservative=False, transitive=True) == strong | {("c+", "d+")}


def test_a_round_reduces_its_graph_once_and_lifts_mappings_as_rows(spark, monkeypatch):
    """One reduction of all thresholds gives the best one and its layout (before: two); lifted mappings are never a row a hit
    (before: every hit was dealt four times)."""
    from longweft.operators import layout, liftover
    from longweft.plans.fixture import Assembly

    a = Assembly(spark, "/root/testdata/sf0.001")
    mapped, calls, plain = a.mappings, [], layout.transitive_reduction
    monkeypatch.setattr(layout, "transitive_reduction", lambda *args: calls.append(1) or plain(*args))
    r = engine.scaffold(a.contigs.select("contig", "seq"), None, engine.Params(k=21, w=10, max_n=2, overlap=False), mapped)
    assert len(calls) == 1 and r.paths.count() > 0
    lifted = liftover.lift_mappings(mapped, r.agp, r.scaffolds.selectExpr("id AS contig", "length(seq) AS length"), 21)
    plan = lifted._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in plan and lifted.count() > 0
