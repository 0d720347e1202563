"""The assembly made of documents has known gaps and order; the engine finds them. Estimates count from the starts of k-mers, so they
are k bases over the true gap, as the established arithmetic has it."""

from longweft.plans import engine
from longweft.plans.fixture import K, W, Z, Assembly

SF = "/root/testdata/sf0.001"


def number(contig):
    return int(contig[1:9]), int(contig[10:])


def test_gaps_of_neighbours_are_the_true_ones(spark):
    rows = Assembly(spark, SF).edges.collect()
    near = [r for r in rows if number(r.source)[0] == number(r.target)[0] and abs(number(r.source)[1] - number(r.target)[1]) == 1]
    assert len(near) > 50 and sum(r.d == 200 + K for r in near) >= 0.95 * len(near)


def test_overlaps_are_the_true_ones(spark):
    rows = Assembly(spark, SF, overlapping=True).edges.collect()
    near = [r for r in rows if number(r.source)[0] == number(r.target)[0] and abs(number(r.source)[1] - number(r.target)[1]) == 1]
    assert len(near) > 50 and sum(r.d == -100 + K for r in near) >= 0.95 * len(near)


def test_engine_rebuilds_the_sequence_between_contigs(spark):
    a = Assembly(spark, SF)
    contigs, reads = a.contigs.select("contig", "seq"), a.reads.select("read_id", "seq")
    p = engine.Params(k=K, w=W, z=Z, max_n=2)
    r = engine.scaffold(contigs, reads, p)
    filled, agp, stats = engine.gap_fill(r, reads, p)
    assert stats.first().filled_gaps >= 0.9 * stats.first().potential_fills > 0
    texts = [x.seq for x in a.dna.collect()]
    other = [t.translate(str.maketrans("ACGT", "TGCA"))[::-1] for t in texts]
    made = [x.seq.upper() for x in filled.collect() if x.id.startswith("scaffold_")]
    whole = [s for s in made if any(s in t for t in texts + other)]
    assert len(made) > 10 and len(whole) >= 0.8 * len(made)
    assert agp.filter("kind = 'P'").count() == stats.first().filled_gaps


def test_rounds_end_with_no_more_sequences_than_before(spark):
    a = Assembly(spark, SF)
    contigs = a.contigs.select("contig", "seq")
    one, two = (engine.run_rounds(contigs, a.reads.select("read_id", "seq"), engine.Params(k=K, w=W, z=Z, max_n=1), rounds=n).count() for n in (1, 2))
    assert 0 < two <= one < contigs.count()
