"""Branches of gap filling that no query takes: stringent re-mapping and soft-masked fills."""

from longweft.functions.shared import stage
from longweft.operators import gapfill
from longweft.plans.fixture import Assembly

SF = "/root/testdata/sf0.001"


def test_stringent_keeps_only_what_was_mapped_again_and_fills_can_be_soft_masked(spark):
    a = Assembly(spark, SF)
    both = stage(gapfill.remapped(a.gap_cuts, a.contigs, a.reads))
    found = both.collect()
    new = {tuple(r) for r in found if not r.old_anchor_used}
    assert len(found) == a.gap_cuts.count() and len(new) > 0
    assert {tuple(r) for r in gapfill.remapped(a.gap_cuts, a.contigs, a.reads, stringent=True).collect()} == new
    placed = stage(a.placed(both.drop("old_anchor_used"))[0])
    plain, soft = ({r.id: r.seq for r in gapfill.filled(placed, a.contigs, a.reads, mask).collect()} for mask in (False, True))
    assert {k: v.upper() for k, v in plain.items()} == {k: v.upper() for k, v in soft.items()}
    lower = lambda seqs: sum(c.islower() for s in seqs.values() for c in s)
    fills = placed.filter("read_id IS NOT NULL AND r1 > r0").selectExpr("sum(r1 - r0)").first()[0]
    assert lower(soft) - lower(plain) == fills > 0


def test_supporting_reads_carry_the_two_hits_that_are_looked_at(spark):
    """The rows that are dealt by gap, read and contig hold two hits a mapping (before: all, here up to hundreds)."""
    a = Assembly(spark, SF)
    most = max(r.n for r in a.mappings.selectExpr("size(hits) AS n").collect())
    rows = a.gap_reads.selectExpr("size(a.hits) AS n", "size(b.hits) AS m").collect()
    assert most > 100 and rows and all(r.n == r.m == 2 for r in rows)


def test_only_what_is_kept_around_a_gap_is_sketched_again(spark, monkeypatch):
    """Its sketch is that of the masked sequences, of a few of their letters (before: all, N included, three times)."""
    from pyspark.sql import functions as F

    from longweft.operators import sketch

    a = Assembly(spark, SF)
    cuts, seen, plain = a.gap_cuts, [], sketch.sketch
    monkeypatch.setattr(gapfill.sketch, "sketch", lambda df, *args, **more: seen.append((df, plain(df, *args, **more))) or seen[-1][1])
    gapfill.remapped(cuts, a.contigs, a.reads)
    (kept, made), = seen
    whole = stage(gapfill.masked(cuts, a.contigs, a.reads).withColumn("key", F.concat_ws("|", "path_id", F.col("step").cast("string"), "role")))
    want = {tuple(r) for r in plain(whole, 20, 10, "key").collect()}
    assert {tuple(r) for r in made.select(F.concat_ws("|", "id", "role"), F.col("pos") + F.col("from"), "hash", "strand").collect()} == want and want
    assert kept.selectExpr("sum(length(seq))").first()[0] < whole.selectExpr("sum(length(seq))").first()[0] / 4
