import gzip

from longweft.plans.fixture import K, Assembly
from longweft.operators import overlap, paf
from longweft.sources import formats, sequences

SF = "/root/testdata/sf0.001"


def test_fasta_fastq_and_gzip(spark, tmp_path):
    fasta, fastq = ">a BX:Z:ACG-1\nAC\nGT\n>b other\nTT", "@r BX:Z:T\nACG\nT\n+\n@I\nII\n@s\nAA\n+\nII"
    for name, text in (("x.fa", fasta), ("y.fq", fastq)):
        (tmp_path / name).write_text(text)
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write(text)
    want = {("a", "ACGT", "ACG-1", None), ("b", "TT", None, None), ("r", "ACGT", "T", "@III"), ("s", "AA", None, "II")}
    for end in ("", ".gz"):
        got = sequences.read_sequences(spark, [f"{tmp_path}/x.fa{end}", f"{tmp_path}/y.fq{end}"]).collect()
        assert {tuple(r) for r in got} == want and len(got) == 4


def in_blocks(data, size):
    """Block gzip: members that say their size in an extra field, and an empty one at the end."""
    import zlib

    out = b""
    for at in range(0, len(data) + size, size):
        part = data[at : at + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


def test_ranges_give_each_record_once(spark, tmp_path):
    """Ranges and blocks that end in any place, with qualities that look like headers and separators."""
    import random

    rng = random.Random(1)
    records = []
    for i in range(150):
        n = rng.choice([1, 5, 30, 400])
        records.append((f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), f"B{i}-1" if i % 3 == 0 else None, rng.choice("@+I") + "".join(rng.choice("@+I>") for _ in range(n - 1))))
    fastq = "".join(f"@{i}{f' BX:Z:{b}' if b else ''}\n{s}\n+\n{q}\n" for i, s, b, q in records).rstrip("\n")
    fasta = "".join(f">{i}\n{s[:20]}\n{s[20:]}\n" for i, s, _, _ in records)
    (tmp_path / "x.fq").write_text(fastq)
    (tmp_path / "dos.fq").write_bytes(fastq.replace("\n", "\r\n").encode())
    for name, text in (("x.fq.gz", fastq), ("x.fa.gz", fasta)):
        (tmp_path / name).write_bytes(in_blocks(text.encode(), 333))
    for name, size in (("x.fq", 100), ("x.fq", 1777), ("dos.fq", 997), ("x.fq.gz", 100), ("x.fq.gz", 1500), ("x.fa.gz", 700)):
        df = sequences.read_sequences(spark, f"file://{tmp_path}/{name}", size)
        want = sorted((i, s, None if ".fa" in name else b, None if ".fa" in name else q) for i, s, b, q in records)
        assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0]), (name, size)
        assert df.rdd.getNumPartitions() >= 10
    (tmp_path / "empty.fq").write_text("")
    assert sequences.read_sequences(spark, [f"{tmp_path}/empty.fq", f"{tmp_path}/x.fq"]).count() == 150


def test_round_trips(spark, tmp_path):
    a = Assembly(spark, SF)
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.select(*x.columns).collect()))
    formats.write_mappings(a.mappings, f"{tmp_path}/m")
    assert same(a.mappings.drop("read_len"), formats.read_mappings(spark, f"{tmp_path}/m", a.lengths))
    formats.write_dot(a.lengths.selectExpr("contig v", "length"), a.graph, f"{tmp_path}/g")
    assert same(a.graph, formats.read_dot(spark, f"{tmp_path}/g")[1])
    formats.write_paths(a.paths, f"{tmp_path}/p")
    assert same(a.paths.select("path_id", "step", "contig", "ori", "gap"), formats.read_paths(spark, f"{tmp_path}/p"))
    agp = overlap.agp(a.paths, a.untrimmed)
    formats.write_agp(agp, f"{tmp_path}/agp")
    assert same(agp.filter("kind = 'W'"), formats.read_agp(spark, f"{tmp_path}/agp").withColumn("start", overlap.F.col("start").cast("long")))
    formats.write_sketch(a.target, f"{tmp_path}/s")
    assert formats.read_sketch(spark, f"{tmp_path}/s").count() == a.target.count()
    formats.write_paf(paf.paf_rows(a.mappings, K), f"{tmp_path}/paf")
    assert spark.read.text(f"{tmp_path}/paf").count() > 0
    formats.write_pairs(a.estimates, f"{tmp_path}/pairs")
    assert spark.read.text(f"{tmp_path}/pairs").filter("value LIKE '%n=%anchor=%'").count() == a.tally.count()


def test_unknown_line_in_a_graph_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "g.dot").write_text('digraph G {\n"a+" [l=5]\nwhat\n}\n')
    with pytest.raises(Exception, match="unexpected line"):
        formats.read_dot(spark, f"{tmp_path}/g.dot")[0].collect()
