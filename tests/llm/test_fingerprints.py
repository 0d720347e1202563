"""Fingerprints against a version that goes triplet by triplet, and the chain of documents on odd tables."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from longweft.llm import fingerprints as fp
from longweft.llm.queries import op13_fingerprints

SF = "/root/testdata/sf0.01"


def plain(text):
    """The digest as the docstring has it, in plain Python."""
    data, counts = text.encode(), [0] * 256
    for i in range(len(data)):
        for k, (a, b) in enumerate(fp.DISTANCES):
            if i + b < len(data):
                x = data[i] + (data[i + a] << 8) + (data[i + b] << 16) + (k << 24)
                counts[x * fp.FACTOR % (1 << 32) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[64 * j - 1] for j in (1, 2, 3))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    digits = "".join("0123456789abcdef"[4 * codes[i] + codes[i + 1]] for i in range(0, 256, 2))
    return f"{fp.length_code(len(data)):02x}{min(15, 16 * q1 // q3) if q3 else 0:x}{min(15, 16 * q2 // q3) if q3 else 0:x}{digits}"


def test_digest_is_the_plain_one_at_every_length():
    text = "Ünder the brîdge, 木の下 — a fox; " * 40
    for n in (0, 1, 2, 3, 4, 5, 6, 50, 1000):
        assert fp.fingerprint(text[:n]) == plain(text[:n]) and len(plain(text[:n])) == 132
    assert fp.fingerprint(None) == fp.fingerprint("")


def test_very_long_texts_are_counted_whole():
    text = "".join(chr(97 + (i * i // 7) % 26) for i in range(3 * fp.BLOCK + 11))
    whole = np.zeros(256, dtype=np.int64)
    x = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.int64)
    for k, (a, b) in enumerate(fp.DISTANCES):
        n = len(x) - b
        whole += np.bincount(((x[:n] + (x[a : n + a] << 8) + (x[b:] << 16) + (k << 24)) * fp.FACTOR % (1 << 32)) >> 24, minlength=256)
    assert (fp.bucket_counts(text.encode()) == whole).all()


def test_length_codes_rise_by_quarters_of_an_octave():
    found = [fp.length_code(n) for n in range(1 << 12)]
    assert found == sorted(found) and found[0] == 0 and found[1] == 1 and fp.length_code(1 << 20) - fp.length_code(1 << 19) == 4


def test_likeness_is_bounded_symmetric_and_one_for_equal():
    marks = [fp.fingerprint(t) for t in ("", "a", "abcdefgh" * 50, "the quick brown fox " * 30, "ß" * 10_000)]
    for a in marks:
        for b in marks:
            assert 0 <= fp.likeness(a, b) == fp.likeness(b, a) <= 1 and (fp.likeness(a, b) == 1) == (a == b)


def expected(rows):
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = fp.edit_end(text, following)
        a, b, c = plain(text), plain(edited), plain(following)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=repr)


def test_chain_of_documents_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(3, "last comes first " * 9), (7, None), (5, ""), (9, "ab"), (4, "same text, same id"), (4, "same text, same id"), (2, "x" * 5000), (None, "no id at all"), (8, "木の下で待つ人" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("fingerprint", F.lit("own")).withColumn("part", F.lit(1)).withColumn("kind", F.lit("first"))
    got = sorted(map(tuple, fp.compared_with_next(df).collect()), key=repr)
    assert got == expected(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))))
    assert [r["fingerprint"] for r in fp.fingerprints(df, ("doc_id", "fingerprint")).filter("doc_id = 9").collect()] == [plain("ab")]


def test_results_are_handed_on_a_few_rows_at_a_time(spark, monkeypatch):
    rows, sizes, to_arrow = [(i, f"text {i} " * (i % 7)) for i in range(40, 0, -1)], spark.sparkContext.accumulator(0), fp._to_arrow

    def counted(out, schema):
        sizes.add(len(out) > 3)
        return to_arrow(out, schema)

    monkeypatch.setattr(fp, "ROWS", 3)
    monkeypatch.setattr(fp, "_to_arrow", counted)
    got = sorted(map(tuple, fp.compared_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == expected(rows) and sizes.value == 0


def test_one_document_follows_itself_and_an_empty_table_gives_nothing(spark):
    df = spark.createDataFrame([(1, "only one here")], "doc_id long, text string")
    assert list(map(tuple, fp.compared_with_next(df).collect())) == expected([(1, "only one here")])
    assert fp.compared_with_next(df.limit(0)).collect() == []


def test_edited_texts_are_nearer_than_other_ones(spark):
    got = op13_fingerprints(spark, SF).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.99 and got.doc_id.nunique() == len(got) == 1000
    twins = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().merge(got, on="doc_id").groupby("text").fingerprint.nunique()
    assert (twins == 1).all()
