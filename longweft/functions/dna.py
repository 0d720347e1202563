"""Sequences as columns: reverse complement, orientation, the DNA that a text stands for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bases and their complements, ambiguity codes included, U read as T (fixed values).
BASES = "ACGTUNMRWSYKVHDBacgtunmrwsykvhdb"
COMPLEMENTS = "TGCAANKYWSRMBDHVtgcaankywsrmbdhv"
LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]


def revcomp(seq: Column) -> Column:
    """The other strand, read in its own direction; letters keep their case and unknown ones stay."""
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def flip(ori: Column) -> Column:
    return F.translate(ori, "+-", "-+")


def oriented(seq: Column, ori: Column) -> Column:
    return F.when(ori == "-", revcomp(seq)).otherwise(seq)


def text_as_dna(text: Column) -> Column:
    """Letters a-z of a text as bases in turn; all else goes."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, AS_BASES)
