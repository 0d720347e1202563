"""From documents to packed training sequences: STAGES in order, each on all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; run() writes
each stage's result to the shared folder and reads it again, so no stage is computed twice and a lost executor costs one stage at
most. The result holds a row for each packed piece. ORACLE_SQL is None: a trained model, MinHash and packing are no SQL. The tests hold
each stage but packing against a brute-force version, language ID given its model; packing is held against the library's ids.

Nulls: a document with a null text, or one without words, is rejected by language ID. Near dedup judges rows
of one doc_id by their own texts; rows with one id and one text are one document, and stay or go together. A row with a null id goes
if an earlier document has the same shingles; substring dedup leaves it whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from longweft.llm import langid, minhash_dedup, packing, quality_rules, substring_dedup
from longweft.llm.common import spool
from longweft.llm.queries import BYTE_BPE, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain: those the calibrated model rejects go."""
    return langid.identify(docs, langid.train(docs), (*COLUMNS,)).filter("NOT rejected").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the table of quality rules keeps."""
    return quality_rules.quality_rules(docs, COLUMNS).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id. Rows go by their id and their own text."""
    judged = minhash_dedup.near_duplicates(docs, minhash_dedup.Rule(shingle=5, of=80), mark=True)
    copies = judged.filter("NOT kept").select(F.col("doc_id").alias("copy"), F.col("mark").alias("copy_mark")).distinct()
    gone = F.col("doc_id").eqNullSafe(F.col("copy")) & (F.xxhash64("text") == F.col("copy_mark"))
    return docs.select(*COLUMNS).join(copies, gone, "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those without such passages stay as they are."""
    done = substring_dedup.remove_repeats(docs, size=13, keep=("doc_id", "lang", "source"), as_was=True)
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, packed into as few sequences as the program finds."""
    return packing.pack(docs, BYTE_BPE, end_id=0, capacity=2048)


STAGES = [("language ID", language_id), ("quality rules", quality), ("MinHash near-dedup", near_dedup), ("substring dedup", substrings), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
