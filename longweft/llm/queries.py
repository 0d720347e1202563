"""Queries opN_<name>: each operator with its production parameters over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, fingerprints, minhash_dedup, quality_rules, spelling, substring_dedup

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), WORD_BPE, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), minhash_dedup.Rule(shingle=3, of=85))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0, capacity=2048)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .common import fold

    documents, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(documents.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(documents.withColumn("held_out", held_out), model, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    from .common import fold

    documents, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = langid.train(documents.filter(~held_out))
    return langid.identify(documents.withColumn("held_out", held_out), model, ("doc_id", "held_out"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summaries(conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))))


QUERIES = {"op12_conversations": op12_conversations, "op11_spelling": op11_spelling, "op13_fingerprints": op13_fingerprints, "op7_html_text": op7_html_text, "op9_ann": op9_ann, "op2_minhash_dedup": op2_minhash_dedup, "op5_substring_dedup": op5_substring_dedup, "op3_packing": op3_packing, "op4_toxicity": op4_toxicity, "op10_langid": op10_langid, "op1_bpe": op1_bpe, "op6_token_files": op6_token_files, "op8_quality_rules": op8_quality_rules}
ORACLE_SQL: dict[str, str] = {"op12_conversations": conversations.SQL, "op11_spelling": spelling.SQL, "op13_fingerprints": fingerprints.SQL, "op2_minhash_dedup": minhash_dedup.SQL, "op5_substring_dedup": substring_dedup.SQL, "op8_quality_rules": quality_rules.SQL}
