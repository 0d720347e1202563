"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions and without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Common words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from or an not but have has he she they we you i his her "
    "der die und den von zu das sich mit auf des für ist nicht im dem ein eine als auch es "
    "de la le et les des en un du une que est pour qui dans par sur au pas avec ne se ce il elle "
    "el y los las del por con no su para al lo como más o pero"
).split()
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is bound, where a repeated expression is worked out again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def symbol_count(text: Column) -> Column:
    rest = text
    for s in SYMBOLS:
        rest = F.replace(rest, F.lit(s), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(words: Column, n: int = 8) -> Column:
    """Words inside n-word windows that occur twice or more. Windows are compared by 64-bit hashes of n 64-bit word hashes; a
    text without repeats, the usual case, is done after one look for distinct hashes, any other is sorted by hash."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(pairs, lambda s: F.flatten(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))
        at = F.array_sort(F.array_distinct(same))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda acc, i: F.struct((acc["n"] + i + n - F.greatest(i, acc["end"])).alias("n"), (i + n).alias("end")), lambda acc: acc["n"])

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n))))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < n, F.lit(0)).otherwise(some)


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: what is measured (an SQL expression over the measures), and the bounds that a kept text is in."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Measures that rules can speak of: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_stop_words.
BASE = (Rule("length", "n_words", least=20), Rule("repeats", "100 * n_repeat_words - 30 * n_words", most=0))
RULES = (
    Rule("word length", "word_chars / n_words", least=2.0, most=12.0),
    Rule("symbols", "n_symbols / n_words", most=0.1),
    Rule("stop words", "n_stop_words / n_words", least=0.02),
    Rule("equal lines", "n_dup_lines / n_lines", most=0.5),
)


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True where every rule of the table holds; a rule whose measure is null (a ratio of nothing) holds."""
    out = F.lit(True)
    for r in rules:
        m = F.expr(f"try_divide({r.measure.replace('/', ',')})" if "/" in r.measure else r.measure)
        for bound in ([m >= r.least] if r.least is not None else []) + ([m <= r.most] if r.most is not None else []):
            out = out & F.coalesce(bound, F.lit(True))
    return out


def quality_rules(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns `keep`, the measures of each text, base_failed and kept.

    Null and empty texts have measures of 0 and fail the base rule of length. Rows are judged one by one, so repeated rows and
    null ids are kept as they are. A measure replaces a column of `keep` that has its name.
    """
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept")
    keep = tuple(c for c in keep if c not in measures)
    stop = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    text, words = F.coalesce(F.col(text_col), F.lit("")), F.col("__words")
    df = df.select(*keep, text.alias("__text"), F.array_remove(F.split(text, SPACE), "").alias("__words"))
    df = df.select(
        *keep, F.size(words).cast("long").alias("n_words"), F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        symbol_count(F.col("__text")).cast("long").alias("n_symbols"), duplicate_lines(F.col("__text")).cast("long").alias("n_dup_lines"),
        F.size(F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"), F.size(F.filter(words, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
    )
    df = df.withColumn("base_failed", ~verdict(BASE))
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))


_STOP = ", ".join(f"'{w}'" for w in (*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)))
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SYMBOLS = r"length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g'))"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({_SYMBOLS})::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.1 AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AS kept FROM b
"""
