"""Spelling variants: words one edit apart, found through a positional q-gram inverted index.

1. Words are counted over all whole texts; tasks count first, so a frequent word makes a row a task.
2. Words that can be one edit apart meet in a group. Of two such words, the shorter of m letters, either the first m // 2 letters are
   equal or the last m - m // 2 are; so a word goes to four groups, by its half and the length m. In a group only the other parts,
   the rests, differ. A group of more than GROUP words is dealt again by the halves of its rests, and so on, so that no task holds
   a large one and no pair is lost.
3. In a group each word's rest is looked up in an inverted index from (bigram, place) to the words before it. Postings of its bigrams,
   at their places and one beside, are merged by a heap; words that come at least as often as rests one edit apart must share
   bigrams (the longer rest's length less one, ends counted in) are verified letter by letter.
4. A group tells for each word how many near ones it has there and the best of them, so pairs never leave a group. A pair whose
   both halves are equal counts in the group of its first half alone.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER_AZ, give_back, slices, spool, unspool

RUN = "[A-Za-zÀ-ÿ]+"
RUN_RE = re.compile(RUN)
#: Words in a group from which on it is dealt again, and counts that a task holds.
GROUP, HELD = 2_000, 200_000
#: One run in so many of a document is damaged.
DAMAGED = 199


def damaged(run: str, start: int) -> str:
    """A lower-cased run, without one letter where the crc32 of `<doc_id>:<run>` says so. start: crc32 of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), start)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = True, letters: int = 6, least: int = 5) -> DataFrame:
    """Words of at least so many letters with their number n of occurrences over all texts, `least` or more. Null texts have none; a
    null id is the text 'null' in the damage; repeated rows count each."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string")).toDF("id", "text").filter("text IS NOT NULL")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n: Counter = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{doc_id.as_py()}:".encode())
                for part in slices(text.as_py()):
                    for run, c in Counter(RUN_RE.findall(part.translate(LOWER_AZ))).items():
                        if len(run) >= letters and len(word := damaged(run, start) if damage else run) >= letters:
                            n[word] += c
                    if len(n) > HELD:
                        yield told()
                        n.clear()
        yield told()
        n.clear()
        give_back()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row once for either half of its rest that may be equal to another word's. Rows: word, n, m, key, path, at, rest (where the
    rest begins, and its length in a word of m letters). path: which half was taken at each step, p(refix) or s(uffix)."""
    half = F.expr("rest DIV 2").cast("int")
    text = F.expr("substring(word, at + 1, rest + length(word) - m)")
    first, last = F.substring(text, F.lit(1), half), F.expr("right(substring(word, at + 1, rest + length(word) - m), cast(rest - rest DIV 2 AS int))")
    step = lambda side, part, at, rest: F.struct(F.xxhash64("m", "key", F.lit(side), part).alias("key"), F.concat("path", F.lit(side)).alias("path"), at.cast("int").alias("at"), rest.cast("int").alias("rest"))
    both = F.array(step("p", first, F.col("at") + half, F.col("rest") - half), step("s", last, F.col("at"), half))
    return rows.select("word", "n", "m", F.inline(both))


def _groups(vocabulary: DataFrame) -> DataFrame:
    """Rows (word, n, m, key, path, at, rest) of all groups, none larger than GROUP whose rests can be halved further."""
    length = F.char_length("word")
    start = vocabulary.withColumn("m", F.explode(F.array(length, length - 1))).filter("m > 1")
    rows, done = _halved(start.select("word", "n", "m", F.lit(0).cast("long").alias("key"), F.lit("").alias("path"), F.lit(0).alias("at"), F.col("m").alias("rest"))), None
    while True:
        rows = spool(rows, "spelling-groups")
        large = spool(rows.filter("rest >= 4").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > GROUP).select("key"), "spelling-large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = _halved(rows.join(large, "key", "left_semi"))


def one_edit(x: str, y: str) -> bool:
    """Whether one letter put in, taken out or replaced makes x to y."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def first_parts(word: str, m: int, path: str) -> tuple[str, ...]:
    """The first half at each step of the path that took the last one: where it's equal too, the pair counts elsewhere."""
    at, rest, out = 0, m, []
    for side in path:
        half = rest // 2
        if side == "p":
            at, rest = at + half, rest - half
        else:
            out.append(word[at : at + half])
            rest = half
    return tuple(out)


def near_in_group(group: list[tuple[str, int]], m: int, path: str, at: int, rest: int) -> Iterator[tuple[str, str]]:
    """Pairs of near words of a group, each once; one of the two at least has m letters, the other m or m + 1."""
    index: dict[tuple[str, int], list[int]] = defaultdict(list)
    heads: list[tuple[str, ...]] = []
    group.sort(key=lambda r: (len(r[0]), r[0]))
    for number, (x, _) in enumerate(group):
        length = rest + len(x) - m
        padded = f"\x00{x[at : at + length]}\x01"
        grams = [padded[p : p + 2] for p in range(length + 1)]
        heads.append(first_parts(x, m, path))
        postings = [found for p, gram in enumerate(grams) for q in (p - 1, p, p + 1) if (found := index.get((gram, q)))]
        before, n = -1, 0
        for y in (*heapq.merge(*postings), -1):
            if y == before:
                n += 1
                continue
            if n >= length - 1 and not any(a == b for a, b in zip(heads[number], heads[before])) and one_edit(x, group[before][0]):
                yield x, group[before][0]
            before, n = y, 1 if y >= 0 else 0
        if len(x) == m:
            for p, gram in enumerate(grams):
                index[gram, p].append(number)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """For each word that has near ones: word, n_near, best_n, best (the near word of largest n, of equal ones the least)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(group, m, path, at, rest):
            count, best, n = Counter(), {}, dict(group)
            for x, y in near_in_group(group, m, path, at, rest):
                for a, b in ((x, y), (y, x)):
                    count[a] += 1
                    best[a] = min(best.get(a, (0, "")), (-n[b], b))
            return [(w, c, -best[w][0], best[w][1]) for w, c in count.items()]

        def batch_of(rows):
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["word", "n_near", "best_n", "best"])

        now, group, out = None, [], []
        for batch in batches:
            for word, n, *key in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if len(group) > 1:
                        out += told(group, *now[1:])
                    now, group = key, []
                group.append((word, n))
            if out:
                yield batch_of(out)
                out = []
        if len(group) > 1 and (out := told(group, *now[1:])):
            yield batch_of(out)
        give_back()

    dealt = _groups(vocabulary).repartition("key").sortWithinPartitions("key", "m", "path").select("word", "n", "key", "m", "path", "at", "rest")
    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", (-F.col("top.less")).alias("best_n"), "top.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the last form of each. A form has five times the occurrences, so chains are short and never
    close; they are followed by doubling."""
    now = spool(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        new = spool(now.join(up, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "spelling-roots")
        unspool(now)
        now = new
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = True, letters: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """A row for each word of the texts: word, n, n_near, form (the near word of largest n, if that is `times` as frequent at least,
    else null), form_n, root (the last of the forms that follow one another; the word itself without a form).

    Words are maximal runs of RUN, A-Z lower-cased and no other letter. Null and empty texts have none, an empty table gives no rows;
    equal rows count each, and of equally frequent near words the first in code-point order is the form.
    """
    vocabulary = spool(words(df, id_col, text_col, damage, letters, least), "vocabulary")
    found = vocabulary.join(near_words(vocabulary), "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    found = spool(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 of a text's bytes in SQL: `crc.of` is the table of its 256 remainders, made by its rule.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS of"


def crc_sql(text: str, table: str = "crc.of") -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, b: xor({table}[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
runs AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, c, {crc_sql("id || ':' || run")} AS h FROM runs, crc),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS MATERIALIZED (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT word, rest FROM less SEMI JOIN v ON less.rest = v.word UNION SELECT rest, word FROM less SEMI JOIN v ON less.rest = v.word),
best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(less := -o.n, other := other)) AS b FROM near JOIN v o ON o.word = near.other GROUP BY near.word),
forms AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * n THEN b.other END AS form, CASE WHEN -b.less >= 5 * n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
up(word, root) AS (SELECT word, word FROM v UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, f.n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms f JOIN (SELECT word, arg_max(root, n) AS root FROM up JOIN (SELECT word AS root, n FROM v) USING (root) GROUP BY word) USING (word)
"""
