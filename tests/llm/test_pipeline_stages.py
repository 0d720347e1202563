"""Each stage of the pipeline on odd rows, against plain loops over all rows."""

import re
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from longweft.llm import langid
from longweft.llm.quality_rules import STOP_WORDS, SYMBOLS

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "extra string, doc_id long, text string, lang string, source string, n_chars long, mark string, kept string"


@pytest.fixture(scope="module")
def rows(spark):
    given = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    clean = next(t for _, t, lang in given if lang == "en" and 1000 < len(t) < 3000)
    other = next(t for _, t, lang in given if lang == "en" and len(t) > 3000 and t[:20] != clean[:20])
    odd = [(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, " \n\t", None), (10**6 + 3, "½ 12 !?", "de"), (10**6 + 4, (other + "\n") * 200, "en")]
    odd += [(10**6 + 5, clean, "en"), (10**6 + 5, clean, "en"), (10**6 + 6, clean + " end", None), (10**6 + 6, other.upper(), "en"), (None, clean, "en"), (None, None, None)]
    return given + odd


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame([("x", i, t, lang, "s", len(t or ""), "m", "k") for i, t, lang in rows], SCHEMA).repartition(3)


def found(df):
    assert tuple(df.columns) == pipeline.COLUMNS
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_language_id_is_the_mean_of_its_subwords(spark, rows, docs):
    model = langid.train(docs)

    def kept(text):
        ids = [i for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for i in langid.subwords("".join(filter(str.isalpha, w))) if any(map(str.isalpha, w))]
        if not ids:
            return False
        x = (model.scores[ids].astype(float).mean(axis=0) + model.bias) / model.temperature
        e = np.exp(x - x.max())
        return e.max() / e.sum() >= model.threshold

    got = found(pipeline.language_id(spark, docs, SF))
    assert got == Counter((i, t) for i, t, _ in rows if kept(t)) and 0 < len(got)


def test_quality_is_the_table_of_rules(spark, rows, docs):
    stop = {*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}

    def kept(text):
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        if len(words) < 20:
            return False
        n = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = len({i + k for i in range(len(words) - 7) if n[tuple(words[i : i + 8])] > 1 for k in range(8)})
        shares = [repeated / len(words) <= 0.3, 2 <= sum(map(len, words)) / len(words) <= 12, sum(map(text.count, SYMBOLS)) / len(words) <= 0.1]
        return all(shares) and sum(w in stop for w in words) / len(words) >= 0.02 and (len(lines) - len(set(lines))) / len(lines) <= 0.5

    assert found(pipeline.quality(spark, docs, SF)) == Counter((i, t) for i, t, _ in rows if kept(t))


def test_near_dedup_keeps_one_of_each_group(spark, rows, docs):
    texts = sorted({(i is None, i or 0, t or "") for i, t, _ in rows})
    sets = []
    for _, _, t in texts:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (no_id, i, _) in zip(group, texts):
        if not no_id:
            least[g] = min(i, least.get(g, i))
    keep = {(None if no_id else i, t) for g, (no_id, i, t) in zip(group, texts) if least.get(g) == i and not no_id or g not in least or not WORD.search(t)}
    got = found(pipeline.near_dedup(spark, docs, SF))
    assert got == Counter((i, t) for i, t, _ in rows if (i, t or "") in keep) and len(got) < len(rows)


def test_packing_has_all_ids_of_every_row(spark, rows, docs):
    library = Tokenizer.from_file(pipeline.BYTE_BPE)
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows if i is not None and i < 10**6)
    placed = pipeline.packed(spark, docs, SF).collect()
    total = Counter()
    for r in placed:
        total[r.doc_id] += r.length
    assert Counter((i, n) for i, n in total.items() if i is not None and i < 10**6) == want
    ends = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_no_rows_give_no_rows(spark, docs):
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
