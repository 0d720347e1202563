"""Language identification: averaged embeddings of hashed subwords under a linear softmax, trained by SGD in numpy.

As averaging and the last layer are linear, a trained model is one score vector for each subword bucket: a word's scores are the
sum over its subwords, a text's logits are the sum over its words divided by the number of its subwords. So a word is worked out
once and then looked up, and whole texts are scored at the speed of splitting them.

Rejection is calibrated on examples held out of training: a temperature fitted by likelihood makes the largest softmax value a
probability, and the threshold is the value below which fewer than `reject_share` of the rightly labelled held-out examples lie.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import give_back, slices

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
LAST = BUCKETS - 1
DIM = 16
#: Bounds of the training sample: examples, dealt evenly to the languages, and the words and characters of each example.
EXAMPLES = 8_000
WORDS, CHARS = 64, 4_096
SEED = 7


def letters(text: str) -> list[str]:
    """Runs of letters, in lower case. Other numeric signs than digits, as halves and circled numbers, are no letters."""
    found = LETTERS.findall(text.lower())
    return found if all(map(str.isalpha, found)) else "".join(c if c.isalpha() else " " for c in text.lower()).split()


def subwords(word: str) -> list[int]:
    """Buckets of the word itself and of the 3- and 4-grams of its UTF-8 bytes, with signs for its ends."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    crc = zlib.crc32
    return [crc(w) & LAST, *[crc(w[i : i + 3]) & LAST for i in range(len(w) - 2)], *[crc(w[i : i + 4]) & LAST for i in range(len(w) - 3)]]


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x langs
    bias: np.ndarray
    temperature: float
    threshold: float
    accuracy: float  # of the examples held out for calibration


class Scorer:
    """Sums of word scores, with a bounded memory of words."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.table = np.zeros((1 << 12, len(model.langs) + 1), dtype=np.float32)
        self.rows: dict[str, int] = {}

    def row(self, chunk: str) -> int:
        found = self.rows.get(chunk)
        if found is None:
            if len(self.table) == len(self.rows):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            found = self.rows[chunk] = len(self.rows)
            ids = [i for w in letters(chunk) for i in subwords(w)]
            self.table[found, :-1] = self.model.scores[ids].sum(axis=0)
            self.table[found, -1] = len(ids)
        return found

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its probability, and whether the text is rejected."""
        total = np.zeros(len(self.model.langs) + 1)
        for part in slices(text or ""):
            words = part.split()
            for i in range(0, len(words), 1 << 16):
                if len(self.rows) > self.limit:
                    self.rows.clear()
                get = self.rows.get
                rows = [r if (r := get(w)) is not None else self.row(w) for w in words[i : i + (1 << 16)]]
                total += self.table[rows].sum(axis=0, dtype=np.float64)
        if not total[-1]:
            return "und", 0.0, True
        if not self.model.langs:
            return "und", 0.0, True
        p = softmax((total[:-1] / total[-1] + self.model.bias) / self.model.temperature)
        best = int(p.argmax())
        return self.model.langs[best], float(p[best]), bool(p[best] < self.model.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def runs(df: DataFrame, per_lang: dict[str, float], lang: Column, words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """Training examples: of each chosen document, a run of at most `words` words and `chars` characters that begins where the hash
    of its text says."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                at = zlib.crc32(text.encode())
                if len(text) > 1 << 20:  # a slice of a very long text, so that it is never held as one list of words
                    text = next(slices(text[at % (len(text) - (1 << 19)) :]))
                split = text.split()
                at %= max(1, len(split) - words + 1)
                out.append(" ".join(split[at : at + words])[:chars])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], names=["lang", "text"])

    share = F.element_at(F.create_map(*(F.lit(x) for kv in per_lang.items() for x in kv)), lang)
    chosen = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 20)) < share * (1 << 20)
    return df.filter(chosen).select(lang.alias("lang"), "text").mapInArrow(cut, "lang string, text string")


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", examples: int = EXAMPLES, reject_share: float = 0.001, epochs: int = 4) -> Model:
    """Fits a model on a bounded sample of the labelled rows of df: one scan of the labels alone counts them, a second takes
    about `examples` / languages documents of each language. Rows with a null language, and texts without a letter, take no part."""
    lang = F.col(lang_col).cast("string")
    df = df.filter(lang.isNotNull() & F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0, 0.0)
    langs = sorted(counts)
    per_lang = {k: min(1.0, examples / len(langs) / n) for k, n in counts.items()}
    rows = runs(df, per_lang, F.col("lang")).limit(2 * examples).collect()
    rng = np.random.default_rng(SEED)
    data = [(np.array(ids, dtype=np.int32), langs.index(r["lang"])) for r in sorted(rows, key=lambda r: (r["lang"], r["text"])) if (ids := [i for w in letters(r["text"]) for i in subwords(w)])]
    order = rng.permutation(len(data))
    held, used = order[: len(data) // 5], order[len(data) // 5 :]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    step, steps = 0, max(1, epochs * len(used))
    for _ in range(epochs):
        for i in rng.permutation(used):
            ids, y = data[i]
            rate = np.float32(0.5 * (1 - step / steps))
            step += 1
            hidden = emb[ids].mean(axis=0)
            g = softmax(hidden @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= rate * np.outer(hidden, g)
            bias -= rate * 0.1 * g
            emb[ids] -= rate * back / np.float32(np.sqrt(len(ids)))
    scores = (emb @ out).astype(np.float32)
    tests = held if len(held) else used
    if not len(tests):
        return Model(langs, scores, bias, 1.0, 0.0, 0.0)
    logits = np.array([scores[data[i][0]].mean(axis=0) + bias for i in tests], dtype=np.float64)
    truth = np.array([data[i][1] for i in tests])
    likely = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 20, 49)}
    temperature = float(min(likely, key=likely.get))
    p = softmax(logits / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    threshold = float(right[int(len(right) * reject_share)]) * 0.9 if len(right) else 0.0
    return Model(langs, scores, bias, temperature, min(threshold, 0.5), float((p.argmax(axis=1) == truth).mean()))


def identify(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score (the probability of lang_pred) and rejected for each whole text, in place.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text under a model of no language.
    Repeated rows and null ids are kept as they are; a column of `keep` with the name of a new one is replaced.
    """
    made = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    keep = tuple(c for c in keep if c not in made)
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T._parse_datatype_string(t)) for c, t in made.items())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one number a language

    def run(batches):
        import pyarrow as pa

        score = Scorer(shared.value)
        for batch in batches:
            found = [score(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            new = [pa.array([f[i] for f in found], type=t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*keep, *made])
        score = None
        give_back()

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
