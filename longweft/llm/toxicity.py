"""Toxicity by non-negative positive-unlabelled learning: a logistic model in numpy over words and character n-grams.

Confirmed toxic texts are the positives; texts of the corpus, whatever they are, are unlabelled. With the class prior p, the
risk of calling unlabelled text negative, corrected for the positives in it, is R_u(-) - p R_p(-). A flexible model drives that
below 0, which no true risk is; so where it falls below 0, a step is taken that raises it again, and else one that lowers
p R_p(+) + R_u(-) - p R_p(-).

All that reaches the driver is bounded by parameters: POSITIVES and UNLABELLED texts of a sample, CANDIDATES features counted
over them, FEATURES kept. The sample is sorted by content and FITS models, each with its own order of batches, are averaged, so the
model is a function of the tables' rows alone and not of their layout or of the number of cores. Every text is scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Cache, slices, spool, unspool

LETTERS = re.compile(r"[^\W\d_]+")
#: Bounds of the sample of confirmed toxic texts and of unlabelled ones.
POSITIVES, UNLABELLED = 3_000, 9_000
#: Bounds of the features whose counts are compared, and of those that the model has.
CANDIDATES, FEATURES = 20_000, 2_048
#: Least estimated share of toxic texts among those with a feature, and least z value of its log ratio, to be kept.
PRECISION, SIGNIFICANT = 0.3, 2.0
SEED = 11
#: Models whose weights are averaged.
FITS = 5


def features(chunk: str) -> set[int]:
    """64-bit hashes of the words of a run without white space, and of their 4- and 5-grams with signs for their ends."""
    out = set()
    for w in LETTERS.findall(chunk.lower()):
        w = f"<{w}>"
        out.add(xxhash.xxh3_64_intdigest(w) >> 1)
        out.update(xxhash.xxh3_64_intdigest(w[i : i + n]) >> 1 for n in (4, 5) for i in range(len(w) - n + 1))
    return out


def words_of(text: str | None) -> set[str]:
    """Distinct runs without white space."""
    return {w for part in slices(text or "") for w in part.split()}


class Present:
    """Which of the known features a text has, by a bounded memory of runs."""

    def __init__(self, known: np.ndarray, limit: int = 300_000):
        self.number = {int(h): i for i, h in enumerate(known)}
        self.of = Cache(lambda chunk: tuple(self.number[h] for h in features(chunk) if h in self.number), limit)

    def __call__(self, text: str | None) -> np.ndarray:
        of = self.of
        return np.array(sorted({i for w in words_of(text) for i in of[w]}), dtype=np.int32)


@dataclass
class Model:
    known: np.ndarray  # hashes of the features
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[ids].sum(), -30, 30))))


def _spread(df: DataFrame) -> DataFrame:
    """A bounded sample over all cores, as what limit() gives lies in one part."""
    return df.select("text").repartition(max(4, df.sparkSession.sparkContext.defaultParallelism))


def _ids(df: DataFrame, known: np.ndarray) -> list[np.ndarray]:
    """The known features of each text of a bounded sample, in an order that no partitioning changes."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa

        present = Present(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([present(v.as_py()).tobytes() for v in batch.column(0)], type=pa.binary())], names=["ids"])

    return [np.frombuffer(ids, dtype=np.int32) for ids in sorted(bytes(r["ids"]) for r in _spread(df).mapInArrow(run, "ids binary").collect())]


def _counts(df: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """How many texts of a bounded sample have each of the known features, and how many texts there are."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa

        present, n = Present(shared.value), np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            for v in batch.column(0):
                n[present(v.as_py())] += 1
                n[-1] += 1
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(n[i])], names=["i", "n"])

    out = np.zeros(len(known) + 1)
    for r in _spread(df).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # CANDIDATES rows
        out[r["i"]] = r["n"]
    return out[:-1], int(out[-1])


def _candidates(df: DataFrame) -> np.ndarray:
    """Hashes of the CANDIDATES features that most positive texts of the sample have, three at least."""

    def run(batches):
        import pyarrow as pa
        from collections import Counter

        of, n = Cache(features, 100_000), Counter()
        for batch in batches:
            for v in batch.column(0):
                n.update({h for w in words_of(v.as_py()) for h in of[w]})
                if len(n) > 500_000:
                    yield pa.RecordBatch.from_pydict({"h": pa.array(n.keys(), pa.int64()), "n": pa.array(n.values(), pa.int64())})
                    n.clear()
        yield pa.RecordBatch.from_pydict({"h": pa.array(n.keys(), pa.int64()), "n": pa.array(n.values(), pa.int64())})

    counts = _spread(df).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 3")
    return np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(CANDIDATES).collect()], dtype=np.int64)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits a model to texts df whose ids have label 1 in `labels`, and to unlabelled ones. The class prior is the share of
    label 1 among labelled rows. Of ids with several labels the largest counts; null labels and ids take no part. Without a
    positive, or without text, the model has no feature and scores all texts 0.0 or so."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    counted = known.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    total, toxic = rows.select(F.count(F.lit(1))).first()[0], int(counted["p"] or 0)
    if not toxic or not total:
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0, 0.0)
    share = lambda most, n: F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))
    chosen = F.broadcast(known.filter("y = 1").filter(share(POSITIVES, toxic)).select("id").limit(2 * POSITIVES))  # at most as many ids
    positive = spool(rows.join(chosen, "id", "left_semi").select("text").limit(2 * POSITIVES), "toxic")
    unlabelled = spool(rows.filter(share(UNLABELLED, total)).select("text").limit(2 * UNLABELLED), "unlabelled")
    prior = min(0.5, max(1e-4, toxic / counted["n"]))
    hashes = _candidates(positive)
    (p, n_pos), (u, n_unl) = _counts(positive, hashes), _counts(unlabelled, hashes)
    if not n_pos or not n_unl or not len(hashes):
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0, prior)
    p, u = (p + 0.5) / (n_pos + 1), (u + 0.5) / (n_unl + 1)
    z = (np.log(p) - np.log(u)) / np.sqrt(1 / (p * n_pos) + 1 / (u * n_unl))
    z[prior * p < PRECISION * u] = 0  # by Bayes' rule, so many texts with the feature are toxic
    kept = np.sort(np.array([i for i in np.argsort(-z, kind="stable")[:FEATURES] if z[i] >= SIGNIFICANT], dtype=np.int64))
    weights, bias = fit(_ids(positive, hashes[kept]), _ids(unlabelled, hashes[kept]), len(kept), prior)
    for table in (positive, unlabelled):
        unspool(table)
    return Model(hashes[kept], weights, bias, prior)


def _flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature numbers of all texts, the text of each, and the number of texts."""
    size = np.array([len(d) for d in docs])
    return np.concatenate(docs) if size.sum() else np.zeros(0, np.int64), np.repeat(np.arange(len(docs)), size), len(docs)


def step(w: np.ndarray, pos: tuple, unl: tuple, prior: float) -> np.ndarray:
    """The direction to descend along: the gradient of prior R_p(+) + (R_u(-) - prior R_p(-)) while what is in brackets is 0 or more,
    else the gradient of its negative. w: weights and, last, the bias; pos, unl: batches as _flat() gives them."""
    n = len(w) - 1
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    logits = lambda flat, row, size: np.bincount(row, weights=w[flat], minlength=size) + w[n]

    def grad(batch, g):
        flat, row, size = batch
        return np.append(np.bincount(flat, weights=g[row], minlength=n), g.sum()) / size

    xp, xu = logits(*pos), logits(*unl)
    negative = np.logaddexp(0, xu).mean() - prior * np.logaddexp(0, xp).mean()
    back = grad(unl, sigmoid(xu)) - prior * grad(pos, sigmoid(xp))
    return prior * grad(pos, -sigmoid(-xp)) + back if negative >= 0 else -back


def fit(pos: list[np.ndarray], unl: list[np.ndarray], n: int, prior: float, epochs: int = 60, rate: float = 0.05, batches: int = 8, decay: float = 1e-4, fits: int = FITS) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, by Adam over mini-batches, the mean of so many fits. pos, unl: the feature numbers
    of each text."""
    found = np.zeros(n + 1)
    for number in range(fits):
        rng = np.random.default_rng((SEED, number))
        w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
        w[n] = np.log(prior / (1 - prior))
        t = 0
        for _ in range(epochs):
            for a, b in zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches)):
                if not len(a) or not len(b):
                    continue
                g = step(w, _flat([pos[i] for i in a]), _flat([unl[i] for i in b]), prior)
                g[:n] += decay * w[:n]
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        found += w / fits
    return found[:n], float(found[n])


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep` and a score from 0 to 1 for each whole text, in place. Null and empty texts have the score of a text
    without features. Repeated rows and null ids are kept as they are; a column of `keep` called score is replaced."""
    keep = tuple(c for c in keep if c != "score")
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        model = shared.value
        present = Present(model.known)
        for batch in batches:
            found = [model.score(present(v.as_py())) for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, type=pa.float64())], names=[*keep, "score"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
