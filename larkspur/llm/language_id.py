"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text, hashed to FEATURES columns, weighted by 1 + log(count) and inverse
document frequency, scaled to unit length. Document frequencies cover every document that may be learned from;
the weights are trained on the driver by follow-the-regularised-leader with elastic-net penalties on a sample of
at most about max_fit_rows of them, and a temperature is fitted on a fifth of the sample held back. The sample is
drawn language by language, so that every language is learned whatever its share of the corpus; the fifth is held
back of each language, and counts there by the documents that a sampled one stands for.

Defined results: null or letterless text gives `und` with score 0; without any document to learn from, every
text gives `und` with score 0. Extra columns are not read."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fold

FEATURES = 1 << 13
#: Documents the regression sees, and characters of them in all (both on average; chosen by a hash of doc_id).
MAX_FIT_ROWS, MAX_FIT_CHARS = 2500, 5_000_000
#: Documents of a language that are seen whatever the bounds (all where it has fewer; on average).
LEAST_ROWS = 20
SLICE = 1 << 19


def _counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams: one row per text."""
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    out = np.zeros(len(texts) * FEATURES, np.int64)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    gram = np.zeros(len(codes), np.uint32)
    for n in (1, 2, 3):
        gram = (gram[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)) if n > 1 else codes + np.uint32(1)
        if not len(gram):
            break
        own = row[: len(gram)]
        inside = own == row[n - 1 :]
        bucket = ((gram * np.uint32(0x9E3779B1)) ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA77) >> shift
        out += np.bincount(own[inside] * FEATURES + bucket[inside], minlength=len(out))
    return out.reshape(len(texts), FEATURES)


def features(texts: list[str]):
    """Yields (first row, counts) for slices of the texts."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and to - at < 64 and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        yield at, _counts([t.lower() for t in texts[at:to]])
        at = to


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(counts.shape, np.float32)
    some = counts > 0
    x[some] = 1 + np.log(counts[some])
    x *= idf
    scale = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(scale, 1e-9)


def _frequencies(batches):
    total = np.zeros(FEATURES, np.int64)
    rows = 0
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        rows += len(texts)
        for _, counts in features(texts):
            total += (counts > 0).sum(axis=0)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*total[some].tolist(), rows], pa.int64())], names=["feature", "n"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, stands_for: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """FTRL-proximal weights (features + 1 for the bias, classes) and the temperature. x: (columns, values) of each document;
    stands_for: by class, the documents that a held-back one counts for."""
    held = np.zeros(len(x), bool)
    for c in range(classes):
        held[np.flatnonzero(y == c)[4::5]] = True
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    order = np.flatnonzero(~held) if (~held).any() else np.arange(len(x))
    rng = np.random.default_rng(11)

    def weights(rows):
        w = -(z[rows] - np.sign(z[rows]) * l1) / ((beta + np.sqrt(n[rows])) / alpha + l2)
        return np.where(np.abs(z[rows]) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(order):
            rows, v = np.append(x[i][0], FEATURES), np.append(x[i][1], 1.0)
            w = weights(rows)
            error = _softmax(v @ w)
            error[y[i]] -= 1
            g = v[:, None] * error
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = weights(np.arange(FEATURES + 1))
    test = held if held.any() else ~held
    logits = np.array([v @ w[rows] + w[-1] for (rows, v), use in zip(x, test, strict=True) if use])
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    counts_for = np.ones(len(logits)) if stands_for is None else stands_for[y[test]]
    loss = [np.average(-np.log(np.maximum(_softmax(logits / t)[np.arange(len(logits)), y[test]], 1e-12)), weights=counts_for) for t in grid]
    return w.astype(np.float32), float(grid[int(np.argmin(loss))])


def _quotas(have: np.ndarray, bound: float) -> np.ndarray:
    """The bound dealt out, half by size and half evenly; what one language cannot use goes to the others."""
    out, left = np.zeros(len(have)), np.ones(len(have), bool)
    wish = have / have.sum() + 1 / len(have)
    while left.any():
        out[left] = (bound - have[~left].sum()) * wish[left] / wish[left].sum()
        full = left & (out >= have)
        out[full] = have[full]
        if not full.any():
            break
        left &= ~full
    return out


def fit(docs: DataFrame, eligible: F.Column, max_fit_rows: int = MAX_FIT_ROWS, max_fit_chars: int = MAX_FIT_CHARS) -> dict | None:
    """A model from the rows of docs (doc_id, text, lang) where eligible holds and lang is not null."""
    rows = docs.where(eligible & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    frequency = {r.feature: r.n for r in rows.select("text").mapInArrow(_frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total = frequency.pop(-1, 0)
    if not total:
        return None
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy("lang").collect()
    langs = [r.lang for r in sizes]
    n, chars = np.array([r.n for r in sizes], float), np.array([r.chars for r in sizes], float)
    share = np.minimum(1.0, np.maximum(np.minimum(_quotas(n, max_fit_rows) / n, _quotas(chars, max_fit_chars) / chars), LEAST_ROWS / n))
    drawn = rows.join(F.broadcast(docs.sparkSession.createDataFrame(list(zip(langs, share.tolist(), strict=True)), "lang string, share double")), "lang")
    sample = drawn.where((F.col("share") >= 1) | ((F.xxhash64(F.lit("fit"), "doc_id") / float(1 << 63) + 1) / 2 < F.col("share"))).select("doc_id", "text", "lang").toPandas()
    missed = sorted(set(langs) - set(sample.lang))
    if missed:
        # Repeats of one doc_id are drawn together or not at all.
        first = rows.where(F.col("lang").isin(missed)).groupBy("lang").agg(F.min(F.struct("doc_id", "text")).alias("r"))
        sample = pd.concat([sample, first.select("r.doc_id", "r.text", "lang").toPandas()])
    sample = sample.sort_values("doc_id")
    idf = np.ones(FEATURES, np.float32) * (np.log(1 + total) + 1)
    at = np.fromiter(frequency.keys(), int, len(frequency))
    idf[at] = np.log((1 + total) / (1 + np.fromiter(frequency.values(), float, len(frequency)))) + 1
    x = []
    for _, counts in features(sample.text.tolist()):
        x += [(np.flatnonzero(row), row[row != 0]) for row in _weighted(counts, idf)]
    number = {lang: i for i, lang in enumerate(langs)}
    y = np.array([number[v] for v in sample.lang])
    w, temperature = train(x, y, len(langs), stands_for=n / np.bincount(y, minlength=len(langs)))
    return {"idf": idf, "weights": w, "temperature": temperature, "langs": langs}


def _predict(shared):
    def predict(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            for at, counts in features([texts[i] for i in rows]):
                p = _softmax((_weighted(counts, model["idf"]) @ model["weights"][:-1] + model["weights"][-1]) / model["temperature"])
                for i, best in enumerate(p.argmax(axis=1).tolist()):
                    langs[rows[at + i]] = model["langs"][best]
                    scores[rows[at + i]] = min(1.0, float(p[i, best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score (the calibrated probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
