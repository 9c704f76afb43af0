"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are the maximal runs of letters (lower-cased, all-capitals marked) and the runs between them (punctuation,
digits, line breaks); a single space is no token. Every token hashes to one of BUCKETS rows. A row's index vector
is sparse, ternary and random; its word vector adds the index vectors of the tokens seen within REACH places of
it in the fit sample, and keeps a share of its own. A document is pooled as the mean and the spread of its
tokens' vectors, with the logarithm of their number and the shares that equal the token before or the one before that. A two-layer
numpy network gives a logit; its temperature is fitted on a fifth of the sample held back.

The fit sees about max_fit_rows labelled rows at most, and max_fit_chars characters in all, chosen by a hash of
doc_id; scoring reads every whole text. Defined results: null and empty texts are pooled as zero vectors and
scored like any other; without labelled rows every score is 0.5. Extra columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textnp as tx
from larkspur.llm.common import fold

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 48, 6, 2
MAX_FIT_ROWS, MAX_FIT_CHARS = 5000, 10_000_000
HIDDEN = 24
THRESHOLD = 0.3

#: Bytes of letters: ASCII letters and every byte of a longer UTF-8 sequence.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SMALL = np.zeros(256, bool)
SMALL[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(3)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIMENSIONS, BUCKETS)] = rng.choice([-1.0, 1.0], BUCKETS)
    return out


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the tokens of several texts, index of each text's first token and one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    letter = LETTER[data]
    new = np.ones(len(data), bool)
    new[1:] = letter[1:] != letter[:-1]
    new[offs[:-1][offs[:-1] < len(data)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    low = np.concatenate([[0], np.cumsum(SMALL[data])])
    shout = letter[start] & (end - start > 1) & (low[end] == low[start])
    hashes = tx.mix(tx.span_hashes(tx.LOWER[data], start, end) + shout.astype(np.uint64))
    keep = ~((end - start == 1) & (data[start] == 0x20))
    return (hashes[keep] >> np.uint64(50)).astype(np.int64), np.searchsorted(start[keep], offs)


def word_vectors(buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Context vectors from the tokens of the fit sample."""
    index = index_vectors()
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros((BUCKETS, DIMENSIONS), np.float64)
    for reach in range(1, REACH + 1):
        for at in range(0, max(0, len(buckets) - reach), 200_000):
            a, b = slice(at, min(at + 200_000, len(buckets) - reach)), slice(at + reach, min(at + 200_000, len(buckets) - reach) + reach)
            same = row[a] == row[b]
            for x, y in ((buckets[a][same], buckets[b][same]), (buckets[b][same], buckets[a][same])):
                order = np.argsort(x, kind="stable")
                if len(order):
                    own, begin = np.unique(x[order], return_index=True)
                    out[own] += np.add.reduceat(index[y[order]], begin, axis=0)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
    return (out + 0.5 * index / np.sqrt(NONZERO)).astype(np.float32)


def pooled(buckets: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Document rows: mean, spread, log count, shares of tokens equal to the one before, and to the one two before."""
    n = len(first) - 1
    counts = np.diff(first)
    out = np.zeros((n, 2 * DIMENSIONS + 3), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        for chunk in np.array_split(some, max(1, len(buckets) // 100_000)):
            if not len(chunk):
                continue
            a, b = first[chunk[0]], first[chunk[-1] + 1]
            v = vectors[buckets[a:b]]
            own = np.repeat(np.arange(len(chunk)), counts[chunk])
            begin = first[chunk] - a
            mean = np.add.reduceat(v, begin, axis=0) / counts[chunk][:, None]
            square = np.add.reduceat(v * v, begin, axis=0) / counts[chunk][:, None]
            out[chunk, :DIMENSIONS] = mean
            out[chunk, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
            for back in (1, 2):
                again = np.zeros(b - a, np.float32)
                if b - a > back:
                    again[back:] = (buckets[a + back : b] == buckets[a : b - back]) & (own[back:] == own[:-back])
                out[chunk, -back] = np.sqrt(np.add.reduceat(again, begin) / counts[chunk])
    out[:, -3] = np.log1p(counts) / 5
    return out


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01) -> dict:
    """A two-layer network by Adam, standardised inputs, then a temperature."""
    rng = np.random.default_rng(5)
    held = np.arange(len(x)) % 5 == 4
    use = np.flatnonzero(~held) if (~held).any() else np.arange(len(x))
    mean, scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // 64)):
            h = np.maximum(z[part] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(d, p[2]) * (h > 0)
            grads = [z[part].T @ back + 1e-3 * p[0] / len(part), back.sum(axis=0), h.T @ d, np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "scale": scale, "layers": [q.astype(np.float32) for q in p], "temperature": 1.0}
    test = held if held.any() else ~held
    out = logits(x[test], model)
    grid = np.exp(np.linspace(np.log(0.3), np.log(20), 80))
    loss = [np.mean(np.logaddexp(0, np.where(y[test] == 1, -out, out) / t)) for t in grid]
    model["temperature"] = float(grid[int(np.argmin(loss))])
    return model


def logits(x: np.ndarray, model: dict) -> np.ndarray:
    a, b, c, d = model["layers"]
    return np.maximum((x - model["mean"]) / model["scale"] @ a + b, 0) @ c + d[0]


def fit(docs: DataFrame, labels: DataFrame, eligible: F.Column, max_fit_rows: int = MAX_FIT_ROWS, max_fit_chars: int = MAX_FIT_CHARS) -> dict | None:
    """A model from docs (doc_id, text) and labels (doc_id, quality in 0 and 1), on the rows where eligible holds."""
    marked = labels.where(eligible & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n = marked.count()
    if not n or not size["n"]:
        return None
    share = min(1.0, max_fit_rows / n, max_fit_chars / max(1.0, n * (size["chars"] or 0) / size["n"]))
    sample = marked.where((F.xxhash64(F.lit("fit"), "doc_id") / float(1 << 63) + 1) / 2 < share)
    # max_fit_rows bounds the sample, so it may be sent to the tasks that read the texts.
    rows = texts.join(F.broadcast(sample), "doc_id").toPandas().sort_values("doc_id")
    if not len(rows):
        return None
    offs, data = tx.text_buffers(pa.array(rows.text.tolist(), pa.string()))
    parts, first = [], np.zeros(len(rows) + 1, np.int64)
    for at, to in tx.row_slices(offs):
        own, begin = tokens(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        parts.append(own.astype(np.int32))
        first[at + 1 : to + 1] = first[at] + begin[1:]
    buckets = np.concatenate(parts)
    vectors = word_vectors(buckets, first)
    return train(pooled(buckets, first, vectors), rows.quality.to_numpy()) | {"vectors": vectors}


def _score(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model is not None:
                offs, data = tx.text_buffers(batch.column(1))
                for at, to in tx.row_slices(offs, 1 << 20):
                    buckets, first = tokens(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
                    z = logits(pooled(buckets, first, model["vectors"]), model) / model["temperature"]
                    scores[at:to] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return score


def score(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, score (calibrated probability of label 1), predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_score(shared), "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> F.Column:
    return F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
