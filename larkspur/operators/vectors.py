"""Dense vectors of texts by hashed features, and the nearest of them to stated queries.

Features are words, pairs of words, and runs of three characters of the distinct words with a blank at both ends; each adds its weight times
1 + ln of its count to a place of the vector, with a sign. Place and sign are bits of the feature's MD5, so they are
the same in every process and any language. Vectors have length 1, or are zero for texts without a word. They are a
column to store: embedding reads a text once, searching reads vectors alone."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 256
WORD_WEIGHT, PAIR_WEIGHT, RUN_WEIGHT = 1.0, 0.7, 0.35
WORD = re.compile("[A-Za-z0-9]+")
#: Queries are compared in blocks of so many: a matrix of WIDTH times BLOCK doubles, 2 MB, goes to each task.
BLOCK = 1024
#: A task multiplies so many vectors at a time.
ROWS = 1024


@lru_cache(maxsize=1 << 18)
def place(feature: str) -> tuple[int, float]:
    """Place and sign of a feature: bits 0 to 7 and bit 8 of the first four bytes of its MD5."""
    h = int.from_bytes(md5(feature.encode()).digest()[:4], "big")
    return h & 0xFF, 1.0 - 2.0 * (h >> 8 & 1)


def vector(text: str | None) -> np.ndarray:
    words = [w.lower() for w in WORD.findall(text or "")]
    out = np.zeros(WIDTH)
    pairs = Counter(f"b:{a} {b}" for a, b in zip(words, words[1:], strict=False))
    distinct = Counter(words)
    runs = Counter(f"c:{padded[i : i + 3]}" for padded in (f" {w} " for w in distinct) for i in range(len(padded) - 2))
    for weight, features in ((WORD_WEIGHT, {f"u:{w}": n for w, n in distinct.items()}), (PAIR_WEIGHT, pairs), (RUN_WEIGHT, runs)):
        if features:
            at, sign = zip(*map(place, features), strict=True)
            out += np.bincount(at, np.array(sign) * weight * (1 + np.log(list(features.values()))), WIDTH)
    norm = np.sqrt(out @ out)
    return out / norm if norm > 0 else out


def embedded(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, vec): one vector of WIDTH doubles for each row, whole texts, no shuffle. Null texts are empty; rows with a null id keep theirs."""

    def run(batches):
        for batch in batches:
            flat = [vector(x) for x in batch.column(1).to_pylist()]
            offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat) if flat else np.zeros(0)))], names=[id, "vec"])

    kind = dict(texts.dtypes)[id]
    return texts.select(id, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{id} {kind}, vec array<double>")


def _blocks(queries: DataFrame):
    block = []
    for r in queries.toLocalIterator():
        block.append((r.item_id, r.vec))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _best(shared, depth: int, floor: float):
    """The depth best vectors of a task for each query: a product of matrices for each slice of rows, then a partial sort."""

    def run(batches):
        asked = shared.value
        n = asked.shape[1]
        scores, ids = np.full((depth, n), -np.inf), np.full((depth, n), np.iinfo(np.int64).max)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                own = part.column(0).to_numpy(zero_copy_only=False)
                x = np.array(part.column(1).flatten()).reshape(len(own), WIDTH)
                s = np.round(x @ asked, 6)
                s[s <= floor] = -np.inf
                both, names = np.vstack([scores, s]), np.vstack([ids, np.repeat(own[:, None], n, 1)])
                names[np.isneginf(both)] = np.iinfo(np.int64).max
                order = np.lexsort((names, -both), axis=0)[:depth]
                scores, ids = np.take_along_axis(both, order, 0), np.take_along_axis(names, order, 0)
        rank, query = np.nonzero(np.isfinite(scores))
        if len(rank):
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(ids[rank, query]), pa.array(scores[rank, query])], names=["q", "doc_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, depth: int, floor: float = 0.0) -> DataFrame:
    """(item_id, doc_id, score, rank): for each query (item_id, vec) the depth nearest vectors (doc_id, vec) by cosine above the floor,
    ties to the smaller doc_id. Vectors are of length 1 or zero; rows with a null doc_id or vec are never found, queries with a null vec find none.

    The stated queries go to the tasks block by block; each task hands on its depth best alone."""
    spark, out = vectors.sparkSession, None
    known = vectors.where("doc_id IS NOT NULL AND vec IS NOT NULL").select(F.col("doc_id").cast("bigint"), "vec")
    for block in _blocks(queries.where("vec IS NOT NULL").select("item_id", "vec")):
        shared = spark.sparkContext.broadcast(np.array([v for _, v in block]).T)
        found = known.mapInArrow(_best(shared, depth, floor), "q bigint, doc_id bigint, score double")
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"q bigint, item_id {dict(queries.dtypes)['item_id']}")
        found = found.join(F.broadcast(names), "q").select("item_id", "doc_id", "score")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {dict(queries.dtypes)['item_id']}, doc_id bigint, score double, rank int")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
