"""Search by sparse postings against scores computed pair by pair, and the size of what a large block sends to the tasks."""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from larkspur.operators import retrieval


class Value:
    def __init__(self, value):
        self.value = value


def by_pairs(docs, queries, depth):
    """{(channel, q): [(doc, score)]}, each document against each query."""
    own = {d: Counter(retrieval.TERM.findall(x)) for d, x in docs}
    n, mean = len(docs), sum(map(lambda c: sum(c.values()), own.values())) / len(docs)
    df = Counter(t for c in own.values() for t in c)
    out = {}
    for q, (_, asked) in enumerate(queries):
        scores = {"lexical": [], "dense": []}
        for d, c in own.items():
            both = [t for t in asked if t in c]
            if both:
                scores["lexical"].append((-round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in both), 6), d))
                scores["dense"].append((-round(sum(c[t] * asked[t] for t in both) / math.sqrt(sum(x * x for x in c.values()) * sum(x * x for x in asked.values())), 6), d))
        for channel, found in scores.items():
            if found:
                out[channel, q] = [(d, -s) for s, d in sorted(found)[:depth]]
    return out


@pytest.mark.parametrize("kept", [1, 60, 500_000])
def test_best_equal_pairs(monkeypatch, kept):
    monkeypatch.setattr(retrieval, "KEPT", kept)
    rng = random.Random(kept)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([3, 40])]) for _ in range(rng.randrange(n)))
    docs = [(i, text(30)) for i in range(120)]
    docs += [(500 + i, docs[i][1]) for i in range(10)]
    queries = [(i, Counter(text(9).split() + ["unseen"])) for i in range(25)] + [(25, Counter()), (26, Counter(["nowhere"]))]
    known = {t: i for i, t in enumerate(sorted({t for _, c in queries for t in c}))}
    df = Counter(t for _, x in docs for t in set(x.split()))
    idf = np.array([math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t in sorted(known, key=known.get)])
    mean = sum(len(x.split()) for _, x in docs) / len(docs)
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in part]), pa.array([x for _, x in part])], names=["d", "x"]) for part in (docs[:50], docs[50:])]
    got = {}
    for batch in retrieval._scorer(Value((known, retrieval._Postings(queries, known), idf, mean)), 4)(iter(batches)):
        for r in batch.to_pylist():
            got.setdefault((r["channel"], r["q"]), []).append((r["doc_id"], r["score"]))
    want = by_pairs(docs, queries, 4)
    assert got.keys() == want.keys()
    for at, found in want.items():
        assert [d for d, _ in got[at]] == [d for d, _ in found] and np.allclose([s for _, s in got[at]], [s for _, s in found], atol=2e-6)


def test_a_large_block_is_small():
    rng = random.Random(1)
    queries = [(i, Counter(f"t{int(rng.expovariate(1 / 6000))}" for _ in range(40))) for i in range(20_000)]
    known = {t: i for i, t in enumerate(sorted({t for _, c in queries for t in c}))}
    postings = retrieval._Postings(queries, known)
    assert len(known) > 30_000 and postings.queries == 20_000
    assert len(pickle.dumps(postings)) < 20_000_000


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "some words"), (3, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "words"), (2, None), (3, "")], "item_id bigint, text string")
    assert {(r.channel, r.item_id, r.doc_id, r["rank"]) for r in retrieval.best_documents(docs, asked, 3).collect()} == {("lexical", 1, 1, 1), ("dense", 1, 1, 1)}
    assert retrieval.best_documents(docs.limit(0), asked, 3).count() == 0 and retrieval.best_documents(docs, asked.limit(0), 3).count() == 0
