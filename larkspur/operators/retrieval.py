"""Scoring of a stated set of query texts against all documents.

The queries are read in blocks of bounded size and sent to the tasks as sparse postings, term by term; a document is read once for the counts of the
terms and once for the scores, where each task keeps the best few of its documents for each query. So no word of a
document is shuffled, and no row stands for a pair of a query and a document that isn't among the best of a task."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERM = re.compile("[a-z0-9]{2,}")
#: Queries are searched in blocks of about so many characters.
BLOCK_CHARS = 4_000_000
#: A task holds about so many pairs of a document's term and a query before it adds them up, and so many scores before it sorts them.
KEPT = 500_000
K1, B = 1.2, 0.75


def query_blocks(queries: DataFrame):
    """(ids, counters of terms) of the queries (item_id, text), block by block."""
    block, size = [], 0
    for r in queries.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).toLocalIterator():
        if block and size + len(r.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.item_id, Counter(TERM.findall(r.text))))
        size += len(r.text)
    if block:
        yield block


def _statistics(vocabulary):
    """Of the documents (doc_id, text): rows (term, n), where term -1 counts documents and -2 their terms."""

    def run(batches):
        known = vocabulary.value
        found, n, total = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                own = TERM.findall(text)
                n, total = n + 1, total + len(own)
                for term in set(own):
                    if (i := known.get(term)) is not None:
                        found[i] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(found[some], [n, total]))], names=["term", "n"])

    return run


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges (start, length), one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _numbered(pairs: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct pairs, a number below the third value for each of the given ones: the pair itself where most of the space is met, else its rank."""
    if space <= 2 * len(pairs):
        return np.flatnonzero(np.bincount(pairs, minlength=space)), pairs, space
    pair, of = np.unique(pairs, return_inverse=True)
    return pair, of, len(pair)


class _Postings:
    """The queries of a block by term: for term i the queries that hold it, and how often, at starts[i] to starts[i + 1]."""

    def __init__(self, block: list, known: dict[str, int]):
        found = [(known[t], q, c) for q, (_, own) in enumerate(block) for t, c in own.items()]
        term, self.query, self.count = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True)) if found else (np.zeros(0, np.int64),) * 3
        self.starts = np.searchsorted(term, np.arange(len(known) + 1))
        self.queries = len(block)
        self.norm = np.sqrt(np.bincount(self.query, self.count * self.count, self.queries))


class _Best:
    """The best few documents for each query; those that cannot stay are let go of whenever a few hundred thousand have come."""

    def __init__(self, depth: int):
        self.depth, self.rows, self.new = depth, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.new.append((query, doc, np.round(score, 6)))
        if sum(len(x[0]) for x in self.new) > KEPT:
            self.sort()

    def sort(self) -> tuple:
        query, doc, score = (np.concatenate(x) for x in zip(self.rows, *self.new, strict=True))
        order = np.lexsort((doc, -score, query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[nth < self.depth]
        self.rows, self.new = (query[nth < self.depth], doc[order], score[order]), []
        return self.rows


def _scorer(shared, depth: int):
    """The best documents of a task for each query and channel."""

    def run(batches):
        known, postings, idf, mean = shared.value
        best = {"lexical": _Best(depth), "dense": _Best(depth)}
        lengths_of = np.diff(postings.starts)

        def score(ids, rows, terms, counts, lengths, norms):
            row, term, tf = np.array(rows), np.array(terms), np.array(counts, float)
            length, norm, ids = np.array(lengths, float), np.array(norms), np.array(ids, np.int64)
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
            n = lengths_of[term]
            at = _ranges(postings.starts[term], n)
            pair, of, every = _numbered(np.repeat(row, n) * postings.queries + postings.query[at], len(ids) * postings.queries)
            doc, query = pair // postings.queries, pair % postings.queries
            total = lambda x: np.bincount(of, x, every)[pair if every > len(pair) else slice(None)]
            best["lexical"].add(query, ids[doc], total(np.repeat(weight, n)))
            best["dense"].add(query, ids[doc], total(np.repeat(tf, n) * postings.count[at]) / (norm[doc] * postings.norm[query]))

        held, size = ([], [], [], [], [], []), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(TERM.findall(text))
                met = [(known[t], c) for t, c in own.items() if t in known]
                if not met:
                    continue
                ids, rows, terms, counts, lengths, norms = held
                rows += [len(ids)] * len(met)
                terms += [t for t, _ in met]
                counts += [c for _, c in met]
                ids.append(doc)
                lengths.append(sum(own.values()))
                norms.append(sum(c * c for c in own.values()) ** 0.5)
                size += int(lengths_of[[t for t, _ in met]].sum())
                if size > KEPT:
                    score(*held)
                    held, size = ([], [], [], [], [], []), 0
        if held[0]:
            score(*held)
        for channel, of in best.items():
            query, doc, scores = of.sort()
            for a in range(0, len(query), 10_000):
                part = slice(a, a + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([channel] * len(query[part])), pa.array(query[part]), pa.array(doc[part]), pa.array(scores[part])], names=["channel", "q", "doc_id", "score"])

    return run


def best_documents(documents: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """(channel, item_id, doc_id, score): for each of the queries (item_id, text) and each channel, lexical (BM25) and dense
    (cosine of term counts), at least the depth best documents (doc_id, text) that share a term with it, and the best of each task.

    Statistics are over all documents. Null texts have no terms; rows with null doc_id count but are never found."""
    spark, out = documents.sparkSession, None
    docs = documents.select(F.col("doc_id").cast("bigint"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    for block in query_blocks(queries):
        known = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        vocabulary = spark.sparkContext.broadcast(known)
        stats = {r.term: r.n for r in docs.mapInArrow(_statistics(vocabulary), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, mean = stats.get(-1, 0), stats.get(-2, 0) / max(stats.get(-1, 0), 1)
        df = np.array([stats.get(i, 0) for i in range(len(known))], float)
        shared = spark.sparkContext.broadcast((known, _Postings(block, known), np.log(1 + (n - df + 0.5) / (df + 0.5)), max(mean, 1e-12)))
        found = docs.where("doc_id is not null").mapInArrow(_scorer(shared, depth), "channel string, q bigint, doc_id bigint, score double")
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "q bigint, item_id bigint")
        found = found.join(F.broadcast(names), "q").select("channel", "item_id", "doc_id", "score")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "channel string, item_id bigint, doc_id bigint, score double")
    w = Window.partitionBy("channel", "item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
