"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

A pattern is a window of `width` consecutive words of a benchmark item, or all words of a shorter item. Patterns
of one length share a searcher. The symbol is a word; a block is the last two words (one for one-word patterns)
of the part of the text under the patterns. A shift table, indexed by the block's hash, says how far the search
can move before any pattern could end; where it says 0, the suffix-hash bucket gives the patterns to try, and
words are compared directly. Texts are searched in segments side by side, each at its own pace, so one step of
the search is a few array operations over all segments.

Defined results: null text has no words and no hits; null or wordless items have no window; repeated item_ids
count once for each document; null item_ids are left out. Extra columns are not read."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textnp as tx
from larkspur.llm.common import written

WIDTH = 13
#: Benchmarks are searched in blocks of about so many characters, each held by the search tasks.
BLOCK_CHARS = 8_000_000
TABLE_BITS = 20
SEGMENT = 512


class Searcher:
    """Wu-Manber tables for the patterns of one length. A pattern is a run of words of the items, kept as the number of its
    first word; the words' bytes are one buffer, so millions of patterns are a few arrays."""

    def __init__(self, words: tx.Words, hashes: np.ndarray, firsts: np.ndarray, rows: np.ndarray, items: list[str], length: int):
        self.words, self.firsts, self.rows, self.items, self.length = words, firsts, rows, items, length
        self.block = min(2, length)
        blocks = self.blocks(hashes)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int32)
        for j in range(length - self.block + 1):
            np.minimum.at(self.shift, blocks[firsts + j] >> np.uint64(64 - TABLE_BITS), length - self.block - j)
        self.suffixes = np.unique(blocks[firsts + length - self.block])
        # Inside a suffix bucket, patterns are found by the hash of all their words.
        whole = tx.run_hashes(hashes, length)[firsts]
        self.order = np.argsort(whole, kind="stable")
        self.whole = whole[self.order]

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        return tx.run_hashes(hashes, self.block) if self.block > 1 else tx.mix(hashes)

    def search(self, words: tx.Words, hashes: np.ndarray):
        """Yields (index of the first word, item_id) of every occurrence."""
        n, m = len(hashes), self.length
        if n < m:
            return
        ends = self.blocks(hashes)  # block i ends at word i + block - 1
        # Segments of positions where a pattern may start, never beyond the text's last start.
        lows, highs = [], []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= m:
                cut = np.arange(a, b - m + 1, SEGMENT)
                lows.append(cut)
                highs.append(np.minimum(cut + SEGMENT, b - m + 1))
        if not lows:
            return
        at, stop = np.concatenate(lows), np.concatenate(highs)
        tail, runs = m - self.block, None
        while len(at):
            move = self.shift[ends[at + tail] >> np.uint64(64 - TABLE_BITS)]
            zero = move == 0
            if zero.any():
                here = at[zero]
                key = ends[here + tail]
                here = here[self.suffixes[np.minimum(np.searchsorted(self.suffixes, key), len(self.suffixes) - 1)] == key]
                if len(here):
                    runs = tx.run_hashes(hashes, m) if runs is None else runs
                    left, right = (np.searchsorted(self.whole, runs[here], side) for side in ("left", "right"))
                    hit = left < right
                    for i, lo, hi in zip(here[hit].tolist(), left[hit].tolist(), right[hit].tolist(), strict=True):
                        text = _bytes(words, i, m)
                        for p in self.order[lo:hi].tolist():
                            if _bytes(self.words, int(self.firsts[p]), m) == text:
                                yield i, self.items[self.rows[p]]
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]


def _bytes(words: tx.Words, first: int, n: int) -> list[bytes]:
    return [words.data[s:e].tobytes() for s, e in zip(words.start[first : first + n].tolist(), words.end[first : first + n].tolist(), strict=True)]


def windows_of(items: list[tuple[object, str | None]], width: int) -> list[Searcher]:
    """The searchers, one per pattern length, for (item_id, text) rows."""
    items = [(str(item), text.encode()) for item, text in items if item is not None and text]
    offs = np.cumsum([0, *(len(text) for _, text in items)])
    words = tx.split(np.frombuffer(b"".join(text for _, text in items), np.uint8), offs, tx.NOT_ALNUM, lower=True)
    hashes, counts, names = words.hashes(), words.counts(), [item for item, _ in items]
    length = np.minimum(counts, width)
    out = []
    for n in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == n)
        of = np.repeat(rows, counts[rows] - n + 1)
        begin = np.cumsum(counts[rows] - n + 1) - (counts[rows] - n + 1)
        firsts = words.first[of] + np.arange(len(of)) - np.repeat(begin, counts[rows] - n + 1)
        out.append(Searcher(words, hashes, firsts, of, names, n))
    return out


def _scan(shared):
    def scan(batches):
        searchers = shared.value
        for batch in batches:
            offs, data = tx.text_buffers(batch.column(1))
            counts = np.zeros(batch.num_rows, np.int64)
            n_hit = np.zeros(batch.num_rows, np.int64)
            spans = [[] for _ in range(batch.num_rows)]
            items = [[] for _ in range(batch.num_rows)]
            for at, to in tx.row_slices(offs):
                words = tx.split(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], tx.NOT_ALNUM, lower=True)
                counts[at:to] = words.counts()
                hashes = words.hashes()
                hits = defaultdict(list)
                for s in searchers:
                    for i, item in s.search(words, hashes):
                        row = int(np.searchsorted(words.first, i, "right")) - 1
                        hits[row].append((i - int(words.first[row]), s.length, item))
                for row, found in hits.items():
                    covered = np.zeros(counts[at + row], bool)
                    for i, n, _ in found:
                        covered[i : i + n] = True
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    spans[at + row] = edges.tolist()
                    n_hit[at + row] = covered.sum()
                    items[at + row] = sorted({x for _, _, x in found})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(n_hit), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "edges", "items"])

    return scan


def _union_of_blocks(batches):
    """Rows (row, edges of each block, other columns) to covered words."""
    for batch in batches:
        hit = []
        for blocks in batch.column(1).to_pylist():
            pairs = sorted((e[i], e[i + 1]) for e in blocks or () for i in range(0, len(e), 2))
            total, reach = 0, 0
            for a, b in pairs:
                total += max(0, b - max(a, reach))
                reach = max(reach, b)
            hit.append(total)
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(hit, pa.int64()), batch.column(4)], names=["doc_id", "n_words", "n_hit", "items"])


def _pieces(width: int, chars: int):
    """Items (item_id, text) to runs of whole words of about so many characters; a run shares width - 1 words with the
    next, so each window is in one of them."""

    def pieces(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                if len(raw) <= chars:
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([text], pa.string())], names=["item_id", "text"])
                    continue
                w = tx.split(raw, np.array([0, len(raw)]), tx.NOT_ALNUM, lower=False)
                at, last = 0, len(w.start)
                while at < last:
                    to = min(last, max(at + width, int(np.searchsorted(w.end, w.start[at] + chars, "right"))))
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([raw[w.start[at] : w.end[to - 1]].tobytes().decode()], pa.string())], names=["item_id", "text"])
                    at = last if to == last else to - width + 1

    return pieces


def _blocks(rows, chars: int):
    """Rows (item_id, text) to lists of at most so many characters; a longer text stands alone."""
    out, size = [], 0
    for r in rows:
        if out and size + len(r.text) > chars:
            yield out
            out, size = [], 0
        out.append((r.item_id, r.text))
        size += len(r.text)
    yield out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = 5) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit (words inside an occurrence of a window of
    benchmark (item_id, text)), items (item_ids with occurring windows, sorted as strings) and contaminated
    (n_hit > 0 and 100 * n_hit >= percent * n_words).

    The benchmark is read in blocks of a bounded number of characters, long items in several pieces; each block is
    sent to the tasks and meets all documents. With one block, the usual case, nothing is shuffled. With more, the rows
    of docs are numbered and written once, the hits of each block are written, and brought together by that number."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    asked = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    kind = "doc_id bigint, n_words bigint, n_hit bigint, edges array<bigint>, items array<string>"
    if chars <= BLOCK_CHARS:
        shared = spark.sparkContext.broadcast(windows_of([(r.item_id, r.text) for r in asked.toLocalIterator()], width))
        hit = texts.mapInArrow(_scan(shared), kind).select("doc_id", "n_words", "n_hit", "items")
    else:
        hit = _in_blocks(texts, asked, chars, width, kind)
    return hit.select("*", ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))


def _in_blocks(texts: DataFrame, asked: DataFrame, chars: int, width: int, kind: str) -> DataFrame:
    """The same for a benchmark of several blocks."""
    spark = texts.sparkSession
    row = F.monotonically_increasing_id()
    numbered = written(texts.select(row.alias("row"), "text", "doc_id"))
    # So many parts that the driver holds about a quarter of a block at a time.
    parts = asked.mapInArrow(_pieces(width, max(1, BLOCK_CHARS // 4)), "item_id string, text string").repartition(-(-4 * chars // BLOCK_CHARS))
    found = None
    for b, block in enumerate(_blocks(parts.toLocalIterator(), BLOCK_CHARS)):
        shared = spark.sparkContext.broadcast(windows_of(block, width))
        # The scan hands its first column through: here the number of the row.
        part = numbered.select("row", "text").mapInArrow(_scan(shared), kind.replace("doc_id", "row", 1))
        # Every row comes from the first block, from the others those with hits.
        part = written(part.select("row", "n_words", "edges", "items").where(F.lit(not b) | (F.col("n_hit") > 0)))
        shared.destroy()
        found = part if found is None else found.union(part)
    merged = found.groupBy("row").agg(F.first("n_words").alias("n_words"), F.collect_list("edges").alias("edges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    named = merged.join(numbered.select("row", "doc_id"), "row").select("row", "edges", "doc_id", "n_words", "items")
    return named.mapInArrow(_union_of_blocks, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>")


def items_digest(items: str = "items") -> F.Column:
    """Lowercase hex SHA-256 of the item_ids joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(items)), 256)
