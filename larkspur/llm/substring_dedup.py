"""Exact removal of repeated passages by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the smallest hash of its runs of `minimizer` words, a
function of the window's words alone. Consecutive windows with one minimiser form a super-k-mer, which travels
as one packed string to the bucket of its minimiser; there the windows are sorted and each distinct window gets
the smallest document that holds it.

Before anything is packed, a light pass over (minimiser, document) finds the minimisers of at least two
documents; windows under any other minimiser cannot repeat. Equal packed strings are merged before the shuffle,
with the smallest document. Under a minimiser with very many super-k-mers (a passage in a third of all documents,
or a line with different words around it) each window travels by itself as a digest of its own words: only equal
windows meet, and they are merged with the smallest document before the shuffle, so no bucket is hot.

Defined results: null or short text has no windows and loses nothing; null doc_id rows keep all words and
remove none elsewhere; rows with one doc_id are one document, so they do not remove each other's words.
Extra columns are not read."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textnp as tx
from larkspur.llm.common import written

WINDOW, MINIMIZER = 50, 20
#: Under a minimiser with more super-k-mers than this, windows travel one by one.
HOT = 500
#: A super-k-mer is cut after so many windows (texts of one repeated word).
LONGEST = 2048


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, cut at LONGEST; one more at the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    run = np.arange(n) - np.repeat(starts, np.diff([*starts, n]))
    return np.append(np.flatnonzero(run % LONGEST == 0), n)


def _minimisers(hashes: np.ndarray, window: int, minimizer: int) -> np.ndarray:
    """The minimiser of each window of one text."""
    return tx.run_minimum(tx.run_hashes(hashes, minimizer), window - minimizer + 1)


def _light(window: int, minimizer: int):
    def light(batches):
        for batch in batches:
            offs, data = tx.text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, to in tx.row_slices(offs):
                words = tx.split(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], tx.SPACE, lower=False)
                hashes = words.hashes()
                total = len(hashes)
                if total < window:
                    continue
                least = _minimisers(hashes, window, minimizer)
                valid = tx.starts_of_runs(words.first, window, total)
                row = words.row_of()[: len(least)][valid]
                least = least[valid]
                if not len(least):
                    continue
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(ids[at + row[new]])], names=["m", "doc_id"])

    return light


def _pack(window: int, minimizer: int):
    """(doc_id, text, cold, hot): the super-k-mers of the document under its shared minimisers; under hot ones the digests
    of their windows. Equal windows that overlap or touch are one row: all words between them go or stay together."""

    def pack(batches):
        for batch in batches:
            offs, data = tx.text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cold, hot = batch.column(2), batch.column(3)
            out, size = [[] for _ in range(7)], 0
            for i in range(batch.num_rows):
                words = tx.split(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]), tx.SPACE, lower=False)
                hashes = words.hashes()
                if len(hashes) < window:
                    continue
                least = _minimisers(hashes, window, minimizer)
                dense = np.isin(least, np.array(hot[i].as_py() or [], np.int64).view(np.uint64))
                shared = dense | np.isin(least, np.array(cold[i].as_py() or [], np.int64).view(np.uint64))
                cuts = _cuts(least, shared)
                # The words with one space between them, and where each begins and ends there.
                raw = b" ".join(words.data.tobytes().split()).decode()
                seen: dict[bytes, int] = {}
                own = np.cumsum(_code_points(words) + 1)
                begin, end = np.append(0, own[:-1]), own - 1
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if dense[a]:
                        for k, low, high in zip(range(a, b), begin[a:b].tolist(), end[a + window - 1 : b + window - 1].tolist(), strict=True):
                            digest = hashlib.blake2b(raw[low:high].encode(), digest_size=16).digest()
                            row = seen.get(digest)
                            if row is not None and k - (out[5][row] + out[6][row] - 1) <= window:
                                out[6][row] = k - out[5][row] + 1
                                continue
                            seen[digest] = len(out[0])
                            for column, x in zip(out, (None, None, *struct.unpack("<qq", digest), ids[i], k, 1), strict=True):
                                column.append(x)
                            size += 64
                    elif shared[a]:
                        packed = raw[begin[a] : end[b + window - 2]]
                        for column, x in zip(out, (int(least[a].view(np.int64)), packed, None, None, ids[i], a, b - a), strict=True):
                            column.append(x)
                        size += len(packed)
                    if size > 8 << 20:
                        yield _packed(out)
                        out, size, seen = [[] for _ in range(7)], 0, {}
            if out[0]:
                yield _packed(out)

    return pack


PACKED = "key bigint, packed string, d1 bigint, d2 bigint, doc_id bigint, at bigint, n bigint"


def _packed(out: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["key", "packed", "d1", "d2", "doc_id", "at", "n"])


def _code_points(words: tx.Words) -> np.ndarray:
    """The length of each word in code points."""
    heads = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    return heads[words.end] - heads[words.start]


def _first_documents(window: int):
    """Rows (key, packed, first_doc) in order of key: for each packed string, its runs of windows and their first document."""

    def counted(keys: list, strings: list, docs: list):
        """Sort the windows of whole buckets by a hash of their words; windows with equal hashes are compared as bytes."""
        offs, data = tx.text_buffers(pa.array(strings, pa.string()))
        words = tx.split(data, offs, tx.SPACE, lower=False)
        first = words.first
        runs = tx.run_hashes(words.hashes(), window)
        begins = np.flatnonzero(tx.starts_of_runs(first, window, len(words.start)))
        of = np.repeat(np.arange(len(strings)), np.diff(first) - window + 1)
        bucket, doc, hashed = np.array(keys, np.int64)[of], np.array(docs, np.int64)[of], runs[begins]
        order = np.lexsort((doc, hashed, bucket))
        raw, low, high = data.tobytes(), words.start[begins], words.end[begins + window - 1]
        same = (bucket[order][1:] == bucket[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
        at = np.flatnonzero(same)
        one, two = order[at], order[at + 1]
        if any(raw[a:b] != raw[c:d] for a, b, c, d in zip(low[one].tolist(), high[one].tolist(), low[two].tolist(), high[two].tolist(), strict=True)):
            # Different windows with one hash: number the windows by their bytes instead.
            known: dict[bytes, int] = {}
            number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            order = np.lexsort((doc, number, bucket))
            same = (bucket[order][1:] == bucket[order][:-1]) & (number[order][1:] == number[order][:-1])
        leader = np.flatnonzero(np.append(True, ~same))
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(doc[order][leader], np.diff(np.append(leader, len(order))))
        # Runs of windows of one string with one first document.
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
        cut = np.flatnonzero(new)
        offset = begins - first[of]
        lengths = np.diff(np.append(cut, len(of)))
        rows = np.searchsorted(of[cut], np.arange(len(strings) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(rows), pa.array(x.astype(np.int64))) for x in (offset[cut], lengths, least[cut])]
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)), pa.array(strings), *lists], names=["key", "packed", "offsets", "lengths", "docs"])

    def first_documents(batches):
        keys, strings, docs, size = [], [], [], 0
        for batch in batches:
            for key, string, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if size > 1 << 20 and key != keys[-1]:
                    yield counted(keys, strings, docs)
                    keys, strings, docs, size = [], [], [], 0
                keys.append(key)
                strings.append(string)
                docs.append(doc)
                size += len(string)
        if keys:
            yield counted(keys, strings, docs)

    return first_documents


def removed_spans(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """(doc_id, spans): for documents with repeated passages, the spans [word index, number of words) to remove."""
    known = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    light = known.mapInArrow(_light(window, minimizer), "m bigint, doc_id bigint")
    shared = light.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("m", (F.col("c") > HOT).alias("hot"))
    asked = light.join(shared, "m").groupBy("doc_id").agg(F.collect_set(F.when(~F.col("hot"), F.col("m"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("m"))).alias("dense"))
    every = written(known.join(asked, "doc_id").select("doc_id", "text", "cold", "dense").mapInArrow(_pack(window, minimizer), PACKED))
    packed = every.where("packed is not null").select("key", "packed", "doc_id", "at")
    distinct = packed.groupBy("key", "packed").agg(F.min("doc_id").alias("first_doc"))
    sorted_in_buckets = distinct.repartition("key").sortWithinPartitions("key")
    runs = "key bigint, packed string, offsets array<bigint>, lengths array<bigint>, docs array<bigint>"
    firsts = sorted_in_buckets.mapInArrow(_first_documents(window), runs)
    digest = [F.xxhash64("packed").alias("p1"), F.crc32(F.encode("packed", "UTF-8")).alias("p2"), F.length("packed").alias("p3")]
    back = packed.select("key", *digest, "doc_id", "at").join(firsts.select("key", *digest, "offsets", "lengths", "docs"), ["key", "p1", "p2", "p3"])
    spans = back.select("doc_id", "at", F.explode(F.arrays_zip("offsets", "lengths", "docs")).alias("r")).where("r.docs < doc_id")
    spans = spans.select("doc_id", (F.col("at") + F.col("r.offsets")).alias("s"), F.col("r.lengths").alias("n"))
    # The windows under hot minimisers, and the first document of each that several hold.
    single = every.where("d1 is not null").select("d1", "d2", "doc_id", "at", "n")
    repeated = single.groupBy("d1", "d2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("d1", "d2", "lo")
    spans = spans.union(single.join(repeated, ["d1", "d2"]).where("lo < doc_id").select("doc_id", "at", "n"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", (F.col("n") + (window - 1)).alias("n"))).alias("spans"))


def _cut(with_text: bool):
    def cut(batches):
        for batch in batches:
            offs, data = tx.text_buffers(batch.column(1))
            counts, gone, digests, texts = [], [], [], []
            spans = batch.column(2)
            for i in range(batch.num_rows):
                words = data[offs[i] : offs[i + 1]].tobytes().split()
                keep = np.ones(len(words), bool)
                own = spans[i].as_py()
                for span in own or ():
                    keep[span["s"] : span["s"] + span["n"]] = False
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if own else b" ".join(words)
                counts.append(len(words))
                gone.append(len(words) - int(keep.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space;
    null without with_text). Every word goes that a window covers which also starts in a smaller doc_id's text."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    joined = texts.join(removed_spans(docs, window, minimizer), "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(with_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
