"""Removal of repeated line chunks with content-defined boundaries.

Lines are what stands between newlines. A rolling hash over the hashes of two neighbouring lines ends a chunk
where it falls on a fixed residue, so an insertion moves boundaries near it only. Chunks of at least two lines
that occur more than once anywhere are removed but for the first occurrence (smallest doc_id, then position);
single lines are never removed. A light pass counts chunk hashes; only the texts of chunks with a repeated hash
are gathered, and Spark groups them by their bytes, so equality does not rest on a hash.

Defined results: null text stays null; a text that loses every line becomes empty; rows with null doc_id are
left as they are; rows that share a doc_id and a text are one document and share the removals, rows that share only a
doc_id are different documents, in the order of a hash of their texts. All columns are
kept; n_chars, where there is one, is set to the new text's length on changed rows."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import unused, written

#: A chunk ends after a line in one of MODULUS cases.
MODULUS = 4


def line_hash(line: str) -> int:
    """The first 60 bits of the line's MD5."""
    return int(hashlib.md5(line.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)


def chunks(text: str, modulus: int = MODULUS) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk."""
    hashes = [line_hash(x) for x in text.split("\n")]
    out, begin = [], 0
    for i, h in enumerate(hashes):
        rolled = h % 1_000_003 * 31 + (hashes[i - 1] % 1_000_003 if i else 0)
        if rolled % modulus == 0 or i == len(hashes) - 1:
            out.append((begin, i + 1 - begin))
            begin = i + 1
    return out


def _light(modulus: int):
    def light(batches):
        for batch in batches:
            ids, of, h1, h2, at = [], [], [], [], []
            for doc, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if "\n" not in text:
                    continue
                lines = text.split("\n")
                for begin, n in chunks(text, modulus):
                    if n > 1:
                        digest = hashlib.md5("\n".join(lines[begin : begin + n]).encode()).digest()
                        ids.append(doc)
                        of.append(t)
                        h1.append(int.from_bytes(digest[:8], "little", signed=True))
                        h2.append(int.from_bytes(digest[8:], "little", signed=True))
                        at.append(begin)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, of, h1, h2, at)], names=["doc_id", "t", "h1", "h2", "at"])

    return light


def _texts(modulus: int):
    """(doc_id, t, text, starts) to one row per chunk that begins at one of starts."""

    def texts(batches):
        for batch in batches:
            ids, of, at, chunk = [], [], [], []
            for doc, t, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, wanted = text.split("\n"), set(starts)
                for begin, n in chunks(text, modulus):
                    if begin in wanted:
                        ids.append(doc)
                        of.append(t)
                        at.append(begin)
                        chunk.append("\n".join(lines[begin : begin + n]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, of, at)), pa.array(chunk, pa.string())], names=["doc_id", "t", "at", "chunk"])

    return texts


def repeats(docs: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """(doc_id, t, gone): the first lines of the chunks to remove from each document (t: a hash of its text), as an array."""
    known = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    light = known.mapInArrow(_light(modulus), "doc_id bigint, t bigint, h1 bigint, h2 bigint, at bigint")
    place = F.struct("doc_id", "t", "at")
    again = light.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("h1", "h2")
    asked = light.join(again, ["h1", "h2"]).groupBy("doc_id", "t").agg(F.collect_set("at").alias("starts"))
    found = written(known.join(asked, ["doc_id", "t"]).select("doc_id", "t", "text", "starts").mapInArrow(_texts(modulus), "doc_id bigint, t bigint, at bigint, chunk string"))
    first = found.groupBy("chunk").agg(F.min(place).alias("first"))
    later = found.join(first, "chunk").where(place > F.col("first"))
    return later.groupBy("doc_id", "t").agg(F.collect_set("at").alias("gone"))


def remove_repeated_chunks(docs: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """docs with text stripped of repeated chunks: all columns of docs, text replaced."""
    gone, text, key, of = (unused(docs, x) for x in ("gone_lines", "new_text", "of_doc", "of_text"))
    found = repeats(docs, modulus).toDF(key, of, gone)
    joined = docs.join(found, (F.col("doc_id") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(of)), "left")
    strip = F.pandas_udf(_strip_series(modulus), "string")
    changed = F.col(gone).isNotNull()
    out = joined.withColumn(text, F.when(changed, strip(F.when(changed, F.col("text").cast("string")), gone)).otherwise(F.col("text")))
    cols = [F.col(text).alias("text") if c == "text" else F.when(changed, F.length(text)).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes]
    return out.select(*cols)


def _strip_series(modulus: int):
    def strip(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, starts in zip(texts, gone, strict=True):
            if text is None or starts is None:
                out.append(text)
                continue
            lines, drop = text.split("\n"), {int(x) for x in starts}
            out.append("\n".join(x for begin, n in chunks(text, modulus) if begin not in drop for x in lines[begin : begin + n]))
        return pd.Series(out, dtype=object)

    return strip
