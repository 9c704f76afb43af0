"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Vectors are compared only under equal, non-null labels. Equal vectors are collapsed first, with their number.
Each table hashes a vector to the signs of some random projections: their number grows with the rows of the largest
label, so that buckets of unlike vectors stay small, and the number of tables with it. Vectors in one bucket of a table are
compared exactly, in double precision. A large bucket is divided into blocks, and each pair of blocks is one
group of at most 2 * BLOCK vectors, so no task holds a bucket and no pair becomes a row: a group reports, per
vector, how many links it found and the smallest vector of its connected part. A pair that meets in several
tables is counted in the first of them, which the vectors' signatures tell. A pair at the threshold meets in one of
the tables with probability above 1 - MISS, whatever the number of bits.

Defined results: a vector that is null, zero, or holds a null or non-finite component links with nothing, and
so does one with a null label or null vec_id (one row each); labels may be numbers or text; vectors of different lengths
never link; repeated rows with one vec_id are one vector, the least where they differ. Extra columns are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import whole_groups, written
from larkspur.llm.graph import connected_components

BITS, MOST_BITS, BUCKET, BLOCK = 16, 30, 16, 256
MISS = 4e-5
SEED = 7


def shape(rows: int, cosine: float) -> tuple[int, int]:
    """(tables, bits) for the rows of the largest label: about BUCKET unlike vectors to a bucket."""
    bits = min(MOST_BITS, max(BITS, math.ceil(math.log2(max(rows, 1) / BUCKET))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log(1 - agree)), bits


def planes(dimensions: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions]).standard_normal((dimensions, tables * bits))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length to a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _signed(tables: int, bits: int):
    def signed(batches):
        weights = 1 << np.arange(bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                part = batch.filter(pa.array(lengths == n))
                values = _matrix(part.column(1))
                signs = (values @ planes(int(n), tables, bits) > 0).reshape(len(values), tables, bits)
                keys = (signs * weights).sum(axis=2).astype(np.int32)
                bounds = pa.array(np.arange(len(values) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(bounds, pa.array(keys.ravel()))], names=["vec_id", "sig"])

    return signed


def _links_in_groups(cosine: float):
    """Rows sorted by (label, len, t, key, x, y): members of a pair of blocks; left and right tell the block's side."""

    def linked(part: pa.RecordBatch):
        table, x, y = (part.column(j)[0].as_py() for j in (2, 4, 5))
        ids = part.column(6).to_numpy()
        copies = part.column(7).to_numpy()
        block = part.column(8).to_numpy()
        values, sig = _matrix(part.column(9)), _matrix(part.column(10)).astype(np.int32)
        scale = np.sqrt((values * values).sum(axis=1))
        left = np.flatnonzero(block == x)
        right = left if x == y else np.flatnonzero(block == y)
        near = (values[left] @ values[right].T) / np.outer(scale[left], scale[right]) >= cosine
        for t in range(table):
            near &= sig[left, t][:, None] != sig[right, t][None, :]
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        keep = a != b
        a, b = a[keep], b[keep]
        if not len(a):
            return None
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, a, copies[b])
        if x != y:
            np.add.at(count, b, copies[a])
        least = ids.copy()
        while True:
            before = least.copy()
            np.minimum.at(least, a, before[b])
            np.minimum.at(least, b, before[a])
            if (least == before).all():
                break
        some = np.flatnonzero((count > 0) | (least < ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(least[some])], names=["vec_id", "links", "least"])

    def links(batches):
        for group in whole_groups(batches, 6):
            if group.num_rows > 1 and (out := linked(group)) is not None:
                yield out

    return links


def near_duplicates(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """embeddings (vec_id, embedding, label): one row per distinct vec_id, and per row without one: n_links (other vectors linked directly),
    component_id (smallest vec_id reachable) and kept (vec_id is its component's smallest)."""
    given = embeddings.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    rows = given.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("r")).select("vec_id", "r.*")
    finite = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    usable = rows.where(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
    usable = usable.withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))
    groups = written(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    reps = groups.select(F.col("rep").alias("vec_id"), "label", "embedding", "copies", F.size("embedding").alias("len"))
    most = groups.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    signed = written(reps.select("vec_id", "embedding").mapInArrow(_signed(*shape(most, cosine)), "vec_id bigint, sig array<int>"))
    keyed = signed.join(reps.select("vec_id", "label", "len"), "vec_id").select("vec_id", "label", "len", F.posexplode("sig").alias("t", "key"))
    where = ["label", "len", "t", "key"]
    buckets = keyed.groupBy(*where).agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(buckets, where).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    paired = members.select(*where, "vec_id", "block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))).alias("p"))
    full = paired.join(reps.select("vec_id", "embedding", "copies"), "vec_id").join(signed, "vec_id")
    group = [*where, "x", "y"]
    full = full.select(*where, F.col("p.x").alias("x"), F.col("p.y").alias("y"), "vec_id", "copies", "block", "embedding", "sig")
    found = written(full.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links_in_groups(cosine), "vec_id bigint, links bigint, least bigint"))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("least < vec_id").select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    classes = reps.select(F.col("vec_id").alias("rep"), "copies").join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    membership = usable.select("vec_id", "label", "embedding").join(groups.select("label", "embedding", "rep"), ["label", "embedding"]).select("vec_id", "rep")
    linked = membership.join(classes, "rep").select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(linked, "vec_id", "left").unionByName(given.where("vec_id is null").select("vec_id"), allowMissingColumns=True)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
