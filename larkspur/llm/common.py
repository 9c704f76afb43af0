"""Helpers shared by the corpus operators: reading tables, cutting lineage, column names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if a count shows it has at most this many rows of a few fixed-width columns.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (spark.checkpoint.dir). A temporary one only where none is set and
    driver and executors are one process; on a cluster without a shared folder this is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "scratch" not in _own:
        _own["scratch"] = tempfile.mkdtemp(prefix="spark-larkspur-")
    return _own["scratch"]


_own: dict[str, str] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table through Spark's file system layer."""
    with contextlib.suppress(Exception):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    A lost executor costs nothing that has been written. Files are removed by `release`, or else when the session's
    process ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def mark() -> int:
    """A point in time for release."""
    return len(_written)


@atexit.register
def release(since: int = 0) -> None:
    """Delete the intermediate tables written since then: for callers who have written the results made of them."""
    while len(_written) > since:
        remove(*_written.pop())


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def small(df: DataFrame, rows: int) -> DataFrame:
    """df as a broadcast side if its known row count is within BROADCAST_ROWS, else unchanged (shuffled join)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fold(column: str, folds: int):
    """crc32 of the column's decimal text, modulo folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def whole_groups(batches, keys: int):
    """Arrow batches sorted by their first `keys` columns to one batch per group, however the groups fall on batches."""
    import numpy as np
    import pyarrow as pa

    held: list = []

    def joined():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in batch.columns[:keys]:
            values = c.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        new[0] = bool(held) and any(batch.column(j)[0] != held[-1].column(j)[held[-1].num_rows - 1] for j in range(keys))
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if new[a] and held:
                yield joined()
                held.clear()
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield joined()
