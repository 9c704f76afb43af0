"""Covariances of vector columns by centred outer products that tasks add up, and the variance their components explain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance(rows: DataFrame, vector: str) -> DataFrame:
    """Sample covariances (i, j, covariance), i <= j from 1, of rows whose vector is an array of doubles of one length, without nulls.
    One pass for the means (a value per place), one for the products: a task keeps a square of the length, whatever its rows. No
    rows give no covariances, one row zeros."""
    means = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.count("*").alias("n")).orderBy("i").toArrow()
    if not means.num_rows:
        return rows.sparkSession.createDataFrame([], "i int, j int, covariance double")
    centre, n = means["mean"].to_numpy(), means["n"][0].as_py()
    shared = rows.sparkSession.sparkContext.broadcast(centre)

    def run(batches):
        centre = shared.value
        total = np.zeros((len(centre), len(centre)))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(centre)) - centre
            total += x.T @ x
        i, j = np.triu_indices(len(centre))
        yield pa.RecordBatch.from_arrays([pa.array((i + 1).astype(np.int32)), pa.array((j + 1).astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "i int, j int, s double")
    return sums.groupBy("i", "j").agg((F.sum("s") / max(1, n - 1)).alias("covariance"))


def explained(covariances: DataFrame) -> DataFrame:
    """(component, variance, share, cumulative) in order of variance, from a covariance matrix in long rows: the square of the vectors'
    length comes to the driver."""
    t = covariances.toArrow()
    if not t.num_rows:
        return covariances.sparkSession.createDataFrame([], "component int, variance double, share double, cumulative double")
    i, j, d = t["i"].to_numpy() - 1, t["j"].to_numpy() - 1, int(t["j"].to_numpy().max())
    matrix = np.zeros((d, d))
    matrix[i, j] = matrix[j, i] = t["covariance"].to_numpy()
    variance = np.maximum(np.linalg.eigvalsh(matrix)[::-1], 0.0)
    share = variance / max(variance.sum(), 1e-300)
    rows = [(k + 1, float(v), float(s), float(c)) for k, (v, s, c) in enumerate(zip(variance, share, np.cumsum(share), strict=True))]
    return covariances.sparkSession.createDataFrame(rows, "component int, variance double, share double, cumulative double")


def components_for(explained_variance: DataFrame, threshold: float = 0.9) -> int:
    """The least number of components whose shares add up to the threshold; all if none do."""
    least, n = explained_variance.agg(F.min(F.when(F.col("cumulative") >= threshold, F.col("component"))), F.count("*")).first()
    return least or n
