"""Nearest vectors by Euclidean distance, exactly: each task goes through its vectors a batch at
a time, and only what may be among a query's nearest leaves it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.shipping import ship, spread

#: Queries measured against a batch at once.
QUERIES_AT_ONCE = 256
#: Distances are compared after rounding to 4 digits, so what is this near the last one may come before it.
SLACK = 2e-4


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def candidates(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of queries, places of vectors) that may be among the nearest, by squared distances
    from a product of matrices; `best` has each query's smallest ones so far. Of vectors
    equally far from a query, those with the smallest ids do."""
    k, norms = best.shape[1], (vectors**2).sum(1)
    found_q, found_e = [], []
    for at in range(0, len(q_ids), QUERIES_AT_ONCE):
        q = q_vectors[at : at + QUERIES_AT_ONCE]
        q_norms = (q**2).sum(1)
        near = norms[None, :] + q_norms[:, None] - 2 * (q @ vectors.T)
        near[q_ids[at : at + QUERIES_AT_ONCE, None] == ids[None, :]] = np.inf
        some = np.partition(near, k - 1, axis=1)[:, :k] if near.shape[1] > k else near
        best[at : at + len(q)] = np.sort(np.concatenate([best[at : at + len(q)], some], axis=1), axis=1)[:, :k]
        error = 1e-9 * (q_norms + norms.max(initial=0)) + 1e-12
        bound = (np.sqrt(np.maximum(best[at : at + len(q), -1], 0) + error) + SLACK) ** 2 + error
        a, b = np.nonzero((near <= bound[:, None]) & (near < np.inf))
        found_q.append(a + at)
        found_e.append(b)
    return np.concatenate(found_q), np.concatenate(found_e)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, added up in the order of the places, as SQL's aggregate does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += (a[:, j] - b[:, j]) ** 2
    return out


def nearest(vectors: DataFrame, query: str, k: int, otherwise) -> DataFrame:
    """(q, vec_id, dist): for each vector for which `query` holds the k nearest others, ties by id.
    Vectors that differ in length or hold nulls or no finite numbers are left to `otherwise`."""
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding")
    usual = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    seen = vectors.agg(F.min(F.size(e)).alias("a"), F.max(F.size(e)).alias("b"), F.coalesce(F.min(usual), F.lit(False)).alias("usual"))
    least, most, fine = seen.first()
    if not fine or least != most or least < 1:
        return otherwise()
    asked = vectors.filter(query).select("vec_id", "embedding").toArrow()
    q_ids = asked["vec_id"].to_numpy().astype(np.int64)
    q_all = spark.sparkContext.broadcast((q_ids, _matrix(asked["embedding"].combine_chunks(), least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, vectors_q = q_all.value
        best = np.full((len(ids_q), k), np.inf)
        for batch in batches:
            if not batch.num_rows or not len(ids_q):
                continue
            ids, own = batch["vec_id"].to_numpy(), _matrix(batch["embedding"], least)
            qi, ei = candidates(ids, own, ids_q, vectors_q, best)
            far = np.concatenate([squares(vectors_q[qi[i : i + 50_000]], own[ei[i : i + 50_000]]) for i in range(0, len(qi), 50_000)]) if len(qi) else np.zeros(0)
            order = np.lexsort((ids[ei], far, qi))
            qi, ei, far = qi[order], ei[order], far[order]
            # Beyond the k-th of equally far ones none is among the nearest.
            new = np.ones(len(qi), dtype=bool)
            new[1:] = (qi[1:] != qi[:-1]) | (far[1:] != far[:-1])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(qi)), 0)) if len(qi) else np.zeros(0, dtype=int)
            kept = np.arange(len(qi)) - starts < k
            yield pa.RecordBatch.from_arrays([pa.array(ids_q[qi[kept]]), pa.array(ids[ei[kept]].astype(np.int64)), pa.array(far[kept])], names=["q", "vec_id", "far"])

    rows = spread(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")).filter("vec_id is not null")
    found = rows.mapInArrow(run, "q bigint, vec_id bigint, far double").select("q", "vec_id", F.round(F.sqrt("far"), 4).alias("dist"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("dist", "vec_id"))
    return found.withColumn("n", place).filter(F.col("n") <= k).select("q", "vec_id", "dist")
