"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is nearest distance after one more coordinate: vectors
are scaled to length 1 at most and filled up to length 1, queries are scaled to
length 1. Each table has m hash functions floor((a x + b) / width) with normal
(2-stable) a. A neighbour at the usual distance falls into a slot of a function
with a known chance, so the buckets of a table have an estimated chance of
success; a query visits perturbed buckets in that order until they sum up to
`mass`. The candidates of all tables are merged and ranked by the exact score.

m follows from the number of vectors, so that a bucket has some hundreds, the usual distance of a k-th neighbour
from SAMPLE queries against all vectors. Both tables index every vector. On
random directions in 64 dimensions, where neighbours are hardly nearer than
others, most buckets are needed for a recall of 0.9; on clustered data few are.

Defined cases: null, zero and non-finite vectors take no part; equal vectors
are searched once and answer by smaller ids; ties go to smaller ids; fewer than
k other vectors give fewer rows; no vectors give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedloom.llm import vectors as V
from feedloom.llm.common import cut

TABLES, MASS, WIDTH, SAMPLE, SEED = 2, 0.78, 1.6, 32, 7


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


def functions(n: int, dim: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (tables, dim + 1, m) and offsets (tables, m) for n vectors."""
    m = int(min(12, max(2, round(math.log(max(n, 1) / 1000, 4)))))
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(tables, dim + 1, m)), rng.uniform(0, WIDTH, size=(tables, m))


def slots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((x @ a + b) / WIDTH), -7, 8).astype(np.int64) + 7


def keyed(found: np.ndarray) -> np.ndarray:
    """One number for the slots of all functions (16 values each)."""
    key = np.zeros(len(found), np.int64)
    for j in range(found.shape[1]):
        key = key * 16 + found[:, j]
    return key


def filled(x: np.ndarray, longest: float) -> np.ndarray:
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])


def probes(q: np.ndarray, a: np.ndarray, b: np.ndarray, distance: float, mass: float) -> np.ndarray:
    """Keys of the buckets that a query visits, likeliest first, until their chances sum up to `mass`."""
    cosine = max(-0.99, 1 - distance * distance / 2)
    at = q @ a
    spread = math.sqrt(max(1e-6, 1 - cosine * cosine))
    keys, chance = np.zeros(1, np.int64), np.ones(1)
    for j in range(len(at)):
        edges = np.arange(-7, 10) * WIDTH - b[j]
        edges[0], edges[-1] = -np.inf, np.inf
        each = np.diff(normal_cdf((edges - cosine * at[j]) / spread))
        keep = np.flatnonzero(each > 1e-4)
        keys = (keys[:, None] * 16 + keep[None, :]).ravel()
        chance = (chance[:, None] * each[keep][None, :]).ravel()
        if len(chance) > 1 << 16:  # buckets beyond could not be among the likeliest that reach the mass
            order = np.argsort(-chance)[:1 << 16]
            keys, chance = keys[order], chance[order]
    order = np.argsort(-chance, kind="stable")
    return keys[order[:int(np.searchsorted(np.cumsum(chance[order]), mass)) + 1]]


def usual_distance(items: DataFrame, queries: DataFrame, longest: float, k: int) -> float:
    """Median distance of the k-th neighbour of SAMPLE queries, chosen by a hash, over all vectors."""
    chosen = np.array([r.vec for r in queries.orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE).collect()])
    chosen = np.hstack([chosen / np.linalg.norm(chosen, axis=1)[:, None], np.zeros((len(chosen), 1))])

    def run(batches):
        best = np.full((len(chosen), 0), np.inf)
        for batch in batches:
            x = filled(np.stack(batch.column(0).to_numpy(zero_copy_only=False)), longest)
            d = np.sqrt(np.maximum(0, 2 - 2 * chosen @ x.T))
            best = np.sort(np.hstack([best, d]), axis=1)[:, :k + 1]
        for q, row in enumerate(best):
            yield pa.record_batch([pa.array(np.full(len(row), q)), pa.array(row)], ["q", "d"])

    nearest = items.select("vec").mapInArrow(run, "q long, d double")
    line = V.Window.partitionBy("q").orderBy("d")
    kth = nearest.withColumn("r", F.row_number().over(line)).where(F.col("r") <= k + 1).groupBy("q").agg(F.max("d").alias("d"))
    return float(kth.agg(F.expr("percentile(d, 0.5)")).first()[0] or 1.0)


def search(df: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, mass: float = MASS) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows with an id divisible by `every` the k nearest found of all others."""
    some = V.valid(df)
    items = cut(V.classes(some, k + 1))
    queries, asked = V.distinct_queries(some, every)
    n, longest, dim = items.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("vec"))).first()
    if not n or queries.isEmpty():
        return V.answers(df.sparkSession.createDataFrame([], "qid long, vec_id long, score double"), asked, k)
    longest = math.sqrt(longest)
    a, b = functions(n, dim, tables)
    distance = usual_distance(items, queries, longest, k)

    def hashed(frames):
        for f in frames:
            x = filled(V.matrix(f["vec"]), longest)
            for t in range(tables):
                yield f.assign(t=t, bucket=keyed(slots(x, a[t], b[t])))

    def probing(frames):
        for f in frames:
            for row in f.itertuples():
                q = np.append(np.asarray(row.vec, float) / np.linalg.norm(row.vec), 0.0)
                for t in range(tables):
                    keys = probes(q, a[t], b[t], distance, mass)
                    yield pd.DataFrame({"qid": row.qid, "vec": pd.Series([row.vec] * len(keys), dtype=object), "t": t, "bucket": keys})

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, q = V.matrix(left["vec"]), V.matrix(right["vec"])
        error = 2 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()  # of either sum
        return V.best_members(left, right, q @ x.T, lambda r, cols: (x[cols] * q[r]).sum(1), k + 1, error)

    index = items.mapInPandas(hashed, "cid long, vec array<double>, members array<long>, t int, bucket long")
    visits = V.dealt(queries, "qid").mapInPandas(probing, "qid long, vec array<double>, t int, bucket long")
    return V.answers(V.merged(V.block_search(index, visits, ["t", "bucket"], score, V.FOUND), k + 1), asked, k)
