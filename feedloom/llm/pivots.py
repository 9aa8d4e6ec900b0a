"""Exact top-k by a pivot-distance index.

Vectors are made integers, floor(256 x). Largest integer inner product is
nearest distance after one more coordinate, which fills every vector up to the
longest length. A vector is keyed by its nearest pivot and its distance to it;
each pivot's vectors are cut into annuli of neighbouring distances. A query
first looks at the annuli around its own distance to its nearest pivots, which
bounds the distance of its k-th answer. Then the triangle inequality names all
other annuli, and within an annulus the sorted distances, that can hold a
nearer one; the rest is never looked at. Both passes are exact, and so is what
is left out.

Pivots are a sample of PIVOTS vectors by a hash. Annuli have at least
ANNULUS_ROWS vectors and number at most MAX_ANNULI, so that their table, which
every task gets, has a fixed bound.

A task holds no more than VISITS pairs of a query and an annulus, sends their
rows on by SENT_ROWS, and scores SCORED queries of a block at a time, however
many vectors, queries and annuli there are. The second pass leaves out what is
below the k-th answer of the first, so most visits send nothing back.

Defined cases: null and non-finite vectors take no part, zero vectors do; equal
integer vectors are searched once and answer by smaller ids; ties go to smaller
ids; fewer than k other vectors give fewer rows; no vectors give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedloom.llm import vectors as V
from feedloom.llm.common import cut

PIVOTS, ANNULUS_ROWS, MAX_ANNULI, HOMES = 16, 2048, 65_536, 2
VISITS, SENT_ROWS, SCORED = 1 << 19, 2048, 256
SCALE = 256
SLACK = 1e-6


def search(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows with an id divisible by `every` the k highest integer inner products."""
    spark = df.sparkSession
    some = V.valid(df, zero=True).withColumn("vec", F.transform("vec", lambda x: F.floor(x * SCALE).cast("double")))
    items = cut(V.classes(some, k + 1))
    queries, asked = V.distinct_queries(some, every)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n, longest = items.agg(F.count("*"), F.max(square)).first()
    if not n or queries.isEmpty():
        return whole(V.answers(spark.createDataFrame([], "qid long, vec_id long, score double"), asked, k))

    def filled(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, longest - (x * x).sum(1)))[:, None]])

    pivots = filled(np.array([r.vec for r in items.orderBy(F.xxhash64("cid"), "cid").limit(PIVOTS).collect()]))

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T))

    def keyed(frames):
        for f in frames:
            d = distances(filled(V.matrix(f["vec"])))
            nearest = d.argmin(1)
            yield f.assign(pivot=nearest, d=d[np.arange(len(d)), nearest])

    index = cut(items.mapInPandas(keyed, "cid long, vec array<double>, members array<long>, pivot int, d double"))
    # Edges of the annuli: quantiles of the distances to each pivot.
    cuts = max(1, min(MAX_ANNULI // PIVOTS, math.ceil(n / (ANNULUS_ROWS * len(pivots)))))
    shares = [i / cuts for i in range(1, cuts)]
    quantiles = {r.pivot: r.e for r in index.groupBy("pivot").agg(F.percentile_approx("d", shares or [0.5], 1000).alias("e")).collect()}
    edges = {p: np.unique(np.array(e if shares else [], float)) for p, e in quantiles.items()}

    @F.arrow_udf("int")
    def ring(pivot: pa.Array, d: pa.Array) -> pa.Array:
        p, d = pivot.to_numpy(zero_copy_only=False), d.to_numpy(zero_copy_only=False)
        out = np.zeros(len(d), np.int32)
        for each in np.unique(p):
            out[p == each] = np.searchsorted(edges[int(each)], d[p == each])
        return pa.array(out, pa.int32())

    placed = index.withColumn("ring", ring("pivot", "d"))
    rings = placed.groupBy("pivot", "ring").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).orderBy("pivot", "ring").collect()
    ring_pivot, ring_no = np.array([r.pivot for r in rings]), np.array([r.ring for r in rings])
    lo, hi = np.array([r.lo for r in rings]), np.array([r.hi for r in rings])

    step = max(1, VISITS // len(rings))

    def sent(queries_of: DataFrame, first: bool) -> DataFrame:
        """Queries with the annuli that they visit: those around their own distance first, then all others that the bound leaves."""
        def run(batches):
            for part in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
                q = part["vec"].flatten().to_numpy().reshape(part.num_rows, -1)
                d = distances(np.hstack([q, np.zeros((len(q), 1))]))[:, ring_pivot]
                gap = np.maximum(0, np.maximum(lo[None, :] - d, d - hi[None, :]))
                home = np.zeros(gap.shape, bool)
                near = np.argsort(gap + 1e-9 * d, axis=1, kind="stable")[:, :HOMES]
                np.put_along_axis(home, near, True, axis=1)
                row, col = np.nonzero(home if first else ~home & (gap <= part["bound"].to_numpy()[:, None] + SLACK))
                own = d[row, col]
                for at in range(0, len(row), SENT_ROWS):
                    some = slice(at, at + SENT_ROWS)
                    yield pa.record_batch([*part.take(pa.array(row[some])).columns, pa.array(own[some]),
                                           pa.array(ring_pivot[col[some]], pa.int32()), pa.array(ring_no[col[some]], pa.int32())],
                                          [*part.schema.names, "own", "pivot", "ring"])

        return V.dealt(queries_of, "qid").mapInArrow(
            run, "qid long, vec array<double>, bound double, least double, own double, pivot int, ring int")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("d").reset_index(drop=True)
        x, d = V.matrix(left["vec"]), left["d"].to_numpy()
        column, longest_x, found = np.arange(len(d))[None, :], np.linalg.norm(x, axis=1).max(), []
        for at in range(0, len(right), SCORED):
            some = right.iloc[at:at + SCORED]
            q = V.matrix(some["vec"])
            scores = q @ x.T
            # Of the sorted annulus only distances within the bound of the query's own can win,
            bound, own = some["bound"].to_numpy() + SLACK, some["own"].to_numpy()
            start, stop = np.searchsorted(d, own - bound), np.searchsorted(d, own + bound, "right")
            scores[(column < start[:, None]) | (column >= stop[:, None])] = -np.inf
            # and of those only what is not below the k-th answer so far; both sums may be rounded.
            error = 2 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * longest_x
            scores[scores < (some["least"].to_numpy() - 2 * error)[:, None]] = -np.inf
            hit = np.flatnonzero((scores > -np.inf).any(1))
            found.append(V.best_members(left, some.iloc[hit], scores[hit], lambda r, cols: np.rint((x[cols] * q[hit[r]]).sum(1)), k + 1))
        return pd.concat(found, ignore_index=True)

    open_bound = queries.select("qid", "vec", F.lit(float("inf")).alias("bound"), F.lit(float("-inf")).alias("least"))
    near = cut(V.block_search(placed, sent(open_bound, True), ["pivot", "ring"], score, V.FOUND))
    kth = V.merged(near, k + 1).groupBy("qid").agg(F.min("score").alias("score"), F.count("*").alias("c"))
    # Squared distance is |q|^2 + longest - 2 * score. With fewer than k + 1 answers nothing is bounded yet.
    bound = F.sqrt(F.greatest(F.lit(0.0), square + F.lit(float(longest)) - 2 * F.col("score")))
    bounded = queries.join(kth, "qid", "left").select(
        "qid", "vec", F.when(F.col("c") > k, bound).otherwise(F.lit(float("inf"))).alias("bound"),
        F.when(F.col("c") > k, F.col("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    far = V.block_search(placed, sent(bounded, False), ["pivot", "ring"], score, V.FOUND)
    return whole(V.answers(V.merged(near.union(far), k + 1), asked, k))


def whole(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.col("score").cast("long"))
