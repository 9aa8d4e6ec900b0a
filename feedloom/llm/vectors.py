"""What the vector searches share: valid vectors, classes of equal vectors, and scoring one block against its queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.llm.common import cut

#: Rows of a group that one task holds at once.
BLOCK_ROWS = 4096


def valid(df: DataFrame, zero: bool = False) -> DataFrame:
    """(vec_id, vec) of the vectors that take part: doubles, all finite; all-zero ones only if `zero`.

    Repeated rows count once. Vectors of another length than most don't fit and take no part.
    """
    vec = F.col("embedding").cast("array<double>")
    some = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where((F.size("vec") > 0) & finite("vec"))
    if not zero:
        some = some.where(F.exists("vec", lambda x: x != 0))
    length = some.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return some.where(F.size("vec") == (length.n if length else 0))


def finite(vec: str) -> Column:
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(cid, vec, members): each different vector once, with its `keep` smallest ids.

    Rows of equal vectors tie, and ties go to smaller ids: of any number of
    them no more than `keep` can be among the first `keep`. Only these pass the
    shuffle, as the limit by rank is applied before it. Repeated rows go first,
    as they would take the place of other ids.
    """
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    some = vectors.select("vec_id", "vec").distinct().withColumn("r", rank).where(F.col("r") <= keep)
    return some.groupBy("vec").agg(F.array_sort(F.array_distinct(F.collect_list("vec_id"))).alias("members")).select(
        F.col("members")[0].alias("cid"), "vec", "members")


def distinct_queries(vectors: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """(qid, vec) of the different query vectors, and (query_id, qid) of all queries."""
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    distinct = cut(asked.groupBy("vec").agg(F.min("vec_id").alias("qid")))
    return distinct.select("qid", "vec"), asked.join(distinct, "vec").select(F.col("vec_id").alias("query_id"), "qid").distinct()


def top(scores: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Which values of each row are the k largest or tie with the last of them, `slack` (a row's) below it included."""
    usable = scores > -np.inf
    if scores.shape[1] <= k:
        return usable
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    return usable & (scores >= (kth - slack)[:, None])


def block_search(items: DataFrame, queries: DataFrame, on: list[str], score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                 schema: str) -> DataFrame:
    """`score(items, queries)` for each group of `on`, in parts of bounded size on both sides.

    A group with many rows is split by a hash into parts of about BLOCK_ROWS,
    and so are its queries; every part of one meets every part of the other.
    """
    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))

    plan = parts(items, "ni").join(parts(queries, "nq"), on)
    here = items.join(plan, on).withColumn("i", F.pmod(F.xxhash64("cid"), "ni").cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("ni", "nq")
    there = queries.join(plan, on).withColumn("q", F.pmod(F.xxhash64("qid"), "nq").cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).drop("ni", "nq")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in schema.split(", ")})
        return score(left, right)

    return here.groupBy(*on, "i", "q").cogroup(there.groupBy(*on, "i", "q")).applyInPandas(run, schema)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


FOUND = "qid long, ids array<long>, scores array<double>"


def best_members(items: pd.DataFrame, queries: pd.DataFrame, scores: np.ndarray, exact: Callable, keep: int,
                 error: np.ndarray | float = 0.0) -> pd.DataFrame:
    """One row per query: the `keep` best ids of this block; `exact(query row, item rows)` gives the scores to keep.

    `scores` differ from those by at most `error` (one number per query).
    """
    chosen = top(scores, keep, 2 * np.broadcast_to(error, len(queries)))
    members = items["members"].tolist()
    alone = all(len(m) == 1 for m in members)
    ids = np.array([m[0] for m in members], np.int64)
    out_v, out_s = [], []
    for r in range(len(queries)):
        cols = np.flatnonzero(chosen[r])
        found, own = exact(r, cols), ids[cols]
        if not alone:
            times = [len(members[c]) for c in cols]
            found, own = np.repeat(found, times), np.array([m for c in cols for m in members[c]], np.int64)
        order = np.lexsort((own, -found))[:keep]
        out_v.append(own[order])
        out_s.append(found[order])
    return pd.DataFrame({"qid": queries["qid"].to_numpy(), "ids": pd.Series(out_v, dtype=object), "scores": pd.Series(out_s, dtype=object)})


def merged(found: DataFrame, keep: int) -> DataFrame:
    """(qid, vec_id, score): the `keep` best of what a query's blocks found, ties to smaller ids.

    A query has one short row for each block that it visited.
    """
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        ids, scores = np.concatenate(rows["ids"].tolist()), np.concatenate(rows["scores"].tolist())
        ids, first = np.unique(ids, return_index=True)
        scores = scores[first]
        order = np.lexsort((ids, -scores))[:keep]
        return pd.DataFrame({"qid": rows["qid"].iloc[0], "vec_id": ids[order].astype(np.int64), "score": scores[order].astype(float)})

    return found.groupBy("qid").applyInPandas(merge, "qid long, vec_id long, score double")


def answers(first: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from the merged rows of the different queries: own row out, k stay."""
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asked.join(first, "qid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(per_query)).where(
        F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """`df` over as many tasks as a shuffle has, for work that is heavy for its few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
