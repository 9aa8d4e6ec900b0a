"""What the operators of this subpackage share: input tables, words, lineage cuts, spans and a small label loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedloom.operators.joins import cut, shared_folder  # noqa: F401  (for the modules beside)

#: A word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and where each text starts and the last one ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which a word begins, in all texts of a batch."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    lo, hi = int(offsets[0]), int(offsets[-1])
    blank = space[data[lo:hi]]
    begins = np.empty(hi - lo, bool)
    begins[1:] = blank[:-1]
    first = offsets[:-1][offsets[:-1] < hi] - lo
    begins[first] = True
    begins &= ~blank
    return np.flatnonzero(begins) + lo


def word_count():
    """A column function: number of words of a text that is not null."""
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        at = np.searchsorted(word_starts(data, offsets), offsets)
        return pa.array(np.diff(at), pa.int64())

    return run


def fresh(taken: list[str], name: str) -> str:
    """`name`, with underscores in front until no column is called so (names compare without case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """`make` over the Arrow batches of `df`; rows stay in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of an undirected graph: `root` is the smallest node it can reach.

    `edges` has two long columns u and v. Large-star and small-star rounds in
    turn: each turns edges into stars around smaller nodes until nothing moves.
    A node with very many neighbours is no bottleneck: its minimum is summed up
    before the shuffle, and its edges meet that one row in a join that Spark
    can split. Nodes without an edge to another node are not returned.
    """
    edges = cut(edges.where("u <> v").selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v")
        small = large.selectExpr("greatest(u, v) AS u", "least(u, v) AS v")
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        joined = small.join(least, "u")
        edges = joined.selectExpr("v AS u", "m AS v").where("u <> v").union(least.selectExpr("u", "m AS v"))
        edges = cut(edges.selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def numbered(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """`df`, written to the shared folder, with numbers from `start` without gaps, in the order of its partitions.

    Rows are counted by partition, so only as many sums as there are partitions meet.
    """
    at, own, base = (fresh(df.columns, n) for n in ("_at", "_part", "_base"))
    done = cut(df.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), 33)
    sizes = done.groupBy(part.alias(own)).agg(F.count("*").alias(base))
    before = F.sum(base).over(Window.orderBy(own)) - F.col(base)
    bases = F.broadcast(sizes.select(own, before.alias(base)))
    return done.withColumn(own, part).join(bases, own).withColumn(
        name, F.col(base) + F.col(at).bitwiseAND((1 << 33) - 1) + start).drop(at, own, base)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
