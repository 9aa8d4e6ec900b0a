"""Join and lineage helpers that hold up against hot keys and lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SALTS = 256


def lookup_join(facts: DataFrame, dim: DataFrame, on: str, row_key: list[str], salts: int = SALTS,
                how: str = "left") -> DataFrame:
    """Join many rows to a table with one row per key, however hot a key is.

    The rows of a key are spread over `salts` groups by a hash of `row_key`.
    The other side is copied once per group that really occurs, so a key with
    one row costs one copy and a key with a third of all rows is split. Rows
    with a null key are spread as well.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.lit(salts)))
    groups = salted.select(on, "_salt").where(F.col(on).isNotNull()).distinct()
    return salted.join(dim.join(groups, on), [on, "_salt"], how).drop("_salt")


def lookup_wide(facts: DataFrame, dim: DataFrame, on: str, row_key: list[str], max_bytes: int = 64 << 20,
                most: int = SALTS) -> DataFrame:
    """The inner `lookup_join` of narrow rows to wide ones that stay where they are if that is cheap.

    The narrow rows are broadcast if their measured size is at most `max_bytes`
    and no key has more than `most` of them; else the wide rows move. `facts`
    is read twice: cut it if it is costly.
    """
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 24 for c in facts.columns), F.lit(0))
    keys = facts.groupBy(on).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    total, hottest = keys.agg(F.sum("bytes"), F.max("rows")).first()
    if (total or 0) <= max_bytes and (hottest or 0) <= most:
        return dim.join(F.broadcast(facts), on)
    return lookup_join(facts, dim, on, row_key, how="inner")


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, which all executors share.

    Only a local session may do without: it gets a temporary folder, as its
    tasks share the disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000000


def keep_listed(big: DataFrame, keys: DataFrame, on: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Rows of `big` whose key is listed (a semi join).

    The list is broadcast only if its measured size is at most `max_bytes`, so
    `big` is then not shuffled. The list is read twice: cut it if it is costly.
    """
    listed = keys.select(on).where(F.col(on).isNotNull()).distinct()
    size = listed.agg(F.sum(F.octet_length(on) + 64)).first()[0] or 0
    return big.join(F.broadcast(listed) if size <= max_bytes else listed, on, "left_semi")


def spread_small(df: DataFrame, bytes_per_core: int = 16 << 20) -> DataFrame:
    """Spread an input that is small for the cluster over all cores before heavy per-row work.

    A small file is one task however much work its rows are. Above the limit
    the scan's own splits already keep every core busy, so nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_per_core else df
