"""Exact duplicates, found by counting quotient filters and settled by the bytes.

Texts are equal if they are identical after every run of white space has become
one space.

1. One pass over the texts writes a narrow row of each: a 64-bit fingerprint of
   the normalised text and its SHA-256.
2. Every partition builds counting quotient filters of its fingerprints, one
   per segment of the fingerprint space; the filters of a segment merge by
   their sorted remainders, with nothing lost. A fingerprint that counts one
   belongs to a text without a copy: its document is done.
3. Only texts whose fingerprint counts more are read again, and are grouped by
   fingerprint and whole text. What makes a group is thus equality of the
   bytes; copies within a partition meet before the shuffle, so a text with a
   third of all rows sends one row per partition.
4. The narrow rows learn their group by a join on fingerprint and SHA-256 that
   is salted, as a group may be large. If two different texts had both in
   common the query would end with an error.

Defined cases: a null text equals an empty one; a null doc_id is larger than
any other; of rows with the same doc_id and equal texts one stays; empty tables
give no rows; a text of any length is compared whole; further columns do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import cut, fresh, text_of
from feedloom.llm.quotient import Shape
from feedloom.operators.joins import keep_listed, lookup_join

#: Fingerprints of a segment and of a filter.
SEGMENT_KEYS, FILTER_KEYS = 1 << 20, 1 << 21
#: A list of repeated fingerprints is broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def fingerprint(text: Column) -> Column:
    """64 bits of a normalised text."""
    return F.xxhash64(text)


def shards(prints: DataFrame, shape: Shape) -> DataFrame:
    """(segment, filter): the counting quotient filters of each partition's fingerprints (one long column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def send() -> pa.RecordBatch:
            keys = np.concatenate(waiting).view(np.uint64)
            done = list(shape.filters(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([f for _, f in done], pa.binary())],
                                              ["segment", "filter"])

        for rows in batches:
            waiting.append(rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            held += rows.num_rows
            if held >= FILTER_KEYS:
                yield send()
                waiting, held = [], 0
        if held:
            yield send()

    return prints.mapInArrow(run, "segment int, filter binary")


def counts(prints: DataFrame, least: int = 1) -> DataFrame:
    """(fp, n): how often each fingerprint of a long column occurs, if at least `least` times. The column is read twice."""
    shape = Shape.of(64, prints.count(), SEGMENT_KEYS)

    def merged(filters: pa.Table) -> pa.Table:
        hi, lo, n = shape.merge(filters["segment"][0].as_py(), filters["filter"].to_pylist())
        often = n >= least
        return pa.table({"fp": pa.array((hi[often] << np.uint64(32) | lo[often]).view(np.int64)), "n": pa.array(n[often], pa.int64())})

    return shards(prints, shape).groupBy("segment").applyInArrow(merged, "fp long, n long")


def groups(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_sha256, keep_id, group_size, kept) of every row of (doc_id, text); `row` numbers the rows anew."""
    text = normalised(F.col("text"))
    read = docs.select("doc_id", text.alias("t"))
    narrow = cut(read.select("doc_id", fingerprint(F.col("t")).alias("fp"), F.sha2("t", 256).alias("sha"))
                 .withColumn("row", F.monotonically_increasing_id()))
    repeated = cut(counts(narrow.select("fp"), 2).select("fp"))
    again = keep_listed(read.withColumn("fp", fingerprint(F.col("t"))), repeated, "fp", BROADCAST_BYTES)
    found = again.groupBy("fp", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = found.where("group_size > 1").select(
        F.struct("fp", F.sha2("t", 256).alias("sha")).alias("key"), "keep_id", "group_size")
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("different texts with the same fingerprint and SHA-256")).cast("long"))
    found = cut(found.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.coalesce(one, F.min("group_size")).alias("group_size")))
    # The first row of each group; rows may repeat the doc_id and the text of the one that stays.
    smallest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    first = keep_listed(narrow, repeated, "fp", BROADCAST_BYTES).groupBy(F.struct("fp", "sha").alias("key")).agg(smallest.alias("first"))
    joined = lookup_join(narrow.withColumn("key", F.struct("fp", "sha")), found.join(first, "key"), "key", ["row"])
    alone = F.col("group_size").isNull()
    return joined.select("row", "doc_id", F.col("sha").alias("text_sha256"),
                         F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                         F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         (alone | (F.col("row") == F.col("first"))).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    key = fresh(docs.columns, "_key")
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256")
    gone = groups(docs.select("doc_id", "text")).where(~F.col("kept"))
    gone = cut(gone.select(named.alias(key), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("tied")).distinct())
    given = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(normalised(docs["text"]), 256)))
    rest = given.join(gone.where("tied"), key, "left_semi").dropDuplicates([key])
    return given.join(gone, key, "left_anti").unionByName(rest).drop(key)
