"""Mixing sources to target weights by nested hash thresholds.

A source's target says how many words the mix takes from it. Every document
is taken `floor(target / size of its source)` times, and once more if its hash
lies below the source's threshold. The threshold comes from histograms: words
are summed by source and hash bucket, a running sum finds the bucket in which
the budget ends, and only the rows of that boundary bucket are summed again by
finer buckets, until it holds a single hash. Nothing is sorted by row, and the
choice is a filter, so that a mix with a larger budget holds that of a smaller.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; documents with the same doc_id and text share a hash and are
taken alike; a source of size 0 has target 0; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.llm.common import cut, fresh, text_of, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Hashes have 52 bits and are looked at 13 bits at a time.
STEP, LEVELS = 13, 4
#: So many sources at most are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Number of words."""
    return word_count()(text_of(text))


def hash_of(doc_id: Column, text: Column) -> Column:
    """52 bits that depend on the row alone, so that reruns agree."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_of(text)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """Adds `target` to a table (source, source_size) with one row per source.

    Sources in code point order, null last, have `weights` in turn. A target
    stops at `most` times the source's size; what is over goes to the others by
    weight: sorted by size per weight, the stopped sources are a prefix.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                   ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = weighted.withColumn("level", left / weight).withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    level = level.withColumn("rest", F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("at"), "level")))
                             .over(whole)["level"])
    return level.select("source", "source_size",
                        F.when(F.col("free"), F.least("cap", F.col("rest") * F.col("w"))).otherwise(F.col("cap")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, times, below): copies of every document, and the hash below which one more.

    `sized` has source, size and h. Each level works on narrow rows of the
    boundary buckets only, and has at most 2^13 sums per source.
    """
    goals = goals.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                             .otherwise(F.lit(0)).cast("long"))
    state = goals.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")) \
        .withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.col("budget") > 0).withColumn("below", F.lit(0).cast("long"))
    few = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    for level in range(LEVELS):
        bucket = F.shiftright("h", STEP * (LEVELS - 1 - level))
        near = sized
        if level:
            waiting = state.where("open").select(F.col("source").alias("s"), "prefix")
            near = sized.join(F.broadcast(waiting) if few else waiting, sized["source"].eqNullSafe(waiting["s"])
                              & (F.shiftright(bucket, STEP) == waiting["prefix"]), "left_semi")
        sums = near.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        budgets = state.select(F.col("source").alias("s"), "budget")
        sums = sums.join(F.broadcast(budgets) if few else budgets, sums["source"].eqNullSafe(budgets["s"])).drop("s")
        line = Window.partitionBy("source").orderBy("bucket")
        running = sums.withColumn("upto", F.sum("words").over(line))
        edge = running.where("upto >= budget").groupBy("source").agg(F.min(F.struct("bucket", "words", "upto", "lo", "hi")).alias("e"))
        found = edge.select(F.col("source").alias("s"), "e.*")
        state = state.join(found, state["source"].eqNullSafe(found["s"]), "left").drop("s")
        rest = F.col("budget") - (F.col("upto") - F.col("words"))
        one = F.col("lo") == F.col("hi")
        after = F.when(rest * 2 >= F.col("words"), F.col("hi") + 1).otherwise(F.col("lo"))
        hit = F.col("open") & F.col("bucket").isNotNull()
        state = state.select(
            "source", "source_size", "target", "times",
            F.when(hit & ~one, rest).otherwise(F.col("budget")).alias("budget"),
            F.when(hit & ~one, F.col("bucket")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(hit & one, after).when(F.col("open") & F.col("bucket").isNull(), F.lit((1 << 52) + 1))
            .otherwise(F.col("below")).alias("below"),
            (hit & ~one).alias("open"))
        state = cut(state)
        if level < LEVELS - 1 and state.where("open").isEmpty():
            break
    return state.select("source", "source_size", "target", "times", "below")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """`docs` with size, source_size, target and copies, the times that the mix takes the document.

    Columns of `docs` with these names keep their names; the new ones then get
    underscores in front.
    """
    names = {c: fresh(docs.columns, c) for c in ("size", "source_size", "target", "copies")}
    own = {c: fresh(docs.columns, c) for c in ("_h", "_times", "_below", "_source")}
    hashed = hash_of(docs["doc_id"], docs["text"])
    sized = cut(docs.select("source", size_of(docs["text"]).alias("size"), hashed.alias("h")))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    found = thresholds(sized, goals)
    found = found.select(F.col("source").alias(own["_source"]), F.col("source_size").alias(names["source_size"]),
                         F.col("target").alias(names["target"]), F.col("times").alias(own["_times"]),
                         F.col("below").alias(own["_below"]))
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    joined = docs.withColumn(names["size"], size_of(docs["text"])).withColumn(own["_h"], hashed)
    joined = joined.join(found, joined["source"].eqNullSafe(found[own["_source"]]), "left")
    copies = (F.col(own["_times"]) + (F.col(own["_h"]) < F.col(own["_below"])).cast("long")).cast("long")
    return joined.withColumn(names["copies"], copies).drop(*own.values())


def taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each document as many times as it is taken, with the columns of `docs`."""
    copies = fresh(docs.columns, "copies")
    mixed = mix(docs, **options).where(F.col(copies) > 0)
    return mixed.withColumn(fresh(mixed.columns, "_copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
