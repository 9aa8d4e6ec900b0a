"""The response store as a table of captures: freshness, revalidation, newest capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.constants import PERMANENT_SECONDS, STORE_SIZE
from feedloom.operators.joins import cut, lookup_join, seconds_between


def cache_directives(headers: Column) -> Column:
    """Items of cache-control and pragma, in that order."""
    both = F.concat_ws(",", headers["cache-control"], headers["pragma"])
    return F.filter(F.transform(F.regexp_extract_all(both, F.lit(r'((?:[^,"]|"[^"]*")+)'), F.lit(1)), lambda d: F.trim(d)),
                    lambda d: d != "")


def has_directive(headers: Column, *names: str) -> Column:
    return F.arrays_overlap(cache_directives(headers), F.array(*[F.lit(n) for n in names]))


def max_age(headers: Column) -> Column:
    """Seconds of the last max-age, null if missing or not a number."""
    value = F.try_element_at(F.filter(cache_directives(headers), lambda d: d.startswith("max-age=")), F.lit(-1))
    return F.regexp_replace(F.substr(value, F.lit(9)), r'^"(.*)"$', "$1").try_cast("bigint")


def cache_decision(responses: DataFrame, now, policy: str | None = None, force_min: int | None = None,
                   force_max: int | None = None, privacy: str = "private",
                   wanted: DataFrame | None = None) -> DataFrame:
    """url, decision (`use`, `fetch` or `conflict`) for the newest capture of each URL.

    `wanted` (url) adds URLs that may have no capture. `now` is a timestamp.
    The first rule that applies wins.
    """
    assert force_min is None or force_max is None or force_max >= force_min
    store = newest(responses.select("url", "code", "headers", "fetched_at"),
                    F.col("code"), F.to_json("headers"))
    table = store if wanted is None else wanted.select("url").distinct().join(store, "url", "left")
    headers, age = F.col("headers"), seconds_between(F.col("fetched_at"), F.lit(now).cast("timestamp"))
    absent = F.col("fetched_at").isNull()
    never = F.lit(False)
    rules = [
        (F.lit(privacy == "public") & ~absent & has_directive(headers, "private"), "fetch"),
        (F.lit(policy == "offline") & absent, "conflict"),
        (F.lit(policy in ("offline", "cached")) & ~absent, "use"),
        (F.lit(policy == "refresh") | absent, "fetch"),
        (never if force_max is None else age > force_max, "fetch"),
        (never if force_min is None else age < force_min, "use"),
        ((F.col("code") == 301) & (age < PERMANENT_SECONDS), "use"),
        (never if force_min is not None else has_directive(headers, "no-cache", "no-store"), "fetch"),
        (max_age(headers) > age, "use"),
    ]
    decision = F.when(rules[0][0], rules[0][1])
    for condition, result in rules[1:]:
        decision = decision.when(condition, result)
    return table.select("url", decision.otherwise("fetch").alias("decision"))


def cacheable(responses: DataFrame, force_min: int | None = None, privacy: str = "private") -> DataFrame:
    """Drop responses their server forbids to store, unless `force_min` is set."""
    if force_min is not None:
        return responses
    names = ["no-cache", "no-store"] + (["private"] if privacy == "public" else [])
    return responses.where(~has_directive(F.col("headers"), *names))


def revalidation_headers(responses: DataFrame) -> DataFrame:
    """Conditional request headers per URL: url, if_none_match, if_modified_since."""
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    return responses.where(etag.isNotNull() | modified.isNotNull()).select(
        "url", etag.alias("if_none_match"), modified.alias("if_modified_since"))


def tie_break() -> list[Column]:
    return [F.col("code"), F.length("body"), F.xxhash64("body", "msg")]


def newest(responses: DataFrame, *ties: Column) -> DataFrame:
    order = Window.partitionBy("url").orderBy(F.desc("fetched_at"), *ties)
    return responses.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_response(responses: DataFrame, as_of=None) -> DataFrame:
    """Newest capture per URL, optionally at an instant.

    `row_number() = 1` lets Spark keep one row per URL and task before the
    shuffle, so a URL captured very often stays cheap.
    """
    seen = responses if as_of is None else responses.where(F.col("fetched_at") <= F.lit(as_of).cast("timestamp"))
    return newest(seen, *tie_break())


def _listed(rows: DataFrame, places: DataFrame, how: str, broadcast_bytes: int) -> DataFrame:
    """`rows` joined to `places` (url, fetched_at, ...), which are broadcast if their measured size is small."""
    size = places.agg(F.sum(F.octet_length("url") + 80)).first()[0] or 0
    return rows.join(F.broadcast(places) if size <= broadcast_bytes else places, ["url", "fetched_at"], how)


def merge_304(responses: DataFrame, partitions: int | None = None, broadcast_bytes: int = 64 << 20, hot: int = 10_000) -> DataFrame:
    """A 304 takes code, message, headers, body and time of the last full capture of its URL.

    Adds `revalidated_at`, the time of the 304. An as-of search on keys alone:
    (url, time) is range-partitioned, each task carries the last full capture
    along, and what a URL brings from earlier tasks is summed up per task, so
    that a URL with most of all captures spans many tasks. Bodies then meet the
    304s once: not shuffled at all if the list of 304s is small, else by one
    join, apart from captures that more than `hot` 304s confirm, whose rows are
    salted. Of full captures of one instant the first by code, size and hash counts.
    """
    n = partitions or int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = responses.select("url", "fetched_at", (F.col("code") == 304).alias("_empty")).where("_empty IS NOT NULL")
    placed = cut(keys.groupBy("url", "fetched_at", "_empty").agg(F.count("*").alias("_rows"))
                 .repartitionByRange(n, "url", "fetched_at", "_empty").withColumn("_part", F.spark_partition_id()))
    full_at = F.when(~F.col("_empty"), F.col("fetched_at"))
    inside = Window.partitionBy("url", "_part").orderBy("fetched_at", "_empty").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("url").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy("url", "_part").agg(F.max(full_at).alias("_full"))
             .withColumn("_before", F.max("_full").over(before)).drop("_full"))
    marked = cut(placed.withColumn("_inside", F.last(full_at, ignorenulls=True).over(inside)).where("_empty")
                 .join(parts, ["url", "_part"]).select("url", F.col("fetched_at").alias("revalidated_at"), "_rows",
                                                       F.coalesce("_inside", "_before").alias("_at")))
    full = responses.where("code <> 304")
    sources, ties = full, placed.where("NOT _empty AND _rows > 1").select("url", "fetched_at")
    if not ties.isEmpty():
        one = Window.partitionBy("url", "fetched_at").orderBy(*tie_break())
        first = _listed(full, ties, "left_semi", broadcast_bytes).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
        sources = _listed(full, ties, "left_anti", broadcast_bytes).unionByName(first)
    wanted = marked.where("_at IS NOT NULL").select(
        "url", F.col("_at").alias("fetched_at"), "revalidated_at", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_copy")).drop("_copy")
    size = wanted.agg(F.sum(F.octet_length("url") + 80)).first()[0] or 0
    if size <= broadcast_bytes:
        merged = sources.join(F.broadcast(wanted), ["url", "fetched_at"])
    else:
        often = cut(wanted.groupBy("url", "fetched_at").count().where(F.col("count") > hot).drop("count"))
        merged = sources.join(_listed(wanted, often, "left_anti", broadcast_bytes), ["url", "fetched_at"])
        if not often.isEmpty():
            key = F.struct("url", "fetched_at").alias("_key")
            copies = _listed(sources, often, "left_semi", broadcast_bytes).select("*", key)
            many = _listed(wanted, often, "left_semi", broadcast_bytes).select(key, "revalidated_at")
            merged = merged.unionByName(lookup_join(many, copies, "_key", ["revalidated_at"], how="inner").drop("_key"))
    alone = marked.where("_at IS NULL").select("url", F.col("revalidated_at").alias("fetched_at"))
    orphans = _listed(responses.where("code = 304"), alone, "left_semi", broadcast_bytes)
    never = F.lit(None).cast("timestamp")
    return (full.withColumn("revalidated_at", never)
            .unionByName(merged).unionByName(orphans.withColumn("revalidated_at", never)))


def trim_store(responses: DataFrame, n: int = STORE_SIZE) -> DataFrame:
    """The `n` most recently written URLs (a top-n, ties by URL); a negative `n` keeps all."""
    newest = latest_response(responses)
    return newest if n < 0 else newest.orderBy(F.desc("fetched_at"), "url").limit(n)
