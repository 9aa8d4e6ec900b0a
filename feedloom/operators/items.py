"""Items: repair of titles and links, processing order, caps, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.constants import LIM_ITEM, MAX_ITEM
from feedloom.functions.text import fix_title, unescape_basic
from feedloom.functions.urls import absolute_url, decode_portal, unwrap_tracking
from feedloom.operators.joins import cut

_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_WIKIPEDIA = r"(?s)^http.*://.*\.wikipedia\.org/w/api\.php..*&feedformat=atom$"


# --- repair ------------------------------------------------------------------------------
def fix_titles(items: DataFrame) -> DataFrame:
    return items.withColumn("title", fix_title(F.col("title")))


def first_href(html: Column) -> Column:
    """First `<a href>` of a fragment, null if there is none."""
    found = F.concat(*[F.regexp_extract(html, _HREF, g) for g in (1, 2, 3)])
    return F.nullif(unescape_basic(found), F.lit(""))


def _has_link(link: Column) -> Column:
    return F.coalesce(link != "", F.lit(False))


def first_link(items: DataFrame) -> DataFrame:
    """The link becomes the first one of desc, or of content if there is no desc."""
    source = F.coalesce(F.nullif("desc", F.lit("")), F.col("content"))
    return items.withColumn("link", F.when(
        _has_link(F.col("link")), F.coalesce(first_href(source), F.col("link"))).otherwise(F.col("link")))


def wikipedia_link(items: DataFrame, feed_url: str = "feed_url") -> DataFrame:
    """Wikipedia's daily feed: the first link right inside bold text of desc."""
    bold = F.regexp_extract(F.col("desc"), r"(?is)<b(?:\s[^>]*)?>[^<]*(<a\s[^>]*href[^>]*>)", 1)
    hit = _has_link(F.col("link")) & F.col(feed_url).rlike(_WIKIPEDIA)
    return items.withColumn("link", F.when(hit, F.coalesce(first_href(bold), F.col("link"))).otherwise(F.col("link")))


def reddit_link(items: DataFrame, feed_url: str = "feed_url") -> DataFrame:
    """Reddit: the link whose text is `[link]` in content."""
    anchor = F.regexp_extract(F.col("content"), r"(?is)(<a\s[^>]*>)\[link\]</a>", 1)
    hit = _has_link(F.col("link")) & F.col(feed_url).rlike(r"^[a-z]+://www\.reddit\.com(?:[/?#]|$)")
    return items.withColumn("link", F.when(
        hit, F.coalesce(first_href(anchor), F.col("link"))).otherwise(F.col("link")))


def site_link(items: DataFrame, feed_url: str = "feed_url") -> DataFrame:
    """Both site-specific links; the Wikipedia step runs first."""
    return reddit_link(wikipedia_link(items, feed_url), feed_url)


def absolute_item_links(items: DataFrame, feed_url: str = "feed_url") -> DataFrame:
    link = F.col("link")
    return items.withColumn("link", F.when(_has_link(link), absolute_url(F.col(feed_url), link)).otherwise(link))


def unwrap_links(items: DataFrame) -> DataFrame:
    return items.withColumn("link", unwrap_tracking(F.col("link")))


def deobfuscate_link(items: DataFrame) -> DataFrame:
    """FeedBurner's original link replaces the link, then feedsportal links are decoded."""
    link = F.when(_has_link(F.col("link")), F.coalesce(F.nullif("orig_link", F.lit("")), F.col("link"))) \
        .otherwise(F.col("link"))
    return items.withColumn("link", decode_portal(link))


def fix_items(items: DataFrame, feed_url: str = "feed_url", firstlink: bool = False) -> DataFrame:
    """All repairs, in order. Items without a link only get their title fixed."""
    fixed = wikipedia_link(fix_titles(items), feed_url)
    fixed = first_link(fixed) if firstlink else fixed
    fixed = deobfuscate_link(unwrap_links(absolute_item_links(fixed, feed_url)))
    return reddit_link(fixed, feed_url)


# --- order and caps ---------------------------------------------------------------------------
def _sort_keys(order: str, now) -> list[Column]:
    when = F.coalesce("updated", "time", F.lit(now).cast("timestamp"))
    return {"first": [F.asc("pos")], "last": [F.desc("pos")],
            "oldest": [when.asc(), F.asc("pos")], "newest": [when.desc(), F.desc("pos")]}[order]


def rank_items(items: DataFrame, order: str = "first", now=None, limit: int | None = None) -> DataFrame:
    """Add `rank`, the 1-based processing position of each item in its feed.

    With `limit` only ranks up to it are kept, which Spark applies before the
    shuffle, so a feed of any size stays cheap. Without one `rank_all_items`
    spreads a large feed over many tasks.
    """
    if limit is None:
        return rank_all_items(items, order, now)
    per_feed = Window.partitionBy("feed_id").orderBy(*_sort_keys(order, now))
    return items.withColumn("rank", F.row_number().over(per_feed)).where(F.col("rank") <= limit)


def rank_all_items(items: DataFrame, order: str = "first", now=None, partitions: int | None = None,
                   broadcast_bytes: int = 64 << 20) -> DataFrame:
    """`rank_items` without a limit for feeds of any size.

    Only keys are sorted: (feed, time, position) is range-partitioned, so a
    huge feed spans many tasks, and a key's rank is its place in the task plus
    the rows of its feed in the tasks before. The items then get their ranks
    by a join, which moves them once, or not at all if the measured size of the ranks allows
    a broadcast. Items without a feed are ranked as one feed; rows that repeat
    a key are numbered in any order, and only they are brought together.
    """
    at = F.coalesce("updated", "time", F.lit(now).cast("timestamp")) if order in ("oldest", "newest") else F.lit(None).cast("timestamp")
    down = order in ("last", "newest")
    key = ["_feed", "_at", "_pos"]
    sort = [F.col(c).desc() if down else F.col(c).asc() for c in ("_at", "_pos")]
    n = partitions or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = items.select(F.col("feed_id").alias("_feed"), at.alias("_at"), F.col("pos").alias("_pos")).groupBy(*key).agg(F.count("*").alias("_rows"))
    placed = cut(keys.repartitionByRange(n, F.col("_feed"), *sort).withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_upto", F.sum("_rows").over(Window.partitionBy("_feed", "_part").orderBy(*sort)))
    before = Window.partitionBy("_f").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy(F.col("_feed").alias("_f"), F.col("_part").alias("_in")).agg(F.sum("_rows").alias("_own"))
              .withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0))).drop("_own"))
    same = local["_feed"].eqNullSafe(starts["_f"]) & (local["_part"] == starts["_in"])
    ranks = local.join(starts, same).select(*key, "_rows", (F.col("_upto") - F.col("_rows") + F.col("_before") + 1).cast("int").alias("rank"))
    size = placed.agg(F.sum(F.coalesce(F.octet_length("_feed"), F.lit(0)) + 80), F.max("_rows")).first()
    ranks = F.broadcast(ranks) if (size[0] or 0) <= broadcast_bytes else ranks
    ranked = items.withColumn("_when", at)
    matched = ranked["feed_id"].eqNullSafe(ranks["_feed"]) & ranked["_when"].eqNullSafe(ranks["_at"]) & ranked["pos"].eqNullSafe(ranks["_pos"])
    ranked = ranked.join(ranks, matched)
    if (size[1] or 0) > 1:
        again = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) - 1
        ranked = ranked.where("_rows = 1").unionByName(ranked.where("_rows > 1").withColumn("rank", F.col("rank") + again))
    return ranked.select(*items.columns, "rank")


def hard_cap(items: DataFrame, order: str = "first", now=None, lim_item: int = LIM_ITEM) -> DataFrame:
    """Keep the first `lim_item` items of each feed in processing order, with their rank.

    A negative limit keeps everything and ranks it.
    """
    return rank_all_items(items, order, now) if lim_item < 0 else rank_items(items, order, now, lim_item)


def search_title(items: DataFrame, text: str) -> DataFrame:
    """Items whose title contains the text, case-sensitive."""
    return items.where(F.col("title").contains(text))


def soft_cap(items: DataFrame, max_item: int = MAX_ITEM, cache: bool = False) -> DataFrame:
    """Add `store_only`: past the soft cap an item is filled from the store only.

    A negative `max_item` means no soft cap; `cache` makes every item store-only.
    """
    beyond = F.lit(True) if cache else F.lit(False) if max_item < 0 else F.col("rank") > max_item
    return items.withColumn("store_only", beyond)
