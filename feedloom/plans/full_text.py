"""The whole job: captured responses and wanted feeds in, full-text feeds out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from feedloom.constants import LIM_ITEM, MAX_HOPS, MAX_ITEM
from feedloom.functions.urls import sanitize_url
from feedloom.operators import exports, feeds as dialects, fill, items as repair
from feedloom.operators.joins import cut, keep_listed, lookup_join, lookup_wide
from feedloom.operators.redirects import next_url
from feedloom.operators.responses import apply_http_equiv, decode_bodies, is_ok
from feedloom.operators.store import latest_response
from feedloom.sources.archive import Archive, newest_rows
from feedloom.sources.rules import Rule


#: A list of places or addresses is broadcast up to so many bytes.
LISTED_BYTES = 64 << 20


def readable(captures: DataFrame) -> DataFrame:
    """Captures with decoded text and the headers pages give themselves; of the bytes only their number stays."""
    done = apply_http_equiv(decode_bodies(captures))
    return done.withColumn("data_bytes", F.length("data")).drop("data")


class Heads:
    """Captures as a table: addresses are followed on url, fetched_at, code and headers as far as that goes."""

    def __init__(self, captures: DataFrame):
        self.captures = captures

    def look(self, asked: DataFrame, follow: str | None) -> DataFrame:
        """(url, code, target, pending, ...) of the newest capture of each asked URL (distinct) that has one.

        No body is read: `pending` says that only the page tells (a 2xx page,
        or several captures of the same instant and code).
        """
        narrow = keep_listed(self.captures.select("url", "fetched_at", "code", "headers"), asked, "url", LISTED_BYTES)
        first = Window.partitionBy("url").orderBy(F.desc("fetched_at"), "code")
        ranked = narrow.withColumn("_n", F.rank().over(first)).where("_n = 1")
        heads = ranked.groupBy("url").agg(F.first("fetched_at").alias("fetched_at"), F.first("code").alias("code"),
                                          F.first("headers").alias("headers"), F.count("*").alias("same"))
        pending = (F.col("same") > 1) | F.coalesce(is_ok(F.col("code")), F.lit(False))
        return heads.withColumn("pending", pending).withColumn("target", F.when(~pending, next_url()))

    def read(self, heads: DataFrame, follow: str | None) -> DataFrame:
        """The pages of pending `heads` with their `target`, read in one scan; a shuffle only to settle ties."""
        places = heads.select("url", "fetched_at").withColumn("_at", F.col("fetched_at"))
        size = places.agg(F.sum(F.octet_length("url") + 80)).first()[0] or 0
        places = F.broadcast(places) if size <= LISTED_BYTES else places
        found = self.captures.join(places.select("url", "fetched_at"), ["url", "fetched_at"], "left_semi")
        if not heads.where("same > 1").isEmpty():
            found = latest_response(found)
        return readable(found).withColumn("target", next_url(follow))


class Indexed:
    """An archive: addresses are followed on its index alone, and the pages at the ends are read once."""

    def __init__(self, archive: Archive):
        self.archive = archive

    def look(self, asked: DataFrame, follow: str | None) -> DataFrame:
        rows = keep_listed(self.archive.index.where("code <> 304"), asked, "url", LISTED_BYTES)
        target = F.col(f"target_{follow}" if follow else "target")
        return newest_rows(rows).select("url", "code", target.alias("target"), F.lit(False).alias("pending"), "file", "row")

    def read(self, heads: DataFrame, follow: str | None) -> DataFrame:
        return readable(self.archive.fetch(heads)).withColumn("target", F.lit(None).cast("string"))


def look_up(wanted: DataFrame, captures: DataFrame | Archive, follow: str | None = None,
            max_hops: int = MAX_HOPS) -> tuple[DataFrame, DataFrame]:
    """Follow wanted URLs: (url, final_url) of each, and (url, final_url, code, headers, text, data_bytes) at the ends.

    Chains go on hop by hop on narrow rows of the addresses reached so far.
    Pages are read when no chain moves without them: with a table of captures
    once for each time that pages themselves lead on, with an archive once at
    the end. An address that leads back to one of its chain, or on after
    `max_hops`, has no end.
    """
    source = Indexed(captures) if isinstance(captures, Archive) else Heads(captures)
    asked = wanted.select("url").where(F.col("url").isNotNull()).distinct()
    moving = cut(asked.select("url", F.col("url").alias("current"), F.array("url").alias("_seen")))
    known = parked = ends = pages = None
    kept = ["url", "code", "headers", "text", "data_bytes"]
    while True:
        todo = moving.select(F.col("current").alias("url")).distinct()
        if known is not None:
            todo = todo.join(known.select("url"), "url", "left_anti")
        todo = cut(todo)
        if known is None or not todo.isEmpty():
            heads = source.look(todo, follow)
            known = cut(heads if known is None else known.unionByName(heads))
        joined = cut(lookup_join(moving, known.select(F.col("url").alias("current"), "target", "pending"), "current", ["url"]))
        waits = F.coalesce("pending", F.lit(False))
        ended = joined.where(F.col("target").isNull() & ~waits).select("url", F.col("current").alias("final_url"))
        ends = ended if ends is None else ends.unionByName(ended)
        waiting = joined.where(waits).select("url", "current", "_seen")
        parked = waiting if parked is None else parked.unionByName(waiting)
        moving = joined.where(F.col("target").isNotNull() & ~F.array_contains("_seen", F.col("target")) & (F.size("_seen") <= max_hops)).select(
            "url", F.col("target").alias("current"), F.array_append("_seen", F.col("target")).alias("_seen"))
        if moving.isEmpty():
            if parked.isEmpty():
                break
            read = cut(source.read(known.where("pending"), follow).select(*kept, "target"))
            done = read.where("target IS NULL").select(*kept)
            pages = done if pages is None else pages.unionByName(done)
            told = read.select("url", F.col("code").alias("_code"), F.col("target").alias("_told"))
            known = cut(known.join(told, "url", "left").withColumns({
                "target": F.coalesce("target", "_told"), "pending": F.lit(False)}).drop("_code", "_told"))
            moving, parked = parked, None
    last = known.join(ends.select(F.col("final_url").alias("url")).distinct(), "url", "left_semi").where("target IS NULL")
    if isinstance(source, Indexed):
        pages = cut(source.read(cut(last.where(is_ok(F.col("code"))).select("file", "row")), follow).select(*kept))
    blank = {"headers": "map<string,string>", "text": "string", "data_bytes": "int"}
    others = last.select("url", "code", *[F.lit(None).cast(kind).alias(c) for c, kind in blank.items()])
    if pages is not None:
        others = others.join(pages.select("url"), "url", "left_anti")
        others = pages.unionByName(others)
    return ends, others.withColumn("final_url", F.col("url"))


def full_text_feed(responses: DataFrame | Archive, wanted: DataFrame, now, *, order: str = "first", search: str | None = None,
                   lim_item: int = LIM_ITEM, max_item: int = MAX_ITEM, cache: bool = False, proxy: bool = False,
                   firstlink: bool = False, resolve: bool = False, clip: bool = False, nolink: bool = False,
                   noref: bool = False, rule: Rule | None = None, selector=None) -> tuple[DataFrame, DataFrame]:
    """Full-text feeds for `wanted` (feed_id, feed_url): returns (feeds, items).

    `responses` is a table of captures, or an archive of them, whose pages are read once they are chosen.
    Feed addresses follow redirects and announced feeds; item pages follow
    redirects. The options are those of the operators they switch on. `rule`
    replaces dialect detection; `selector` names the article's element.
    """
    # The response in force is the newest full capture: a 304 only confirms it.
    captures = responses if isinstance(responses, Archive) else responses.where(F.col("code") != 304)

    asked = wanted.select("feed_id", F.col("feed_url").alias("asked_url"),
                          sanitize_url(F.col("feed_url")).alias("url"))
    ends, found = look_up(asked, captures, None if rule else "rss")
    found = found.where(is_ok(F.col("code"))).select(F.col("final_url").alias("feed_url"), "text")
    docs = cut(lookup_join(asked, ends, "url", ["feed_id"], how="inner").select(
        "feed_id", "asked_url", F.col("final_url").alias("feed_url")))
    docs = lookup_wide(docs, found, "feed_url", ["feed_id"])
    if rule is None:
        parsed = dialects.dispatch_rules(docs, url="asked_url")
    else:
        parsed = dialects.extract_by_rule(docs, rule)
    feeds = dialects.feed_rows(parsed)

    kept = repair.hard_cap(dialects.item_rows(parsed, "feed_url"), order, now, lim_item)
    if search:
        kept = repair.search_title(kept, search)
    items = cut(repair.soft_cap(repair.fix_items(kept, firstlink=firstlink), max_item, cache))

    if proxy:
        items = fill.fill_items(items, None, proxy=True)
    else:
        links = fill.with_link_key(items).select(F.col("link_key").alias("url"))
        ends, found = look_up(links, captures)
        outcomes = fill.page_outcomes(found, selector)
        outcomes = lookup_join(ends, outcomes.drop("url"), "final_url", ["url"], how="inner")
        items = fill.drop_unfetched(fill.fill_items(items, outcomes))
    if resolve:
        items = fill.resolve_link(items)
    if clip:
        items = fill.clip(items)
    if nolink:
        items = fill.no_link(items)
    if noref:
        items = fill.no_ref(items)
    return feeds, items.select("feed_id", "pos", "title", "link", "desc", "content", "time", "updated", "orig_link")


def full_text_documents(responses: DataFrame | Archive, wanted: DataFrame, now, format: str = "rss", indent: bool = False,
                        **options) -> DataFrame:
    """`full_text_feed` exported: (feed_id, part, body)."""
    feeds, items = full_text_feed(responses, wanted, now, **options)
    return exports.to_documents(feeds, items, format, indent)
