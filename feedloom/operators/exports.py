"""Feeds and items to CSV, JSON, RSS and HTML documents.

A document comes as one row (feed_id, part 0, body). For feeds too large for
one row, `part_items` cuts the document into parts of so many items each, in
order of position; its text is then the bodies in order of `part`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.constants import ITEM_COLUMNS, NS_CONTENT
from feedloom.functions.text import attr_escape, xml_escape
from feedloom.functions.times import utc_format
from feedloom.operators.items import rank_all_items


def _documents(feeds: DataFrame, items: DataFrame, head: Column, item: Column, tail: Column, sep: str,
               part_items: int | None) -> DataFrame:
    if part_items is None:
        part = F.lit(0)
    else:
        items = rank_all_items(items, "first").withColumnRenamed("rank", "_place")
        part = F.floor((F.col("_place") - 1) / part_items).cast("int")
    rendered = items.select("feed_id", "pos", part.alias("part"), item.alias("_item"))
    bodies = rendered.groupBy("feed_id", "part").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "_item"))), lambda i: i["_item"]), sep).alias("_body"))
    spans = items.select("feed_id", part.alias("_part")).groupBy("feed_id").agg(
        F.min("_part").alias("_low"), F.max("_part").alias("_high"))
    ends = feeds.select("feed_id", head.alias("_head"), tail.alias("_tail")).join(spans, "feed_id", "left")
    low, high = F.coalesce("_low", F.lit(0)), F.coalesce("_high", F.lit(0))
    edges = (ends.select("*", low.alias("_first"), high.alias("_last"),
                         F.explode(F.array_distinct(F.array(low, high))).alias("part"))
             .select("feed_id", "part", F.when(F.col("part") == F.col("_first"), F.col("_head")).alias("_head"),
                     F.when(F.col("part") == F.col("_last"), F.col("_tail")).alias("_tail")))
    joined = bodies.join(edges, ["feed_id", "part"], "full_outer")
    body = F.concat(F.coalesce("_head", F.lit(sep)), F.coalesce("_body", F.lit("")), F.coalesce("_tail", F.lit("")))
    return joined.select("feed_id", "part", body.alias("body"))


def _element(tag: str, col: Column, pad: str = "", attrs: str = "") -> Column:
    """`<tag>text</tag>`, nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{pad}<{tag}{attrs}>"), xml_escape(col), F.lit(f"</{tag}>")), F.lit(""))


def to_feed_rss(feeds: DataFrame, items: DataFrame, indent: bool = False, part_items: int | None = None) -> DataFrame:
    """RSS 2.0, stylesheet instruction first."""
    nl = ["\n" + "  " * n if indent else "" for n in range(5)]
    head = F.concat(
        F.lit("<?xml-stylesheet type=\"text/xsl\" href=\"/sheet.xsl\"?>\n"
              f"<rss version=\"2.0\" xmlns:content=\"{NS_CONTENT}\">{nl[1]}<channel>"),
        _element("title", F.col("title"), nl[2]), _element("description", F.col("desc"), nl[2]))
    time = utc_format(F.col("time"), "EEE, dd MMM yyyy HH:mm:ss 'UTC'")
    item = F.concat(
        F.lit(nl[2] + "<item>"), _element("title", F.col("title"), nl[3]), _element("link", F.col("link"), nl[3]),
        _element("description", F.col("desc"), nl[3]), _element("content:encoded", F.col("content"), nl[3]),
        _element("pubDate", time, nl[3]), F.lit(nl[2] + "</item>"))
    return _documents(feeds, items, head, item, F.lit(f"{nl[1]}</channel>{nl[0]}</rss>"), "", part_items)


def to_feed_json(feeds: DataFrame, items: DataFrame, indent: bool = False, part_items: int | None = None) -> DataFrame:
    """JSON with title, desc and items; null fields are left out."""
    options = {"pretty": "true"} if indent else {}
    nl = "\n" if indent else ""
    stamp = "yyyy-MM-dd'T'HH:mm:ss'+0000'"
    meta = F.regexp_replace(F.to_json(F.struct("title", "desc"), options), r"\s*\}$", "")
    head = F.concat(meta, F.when(meta == "{", "").otherwise(","), F.lit(f"{nl}\"items\":["), F.lit(nl))
    item = F.to_json(F.struct("title", F.col("link").alias("url"), "desc", "content",
                              utc_format(F.col("time"), stamp).alias("time"),
                              utc_format(F.col("updated"), stamp).alias("updated")), options)
    return _documents(feeds, items, head, item, F.lit(f"{nl}]}}"), "," + nl, part_items)


def to_feed_html(feeds: DataFrame, items: DataFrame, indent: bool = False, part_items: int | None = None) -> DataFrame:
    """HTML page: #header with title and desc, #content with one div.item per item. desc and content are markup."""
    nl = ["\n" + "  " * n if indent else "" for n in range(4)]

    def text(col):
        return F.coalesce(xml_escape(F.col(col)), F.lit(""))

    def raw(col):
        return F.coalesce(F.col(col), F.lit(""))

    head = F.concat(
        F.lit(f"<!DOCTYPE html>{nl[0]}<html>{nl[0]}<head><title>"), text("title"),
        F.lit(f"</title></head>{nl[0]}<body>{nl[1]}<div id=\"header\">{nl[2]}<h1>"), text("title"),
        F.lit(f"</h1>{nl[2]}<p>"), text("desc"), F.lit(f"</p>{nl[1]}</div>{nl[1]}<div id=\"content\">"))
    item = F.concat(
        F.lit(f"{nl[2]}<div class=\"item\">{nl[3]}<a target=\"_blank\" href=\""),
        F.coalesce(attr_escape(F.col("link")), F.lit("")), F.lit("\">"), text("title"),
        F.lit(f"</a>{nl[3]}<div class=\"desc\">"), raw("desc"),
        F.lit(f"</div>{nl[3]}<div class=\"content\">"), raw("content"), F.lit(f"</div>{nl[2]}</div>"))
    return _documents(feeds, items, head, item, F.lit(f"{nl[1]}</div>{nl[0]}</body>{nl[0]}</html>"), "", part_items)


def csv_line() -> Column:
    """The six item fields as one CSV line: quotes only where needed, null is empty."""
    def field(name):
        value = F.col(name)
        if name in ("time", "updated"):
            micros = F.when(F.unix_micros(value) % 1000000 != 0, utc_format(value, ".SSSSSS")).otherwise("")
            value = F.concat(utc_format(value, "yyyy-MM-dd HH:mm:ss"), micros, F.lit("+00:00"))
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(value.rlike('[",\r\n]'), quoted).otherwise(value), F.lit(""))
    return F.concat_ws(",", *[field(c) for c in ITEM_COLUMNS])


def to_feed_csv(feeds: DataFrame, items: DataFrame, part_items: int | None = None) -> DataFrame:
    """CSV without a header, lines ending in CR LF."""
    return _documents(feeds, items, F.lit(""), F.concat(csv_line(), F.lit("\r\n")), F.lit(""), "", part_items)


def write_csv(items: DataFrame, path: str, mode: str = "error") -> None:
    """All items as CSV files, sorted by feed and position."""
    lines = items.repartitionByRange("feed_id", "pos").sortWithinPartitions("feed_id", "pos")
    lines.select(csv_line()).write.mode(mode).option("lineSep", "\r\n").text(path)


FORMATS = {"rss": to_feed_rss, "json": to_feed_json, "html": to_feed_html, "csv": to_feed_csv}


def to_documents(feeds: DataFrame, items: DataFrame, format: str = "rss", indent: bool = False) -> DataFrame:
    return to_feed_csv(feeds, items) if format == "csv" else FORMATS[format](feeds, items, indent)
