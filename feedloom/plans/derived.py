"""Tables of responses, items and feed documents derived from the `pages` and `documents` tables.

They give every operator realistic input of any size. `SQL` holds the same
derivations as ANSI SQL over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.functions.text import attr_escape, xml_escape
from feedloom.functions.times import utc_format
from feedloom.sources.captures import header_map

NOW = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of every page: page_id, url, code, msg, header columns as text, html, fetched_at.

    Every 7th page redirects to the next, every 11th has a refresh header,
    every 13th is missing; even ids are captured twice, every 4th id's second
    capture is a 304.
    """
    page = pages(spark, sf_dir)
    nxt = page.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    pid, visit = F.col("page_id"), F.col("visit")
    # Both visits come out of one join, which moves every page.
    visits = F.when(pid % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = page.join(nxt, "page_id", "left").withColumn("visit", F.explode(visits)).withColumns({
        "fetched_at": F.timestamp_seconds(F.lit(1704067200) + visit * 86400 + pid * 60),
        "code": F.when((visit == 1) & (pid % 4 == 0), 304).when((pid % 7 == 0) & F.col("next_url").isNotNull(), 301)
        .when(pid % 13 == 0, 404).otherwise(200)})
    html = F.concat(
        F.when((pid % 17 == 0) & F.col("next_url").isNotNull(), F.concat(
            F.lit('<meta http-equiv="Refresh" content="3; url='), "next_url", F.lit('">'))).otherwise(""),
        F.when(pid % 19 == 0, F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/feed/'),
                                       pid.cast("string"), F.lit('">'))).otherwise(""), "html")
    return both.select(
        "page_id", "url", "visit", "fetched_at", "code",
        F.when(F.col("code") == 200, "OK").when(F.col("code") == 301, "Moved Permanently")
        .when(F.col("code") == 304, "Not Modified").otherwise("Not Found").alias("msg"),
        F.when(F.col("code") != 304, F.when(pid % 5 == 0, "text/html").when(pid % 5 == 1, "application/xhtml+xml")
               .when(pid % 23 == 0, "application/json").otherwise("text/html; charset=UTF-8"))
        .alias("content_type"),
        F.when(pid % 4 == 0, "no-store").when(pid % 4 == 1, "max-age=600").when(pid % 4 == 2, "private, max-age=\"900000\"")
        .alias("cache_control"),
        F.concat(F.lit('"e'), pid.cast("string"), F.lit('"')).alias("etag"),
        F.when(pid % 3 == 0, "Mon, 01 Jan 2024 00:00:00 GMT").alias("last_modified"),
        F.when(F.col("code") == 301, F.col("next_url")).alias("location"),
        F.when((F.col("code") == 200) & (pid % 11 == 0), F.concat(F.lit("0;url="), "next_url")).alias("refresh"),
        F.when(F.col("code") == 200, html).otherwise("").alias("html"))


HEADERS = ["content-type", "cache-control", "etag", "last-modified", "location", "refresh"]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`captures` in the engine's response schema (page_id and visit kept as extra columns)."""
    lines = F.filter(F.array(*[F.concat(F.lit(f"{h}: "), F.col(h.replace("-", "_"))) for h in HEADERS]),
                     lambda h: h.isNotNull())
    return captures(spark, sf_dir).select(
        "page_id", "visit", "url", F.col("url").alias("final_url"), "code", "msg",
        header_map(lines).alias("headers"), F.col("html").cast("binary").alias("body"), "fetched_at")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`responses` with the page text at hand instead of its bytes."""
    return responses(spark, sf_dir).withColumn("text", F.col("body").cast("string")).drop("body")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 items per feed from documents; links point at pages, wrapped in eight ways."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    page = pages(spark, sf_dir)
    did = F.col("doc_id")
    d = docs.withColumn("page_id", did % page.agg(F.count("*")).scalar()).join(page.select("page_id", "url"), "page_id")
    clean = F.regexp_replace("text", r"[\x00-\x1f\x7f]", " ")
    title = F.trim(F.substring(clean, 1, 60))
    quoted = F.replace(F.replace(F.replace(F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit(":"),
                       F.lit("%3A")), F.lit("/"), F.lit("%2F")), F.lit("?"), F.lit("%3F")), F.lit("&"), F.lit("%26")),
                       F.lit("#"), F.lit("%23"))
    form = did % 8
    link = (F.when(form == 0, F.col("url"))
            .when(form == 1, F.concat(F.lit("http://www.google.com/url?q="), quoted, F.lit("&sa=D")))
            .when(form == 2, F.concat(F.lit("http://news.google.com/news/url?sa=t&url="), quoted))
            .when(form == 3, F.concat(F.lit("http://translate.google.com/translate?hl=en&u="), quoted))
            .when(form == 4, F.concat(F.lit("https://getpocket.com/redirect?url="), quoted))
            .when(form == 5, F.concat(F.lit("https://www.facebook.com/l.php?u="), quoted, F.lit("&h=1")))
            .when(form == 6, F.concat(F.lit("../x/./"), did.cast("string"), F.lit("?a=1#top"))))
    rest = F.trim(F.substring(clean, F.lit(61), F.length(clean)))       # the whole text behind the title
    desc = F.when(did % 3 == 0, F.trim(F.substring(clean, 61, 200))).otherwise(rest)
    return d.select(
        (F.floor(did / 20)).cast("string").alias("feed_id"), (did % 20).cast("int").alias("pos"),
        F.nullif(F.when(did % 5 == 0, F.upper(F.replace(title, F.lit("ß"), F.lit("ss")))).otherwise(title),
                 F.lit("")).alias("title"),
        link.alias("link"), F.nullif(desc, F.lit("")).alias("desc"),
        F.when(did % 3 == 0, F.nullif(rest, F.lit(""))).alias("content"),
        F.when(did % 11 != 0, F.timestamp_seconds(F.lit(1704067200) + did * 37 * 60)).alias("time"),
        F.when(did % 2 == 0, F.timestamp_seconds(F.lit(1704067200) + (did * 7919 % 5000) * 60)).alias("updated"),
        F.lit(None).cast("string").alias("orig_link"),
        F.concat(F.lit("http://feeds.example.com/f/"), F.floor(did / 20).cast("string"), F.lit("/rss.xml"))
        .alias("feed_url"))


def feed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per feed of `items`."""
    fid = F.floor(F.col("doc_id") / 20)
    return table(spark, sf_dir, "documents").select(
        fid.cast("string").alias("feed_id"),
        F.concat(F.lit("http://feeds.example.com/f/"), fid.cast("string"), F.lit("/rss.xml")).alias("feed_url"),
        F.concat(F.lit("Feed "), fid.cast("string")).alias("title"),
        F.concat(F.lit("News & notes <"), fid.cast("string"), F.lit(">")).alias("desc")).distinct()


# --- feed documents ----------------------------------------------------------------------
DIALECTS = ["rss", "rdf", "atom", "atom03", "json"]
_OPEN = {
    "rss": '<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>',
    "rdf": '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
           'xmlns:c="http://purl.org/rss/1.0/modules/content/" xmlns="http://purl.org/rss/1.0/"><channel>',
    "atom": '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">',
    "atom03": '<feed version="0.3" xmlns="http://purl.org/atom/ns#">',
}
_CLOSE = {"rss": "</channel></rss>", "rdf": "</rdf:RDF>", "atom": "</feed>", "atom03": "</feed>"}


def _tag(name, col, close=None):
    return F.coalesce(F.concat(F.lit(f"<{name}>"), xml_escape(col), F.lit(f"</{close or name}>")), F.lit(""))


def _entry_text(dialect):
    rfc = utc_format(F.col("time"), "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    iso, iso_updated = (utc_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in ("time", "updated"))
    if dialect in ("rss", "rdf"):
        content = "content:encoded" if dialect == "rss" else "c:encoded"
        return F.concat(F.lit("<item>"), _tag("title", F.col("title")), _tag("link", F.col("link")),
                        _tag("description", F.col("desc")), _tag(content, F.col("content")), _tag("pubDate", rfc),
                        F.lit("</item>"))
    if dialect in ("atom", "atom03"):
        link = F.coalesce(F.concat(F.lit('<link rel="alternate" href="'), attr_escape(F.col("link")), F.lit('"/>')),
                          F.lit(""))
        return F.concat(F.lit("<entry>"), _tag("title", F.col("title")), link, _tag("summary", F.col("desc")),
                        _tag('content type="html"', F.col("content"), "content"), _tag("published", iso),
                        _tag("updated", iso_updated), F.lit("</entry>"))
    return F.to_json(F.struct("title", F.col("link").alias("url"), "desc", "content", iso.alias("time"),
                              iso_updated.alias("updated")))


def feed_docs(spark: SparkSession, sf_dir: str, dialect: str | None = None) -> DataFrame:
    """One document per feed: (feed_id, feed_url, dialect, text), in one dialect or cycling through all."""
    rows = items(spark, sf_dir)
    kind = F.lit(dialect) if dialect else F.get(F.array(*[F.lit(d) for d in DIALECTS]),
                                                (F.col("feed_id").cast("int") % len(DIALECTS)))
    rows = rows.withColumn("dialect", kind)
    wanted = [dialect] if dialect else DIALECTS
    entry = F.coalesce(*[F.when(F.col("dialect") == d, _entry_text(d)) for d in wanted])
    # Dealt by feed alone, as the join needs them: the texts move once for both.
    bodies = rows.repartition("feed_id").groupBy("feed_id", "dialect").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry")))), lambda e: e["entry"]).alias("entries"))
    docs = bodies.join(feed_table(spark, sf_dir), "feed_id")
    sub = {"rss": "description", "rdf": "description", "atom": "subtitle", "atom03": "subtitle"}

    def xml(d):
        gap = "</channel>" if d == "rdf" else ""      # RSS 1.0 lists its items beside the channel
        return F.concat(F.lit(_OPEN[d]), _tag("title", F.col("title")), _tag(sub[d], F.col("desc")), F.lit(gap),
                        F.array_join("entries", ""), F.lit(_CLOSE[d]))

    json = F.concat(F.regexp_replace(F.to_json(F.struct("title", "desc")), r"\}$", ""), F.lit(',"items":['),
                    F.array_join("entries", ","), F.lit("]}"))
    text = F.coalesce(*[F.when(F.col("dialect") == d, json if d == "json" else xml(d)) for d in wanted])
    return docs.select("feed_id", "feed_url", "dialect", text.alias("text"))


def feed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`feed_docs` as captures."""
    kind = F.when(F.col("dialect") == "json", "application/json").otherwise("application/xml")
    return feed_docs(spark, sf_dir).select(
        F.col("feed_url").alias("url"), F.col("feed_url").alias("final_url"), F.lit(200).alias("code"),
        F.lit("OK").alias("msg"), F.create_map(F.lit("content-type"), F.concat(kind, F.lit("; charset=utf-8")))
        .alias("headers"), F.col("text").cast("binary").alias("body"),
        F.lit(NOW).cast("timestamp").alias("fetched_at"))


# --- the same derivations in SQL -----------------------------------------------------------------
SQL_CAPTURES = """
base AS (
  SELECT p.page_id, p.url, p.html, n.url AS next_url
  FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1),
visits AS (
  SELECT page_id, url, next_url, html, 0 AS visit, 1704067200 + page_id * 60 AS fetched,
    CASE WHEN page_id % 7 = 0 AND next_url IS NOT NULL THEN 301 WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS code
  FROM base
  UNION ALL
  SELECT page_id, url, next_url, html, 1, 1704153600 + page_id * 60,
    CASE WHEN page_id % 4 = 0 THEN 304 WHEN page_id % 7 = 0 AND next_url IS NOT NULL THEN 301
         WHEN page_id % 13 = 0 THEN 404 ELSE 200 END
  FROM base WHERE page_id % 2 = 0),
captures AS (
  SELECT page_id, url, visit, fetched, code,
    CASE code WHEN 200 THEN 'OK' WHEN 301 THEN 'Moved Permanently' WHEN 304 THEN 'Not Modified' ELSE 'Not Found' END AS msg,
    CASE WHEN code = 304 THEN NULL WHEN page_id % 5 = 0 THEN 'text/html' WHEN page_id % 5 = 1 THEN 'application/xhtml+xml'
         WHEN page_id % 23 = 0 THEN 'application/json' ELSE 'text/html; charset=UTF-8' END AS content_type,
    CASE page_id % 4 WHEN 0 THEN 'no-store' WHEN 1 THEN 'max-age=600' WHEN 2 THEN 'private, max-age="900000"' END AS cache_control,
    '"e' || page_id || '"' AS etag,
    CASE WHEN page_id % 3 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END AS last_modified,
    CASE WHEN code = 301 THEN next_url END AS location,
    CASE WHEN code = 200 AND page_id % 11 = 0 THEN '0;url=' || next_url END AS refresh,
    CASE WHEN code = 200 THEN
      CASE WHEN page_id % 17 = 0 AND next_url IS NOT NULL THEN '<meta http-equiv="Refresh" content="3; url=' || next_url || '">' ELSE '' END
      || CASE WHEN page_id % 19 = 0 THEN '<link rel="alternate" type="application/rss+xml" href="/feed/' || page_id || '">' ELSE '' END
      || html ELSE '' END AS html
  FROM visits)"""

SQL_ITEMS = r"""
docs AS (
  SELECT doc_id, regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g') AS clean,
    doc_id % (SELECT count(*) FROM pages) AS page_id FROM documents),
linked AS (
  SELECT d.*, p.url, trim(substr(clean, 1, 60), ' ') AS cut_title,
    replace(replace(replace(replace(replace(replace(p.url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'),
            '&', '%26'), '#', '%23') AS quoted
  FROM docs d JOIN pages p USING (page_id)),
items AS (
  SELECT CAST(doc_id // 20 AS VARCHAR) AS feed_id, CAST(doc_id % 20 AS INTEGER) AS pos,
    nullif(CASE WHEN doc_id % 5 = 0 THEN upper(replace(cut_title, 'ß', 'ss')) ELSE cut_title END, '') AS title,
    CASE doc_id % 8 WHEN 0 THEN url
      WHEN 1 THEN 'http://www.google.com/url?q=' || quoted || '&sa=D'
      WHEN 2 THEN 'http://news.google.com/news/url?sa=t&url=' || quoted
      WHEN 3 THEN 'http://translate.google.com/translate?hl=en&u=' || quoted
      WHEN 4 THEN 'https://getpocket.com/redirect?url=' || quoted
      WHEN 5 THEN 'https://www.facebook.com/l.php?u=' || quoted || '&h=1'
      WHEN 6 THEN '../x/./' || doc_id || '?a=1#top' END AS link,
    nullif(trim(CASE WHEN doc_id % 3 = 0 THEN substr(clean, 61, 200) ELSE substr(clean, 61) END, ' '), '') AS "desc",
    CASE WHEN doc_id % 3 = 0 THEN nullif(trim(substr(clean, 61), ' '), '') END AS content,
    CASE WHEN doc_id % 11 <> 0 THEN 1704067200 + doc_id * 37 * 60 END AS time,
    CASE WHEN doc_id % 2 = 0 THEN 1704067200 + (doc_id * 7919 % 5000) * 60 END AS updated,
    'http://feeds.example.com/f/' || (doc_id // 20) || '/rss.xml' AS feed_url,
    url AS page_url, doc_id
  FROM linked),
feeds AS (
  SELECT DISTINCT CAST(doc_id // 20 AS VARCHAR) AS feed_id,
    'http://feeds.example.com/f/' || (doc_id // 20) || '/rss.xml' AS feed_url,
    'Feed ' || (doc_id // 20) AS title, 'News & notes <' || (doc_id // 20) || '>' AS "desc"
  FROM documents)"""
