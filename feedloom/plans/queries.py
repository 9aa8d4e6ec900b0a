"""One query per operator over the test tables, with the same result in SQL where SQL can say it."""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from feedloom.functions import text as txt, urls
from feedloom.functions.dom import node_text
from feedloom.functions.parts import by_parts
from feedloom.functions.select import Select
from feedloom.functions.times import parse_time, utc_format
from feedloom.operators.joins import cut, shared_folder
from feedloom.operators import article, exports, feeds, fill, items as repair, redirects, responses as resp, store
from feedloom.plans import derived
from feedloom.plans.derived import NOW, SQL_CAPTURES, SQL_ITEMS
from feedloom.plans.full_text import full_text_documents, full_text_feed
from feedloom.sources import captures as sources
from feedloom.sources.archive import Archive, write_archive
from feedloom.sources.rules import custom_rule, load_rules, rule_by_path, rules_from_table
from feedloom.streaming import captures as streams

QUERIES, ORACLES = {}, {}

WITH_CAPTURES = "WITH " + SQL_CAPTURES
WITH_ITEMS = "WITH " + SQL_ITEMS
_NOW_EPOCH = 1717200000


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def epoch(col):
    return F.unix_seconds(col)


def item_columns(df, *more):
    return df.select("feed_id", "pos", "title", "link", "desc", "content", epoch("time").alias("time"),
                     epoch("updated").alias("updated"), *more)


_ITEM_SQL = 'feed_id, pos, title, link, "desc", content, time, updated'


# --- scans, sources, sinks ------------------------------------------------------------------------
@query("load_responses", """
SELECT url, url AS final_url, 200 AS code, 'text/html; charset=utf-8' AS content_type, md5(html) AS body_md5
FROM pages""")
def load_responses(spark, sf):
    df = sources.load_pages(spark, f"{sf}/pages.parquet", NOW)
    return df.select("url", "final_url", "code", F.col("headers")["content-type"].alias("content_type"),
                     F.md5("body").alias("body_md5"))


@query("html_nodes", r"""
SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[^>]*>', 1)) AS tag FROM pages)
GROUP BY page_id, tag""")
def html_nodes(spark, sf):
    return article.html_nodes(derived.pages(spark, sf)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_PLAIN_TEXT = r"""replace(replace(replace(replace(replace(replace(replace(regexp_replace(
  replace(html, 'var t="</p>";', 'var t="PPPP";'), '<!--.*?-->|</?[a-zA-Z!][^>]*>', '', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), 'var t="PPPP";', 'var t="</p>";')"""


@query("page_text", f"SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, {_PLAIN_TEXT} AS t FROM pages)")
def page_text(spark, sf):
    df = article.page_text(derived.pages(spark, sf))
    return df.select("page_id", F.length("full_text").cast("bigint").alias("chars"), F.md5("full_text").alias("text_md5"))


@query("scan_tags", r"""
SELECT page_id, CAST(n - 1 AS INTEGER) AS tag_no, hrefs[n] AS href FROM (
  SELECT page_id, hrefs, unnest(generate_series(1, len(hrefs))) AS n FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^">]+)">', 1) AS hrefs FROM pages))""")
def scan_tags(spark, sf):
    df = sources.scan_tags(derived.pages(spark, sf).select("page_id", "html"), "a", "html", limit=None)
    return df.select("page_id", "tag_no", F.col("attrs")["href"].alias("href"))


_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _el(tag, col):
    return f"coalesce('<{tag}>' || {_XML.format(col)} || '</{tag}>', '')"


def _utc(col, fmt):
    return f"strftime(make_timestamp({col} * 1000000), '{fmt}')"


def _csv(col):
    return (f"coalesce(CASE WHEN regexp_matches({col}, '[\",\\r\\n]') THEN '\"' || replace({col}, '\"', '\"\"') || '\"' "
            f"ELSE {col} END, '')")


_STAMP = "%Y-%m-%d %H:%M:%S+00:00"


@query("to_feed_csv", f"""{WITH_ITEMS}
SELECT feed_id, 0 AS part, string_agg({_csv('title')} || ',' || {_csv('link')} || ',' || {_csv('"desc"')} || ',' ||
  {_csv('content')} || ',' || coalesce({_utc('time', _STAMP)}, '') || ',' || coalesce({_utc('updated', _STAMP)}, '')
  || chr(13) || chr(10), '' ORDER BY pos) AS body
FROM items GROUP BY feed_id""")
def to_feed_csv(spark, sf):
    return exports.to_feed_csv(derived.feed_table(spark, sf), derived.items(spark, sf))


def _json_member(name, col):
    return f"""coalesce('"{name}":' || to_json({col}) || ',', '')"""


_ISO = "%Y-%m-%dT%H:%M:%S+0000"
_JSON_ITEM = ("'{' || rtrim(" + " || ".join([
    _json_member("title", "title"), _json_member("url", "link"), _json_member("desc", '"desc"'),
    _json_member("content", "content"), _json_member("time", _utc("time", _ISO)),
    _json_member("updated", _utc("updated", _ISO))]) + ", ',') || '}'")


@query("to_feed_json", f"""{WITH_ITEMS}
SELECT f.feed_id, 0 AS part, '{{"title":' || to_json(f.title) || ',"desc":' || to_json(f."desc") || ',"items":[' ||
  i.body || ']}}' AS body
FROM feeds f JOIN (SELECT feed_id, string_agg({_JSON_ITEM}, ',' ORDER BY pos) AS body FROM items GROUP BY feed_id) i
  USING (feed_id)""")
def to_feed_json(spark, sf):
    return exports.to_feed_json(derived.feed_table(spark, sf), derived.items(spark, sf))


_RSS_ITEM = ("'<item>' || " + " || ".join([
    _el("title", "title"), _el("link", "link"), _el("description", '"desc"'), _el("content:encoded", "content"),
    _el("pubDate", _utc("time", "%a, %d %b %Y %H:%M:%S UTC"))]) + " || '</item>'")
_RSS_SQL = f"""{WITH_ITEMS}
SELECT f.feed_id, {{part}} '<?xml-stylesheet type="text/xsl" href="/sheet.xsl"?>' || chr(10) ||
  '<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>' || {_el('title', 'f.title')} ||
  {_el('description', 'f."desc"')} || i.body || '</channel></rss>' AS body
FROM feeds f JOIN (SELECT feed_id, string_agg({_RSS_ITEM}, '' ORDER BY pos) AS body FROM items GROUP BY feed_id) i
  USING (feed_id)"""


@query("to_feed_rss", _RSS_SQL.replace("{part}", "0 AS part,"))
def to_feed_rss(spark, sf):
    return exports.to_feed_rss(derived.feed_table(spark, sf), derived.items(spark, sf))


@query("to_feed_rss_in_parts", _RSS_SQL.replace("{part}", ""))
def to_feed_rss_in_parts(spark, sf):
    docs = exports.to_feed_rss(derived.feed_table(spark, sf), derived.items(spark, sf), part_items=6)
    return docs.groupBy("feed_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "body"))), lambda p: p["body"]), "").alias("body"))


_HTML_ITEM = ("'<div class=\"item\"><a target=\"_blank\" href=\"' || coalesce(replace(" + _XML.format("link")
              + ", '\"', '&quot;'), '') || '\">' || coalesce(" + _XML.format("title")
              + ", '') || '</a><div class=\"desc\">' || coalesce(\"desc\", '') || '</div><div class=\"content\">' || "
              "coalesce(content, '') || '</div></div>'")


@query("to_feed_html", f"""{WITH_ITEMS}
SELECT f.feed_id, 0 AS part, '<!DOCTYPE html><html><head><title>' || {_XML.format('f.title')} ||
  '</title></head><body><div id="header"><h1>' || {_XML.format('f.title')} || '</h1><p>' || {_XML.format('f."desc"')} ||
  '</p></div><div id="content">' || i.body || '</div></body></html>' AS body
FROM feeds f JOIN (SELECT feed_id, string_agg({_HTML_ITEM}, '' ORDER BY pos) AS body FROM items GROUP BY feed_id) i
  USING (feed_id)""")
def to_feed_html(spark, sf):
    return exports.to_feed_html(derived.feed_table(spark, sf), derived.items(spark, sf))


# --- response clean-up ---------------------------------------------------------------------------------
@query("content_type", f"""{WITH_CAPTURES}
SELECT page_id, visit, m AS contenttype, m IN ('text/html', 'application/xhtml+xml', 'application/xml') AS is_html,
  m IN ('text/xml', 'application/xml', 'application/rss+xml', 'application/rdf+xml', 'application/atom+xml',
        'application/xhtml+xml') AS is_xml,
  m IN ('application/rss+xml', 'application/rdf+xml', 'application/atom+xml') AS is_rss, m = 'application/json' AS is_json
FROM (SELECT page_id, visit, coalesce(split_part(content_type, ';', 1), '') AS m FROM captures)""")
def content_type(spark, sf):
    return resp.content_type(derived.responses(spark, sf)).select(
        "page_id", "visit", "contenttype", "is_html", "is_xml", "is_rss", "is_json")


@query("sanitize_url", r"""
SELECT page_id, CASE page_id % 4
  WHEN 0 THEN 'http://' || regexp_replace(url, '^https?://', '') WHEN 1 THEN url || '%20x'
  ELSE regexp_replace(url, '#$', '') END AS clean_url FROM pages""")
def sanitize_url(spark, sf):
    pid, url = F.col("page_id"), F.col("url")
    messy = (F.when(pid % 4 == 0, F.regexp_replace(url, "^https?://", ""))
             .when(pid % 4 == 1, F.concat(url, F.lit(" x")))
             .when(pid % 4 == 2, F.regexp_replace(url, "^(https?)://", "$1:/")).otherwise(F.concat(url, F.lit("\n"))))
    return derived.pages(spark, sf).select("page_id", urls.sanitize_url(messy).alias("clean_url"))


_LATIN = r"regexp_full_match(html, '[\x00-\xff]*')"


@query("decode_bodies", rf"""
SELECT page_id, CASE WHEN page_id % 3 = 0 AND NOT regexp_matches(html, '[^\x{{00}}-\x{{ff}}]') THEN 'iso-8859-1' ELSE 'utf-8' END AS encoding,
  length(html) AS chars, md5(html) AS text_md5 FROM pages""")
def decode_bodies(spark, sf):
    latin = (F.col("page_id") % 3 == 0) & ~F.col("html").rlike(r"[^\x{00}-\x{ff}]")
    kind = F.when(latin, "text/html; charset=iso-8859-1").otherwise("text/html")
    body = F.when(latin, F.encode("html", "ISO-8859-1")).otherwise(F.col("html").cast("binary"))
    # Of five bodies two say that they are zipped, and one of these is not.
    says = F.when(F.col("page_id") % 5 < 2, F.create_map(F.lit("content-encoding"), F.lit("gzip"))).otherwise(F.create_map().cast("map<string,string>"))

    def zip_all(bodies):
        return pa.array([None if b is None else gzip.compress(b) for b in bodies.to_pylist()], pa.binary())

    # See `html_dom` for why it is marked non-deterministic.
    zipped = F.arrow_udf(by_parts(zip_all), "binary").asNondeterministic()
    raw = derived.pages(spark, sf).select(
        "page_id", F.lit(200).alias("code"), F.map_concat(F.create_map(F.lit("content-type"), kind), says).alias("headers"),
        F.coalesce(zipped(F.when(F.col("page_id") % 5 == 0, body)), body).alias("body"))
    return resp.decode_bodies(raw).select("page_id", "encoding", F.length("text").cast("bigint").alias("chars"),
                                          F.md5("text").alias("text_md5"))


@query("detect_encoding", rf"""{WITH_CAPTURES}
SELECT page_id, visit, coalesce(nullif(regexp_extract(content_type, 'charset=([^;]+)', 1), ''),
  nullif(lower(regexp_extract(substr(html, 1, 1000), 'charset=["'']?([0-9a-zA-Z-]+)', 1)), ''), 'utf-8') AS encoding
FROM captures""")
def detect_encoding(spark, sf):
    return resp.detect_encoding(derived.responses(spark, sf)).select("page_id", "visit", "encoding")


_IS_HTML = "split_part(content_type, ';', 1) IN ('text/html', 'application/xhtml+xml', 'application/xml')"
_EQUIV = f"""equiv AS (
  SELECT *, coalesce(refresh, CASE WHEN code = 200 AND {_IS_HTML}
    THEN nullif(regexp_extract(substr(html, 1, 10000), '<meta http-equiv="Refresh" content="([^"]+)">', 1), '') END) AS refresh2
  FROM captures)"""


@query("apply_http_equiv", f"{WITH_CAPTURES}, {_EQUIV} SELECT page_id, visit, refresh2 AS refresh FROM equiv")
def apply_http_equiv(spark, sf):
    return resp.apply_http_equiv(derived.texts(spark, sf)).select(
        "page_id", "visit", F.col("headers")["refresh"].alias("refresh"))


# --- redirects and the store ------------------------------------------------------------------------------
@query("redirect_target", f"""{WITH_CAPTURES}
SELECT page_id, visit, location AS target FROM captures""")
def redirect_target(spark, sf):
    return redirects.redirect_target(derived.responses(spark, sf)).select("page_id", "visit", "target")


@query("refresh_target", rf"""{WITH_CAPTURES}, {_EQUIV}
SELECT page_id, visit, regexp_extract(refresh2, '^[0-9]+; ?url=(.+)$', 1) AS target FROM equiv WHERE refresh2 IS NOT NULL""")
def refresh_target(spark, sf):
    df = resp.apply_http_equiv(derived.texts(spark, sf))
    return redirects.refresh_target(df).where("target is not null").select("page_id", "visit", "target")


@query("alternate_feed", rf"""{WITH_CAPTURES}
SELECT page_id, visit, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/feed/' || page_id AS target FROM captures
WHERE code = 200 AND page_id % 19 = 0 AND {_IS_HTML} AND content_type <> 'application/json'""")
def alternate_feed(spark, sf):
    df = redirects.alternate_feed(derived.texts(spark, sf), "rss")
    return df.where("target is not null").select("page_id", "visit", "target")


_CURRENT = f"""{_EQUIV}, current AS (
  SELECT * FROM equiv WHERE code <> 304 QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched DESC) = 1),
edges AS (
  SELECT url, coalesce(location, nullif(regexp_extract(refresh2, '^[0-9]+; ?url=(.+)$', 1), '')) AS target FROM current),
moving AS (SELECT * FROM edges WHERE target IS NOT NULL)"""


# Of every 40 pages: a chain of 11 hops, a cycle of four addresses that another leads to, and one that points at itself.
_LONG_CHAINS = """
SELECT 'http://moved.example.org/' || floor(page_id / 40)::BIGINT || '/' || page_id % 40 AS url,
  'http://moved.example.org/' || floor(page_id / 40)::BIGINT || '/' || CASE WHEN page_id % 40 IN (23, 30) THEN 20 WHEN page_id % 40 = 35 THEN 35
    ELSE page_id % 40 + 1 END AS target
FROM pages WHERE page_id % 40 < 11 OR page_id % 40 IN (20, 21, 22, 23, 30, 35)"""


@query("resolve_redirects", f"""WITH RECURSIVE {SQL_CAPTURES}, {_CURRENT},
hop AS (SELECT url, target FROM moving UNION ALL {_LONG_CHAINS}),
walk AS (
  SELECT url, target AS final_url, 1 AS hops FROM hop
  UNION ALL
  SELECT w.url, m.target, w.hops + 1 FROM walk w JOIN hop m ON m.url = w.final_url WHERE w.hops < 10),
ends AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM hop m WHERE m.url = w.final_url))
SELECT h.url, e.final_url, e.hops FROM hop h LEFT JOIN ends e ON e.url = h.url""")
def resolve_redirects(spark, sf):
    current = store.latest_response(derived.responses(spark, sf).where("code <> 304"))
    ready = resp.apply_http_equiv(current.withColumn("text", F.col("body").cast("string")))
    place = F.col("page_id") % 40
    base = F.concat(F.lit("http://moved.example.org/"), F.floor(F.col("page_id") / 40).cast("string"), F.lit("/"))
    after = F.when(place.isin(23, 30), 20).when(place == 35, 35).otherwise(place + 1)
    chains = derived.pages(spark, sf).where((place < 11) | place.isin(20, 21, 22, 23, 30, 35)).select(
        F.concat(base, place.cast("string")).alias("url"), F.concat(base, after.cast("string")).alias("target"))
    return redirects.resolve_redirects(redirects.redirect_edges(ready).unionByName(chains)).select("url", "final_url", "hops")


_LATEST = "SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched DESC) = 1"
_AGE = f"({_NOW_EPOCH - 151 * 86400} - fetched)"


def _decision_sql(cases):
    return f"""{WITH_CAPTURES}, latest AS ({_LATEST})
SELECT url, CASE {cases} ELSE 'fetch' END AS decision FROM latest"""


_MAX_AGE = "TRY_CAST(replace(regexp_extract(cache_control, 'max-age=(\"?[0-9]+)', 1), '\"', '') AS BIGINT)"
_DECIDE_AT = "2024-01-02 00:00:00"


@query("cache_decision", _decision_sql(f"""WHEN code = 301 AND {_AGE} < 604800 THEN 'use'
  WHEN cache_control LIKE '%no-store%' THEN 'fetch' WHEN {_MAX_AGE} > {_AGE} THEN 'use'"""))
def cache_decision(spark, sf):
    return store.cache_decision(derived.responses(spark, sf), _DECIDE_AT)


@query("cache_decision_feed", _decision_sql(f"""WHEN {_AGE} > 3600 THEN 'fetch' WHEN {_AGE} < 300 THEN 'use'
  WHEN code = 301 AND {_AGE} < 604800 THEN 'use' WHEN {_MAX_AGE} > {_AGE} THEN 'use'"""))
def cache_decision_feed(spark, sf):
    return store.cache_decision(derived.responses(spark, sf), _DECIDE_AT, force_min=300, force_max=3600)


@query("cache_decision_offline", f"""{WITH_CAPTURES}
SELECT url, 'use' AS decision FROM captures GROUP BY url
UNION ALL SELECT url || '/absent', 'conflict' FROM captures GROUP BY url""")
def cache_decision_offline(spark, sf):
    page = derived.pages(spark, sf).select("url")
    wanted = page.unionByName(page.select(F.concat("url", F.lit("/absent")).alias("url")))
    return store.cache_decision(derived.responses(spark, sf), _DECIDE_AT, policy="offline", wanted=wanted)


@query("cache_decision_public", _decision_sql(f"""WHEN cache_control LIKE '%private%' THEN 'fetch'
  WHEN code = 301 AND {_AGE} < 604800 THEN 'use'
  WHEN cache_control LIKE '%no-store%' THEN 'fetch' WHEN {_MAX_AGE} > {_AGE} THEN 'use'"""))
def cache_decision_public(spark, sf):
    return store.cache_decision(derived.responses(spark, sf), _DECIDE_AT, privacy="public")


@query("cacheable", f"""{WITH_CAPTURES} SELECT page_id, visit, cache_control FROM captures
WHERE coalesce(cache_control, '') NOT LIKE '%no-store%'""")
def cacheable(spark, sf):
    return store.cacheable(derived.responses(spark, sf)).select(
        "page_id", "visit", F.col("headers")["cache-control"].alias("cache_control"))


@query("revalidation_headers", f"""{WITH_CAPTURES}
SELECT url, etag AS if_none_match, last_modified AS if_modified_since FROM ({_LATEST})""")
def revalidation_headers(spark, sf):
    return store.revalidation_headers(store.latest_response(derived.responses(spark, sf)))


@query("merge_304", f"""{WITH_CAPTURES}, merged AS (
  SELECT c.url, c.fetched AS seen_at, c.code AS own_code,
    last_value(CASE WHEN code <> 304 THEN fetched END IGNORE NULLS) OVER w AS fetched
  FROM captures c WINDOW w AS (PARTITION BY url ORDER BY fetched ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT m.url, m.fetched, CASE WHEN m.own_code = 304 THEN m.seen_at END AS revalidated, f.code, f.etag, md5(f.html) AS body_md5
FROM merged m JOIN captures f ON f.url = m.url AND f.fetched = m.fetched""")
def merge_304(spark, sf):
    return store.merge_304(derived.responses(spark, sf)).select(
        "url", epoch("fetched_at").alias("fetched"), epoch("revalidated_at").alias("revalidated"), "code",
        F.col("headers")["etag"].alias("etag"), F.md5("body").alias("body_md5"))


@query("latest_response", f"""{WITH_CAPTURES}
SELECT url, code, fetched, md5(html) AS body_md5 FROM ({_LATEST})""")
def latest_response(spark, sf):
    return _latest_columns(store.latest_response(derived.responses(spark, sf)))


def _latest_columns(df):
    return df.select("url", "code", epoch("fetched_at").alias("fetched"), F.md5("body").alias("body_md5"))


@query("latest_response_as_of", f"""{WITH_CAPTURES}
SELECT url, code, fetched FROM (SELECT * FROM captures WHERE fetched <= 1704153600)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched DESC) = 1""")
def latest_response_as_of(spark, sf):
    return store.latest_response(derived.responses(spark, sf), "2024-01-02 00:00:00").select(
        "url", "code", epoch("fetched_at").alias("fetched"))


@query("trim_store", f"""{WITH_CAPTURES}
SELECT url, code, fetched FROM ({_LATEST}) ORDER BY fetched DESC, url LIMIT 60""")
def trim_store(spark, sf):
    return store.trim_store(derived.responses(spark, sf), 60).select("url", "code", epoch("fetched_at").alias("fetched"))


# --- feed parsing -------------------------------------------------------------------------------------------------
@query("repair_xml", r"""
SELECT doc_id, '<a>' || replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'),
  '&', '+'), '<', '('), '>', ')') || ' &amp; ' || chr(160) || '&amp;x&lt;</a><![CDATA[a & b &nbsp;]]>' AS fixed
FROM documents""")
def repair_xml(spark, sf):
    body = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("+")), F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")"))
    broken = F.concat(F.lit("junk <a>\x01"), body, F.lit(" & &nbsp;&amp;x&lt;</a><![CDATA[a & b &nbsp;]]>"))
    return derived.table(spark, sf, "documents").select("doc_id", feeds.repair_xml(broken).alias("fixed"))


def _parsed(parse, dialect):
    def run(spark, sf):
        return item_columns(feeds.item_rows(parse(derived.feed_docs(spark, sf, dialect))))
    return run


_WITHOUT_UPDATED = f'{WITH_ITEMS} SELECT feed_id, pos, title, link, "desc", content, time, CAST(NULL AS BIGINT) AS updated FROM items'
_ALL_FIELDS = f"{WITH_ITEMS} SELECT {_ITEM_SQL} FROM items"
query("parse_rss", _WITHOUT_UPDATED)(_parsed(feeds.parse_rss, "rss"))
query("parse_rdf", _WITHOUT_UPDATED)(_parsed(feeds.parse_rdf, "rdf"))
query("parse_atom", _ALL_FIELDS)(_parsed(feeds.parse_atom, "atom"))
query("parse_atom03", _ALL_FIELDS)(_parsed(feeds.parse_atom03, "atom03"))
query("parse_json_feed", _ALL_FIELDS)(_parsed(feeds.parse_json_feed, "json"))


@query("parse_html_feed", f"""{WITH_ITEMS}
SELECT feed_id, pos, title, link, {_XML.format('"desc"')} AS "desc", {_XML.format('content')} AS content,
  CAST(NULL AS BIGINT) AS time, CAST(NULL AS BIGINT) AS updated FROM items""")
def parse_html_feed(spark, sf):
    rows = derived.items(spark, sf).withColumns({c: txt.xml_escape(F.col(c)) for c in ("desc", "content")})
    docs = exports.to_feed_html(derived.feed_table(spark, sf), rows).select("feed_id", F.col("body").alias("text"))
    return item_columns(feeds.item_rows(feeds.parse_html_feed(docs)))


_UNESCAPE = "replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query("extract_by_rule", rf"""
SELECT page_id, CAST(n - 1 AS INTEGER) AS pos, nullif(trim({_UNESCAPE.format("regexp_extract(li[n], '>([^<]*)</a>', 1)")}), '') AS title,
  regexp_extract(li[n], '<a href="([^"]*)"', 1) AS link FROM (
  SELECT page_id, li, unnest(generate_series(1, len(li))) AS n FROM (
    SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS li FROM pages))""")
def extract_by_rule(spark, sf):
    rule = custom_rule(Select(tag="li"))
    docs = derived.pages(spark, sf).select(F.col("page_id").alias("feed_id"), F.col("html").alias("text"))
    rows = feeds.item_rows(feeds.extract_by_rule(docs, rule))
    return rows.select(F.col("feed_id").alias("page_id"), "pos", "title", "link")


@query("extract_json_by_rule", f"""{WITH_ITEMS}
SELECT feed_id, pos, title, link, "desc", time FROM items""")
def extract_json_by_rule(spark, sf):
    entry = F.struct(F.struct("title", F.struct(F.col("link").alias("u")).alias("where")).alias("meta"),
                     F.col("desc").alias("summary"), utc_format(F.col("time"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("at"),
                     "pos")
    docs = derived.items(spark, sf).groupBy("feed_id").agg(F.to_json(F.struct(F.struct(F.array_sort(
        F.collect_list(F.struct("pos", entry.alias("e")))).getField("e").alias("posts")).alias("data"))).alias("text"))
    rule = custom_rule("data.posts.[]", "json", item_title="meta.title", item_link="meta.where.u", item_desc="summary",
                       item_time="at")
    rows = feeds.item_rows(feeds.extract_json_by_rule(docs, rule))
    return rows.select("feed_id", "pos", "title", "link", "desc", epoch("time").alias("time"))


@query("extract_xml_by_rule", f"""{WITH_ITEMS}
SELECT feed_id, pos, nullif(trim(title, ' '), '') AS title, link, time FROM items""")
def extract_xml_by_rule(spark, sf):
    def tag(name, value):
        return F.coalesce(F.concat(F.lit(f"<{name}>"), txt.xml_escape(value), F.lit(f"</{name}>")), F.lit(""))

    at = F.coalesce(F.concat(F.lit(' at="'), utc_format(F.col("time"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')), F.lit(""))
    entry = F.concat(F.lit("<note"), at, F.lit("><about>"), tag("name", F.col("title")), F.lit("</about>"), tag("where", F.col("link")),
                     F.lit("</note>"))
    docs = derived.items(spark, sf).groupBy("feed_id").agg(F.concat(
        F.lit("<board><list>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]), ""),
        F.lit("</list></board>")).alias("text"))
    rule = custom_rule("/board/list/note", "xml", item_title="about/name", item_link="where", item_time="@at")
    rows = feeds.item_rows(feeds.extract_by_rule(docs, rule))
    return rows.select("feed_id", "pos", "title", "link", epoch("time").alias("time"))


@query("load_rules", """
SELECT * FROM (VALUES ('rss-rdf', 0, 'xml', 0), ('rss-channel', 1, 'xml', 0), ('rss-atom', 2, 'xml', 0), ('rss-atom03', 3, 'xml', 0),
  ('json', 4, 'json', 0), ('html', 5, 'html', 0), ('twitter', 6, 'html', 4), ('google', 7, 'html', 2), ('ddg.gg', 8, 'html', 2))
  t(rule, rule_order, mode, paths) JOIN (SELECT count(*) AS pages, count(*) FILTER (WHERE url LIKE 'http%') AS plain FROM pages) ON true""")
def rules_by_pages(spark, sf):
    """The rulesets, and how many pages there are to which no path of theirs applies."""
    pages = derived.pages(spark, sf).agg(F.count("*").alias("pages"), F.count_if(
        F.col("url").startswith("http") & rule_by_path(F.col("url")).isNull()).alias("plain"))
    rules = load_rules(spark).select("rule", "rule_order", "mode", F.coalesce(F.size("path"), F.lit(0)).alias("paths"))
    return rules.join(F.broadcast(pages))


@query("dispatch_rules", f"""{WITH_ITEMS},
picked AS (SELECT f.*, CAST(f.feed_id AS INTEGER) % 5 AS k FROM feeds f)
SELECT p.feed_id, CASE k WHEN 0 THEN 'rss-channel' WHEN 1 THEN 'rss-rdf' WHEN 2 THEN 'rss-atom' WHEN 3 THEN 'rss-atom03'
  ELSE 'json' END AS rule, CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS rule_order,
  CASE k WHEN 4 THEN 'json' ELSE 'xml' END AS mode, p.title, p."desc", count(*) AS n
FROM picked p JOIN items i USING (feed_id) GROUP BY ALL""")
def dispatch_rules(spark, sf):
    parsed = feeds.dispatch_rules(derived.feed_docs(spark, sf))
    rules = load_rules(spark).select("rule", "rule_order", "mode")
    return parsed.join(F.broadcast(rules), "rule", "left").select(
        "feed_id", "rule", "rule_order", "mode", "feed.title", "feed.desc",
        F.size("feed.items").cast("bigint").alias("n"))


@query("dispatch_loaded_rules", ORACLES["dispatch_rules"])
def dispatch_loaded_rules(spark, sf):
    """The same documents by rules that are read back from their table."""
    table = load_rules(spark)
    parsed = feeds.dispatch_rules(derived.feed_docs(spark, sf), rules=rules_from_table(table))
    return parsed.join(F.broadcast(table.select("rule", "rule_order", "mode")), "rule", "left").select(
        "feed_id", "rule", "rule_order", "mode", "feed.title", "feed.desc",
        F.size("feed.items").cast("bigint").alias("n"))


_FORMS = 8


@query("parse_time", f"SELECT event_id, epoch_us(ts) // 1000000 - CASE WHEN event_id % {_FORMS} = 5 THEN epoch_us(ts) // 1000000 % 60 ELSE 0 END AS at FROM events")
def parse_time_query(spark, sf):
    ts = F.col("ts").cast("timestamp")
    shifted = F.timestamp_seconds(F.unix_seconds(ts) + 5400)
    form = F.col("event_id") % _FORMS
    text = (F.when(form == 0, F.concat(F.lit("Mon, "), utc_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
            .when(form == 1, utc_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(form == 2, F.concat(utc_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")))
            .when(form == 3, F.concat(utc_format(shifted, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0130")))
            .when(form == 4, F.unix_seconds(ts).cast("string"))
            .when(form == 5, utc_format(ts, "d MMM yyyy HH:mm"))
            .when(form == 6, utc_format(ts, "MMMM d, yyyy h:mm:ss a")).otherwise(utc_format(ts, "yyyy-MM-dd HH:mm:ss")))
    return derived.table(spark, sf, "events").select("event_id", epoch(parse_time(text)).alias("at"))


@query("convert", f"""{WITH_ITEMS}
SELECT feed_id, pos, title, link, CAST(NULL AS VARCHAR) AS "desc", content, time, CAST(NULL AS BIGINT) AS updated FROM items""")
def convert(spark, sf):
    rows = derived.items(spark, sf).drop("desc", "updated", "orig_link", "feed_url")
    return item_columns(feeds.convert(derived.feed_table(spark, sf), rows)[1])


@query("append_items", f"""{WITH_ITEMS}, old AS (SELECT * FROM items WHERE content IS NULL),
last AS (SELECT feed_id, max(pos) AS last FROM old GROUP BY feed_id)
SELECT feed_id, pos, title, link FROM old
UNION ALL SELECT i.feed_id, CAST(coalesce(l.last, -1) + 1 + i.pos AS INTEGER), i.title, NULL
FROM items i LEFT JOIN last l USING (feed_id) WHERE i.content IS NOT NULL""")
def append_items(spark, sf):
    rows = derived.items(spark, sf)
    new = rows.where("content is not null").select("feed_id", "pos", "title")
    return feeds.append_items(rows.where("content is null"), new).select("feed_id", "pos", "title", "link")


@query("set_fields", f"""{WITH_ITEMS} SELECT feed_id, pos, CASE WHEN pos = 0 THEN 'first' ELSE title END AS title,
  CASE WHEN pos = 0 THEN NULL ELSE link END AS link FROM items""")
def set_fields(spark, sf):
    return feeds.set_fields(derived.items(spark, sf), F.col("pos") == 0, title="first", link=None).select(
        "feed_id", "pos", "title", "link")


@query("remove_items", f"{WITH_ITEMS} SELECT feed_id, pos, title FROM items WHERE time IS NOT NULL")
def remove_items(spark, sf):
    rows = derived.items(spark, sf)
    return feeds.remove_items(rows, rows.where("time is null")).select("feed_id", "pos", "title")


# --- item repair -----------------------------------------------------------------------------------------------------
_TITLE_CASE = r"""array_to_string(list_transform(regexp_extract_all(title, '\pL+|[^\pL]+'),
  lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"""
_IS_UPPER = r"length(title) > 20 AND regexp_matches(title, '\p{Lu}') AND NOT regexp_matches(title, '[\p{Ll}\p{Lt}]')"
_FIX_TITLE = f"CASE WHEN {_IS_UPPER} THEN {_TITLE_CASE} ELSE title END"


@query("fix_title", f"{WITH_ITEMS} SELECT feed_id, pos, {_FIX_TITLE} AS title FROM items")
def fix_title(spark, sf):
    return repair.fix_titles(derived.items(spark, sf)).select("feed_id", "pos", "title")


_ABSOLUTE = """CASE WHEN link LIKE '../x/./%' THEN 'http://feeds.example.com/f/x/' || substr(link, 8) ELSE link END"""


@query("absolute_url", f"{WITH_ITEMS} SELECT feed_id, pos, {_ABSOLUTE} AS link FROM items")
def absolute_url(spark, sf):
    return repair.absolute_item_links(derived.items(spark, sf)).select("feed_id", "pos", "link")


@query("first_link", f"""{WITH_ITEMS}
SELECT feed_id, pos, CASE WHEN link IS NULL THEN NULL WHEN pos % 3 = 0 THEN page_url
  WHEN pos % 3 = 1 THEN link ELSE '/c?' || pos END AS link FROM items""")
def first_link(spark, sf):
    did = F.col("feed_id").cast("bigint") * 20 + F.col("pos")
    page = derived.pages(spark, sf)
    rows = derived.items(spark, sf).withColumn("page_id", did % F.lit(page.count())).join(
        page.select("page_id", "url"), "page_id")
    href = txt.attr_escape(F.col("url"))
    rows = rows.withColumns({
        "desc": F.when(F.col("pos") % 3 == 0, F.concat(F.lit('<b>x</b><A class="k" href="'), href, F.lit('">y</A><a href="/z">z</a>')))
        .when(F.col("pos") % 3 == 1, F.lit("no link <abbr href='/q'>here</abbr>")),
        "content": F.concat(F.lit("<p><a href='/c?"), F.col("pos").cast("string"), F.lit("'>c</a>"))})
    return repair.first_link(rows).select("feed_id", "pos", "link")


@query("site_link", f"""{WITH_ITEMS}
SELECT feed_id, pos, CASE WHEN link IS NULL THEN NULL WHEN pos % 2 = 0 THEN '/wiki/' || pos ELSE '/c/' || pos END AS link
FROM items""")
def site_link(spark, sf):
    even = F.col("pos") % 2 == 0
    pos = F.col("pos").cast("string")
    rows = derived.items(spark, sf).withColumns({
        "feed_url": F.when(even, "https://en.wikipedia.org/w/api.php?action=featuredfeed&feedformat=atom")
        .otherwise("https://www.reddit.com/r/x/.rss"),
        "desc": F.concat(F.lit('<a href="/no">n</a><b><a href="/wiki/'), pos, F.lit('" title="t">T</a></b>')),
        "content": F.concat(F.lit('<a href="/u">u</a> <span><a href="/c/'), pos, F.lit('">[link]</a></span>'))})
    return repair.site_link(rows).select("feed_id", "pos", "link")


_UNWRAPPED = f"CASE WHEN doc_id % 8 BETWEEN 1 AND 5 THEN page_url ELSE {_ABSOLUTE} END"


@query("unwrap_tracking", f"{WITH_ITEMS} SELECT feed_id, pos, {_UNWRAPPED} AS link FROM items")
def unwrap_tracking(spark, sf):
    return repair.unwrap_links(repair.absolute_item_links(derived.items(spark, sf))).select("feed_id", "pos", "link")


@query("deobfuscate_link", f"""{WITH_ITEMS}
SELECT feed_id, pos, CASE WHEN link IS NULL THEN NULL WHEN pos % 2 = 0 THEN page_url
  ELSE 'http://www.example' || pos || '.com/a-b' END AS link FROM items""")
def deobfuscate_link(spark, sf):
    did = F.col("feed_id").cast("bigint") * 20 + F.col("pos")
    page = derived.pages(spark, sf)
    rows = derived.items(spark, sf).withColumn("page_id", did % F.lit(page.count())).join(
        page.select("page_id", "url"), "page_id")
    digits = F.regexp_replace(F.col("pos").cast("string"), "0", "0A")
    portal = F.concat(F.lit("http://rss.feedsportal.com/c/1/f/2/s/3/sc/4/l/0L0Swww0Bexample"), digits,
                      F.lit("0N0Ca0Eb/story01.htm"))
    rows = rows.withColumns({
        "orig_link": F.when(F.col("pos") % 2 == 0, F.col("url")),
        "link": F.when(F.col("link").isNotNull(), F.when(F.col("pos") % 2 == 1, F.regexp_replace(
            portal, "0Swww0B", "0S")).otherwise(F.col("link")))})
    return repair.deobfuscate_link(rows).select("feed_id", "pos", "link")


# --- order, caps, search ------------------------------------------------------------------------------------------------
def _rank_sql(keys):
    return f"row_number() OVER (PARTITION BY feed_id ORDER BY {keys})"


_WHEN = f"coalesce(updated, time, {_NOW_EPOCH})"
_ORDERS = {"first": "pos", "last": "pos DESC", "oldest": f"{_WHEN}, pos", "newest": f"{_WHEN} DESC, pos DESC"}


def _ranked(order):
    def run(spark, sf):
        return repair.rank_items(derived.items(spark, sf), order, NOW).select("feed_id", "pos", "rank")
    return run


for _order, _keys in _ORDERS.items():
    query(f"rank_items_{_order}", f"{WITH_ITEMS} SELECT feed_id, pos, CAST({_rank_sql(_keys)} AS INTEGER) AS rank FROM items")(
        _ranked(_order))


@query("rank_all_items", f"{WITH_ITEMS} SELECT feed_id, pos, CAST({_rank_sql(_ORDERS['newest'])} AS INTEGER) AS rank FROM items")
def rank_all_items(spark, sf):
    return repair.rank_all_items(derived.items(spark, sf), "newest", NOW).select("feed_id", "pos", "rank")


@query("hard_cap", f"""{WITH_ITEMS} SELECT feed_id, pos, title FROM items
QUALIFY {_rank_sql(_ORDERS['newest'])} <= 10""")
def hard_cap(spark, sf):
    return repair.hard_cap(derived.items(spark, sf), "newest", NOW).select("feed_id", "pos", "title")


@query("search_title", f"{WITH_ITEMS} SELECT feed_id, pos, title FROM items WHERE contains(title, 'th')")
def search_title(spark, sf):
    return repair.search_title(derived.items(spark, sf), "th").select("feed_id", "pos", "title")


@query("soft_cap", f"""{WITH_ITEMS} SELECT feed_id, pos, {_rank_sql('pos')} > 5 AS store_only FROM items
QUALIFY {_rank_sql('pos')} <= 10""")
def soft_cap(spark, sf):
    return repair.soft_cap(repair.hard_cap(derived.items(spark, sf))).select("feed_id", "pos", "store_only")


# --- fill and finish ---------------------------------------------------------------------------------------------------------
_FILLED = f"""{WITH_ITEMS},
fixed AS (SELECT *, {_UNWRAPPED} AS fixed_link, row_number() OVER (PARTITION BY feed_id ORDER BY pos) AS rank FROM items),
outcomes AS (
  SELECT url, page_id, regexp_replace(url, '#$', '') AS clean, CASE WHEN page_id % 13 = 0 THEN 'failed'
    WHEN page_id % 17 = 0 THEN 'other' ELSE 'page' END AS status,
    nullif(regexp_extract(html, '<article>.*</article>', 0, 's'), '') AS article FROM pages),
filled AS (
  SELECT f.feed_id, f.pos, f.fixed_link AS link, f."desc", f.rank > 5 AS store_only,
    CASE WHEN f.fixed_link IS NULL THEN 'no link' ELSE coalesce(o.status, 'failed') END AS status,
    CASE WHEN o.status = 'page' THEN coalesce(o.article, f.content) ELSE f.content END AS content,
    CASE WHEN o.status IS NOT NULL THEN o.url || '!' END AS final_url
  FROM fixed f LEFT JOIN outcomes o ON o.clean = f.fixed_link)"""


def _filled(spark, sf):
    rows = repair.rank_items(derived.items(spark, sf))
    rows = repair.soft_cap(repair.unwrap_links(repair.absolute_item_links(rows)))
    pid = F.col("page_id")
    status = F.when(pid % 13 == 0, "failed").when(pid % 17 == 0, "other").otherwise("page")
    outcomes = derived.pages(spark, sf).select(
        "url", F.concat("url", F.lit("!")).alias("final_url"), status.alias("status"), F.when(
            status == "page", F.nullif(F.regexp_extract("html", "(?s)<article>.*</article>", 0), F.lit("")))
        .alias("article"))
    return fill.fill_items(rows, outcomes)


@query("fill_items", f"{_FILLED} SELECT feed_id, pos, status, final_url, md5(content) AS content_md5 FROM filled")
def fill_items(spark, sf):
    return _filled(spark, sf).select("feed_id", "pos", "status", "final_url", F.md5("content").alias("content_md5"))


@query("drop_unfetched", f"{_FILLED} SELECT feed_id, pos, status FROM filled WHERE NOT (store_only AND status = 'failed')")
def drop_unfetched(spark, sf):
    return fill.drop_unfetched(_filled(spark, sf)).select("feed_id", "pos", "status")


@query("resolve_link", f"{_FILLED} SELECT feed_id, pos, CASE WHEN status = 'page' THEN final_url ELSE link END AS link FROM filled")
def resolve_link(spark, sf):
    return fill.resolve_link(_filled(spark, sf)).select("feed_id", "pos", "link")


@query("clip", f"""{WITH_ITEMS} SELECT feed_id, pos, CASE WHEN content IS NULL THEN "desc" END AS "desc",
  "desc" || '{fill.RULE}' || content AS both FROM items""")
def clip(spark, sf):
    df = fill.clip(derived.items(spark, sf))
    return df.select("feed_id", "pos", "desc", F.when(F.col("desc").isNull(), F.col("content")).alias("both"))


@query("no_link", r"""SELECT page_id, regexp_replace(html, '</?a( [^>]*)?>', '', 'g') AS content FROM pages""")
def no_link(spark, sf):
    return fill.no_link(derived.pages(spark, sf).select("page_id", F.col("html").alias("content")))


@query("no_ref", f"{WITH_ITEMS} SELECT feed_id, pos, '' AS link FROM items")
def no_ref(spark, sf):
    return fill.no_ref(derived.items(spark, sf)).select("feed_id", "pos", "link")


# --- article extraction -----------------------------------------------------------------------------------------------------------
_WORDS = r"length(regexp_replace(regexp_replace({0}, '^[\s\x0b\p{{Z}}]+|[\s\x0b\p{{Z}}]+$', '', 'g'), '(?s)[\r\n\t ]*[^\r\n\t ].{{0,5}}', 'x', 'g'))"


@query("stride_words", f"SELECT doc_id, {_WORDS.format('text')} AS words FROM documents")
def stride_words(spark, sf):
    return derived.table(spark, sf, "documents").select(
        "doc_id", txt.stride_words(F.col("text")).cast("bigint").alias("words"))


@query("html_text_stats", rf"""
SELECT page_id, length(t) AS chars, len(list_filter(regexp_split_to_array(t, '[\s\x0b\p{{Z}}]+'), lambda w: w <> '')) AS words
FROM (SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '<!--.*?-->|</?[a-zA-Z][^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM pages)""")
def html_text_stats(spark, sf):
    return derived.pages(spark, sf).select(
        "page_id", txt.text_length(F.col("html")).cast("bigint").alias("chars"),
        txt.text_words(F.col("html")).cast("bigint").alias("words"))


# The test pages all have one layout, so SQL can list their elements: the parts between known tags, list
# entries and paragraphs (an unclosed <b> ends where the next <p> starts).
_FRAGMENT = r"""replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<!--.*?-->|<[^>]*>', '', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')"""


def _between(start, end, whole="html"):
    return f"regexp_extract({whole}, '{start}(.*?){end}', 1, 's')"


_ELEMENTS = rf"""
parts AS (
  SELECT page_id, {_between('<title>', '</title>')} AS title, regexp_extract(html, '<body>(.*)', 1, 's') AS body,
    {_between('<nav>', '</nav>')} AS nav, {_between('<div class="ad">', '</div>')} AS ad,
    {_between('<article>', '</article>')} AS article, {_between('<footer>', '</footer>')} AS footer FROM pages),
entries AS (SELECT page_id, unnest(li) AS li, generate_subscripts(li, 1) AS i FROM (
  SELECT page_id, regexp_extract_all(nav, '<li>(.*?)</li>', 1) AS li FROM parts)),
paragraphs AS (SELECT page_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (
  SELECT page_id, string_split(article, '<p>')[2:] AS p FROM parts)),
elements AS (
  SELECT page_id, 0 AS ord, 'html' AS tag, -1 AS up, 0 AS depth, '' AS t, nav AS links, 0 AS base FROM parts
  UNION ALL SELECT page_id, 1, 'head', 0, 1, title, '', 0 FROM parts
  UNION ALL SELECT page_id, 2, 'meta', 1, 2, '', '', 0 FROM parts
  UNION ALL SELECT page_id, 3, 'title', 1, 2, title, '', 0 FROM parts
  UNION ALL SELECT page_id, 4, 'style', 1, 2, '', '', 0 FROM parts
  UNION ALL SELECT page_id, 5, 'script', 1, 2, '', '', 0 FROM parts
  UNION ALL SELECT page_id, 6, 'body', 0, 1, body, nav, 0 FROM parts
  UNION ALL SELECT page_id, 7, 'nav', 6, 2, nav, nav, 0 FROM parts
  UNION ALL SELECT page_id, 8, 'ul', 7, 3, nav, nav, 0 FROM parts
  UNION ALL SELECT page_id, 10 + 2 * i, 'li', 8, 4, li, li, 0 FROM entries
  UNION ALL SELECT page_id, 11 + 2 * i, 'a', 10 + 2 * i, 5, li, '', -1 FROM entries
  UNION ALL SELECT page_id, 100000, 'div', 6, 2, ad, '', 0 FROM parts
  UNION ALL SELECT page_id, 100001, 'article', 6, 2, article, '', 4 FROM parts
  UNION ALL SELECT page_id, 100002, 'h1', 100001, 3, {_between('<h1>', '</h1>', 'article')}, '', 4 FROM parts
  UNION ALL SELECT page_id, 100000 + 3 * i, 'p', 100001, 3, p, '', 4 FROM paragraphs
  UNION ALL SELECT page_id, 100001 + 3 * i, 'b', 100000 + 3 * i, 4, p, '', 0 FROM paragraphs WHERE p LIKE '<b>%'
  UNION ALL SELECT page_id, 100002 + 3 * i, 'br', 100001 + 3 * i, 5, '', '', 4 FROM paragraphs WHERE p LIKE '<b>%'
  UNION ALL SELECT page_id, 2000000000, 'footer', 6, 2, footer, '', -2 FROM parts),
counted AS (
  SELECT *, {_WORDS.format(_FRAGMENT.format('t'))} AS words,
    {_WORDS.format(_FRAGMENT.format("array_to_string(regexp_extract_all(links, '<a[^>]*>(.*?)</a>', 1), ' ')"))} AS link_words
  FROM elements),
owned AS (
  SELECT *, CASE WHEN tag IN ('head', 'meta', 'style', 'script') THEN 0.0 WHEN tag <> 'html' THEN (base + least(words // 10, 3))
    * (1 - CASE WHEN words = 0 THEN 0 ELSE 2 * CAST(link_words AS DOUBLE) / words END) END AS own FROM counted),
gated AS (
  SELECT o.*, o.tag <> 'html' AND (o.depth < 4 OR (u.own > 0 AND (o.depth < 5 OR g.own > 0))) AS visited
  FROM owned o LEFT JOIN owned u ON u.page_id = o.page_id AND u.ord = o.up
    LEFT JOIN owned g ON g.page_id = o.page_id AND g.ord = u.up),
spread AS (
  SELECT g.*, CASE WHEN g.visited AND (g.own > 0 OR g.depth <= 2) THEN g.own ELSE 0 END + coalesce(h.half, 0) AS score
  FROM gated g LEFT JOIN (SELECT page_id, up, sum(own / 2) AS half FROM gated WHERE visited AND own >= 2 GROUP BY ALL) h
    ON h.page_id = g.page_id AND h.up = g.ord)"""


@query("score_nodes", f"""WITH {_ELEMENTS}
SELECT page_id, tag, count(*) AS n, CAST(sum(link_words) AS BIGINT) AS link_words, round(sum(own), 6) AS own FROM owned
GROUP BY ALL""")
def score_nodes(spark, sf):
    rows = article.score_nodes(derived.pages(spark, sf))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum("link_words").alias("link_words"),
                                              F.round(F.sum("own_score"), 6).alias("own"))


@query("visit_gate", f"""WITH {_ELEMENTS} SELECT page_id, tag, count(*) AS n FROM gated WHERE visited GROUP BY ALL""")
def visit_gate(spark, sf):
    rows = article.visit_gate(derived.pages(spark, sf))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("spread_scores", f"""WITH {_ELEMENTS}
SELECT page_id, tag, round(sum(score), 6) AS score FROM spread GROUP BY ALL HAVING round(sum(score), 6) <> 0""")
def spread_scores(spark, sf):
    rows = article.score_nodes(derived.pages(spark, sf)).groupBy("page_id", "tag").agg(
        F.round(F.sum("score"), 6).alias("score"))
    return rows.where("score <> 0")


_BEST = f"""{_ELEMENTS},
chained AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.page_id ORDER BY round(s.score, 9) DESC, s.ord) AS n,
    list_value(s.ord, s.up, u.up, g.up) AS chain
  FROM spread s LEFT JOIN spread u ON u.page_id = s.page_id AND u.ord = s.up
    LEFT JOIN spread g ON g.page_id = s.page_id AND g.ord = u.up),
picked AS (
  SELECT a.page_id, CASE WHEN round(a.score, 9) >= 5 THEN coalesce(
    list_filter(a.chain, lambda x: x >= 0 AND list_contains(b.chain, x))[1], a.ord) END AS ord
  FROM chained a JOIN chained b ON b.page_id = a.page_id AND b.n = 2 WHERE a.n = 1)"""


@query("best_node", f"""WITH {_BEST}
SELECT p.page_id, s.tag AS best_tag, round(s.score, 6) AS best_score
FROM picked p LEFT JOIN spread s ON s.page_id = p.page_id AND s.ord = p.ord""")
def best_node(spark, sf):
    return article.best_node(derived.pages(spark, sf)).select(
        "page_id", "best_tag", F.round("best_score", 6).alias("best_score"))


@query("node_override", f"""
WITH {_BEST} SELECT picked.page_id, CASE WHEN picked.page_id % 3 = 0 THEN 'section' ELSE e.tag END AS best_tag
FROM picked LEFT JOIN elements e ON e.page_id = picked.page_id AND e.ord = picked.ord""")
def node_override(spark, sf):
    # Every third page has a <section>, which is wanted wherever it is; the others keep their best element.
    marked = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("</footer>"), F.lit("<section>x</section></footer>")))
    given = derived.pages(spark, sf).withColumn("html", F.coalesce(marked, "html"))
    return article.best_node(given, selector=Select(tag="section")).select("page_id", "best_tag")


# Cleaned articles of the test pages: paragraphs without words go, the list of links and the footer go with <body>.
_MARKUP = _XML.format(_FRAGMENT)
_CLEANED = f"""{_BEST},
kept AS (
  SELECT page_id, string_agg(CASE WHEN p LIKE '<b>%' THEN '<p><b>' || {_MARKUP.format('p')} || '<br></b></p>'
    ELSE '<p>' || {_MARKUP.format('p')} || '</p>' END, '' ORDER BY i) AS ps, string_agg({_FRAGMENT.format('p')}, '' ORDER BY i) AS t
  FROM paragraphs WHERE {_WORDS.format(_FRAGMENT.format('p'))} > 0 GROUP BY page_id),
articles AS (
  SELECT q.page_id, e.tag, '<article><h1>' || {_MARKUP.format(_between('<h1>', '</h1>', 'q.article'))} || '</h1>' || coalesce(k.ps, '') || '</article>' AS art,
    {_FRAGMENT.format(_between('<h1>', '</h1>', 'q.article'))} || coalesce(k.t, '') AS t,
    CASE WHEN {_WORDS.format(_FRAGMENT.format('ad'))} > 0 THEN '<div>' || {_MARKUP.format('ad')} || '</div>' ELSE ad END AS ad_kept,
    {_FRAGMENT.format('ad')} AS ad_text
  FROM parts q JOIN picked USING (page_id) LEFT JOIN elements e ON e.page_id = q.page_id AND e.ord = picked.ord
    LEFT JOIN kept k ON k.page_id = q.page_id),
cleaned AS (
  SELECT page_id, CASE tag WHEN 'body' THEN '<body>' || ad_kept || art || '</body>' WHEN 'article' THEN art END AS html,
    CASE tag WHEN 'body' THEN ad_text || t WHEN 'article' THEN t END AS text FROM articles),
extracted AS (
  SELECT page_id, CASE WHEN {_WORDS.format('text')} >= 50 THEN html END AS article FROM cleaned)"""


@query("clean_subtree", f"WITH {_CLEANED} SELECT page_id, html, text FROM cleaned")
def clean_subtree(spark, sf):
    return article.clean_subtree(derived.pages(spark, sf)).select("page_id", "cleaned.html", "cleaned.text")


_ARTICLE_TEXT = f"regexp_extract(html, '<article>(.*)</article>', 1, 's')"


@query("link_density", rf"""
SELECT page_id, words, link_words, words - link_words >= 50 AND link_words / words <= 0.3 AS accepted FROM (
  SELECT page_id, {_WORDS.format("regexp_replace(html, '<[^>]*>', '', 'g')")} AS words,
    {_WORDS.format("array_to_string(regexp_extract_all(html, '<a href[^>]*>([^<]*)</a>', 1), ' ')")} AS link_words FROM pages)""")
def link_density(spark, sf):
    text = F.regexp_replace("html", "<[^>]*>", "")
    links = F.array_join(F.regexp_extract_all("html", F.lit("<a href[^>]*>([^<]*)</a>"), F.lit(1)), " ")
    counted = derived.pages(spark, sf).select("page_id", txt.stride_words(text).cast("bigint").alias("words"),
                                              txt.stride_words(links).cast("bigint").alias("link_words"))
    return counted.withColumn("accepted", article.link_density(F.col("words"), F.col("link_words")))


_ROOT = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


# Whole markup of a page: no declaration or comments, what is left open closed, links absolute, and
# references as characters (one cut off by a tag is text); `{}` adds what the query puts behind the heading.
_WHOLE = rf"""replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  html, '&([a-z]*)<', '&amp;\1<', 'g'), '(</body></html>)?$', '</body></html>'), '<!DOCTYPE[^>]*>|<!--.*?-->', '', 'gs'), '<a href="(/[^"]*)"', '<a href="' || {_ROOT} || '\1"', 'g'),
  '<br>(</p>)?', '<br></b></p>', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '</h1>', '</h1>' || {{}})"""


@query("absolute_links", f"""
SELECT page_id, {_WHOLE.format("""'<img alt="x" src="' || """ + _ROOT + """ || '/pics/a.png">'""")} AS html FROM pages""")
def absolute_links(spark, sf):
    with_image = F.replace("html", F.lit("</h1>"), F.lit('</h1><img alt="x" src=" /pics/a.png">'))
    return article.absolute_links(derived.pages(spark, sf).withColumn("html", with_image)).select("page_id", "html")


@query("sanitize_page", f"""
SELECT page_id, regexp_replace({_WHOLE.format("' behind<a href=\"' || " + _ROOT + " || '/r/' || page_id || '\">x</a> end'")},
  '<script>.*?</script>', '', 'gs') AS html FROM pages""")
def sanitize_page(spark, sf):
    dropped = F.concat(F.lit('</h1><script src="s.js">var a = "<p>no</p>";</script> behind<a href="/r/'), F.col("page_id").cast("string"),
                       F.lit('">x</a><noscript><a href="/n">n</a></noscript><iframe src="/i"></iframe> end'))
    return article.sanitize_page(derived.pages(spark, sf).withColumn("html", F.replace(F.col("html"), F.lit("</h1>"), dropped))).select("page_id", "html")


@query("extract_articles", f"WITH {_CLEANED} SELECT x.page_id, p.url, x.article FROM extracted x JOIN pages p USING (page_id)")
def extract_articles(spark, sf):
    return article.extract_articles(derived.pages(spark, sf))


# --- the whole job ---------------------------------------------------------------------------------------------------------------------
def _world(spark, sf):
    captured = derived.responses(spark, sf).drop("page_id", "visit")
    return captured.unionByName(derived.feed_responses(spark, sf)), derived.feed_table(spark, sf).select("feed_id", "feed_url")


@query("full_text_feed_proxy", f"""{WITH_ITEMS},
capped AS (SELECT *, CAST(feed_id AS INTEGER) % 5 < 2 AS rss FROM items),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY
  coalesce(CASE WHEN NOT rss THEN updated END, time, {_NOW_EPOCH}) DESC, pos DESC) AS rank FROM capped)
SELECT feed_id, pos, {_FIX_TITLE} AS title, {_UNWRAPPED} AS link, "desc", content, time,
  CASE WHEN NOT rss THEN updated END AS updated FROM ranked WHERE rank <= 10""")
def full_text_feed_proxy(spark, sf):
    responses, wanted = _world(spark, sf)
    return item_columns(full_text_feed(responses, wanted, NOW, order="newest", proxy=True)[1])


_FULL = f"""WITH RECURSIVE {SQL_CAPTURES}, {_CURRENT},
walk AS (
  SELECT url, target AS final_url, 1 AS hops FROM moving
  UNION ALL
  SELECT w.url, m.target, w.hops + 1 FROM walk w JOIN moving m ON m.url = w.final_url WHERE w.hops < 10),
finals AS (
  SELECT c.url, coalesce(w.final_url, c.url) AS final_url FROM current c LEFT JOIN (
    SELECT * FROM walk WHERE final_url NOT IN (SELECT url FROM moving)) w USING (url)), {_CLEANED},
outcomes AS (
  SELECT f.url, f.final_url, x.article, CASE WHEN t.code <> 200 THEN 'failed' WHEN {_IS_HTML} THEN 'page' ELSE 'other' END AS status
  FROM finals f JOIN current t ON t.url = f.final_url LEFT JOIN extracted x ON x.page_id = t.page_id), {SQL_ITEMS},
ranked AS (
  SELECT *, {_FIX_TITLE} AS fixed_title, {_UNWRAPPED} AS fixed_link, row_number() OVER (PARTITION BY feed_id ORDER BY pos) AS rank
  FROM items),
full_items AS (
  SELECT r.feed_id, r.pos, r.fixed_title AS title, r.fixed_link AS link,
    CASE WHEN o.status = 'page' THEN o.final_url ELSE r.fixed_link END AS final_link, r."desc",
    CASE WHEN o.status = 'page' THEN coalesce(o.article, r.content) ELSE r.content END AS content, r.time,
    CASE WHEN CAST(r.feed_id AS INTEGER) % 5 >= 2 THEN r.updated END AS updated
  FROM ranked r LEFT JOIN outcomes o ON o.url = r.fixed_link
  WHERE r.rank <= 10 AND NOT (r.rank > 5 AND r.fixed_link IS NOT NULL AND coalesce(o.status, 'failed') = 'failed'))"""


@query("full_text_feed", f"""{_FULL}
SELECT feed_id, pos, title, final_link AS link, "desc", content, time, updated FROM full_items""")
def full_text_feed_query(spark, sf):
    responses, wanted = _world(spark, sf)
    captures, folder = _written(spark, responses)
    items = full_text_feed(captures, wanted, NOW, resolve=True)[1]
    _remove(spark, folder)      # what is still to do reads checkpoints
    return item_columns(items)


@query("full_text_documents", _RSS_SQL.replace("{part}", "0 AS part,").replace(WITH_ITEMS, _FULL).replace(
    "FROM items GROUP BY", "FROM full_items GROUP BY"))
def full_text_documents_query(spark, sf):
    responses, wanted = _world(spark, sf)
    captures, folder = _written(spark, responses)
    documents = full_text_documents(captures, wanted, NOW, format="rss")
    _remove(spark, folder)
    return documents


def _written(spark, captures):
    """`captures` as a table below the shared folder, so that reading pages again does not build them again, and that folder."""
    folder = _work_folder(spark)
    captures.write.parquet(f"{folder}/captures")
    return spark.read.parquet(f"{folder}/captures"), folder


def _archived(spark, captures):
    """An archive of `captures` below the shared folder, and that folder."""
    folder = _work_folder(spark)
    write_archive(captures, folder)
    return Archive(spark, folder), folder


@query("full_text_feed_archive", ORACLES["full_text_feed"])
def full_text_feed_archive(spark, sf):
    responses, wanted = _world(spark, sf)
    archive, folder = _archived(spark, responses)
    return _kept(item_columns(full_text_feed(archive, wanted, NOW, resolve=True)[1]), folder)


@query("archive_latest_response", ORACLES["latest_response"])
def archive_latest_response(spark, sf):
    archive, folder = _archived(spark, derived.responses(spark, sf))
    return _kept(_latest_columns(archive.latest_response()), folder)


# --- streams ---------------------------------------------------------------------------------------------------------------------------
def _work_folder(spark):
    """A new folder below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/feedloom-{uuid.uuid4().hex}"


def _kept(df, folder):
    """`df` cut off from the folder it is read from, which goes."""
    kept = cut(df)
    _remove(df.sparkSession, folder)
    return kept


def _remove(spark, folder):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _spool(df, folder, days):
    """Write captures in a few files by day, as they would arrive; several tasks can read one file."""
    _arrive(df.repartitionByRange(days, F.to_date("fetched_at")), f"{folder}/captures")
    return f"{folder}/captures"


def _arrive(df, path):
    """Write captures as they are dealt; several tasks can read one file."""
    df.select("url", "final_url", "code", "msg", "headers", "body", "fetched_at").write.option(
        "parquet.block.size", str(8 << 20)).option("compression", "zstd").parquet(path)


@query("stream_items", f"""{WITH_ITEMS}
SELECT DISTINCT feed_url AS feed_id, coalesce(link, title, '') AS item_key FROM items""")
def stream_items(spark, sf):
    folder = _work_folder(spark)
    first = derived.feed_responses(spark, sf)
    # Each feed again after 30 hours and then every three days for two weeks, with two days for late data. What arrives is taken in
    # and goes before the next does, but for the first, of which the others are made.
    for hours in (0, 30, 102, 174, 246, 318):
        arrived = f"{folder}/captures/{hours}"
        _arrive(first.withColumn("fetched_at", F.timestamp_add("HOUR", F.lit(hours), "fetched_at")), arrived)
        first = spark.read.parquet(f"{folder}/captures/0")
        spark.sparkContext._jvm.System.gc()     # shuffle files stay until the driver collects what made them
        stream = streams.read_captures(spark, f"{folder}/captures/*")
        (streams.stream_items(stream).select("feed_id", "item_key").writeStream.format("parquet").outputMode("append")
         .option("path", f"{folder}/items").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
         .start().awaitTermination())
        if hours:
            _remove(spark, arrived)
    return _kept(spark.read.schema("feed_id string, item_key string").parquet(f"{folder}/items"), folder)


@query("stream_latest_response", f"""{WITH_CAPTURES}, full_captures AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched DESC) AS n FROM captures WHERE code <> 304),
confirmed AS (SELECT url, max(fetched) AS at FROM captures WHERE code = 304 GROUP BY url)
SELECT f.url, f.code, f.fetched, CASE WHEN c.at > f.fetched THEN c.at END AS revalidated, md5(f.html) AS body_md5
FROM full_captures f LEFT JOIN confirmed c USING (url) WHERE n = 1""")
def stream_latest_response(spark, sf):
    folder = _work_folder(spark)
    stream = streams.read_captures(spark, _spool(derived.responses(spark, sf), folder, 3), files_per_batch=1)
    (streams.stream_latest_response(stream, f"{folder}/store").option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return _kept(streams.read_store(spark, f"{folder}/store").select(
        "url", "code", epoch("fetched_at").alias("fetched"), epoch("revalidated_at").alias("revalidated"),
        F.md5("body").alias("body_md5")), folder)
