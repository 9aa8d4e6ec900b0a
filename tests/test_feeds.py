"""Feeds: every dialect, round trips, editing, broken documents, site and custom rules, caps, exports, the whole job."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.functions.select import Select, parse_select
from feedloom.operators import exports, feeds, fill, items as repair
from feedloom.plans.full_text import full_text_documents, full_text_feed
from feedloom.sources.rules import CUSTOM_DEFAULTS, RULES, custom_rule, load_rules, read_rules, rules_from_table

TITLE, DESC = "Harbour bulletin", "Notices from the quay"
VALUES = ("Ferry runs again", "https://quay.example/ferry/17", "Crossings on the hour", "The ferry sails from pier four")
ITEM_TITLE, ITEM_LINK, ITEM_DESC, ITEM_CONTENT = VALUES
DOCS = {
    "rss-channel": f"""<?xml version="1.0" encoding="utf-8"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<title>{TITLE}</title><link>https://quay.example/</link><description>{DESC}</description>
<item><guid>17</guid><link>{ITEM_LINK}</link><title>{ITEM_TITLE}</title><pubDate>Tue, 05 Mar 2024 08:30:00 +0200</pubDate>
<content:encoded>{ITEM_CONTENT}</content:encoded><description>{ITEM_DESC}</description></item></channel></rss>""",
    "rss-atom": f"""<feed xmlns="http://www.w3.org/2005/Atom"><id>quay</id><title>{TITLE}</title><subtitle>{DESC}</subtitle>
<entry><id>17</id><published>2024-03-05T08:30:00+02:00</published><updated>2024-03-09T23:15:40Z</updated><link href="{ITEM_LINK}"/>
<title>{ITEM_TITLE}</title><content type="html">{ITEM_CONTENT}</content><summary>{ITEM_DESC}</summary></entry></feed>""",
    "rss-atom03": f"""<feed version="0.3" xmlns="http://purl.org/atom/ns#"><title>{TITLE}</title><subtitle>{DESC}</subtitle>
<entry><issued>2024-03-05T08:30:00+02:00</issued><summary>{ITEM_DESC}</summary><title>{ITEM_TITLE}</title>
<content>{ITEM_CONTENT}</content><link rel="alternate" href="{ITEM_LINK}" type="text/html"/></entry></feed>""",
    "json": json.dumps({"items": [{"content": ITEM_CONTENT, "desc": ITEM_DESC, "time": "2024-03-05T08:30:00+0200", "title": ITEM_TITLE,
                                   "url": ITEM_LINK}], "desc": DESC, "title": TITLE}),
    "html": f"""<!DOCTYPE html><html><body><div id="header"><h1>{TITLE}</h1><p>{DESC}</p></div><div id="content">
<div class="item"><a href="{ITEM_LINK}">{ITEM_TITLE}</a><div class="desc">{ITEM_DESC}</div>
<div class="content">{ITEM_CONTENT}</div></div></div></body></html>""",
    "rss-rdf": f"""<rdf:RDF xmlns="http://purl.org/rss/1.0/" xmlns:content="http://purl.org/rss/1.0/modules/content/"
 xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>{TITLE}</title><description>{DESC}</description></channel>
<item><title>{ITEM_TITLE}</title><description>{ITEM_DESC}</description><content:encoded>{ITEM_CONTENT}</content:encoded>
<link>{ITEM_LINK}</link></item></rdf:RDF>""",
}
WHEN = "2024-03-05 06:30:00"
TIMES = {"rss-channel": (WHEN, None), "rss-atom": (WHEN, "2024-03-09 23:15:40"), "rss-atom03": (None, None), "json": (WHEN, None),
         "html": (None, None), "rss-rdf": (None, None)}


def docs(spark, **texts):
    return spark.createDataFrame([(k, "http://f/" + k, v) for k, v in texts.items()],
                                 "feed_id string, feed_url string, text string")


def parse(spark, **texts):
    parsed = feeds.dispatch_rules(docs(spark, **texts)).cache()
    return parsed, feeds.feed_rows(parsed), feeds.item_rows(parsed)


def fields(row):
    return (row.title, row.link, row.desc, row.content)


@pytest.fixture(scope="module")
def dialects(spark):
    return parse(spark, **DOCS)


def test_every_dialect_is_found_and_read(dialects):
    _, feed_rows, item_rows = dialects
    assert {r.feed_id: (r.rule, r.title, r.desc) for r in feed_rows.collect()} == {
        k: (k, "Harbour bulletin", "Notices from the quay") for k in DOCS}
    got = {r.feed_id: r for r in item_rows.collect()}
    for name in DOCS:
        assert fields(got[name]) == VALUES, name
        assert tuple(str(t) if t else None for t in (got[name].time, got[name].updated)) == TIMES[name]


@pytest.mark.parametrize("target", ["rss", "json", "html"])
@pytest.mark.parametrize("indent", [False, True])
def test_convert_and_read_back(spark, dialects, target, indent):
    _, feed_rows, item_rows = dialects
    out = exports.to_documents(feed_rows, item_rows, target, indent)
    texts = {r.feed_id: r.body for r in out.collect()}
    for text in texts.values():
        assert all(v in text for v in ("Harbour bulletin", "Notices from the quay", *VALUES))
    _, again, rows = parse(spark, **texts)
    assert {r.rule for r in again.collect()} == {{"rss": "rss-channel", "json": "json", "html": "html"}[target]}
    assert {(r.title, r.desc) for r in again.collect()} == {("Harbour bulletin", "Notices from the quay")}
    got = {r.feed_id: r for r in rows.collect()}
    for name in DOCS:
        assert fields(got[name]) == VALUES
        assert str(got[name].time) == str(TIMES[name][0] if target != "html" else None)


def test_change_and_append(dialects):
    _, feed_rows, item_rows = dialects
    changed = feeds.set_fields(item_rows, title="2", link=F.concat("link", F.lit("2")), desc=None)
    assert {fields(r) for r in changed.collect()} == {("2", "https://quay.example/ferry/172", None, "The ferry sails from pier four")}
    assert feeds.set_fields(feed_rows, title="x").first().title == "x"
    new = item_rows.select("feed_id", "pos", F.lit("third").alias("title"))
    both = feeds.append_items(item_rows, new).where("pos = 1").collect()
    assert len(both) == len(DOCS) and {(r.title, r.link) for r in both} == {("third", None)}
    assert feeds.remove_items(item_rows, item_rows.where("feed_id = 'json'")).count() == len(DOCS) - 1
    assert feeds.convert(feed_rows.drop("desc"), item_rows.drop("time"))[1].columns == item_rows.columns


def test_csv(spark, dialects, tmp_path):
    _, feed_rows, item_rows = dialects
    got = {r.feed_id: r.body for r in exports.to_feed_csv(feed_rows, item_rows).collect()}
    assert got["rss-atom"] == ",".join(VALUES) + ",2024-03-05 06:30:00+00:00,2024-03-09 23:15:40+00:00\r\n"
    assert got["html"] == ",".join(VALUES) + ",,\r\n"
    odd = feeds.set_fields(item_rows.where("feed_id = 'html'"), title='a "b", c', desc="x\ny")
    exports.write_csv(odd, str(tmp_path / "csv"))
    text = b"".join(f.read_bytes() for f in (tmp_path / "csv").glob("part-*"))
    assert text == b'"a ""b"", c",https://quay.example/ferry/17,"x\ny",The ferry sails from pier four,,\r\n'


def test_broken_documents(spark):
    rss = DOCS["rss-channel"]
    texts = {
        "junk": "﻿junk " + rss, "bare": rss.replace("Ferry runs again", "a & b &nbsp; &foo; &eacute; &amp;lt;"),
        "control": rss.replace("Ferry runs again", "a\x01b"),
        "cut": rss.replace("</channel></rss>", "<item><title>lost"),
        "cdata": rss.replace("Crossings on the hour", "<![CDATA[<p>a & b</p> &nbsp;]]>"),
        "prefixed": DOCS["rss-atom"].replace("<feed xmlns=", "<atom:feed xmlns:atom=").replace("</feed>", "</atom:feed>")
        .replace("<title", "<atom:title").replace("</title", "</atom:title").replace("<entry", "<atom:entry")
        .replace("</entry", "</atom:entry").replace("<link", "<atom:link"),
        "other prefix": rss.replace("xmlns:content", "xmlns:c").replace("content:encoded", "c:encoded"),
        "media": rss.replace("<item>", '<item xmlns:media="m"><media:title>no</media:title>'),
        "nothing": "<html><body>hello</body></html>", "empty list": '{"items": []}', "no items": "<rss><channel/></rss>",
        "bad json": '{"items": 5', "blank": "",
    }
    parsed, _, rows = parse(spark, **texts)
    got = {r.feed_id: r for r in rows.collect()}
    assert got["junk"].title == "Ferry runs again" and got["cut"].title == "Ferry runs again"
    assert got["bare"].title == "a & b   &foo; é &lt;"
    assert got["control"].title == "ab" and got["cdata"].desc == "<p>a & b</p> &nbsp;"
    assert got["prefixed"].title == "Ferry runs again" and got["prefixed"].link == "https://quay.example/ferry/17"
    assert got["other prefix"].content == "The ferry sails from pier four" and got["media"].title == "Ferry runs again"
    cut = {r.feed_id: r for r in feeds.feed_rows(parsed).collect()}["cut"]
    assert (cut.title, cut.desc) == ("Harbour bulletin", "Notices from the quay")
    rules = {r.feed_id: r.rule for r in parsed.collect()}
    assert all(rules[k] is None for k in ("nothing", "empty list", "no items", "bad json", "blank"))


def test_atom_rich_text_and_orig_link(spark):
    atom = DOCS["rss-atom"].replace('<content type="html">The ferry sails from pier four</content>', '<content type="xhtml">lead <div>a <b>c</b></div> tail</content>') \
        .replace("<feed ", '<feed xmlns:fb="http://rssnamespace.org/feedburner/ext/1.0" ').replace("</entry>", "<fb:origLink>http://o/</fb:origLink></entry>")
    _, _, rows = parse(spark, a=atom)
    row = rows.first()
    assert row.content == "lead <div>a <b>c</b></div> tail" and row.orig_link == "http://o/"
    fixed = repair.deobfuscate_link(rows).first()
    assert fixed.link == "http://o/"


SITES = {
    "https://twitter.com/x": ('<title>T</title><div class="a tweet b" href="/s/1"><div class="username">u <b>v</b></div>'
                              '<div class="tweet-text"><div>hello <i>w</i></div></div></div><div class="tweets">no</div>',
                              ("u v", "/s/1", "hello <i>w</i>")),
    "http://www.google.com/search?q=a": ('<title>T</title><ul><li class="g"><h3><a href="http://r/">R</a></h3><span class="st">s</span>',
                                         ("R", "http://r/", "s")),
    "https://duckduckgo.com/html/?q=a": (
        '<title>T</title><div class="results_links sponsored"><a class="result__a" href="ad">ad</a></div>'
        '<div class="results_links"><a class="result__a" href="h">t</a><a class="result__snippet">sn</a></div>', ("t", "h", "sn")),
}


def test_site_rules(spark):
    rows = [(u, u, t) for u, (t, _) in SITES.items()] + [("https://twitter.com/none", "https://twitter.com/none", DOCS["rss-channel"])]
    parsed = feeds.dispatch_rules(spark.createDataFrame(rows, "feed_id string, feed_url string, text string")).cache()
    got = {r.feed_id: r for r in feeds.item_rows(parsed).collect()}
    for url, (_, expected) in SITES.items():
        assert (got[url].title, got[url].link, got[url].desc) == expected
    assert {r.title for r in feeds.feed_rows(parsed).collect()} == {"T", None}
    # a matching path is final, even without items
    assert {r.feed_id: r.rule for r in parsed.collect()}["https://twitter.com/none"] == "twitter"
    assert "https://twitter.com/none" not in got


def test_custom_rules(spark):
    html = ('<title>P</title><a href="/up"><li class="e x">one</li></a><li class="e">two <a href="/in">i</a><p>c <b>d</b></p></li>'
            '<li class="ee">no</li>')
    rule = custom_rule(Select(tag="li", cls="e"), item_content=Select(tag="p"))
    parsed = feeds.extract_by_rule(docs(spark, a=html), rule)
    assert [(r.title, r.link, r.content) for r in feeds.item_rows(parsed).orderBy("pos").collect()] == [
        ("one", "/up", None), ("two ic d", "/in", "c <b>d</b>")]
    assert feeds.feed_rows(parsed).first().title == "P"
    text = json.dumps({"a": {"b": [{"t": {"x": "1\n2"}, "n": 5}, {"t": {}}]}, "name": "N"})
    rule = custom_rule("a.b.[]", "json", title="name", item_title="t.x", item_link="n")
    parsed = feeds.extract_json_by_rule(docs(spark, a=text, b='{"a": {"b": {"n": 1}}}', c="nope", d="{}"), rule)
    assert [(r.feed_id, r.title, r.link) for r in feeds.item_rows(parsed).orderBy("feed_id", "pos").collect()] == [
        ("a", "1<br/>2", "5"), ("a", None, None), ("b", None, "1")]


def test_rules_table(spark):
    rules = load_rules(spark).orderBy("rule_order").collect()
    assert [r.rule for r in rules] == ["rss-rdf", "rss-channel", "rss-atom", "rss-atom03", "json", "html", "twitter", "google", "ddg.gg"]
    assert len(rules[6].path) == 4 and rules[1].exprs["items"] == "/rss/channel/item"


def test_rules_from_their_table(spark):
    assert rules_from_table(load_rules(spark)) == RULES
    own = custom_rule((Select(tag="li", cls="x") / Select(tag="p", having=("lang", "a")), Select(cls="y", id="z", without="w")))
    assert rules_from_table(load_rules(spark, [own])) == [own]


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "own.ini").write_text("""
[shelf]
mode = xml
timeformat = %Y
items = /shelf/book
item_title = name
mimetype = text/xml

[boards]
path =
  http://boards.test/*
  https://boards.test/b?q=*
items = //table[class=post]|//div[class=post][not(contains(@class,'ad'))]
item_title = .//h2
item_link = ./@href
item_desc = ./p
""")
    shelf, boards = read_rules(spark, str(tmp_path / "own.ini"))
    assert (shelf.mode, shelf.timeformat, shelf.exprs) == ("xml", "%Y", {"items": "/shelf/book", "item_title": "name"})
    assert boards.mode == "html" and boards.path == ("http://boards.test/*", "https://boards.test/b?q=*")
    assert boards.exprs == {
        "items": (Select(tag="table", cls="post"), Select(tag="div", cls="post", without="ad")),
        "item_title": Select(tag="h2"), "item_link": Select(axis="self", attr="href"), "item_desc": Select(tag="p", axis="child")}
    rows = [("a", "http://boards.test/1", "<div class='post' href='/x'><h2>T</h2><p>d</p></div><div class='post ad'><h2>no</h2></div>"),
            ("b", None, "<shelf><book><name>N</name></book></shelf>")]
    parsed = feeds.dispatch_rules(spark.createDataFrame(rows, "feed_id string, feed_url string, text string"), rules=[shelf, boards])
    assert {(r.feed_id, r.title, r.link, r.desc) for r in feeds.item_rows(parsed).collect()} == {("a", "T", "/x", "d"), ("b", "N", None, None)}


def test_written_paths(spark):
    for rule in RULES:
        for expr in rule.exprs.values() if rule.mode == "html" else ():
            assert parse_select("|".join(map(str, expr)) if isinstance(expr, tuple) else str(expr)) == expr
    for expr in CUSTOM_DEFAULTS.values():
        assert parse_select("|".join(map(str, expr)) if isinstance(expr, tuple) else str(expr)) == expr
    for wrong in ("", "div", "//", "//div[position()=1]", "./a/b", "//a/@href/b", "//a|", "//a//b", "self::a/b", "//a[class=x][class=y]"):
        with pytest.raises(ValueError):
            parse_select(wrong)


def test_rules_that_cannot_be_used(spark, tmp_path):
    for i, text in enumerate(("[a]\nmode = html\n", "[a]\nmode = pdf\nitems = //a\n", "[a]\nitems = //a[1]\n")):
        (tmp_path / f"{i}.ini").write_text(text)
        with pytest.raises(ValueError, match="rule a"):
            read_rules(spark, str(tmp_path / f"{i}.ini"))


# --- order, caps, parts -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def hot(spark):
    """One feed with a third of all items, most of them without a time."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("feed_id"),
        F.col("id").cast("int").alias("pos"), F.concat(F.lit("t"), F.col("id")).alias("title"), F.lit("l").alias("link"),
        F.lit("d").alias("desc"), F.lit(None).cast("string").alias("content"),
        F.when(F.col("id") % 4 == 0, F.timestamp_seconds(F.col("id") * 7919 % 1000)).alias("time"),
        F.when(F.col("id") % 10 == 0, F.timestamp_seconds(F.col("id") % 13)).alias("updated"),
        F.lit(None).cast("string").alias("orig_link"))


@pytest.mark.parametrize("order", ["first", "last", "oldest", "newest"])
def test_rank_of_huge_feeds(hot, order):
    now = "2024-01-01 00:00:00"
    want = {(r.feed_id, r.pos): r.rank for r in repair.rank_items(hot, order, now, 10**6).collect()}
    for parts in (1, 5):
        got = repair.rank_all_items(hot.repartition(11), order, now, parts)
        assert {(r.feed_id, r.pos): r.rank for r in got.collect()} == want
    assert repair.hard_cap(hot, order, now, -1).count() == 900
    assert {(r.feed_id, r.pos) for r in repair.hard_cap(hot, order, now, 120).collect()} == {
        k for k, v in want.items() if v <= 120}
    assert {(r.feed_id, r.pos) for r in repair.hard_cap(hot, order, now, 3).collect()} == {k for k, v in want.items() if v <= 3}


def test_items_without_keys_and_repeats_stay(spark):
    rows = [("f", k % 40, f"t{k}") for k in range(60)] + [(None, 1, "x"), (None, None, "y"), ("g", None, "z")]
    items = spark.createDataFrame([(f, p, t, None, None) for f, p, t in rows],
                                  "feed_id string, pos int, title string, time timestamp, updated timestamp")
    for cap in (-1, 2000, 70):
        got = [(r.feed_id, r.pos, r.title) for r in repair.hard_cap(items, "first", None, cap).collect()]
        assert sorted(got, key=str) == sorted(rows, key=str)
    ranks = sorted(r["rank"] for r in repair.rank_all_items(items, "last", None, 4).collect() if r.feed_id == "f")
    assert ranks == list(range(1, 61))


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_ranks_of_repeated_and_null_keys(spark, limit):
    rows = [("a", 1), ("a", 1), ("a", 0), (None, 5), (None, 5), (None, None), ("b", None), ("b", 2), ("b", 2), ("b", 2)]
    df = spark.createDataFrame([(f, p, None, None, "t" * 9) for f, p in rows], "feed_id string, pos int, time timestamp, updated timestamp, title string")
    for order in ("first", "last", "newest"):
        ranked = repair.rank_all_items(df.repartition(3), order, "2024-01-01", 2, limit)
        assert ranked.columns == [*df.columns, "rank"]
        got = sorted(((r.feed_id, r.pos, r["rank"]) for r in ranked.collect()), key=str)
        plain = df.withColumn("rank", F.expr("row_number() OVER (PARTITION BY feed_id ORDER BY pos " + ("ASC" if order == "first" else "DESC") + ")"))
        assert got == sorted(((r.feed_id, r.pos, r["rank"]) for r in plain.collect()), key=str)


def test_ranking_sorts_keys_only(spark, hot):
    plan = repair.rank_all_items(hot, "newest", "2024-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "BroadcastHashJoin" in plan  # the sort of the keys is done, the items stay


def test_capped_feed_is_one_document(spark, hot):
    feed_rows = hot.select("feed_id", F.lit("T").alias("title"), F.lit("D").alias("desc")).distinct()
    for order in ("newest", "last"):
        capped = repair.hard_cap(hot, order, "2024-01-01 00:00:00", 10).drop("rank")
        for name in ("rss", "json", "html", "csv"):
            assert {(r.feed_id, r.part) for r in exports.to_documents(feed_rows, capped, name).collect()} == {
                (r.feed_id, 0) for r in feed_rows.collect()}


def test_ties_of_equal_times(spark):
    rows = spark.createDataFrame([("f", i, None) for i in range(4)], "feed_id string, pos int, time timestamp") \
        .withColumn("updated", F.col("time"))
    got = {o: [r.pos for r in repair.rank_items(rows, o, "2024-01-01").orderBy("rank").collect()] for o in ("oldest", "newest")}
    assert got == {"oldest": [0, 1, 2, 3], "newest": [3, 2, 1, 0]}


def test_documents_in_parts(spark, hot):
    feed_rows = hot.select("feed_id").distinct().withColumns({"title": F.lit("T"), "desc": F.lit(None).cast("string")})
    feed_rows = feed_rows.unionByName(spark.createDataFrame([("none", "T", None)], "feed_id string, title string, desc string"))
    for target in exports.FORMATS.values():
        whole = {r.feed_id: r.body for r in target(feed_rows, hot, part_items=10**6).collect()}
        parts = {}
        for r in target(feed_rows, hot, part_items=17).orderBy("feed_id", "part").collect():
            parts[r.feed_id] = parts.get(r.feed_id, "") + r.body
        assert parts == whole
    whole = {r.feed_id: json.loads(r.body) for r in exports.to_feed_json(feed_rows, hot, part_items=17)
             .groupBy("feed_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("part", "body"))).getField("body"), "").alias("body")).collect()}
    assert len(whole["hot"]["items"]) == 300 and whole["none"] == {"title": "T", "items": []}


def test_soft_cap_and_search(hot):
    capped = repair.hard_cap(hot, lim_item=4)
    assert repair.soft_cap(capped, 2).where("store_only").count() == capped.where("rank > 2").count()
    assert repair.soft_cap(capped, -1).where("store_only").count() == 0
    assert repair.soft_cap(capped, 2, cache=True).where("NOT store_only").count() == 0
    titled = repair.search_title(hot.withColumn("title", F.when(F.col("pos") > 0, F.col("title"))), "t89")
    assert titled.count() == 11


# --- the whole job ------------------------------------------------------------------------------------
BODY = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore. " * 6


@pytest.fixture(scope="module")
def world(spark):
    page = f"<html><body><article><h1>H</h1><p>{BODY}</p><p><a href='/rel'>r</a> {BODY}</p></article></body></html>"
    items = "".join(f"<item><title>N{i}</title><link>{link}</link><description>D{i}</description></item>" for i, link in enumerate(
        ["http://s/a", "/b", "http://s/moved", "http://s/404", "", "http://s/json", "http://s/a", "http://s/missing", "http://s/short", "http://s/a", "http://s/a"]))
    rows = [
        ("http://f/", 200, "text/html", '<html><head><link rel="alternate" type="application/rss+xml" href="/rss"></head>'),
        ("http://f/rss", 200, "application/rss+xml", f"<rss><channel><title>F</title>{items}</channel></rss>"),
        ("http://s/a", 200, "text/html", page), ("http://f/b", 200, "text/html", page), ("http://s/404", 404, "text/html", page),
        ("http://s/json", 200, "application/json", "{}"), ("http://s/short", 200, "text/html", "<p>short</p>"),
        ("http://f2/", 200, "text/html", "no feed here"),
    ]
    full = [(u, u, c, "m", {"content-type": t}, b.encode(), "2024-01-01 10:00:00") for u, c, t, b in rows]
    full.append(("http://s/moved", "x", 301, "m", {"location": "/a"}, b"", "2024-01-01 10:00:00"))
    full.append(("http://s/a", "x", 304, "m", {}, b"", "2024-01-02 10:00:00"))
    full.append(("http://s/a", "x", 500, "m", {}, b"", "2023-01-02 10:00:00"))
    df = spark.createDataFrame(full, "url string, final_url string, code int, msg string, headers map<string,string>, body binary, at string")
    wanted = spark.createDataFrame([("one", "f/"), ("two", "http://f2/"), ("three", "http://absent/")], "feed_id string, feed_url string")
    return df.withColumn("fetched_at", F.col("at").cast("timestamp")).drop("at").cache(), wanted


def run(world, **options):
    feed_rows, rows = full_text_feed(*world, "2024-06-01 00:00:00", **options)
    return feed_rows.collect(), {r.pos: r for r in rows.collect()}


def test_full_text(world):
    feed_rows, rows = run(world)
    assert [(r.feed_id, r.feed_url, r.rule, r.title) for r in feed_rows] == [("one", "http://f/rss", "rss-channel", "F")]
    # past five items a failed page removes the item; ten items are kept at most
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert rows[0].content.startswith("<article><h1>H</h1><p>Lorem") and 'href="http://s/rel"' in rows[0].content
    assert rows[1].link == "http://f/b" and 'href="http://f/rel"' in rows[1].content
    assert rows[2].content == rows[0].content and rows[2].link == "http://s/moved"
    assert all(rows[i].content is None for i in (3, 4, 5, 8))


def test_options(world):
    _, rows = run(world, resolve=True, clip=True, nolink=True, max_item=2, order="last", lim_item=3)
    assert sorted(rows) == [8, 9, 10] and rows[10].content.startswith("D10" + fill.RULE + "<article>")
    assert "<a " not in rows[10].content and rows[10].desc is None and rows[8].desc == "D8"
    _, rows = run(world, resolve=True, noref=False)
    assert rows[2].link == "http://s/a"
    _, rows = run(world, proxy=True, search="N1", noref=True, lim_item=-1)
    assert sorted(rows) == [1, 10] and rows[1].link == "" and rows[1].content is None
    _, rows = run(world, rule=custom_rule(Select(tag="link"), item_title=Select(axis="self", attr="type"), item_link=Select(axis="self", attr="href")), proxy=True)
    assert (rows[0].title, rows[0].link) == ("application/rss+xml", "http://f/rss")


def test_documents_and_repartitioning(world):
    first = full_text_documents(*world, "2024-06-01", format="json").collect()
    again = full_text_documents(world[0].repartition(7), world[1], "2024-06-01", format="json").collect()
    assert first == again and len(json.loads(first[0].body)["items"]) == 9


# --- user rules ------------------------------------------------------------------------------------------
CATALOGUE = """<?xml version="1.0"?><!-- list --><shelf><label>Books &amp; maps</label><row no="1"><book id="b1"><name>One</name>
<see href="http://b/1">here</see></book><book id="b2"><name> Two </name></book></row><row><book/></row></shelf>"""


def test_xml_rule(spark):
    rule = custom_rule("/shelf/row/book", "xml", title="/shelf/label", item_title="name", item_link="see/@href", item_desc="see", item_content="@id")
    texts = {"a": CATALOGUE, "other": "<rss><channel/></rss>", "bare": CATALOGUE.replace("One", "One & more"), "none": ""}
    parsed = {r.feed_id: r.feed for r in feeds.extract_by_rule(docs(spark, **texts), rule).collect()}
    assert parsed["other"] is None and parsed["none"] is None
    assert parsed["a"].title == "Books & maps"
    assert [(i.title, i.link, i.desc, i.content) for i in parsed["a"]["items"]] == [
        ("One", "http://b/1", "here", "b1"), ("Two", None, None, "b2"), (None, None, None, None)]
    assert parsed["bare"]["items"][0].title == "One & more"


def test_user_rules_in_dispatch(spark):
    shelf = custom_rule("/shelf/row/book", "xml", name="shelf", item_title="name")
    first = custom_rule("/shelf/row", "xml", name="rows", item_title="@no")
    lists = custom_rule(Select(tag="li"), name="lists")
    posts = custom_rule("posts.[]", "json", name="posts", item_title="t")
    far = custom_rule("/shelf/row/book", "xml", name="far", path=("http://f/far*",), item_title="@id")
    texts = {"xml": CATALOGUE, "far1": CATALOGUE, "page": "<ul><li>a<li>b</ul>", "json": '{"posts": [{"t": "x"}]}', "rss": DOCS["rss-channel"],
             "nothing": "<p>x</p>", "text": "just words"}
    own = feeds.dispatch_rules(docs(spark, **texts), rules=[shelf, lists, posts, far]).collect()
    got = {r.feed_id: (r.rule, [i.title for i in r.feed["items"]] if r.feed else None) for r in own}
    assert got == {"xml": ("shelf", ["One", "Two", None]), "far1": ("far", ["b1", "b2", None]), "page": ("lists", ["a", "b"]),
                   "json": ("posts", ["x"]), "rss": (None, None), "nothing": (None, None), "text": (None, None)}
    mixed = {r.feed_id: r.rule for r in feeds.dispatch_rules(docs(spark, **texts), rules=[first, *RULES, shelf, posts]).collect()}
    assert mixed == {"xml": "rows", "far1": "rows", "page": None, "json": "posts", "rss": "rss-channel", "nothing": None, "text": None}


def test_custom_rule_describes_the_feed(spark):
    page = '<html><head><title>T</title><meta name="other" content="no"><meta name="description" content="What it is"></head><body><li>a</body></html>'
    feed = feeds.extract_by_rule(docs(spark, a=page), custom_rule(Select(tag="li"))).first().feed
    assert (feed.title, feed.desc) == ("T", "What it is")
