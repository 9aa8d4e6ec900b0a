"""Feed documents to feeds and items, whatever the dialect.

A parsed document stays one row with a `feed` struct (title, desc, items).
`feed_rows` and `item_rows` turn that into the two tables. All XML dialects
share one `from_xml` call, so a document is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.constants import ITEM_COLUMNS, NS_ATOM, NS_ATOM03, NS_CONTENT, NS_FEEDBURNER, NS_RDF, NS_RSS1
from feedloom.functions.dom import html_dom
from feedloom.functions.select import all_matches, field_value, page_value
from feedloom.functions.text import blank_to_null_sql, let, named_entities_to_text
from feedloom.functions.times import parse_time
from feedloom.operators.joins import lookup_join, spread_small
from feedloom.sources.rules import RULES, Rule, rule_by_path

FEED_TYPE = ("struct<title:string,desc:string,items:array<struct<title:string,link:string,desc:string,"
             "content:string,time:string,updated:string,orig_link:string>>>")

_RSS_ITEM = ("struct<title:array<string>,link:array<string>,description:array<string>,"
             "`content:encoded`:array<string>,pubDate:array<string>,`feedburner:origLink`:array<string>>")
_ENTRY = ("struct<title:array<string>,link:array<struct<_href:string>>,summary:array<string>,"
          "content:array<string>,published:array<string>,updated:array<string>,`feedburner:origLink`:array<string>>")
_XML = (f"channel struct<title:array<string>,description:array<string>,item:array<{_RSS_ITEM}>>, "
        f"item array<{_RSS_ITEM}>, title array<string>, description array<string>, subtitle array<string>, "
        f"entry array<{_ENTRY}>, _broken string")
_XML_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
_PROLOG = r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>)*"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
_DECLARED = "".join(f' xmlns:{p}="{u}"' for p, u in (
    ("content", NS_CONTENT), ("feedburner", NS_FEEDBURNER), ("rdf", NS_RDF)))


# --- repair --------------------------------------------------------------------------
def repair_xml(text: Column) -> Column:
    """Make broken XML readable: junk in front and control characters dropped, named references and
    bare ampersands turned into proper XML. CDATA sections are left alone."""
    bare = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)"

    def outside(part):
        return F.when(part.rlike(bare), F.regexp_replace(named_entities_to_text(part), bare, "&amp;")).otherwise(part)

    def ampersands(clean):
        parts = F.split(clean, r"(?=<!\[CDATA\[)|(?<=\]\]>)")
        fixed = F.transform(parts, lambda p: F.when(p.startswith("<![CDATA["), p).otherwise(outside(p)))
        return (F.when(~clean.contains("&"), clean).when(clean.contains("<![CDATA["), F.array_join(fixed, ""))
                .otherwise(outside(clean)))

    def readable(begun):
        return let(F.when(begun.rlike(_CONTROL), F.regexp_replace(begun, _CONTROL, "")).otherwise(begun), ampersands)

    # Most documents need little repair: what is fine is looked at, not copied.
    return let(F.when(text.startswith("<"), text).otherwise(F.regexp_replace(text, r"^[^<]+", "")), readable)


def _prefix_of(text: Column, namespace: str) -> Column:
    return F.regexp_extract(text, rf"""xmlns:([A-Za-z0-9_.-]+)\s*=\s*["']{namespace}["']""", 1)


def _rename(text: Column, old: Column, new: str) -> Column:
    tags = F.regexp_replace(text, F.concat(F.lit("(</?)"), old, F.lit(":")), F.lit("$1" + (new + ":" if new else "")))
    return tags if not new else F.regexp_replace(tags, F.concat(F.lit("xmlns:"), old, F.lit("(?=\\s*=)")),
                                                 F.lit(f"xmlns:{new}"))


def usual_prefixes(text: Column) -> Column:
    """Bind `content` and `feedburner` to their usual prefix; drop a prefix on the feed's own elements."""
    def renamed(text, prefix, new, condition):
        return let(F.struct(text.alias("text"), prefix(text).alias("prefix")), lambda v: F.when(
            condition(v), _rename(v["text"], v["prefix"], new)).otherwise(v["text"]))

    def root_prefix(t):
        return F.regexp_extract(t, _PROLOG + r"<([A-Za-z0-9_.-]+):feed[\s>]", 1)

    text = let(text, lambda t: renamed(t, root_prefix, "", lambda v: v["prefix"] != ""))
    text = let(text, lambda t: renamed(t, lambda x: _prefix_of(x, NS_RSS1), "",
                                       lambda v: (v["prefix"] != "") & v["text"].contains("RDF")))
    for usual, namespace in (("content", NS_CONTENT), ("feedburner", NS_FEEDBURNER)):
        text = let(text, lambda t: renamed(t, lambda x: _prefix_of(x, namespace), usual,
                                           lambda v: ~v["prefix"].isin("", usual)))
    return text


# --- dialects ----------------------------------------------------------------------------
def xml_dialect(text: Column) -> Column:
    """Ruleset name by root element and namespace; null if the text is not an XML feed."""
    def of_root(root):
        name = F.regexp_extract(root, r"^<(?:[A-Za-z0-9_.-]+:)?([A-Za-z0-9_.-]+)", 1)
        return (F.when(name == "RDF", "rss-rdf").when(name == "rss", "rss-channel")
                .when((name == "feed") & root.contains(NS_ATOM03), "rss-atom03")
                .when((name == "feed") & root.contains(NS_ATOM), "rss-atom"))
    return let(F.regexp_extract(F.regexp_replace(text, r"^[^<]+", ""), _PROLOG + r"(<[A-Za-z][^>]*>)", 1), of_root)


def _first(values: str) -> str:
    return blank_to_null_sql(f"get({values}, 0)")


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


_NONE = "cast(null AS string)"
_RSS_FIELDS = _struct(
    title=_first("i.title"), link=_first("i.link"), desc=_first("i.description"),
    content=_first("i.`content:encoded`"), time=_first("i.pubDate"), updated=_NONE,
    orig_link=_first("i.`feedburner:origLink`"))
_ENTRY_FIELDS = _struct(
    title=_first("e.title"), link="nullif(get(filter(transform(e.link, k -> k._href), h -> h IS NOT NULL), 0), '')",
    desc=_first("e.summary"), content=_first("e.content"), time=_first("e.published"), updated=_first("e.updated"),
    orig_link=_first("e.`feedburner:origLink`"))
# `_parsed` is the tree of a document, `_dialect` its ruleset; RSS 1.0 may list items beside the channel.
_RSS_FEED = _struct(
    title=f"coalesce({_first('_parsed.channel.title')}, {_first('_parsed.title')})",
    desc=f"coalesce({_first('_parsed.channel.description')}, {_first('_parsed.description')})",
    items="transform(concat(coalesce(_parsed.channel.item, array()), CASE WHEN _dialect = 'rss-rdf' OR _parsed.channel "
          f"IS NULL THEN coalesce(_parsed.item, array()) ELSE array() END), i -> {_RSS_FIELDS})")
_ATOM_FEED = _struct(title=_first("_parsed.title"), desc=_first("_parsed.subtitle"),
                     items=f"transform(coalesce(_parsed.entry, array()), e -> {_ENTRY_FIELDS})")
_XML_FEED = (f"CASE WHEN _dialect IN ('rss-rdf', 'rss-channel') THEN {_RSS_FEED} "
             f"WHEN _dialect IS NOT NULL THEN {_ATOM_FEED} END")


def _salvage(text: Column) -> Column:
    """Fields of a document that is cut off or broken: its head and every complete item, one by one."""
    head = F.regexp_extract(text, r"(?s)^(.*?)(?:<(?:item|entry)[\s>]|$)", 1)

    def head_part(tag):
        return F.regexp_extract(head, rf"(?s)(<{tag}(?:\s[^>]*)?>.*?</{tag}>)", 1)

    def fragment(*parts):
        return F.concat(F.lit(f"<r{_DECLARED}>"), *parts, F.lit("</r>"))

    def one(tag):
        found = F.regexp_extract_all(text, F.lit(rf"(?s)(<{tag}[\s>].*?</{tag}>)"), F.lit(1))
        parsed = F.transform(found, lambda f: F.get(F.from_xml(fragment(f), _XML, _XML_OPTIONS)[tag], F.lit(0)))
        return F.filter(parsed, lambda p: p.isNotNull())

    heads = F.from_xml(fragment(head_part("title"), head_part("description"), head_part("subtitle")),
                       _XML, _XML_OPTIONS)
    return F.struct(
        F.lit(None).cast(f"struct<title:array<string>,description:array<string>,item:array<{_RSS_ITEM}>>")
        .alias("channel"), one("item").alias("item"), heads["title"].alias("title"),
        heads["description"].alias("description"), heads["subtitle"].alias("subtitle"), one("entry").alias("entry"),
        F.lit(None).cast("string").alias("_broken"))


def _with_feed(docs: DataFrame, text: str, dialect: Column) -> DataFrame:
    """Add `rule` and `feed` for XML documents of a known dialect (null otherwise)."""
    ready = (docs.withColumn("_dialect", dialect)
             .withColumn("_xml", F.when(F.col("_dialect").isNotNull(),
                                        usual_prefixes(repair_xml(F.col(text)))))
             .withColumn("_tree", F.from_xml("_xml", _XML, _XML_OPTIONS)))
    tree = F.when(F.col("_tree._broken").isNotNull(), _salvage(F.col("_xml"))).otherwise(F.col("_tree"))
    return (ready.withColumn("_parsed", tree).withColumn("rule", F.col("_dialect"))
            .withColumn("feed", F.expr(_XML_FEED)).drop("_dialect", "_xml", "_tree", "_parsed"))


def parse_rss(docs: DataFrame, text: str = "text") -> DataFrame:
    return _with_feed(docs, text, F.lit("rss-channel"))


def parse_rdf(docs: DataFrame, text: str = "text") -> DataFrame:
    return _with_feed(docs, text, F.lit("rss-rdf"))


def parse_atom(docs: DataFrame, text: str = "text") -> DataFrame:
    return _with_feed(docs, text, F.lit("rss-atom"))


def parse_atom03(docs: DataFrame, text: str = "text") -> DataFrame:
    return _with_feed(docs, text, F.lit("rss-atom03"))


_JSON = ("title string, desc string, items array<struct<title:string,url:string,desc:string,content:string,"
         "time:string,updated:string>>")


def _json_text(value: str) -> str:
    return f"nullif(replace({value}, '\\n', '<br/>'), '')"


_JSON_FEED = _struct(title=_json_text("j.title"), desc=_json_text("j.desc"), items=(
    "transform(coalesce(j.items, array()), i -> " + _struct(
        title=_json_text("i.title"), link=_json_text("i.url"), desc=_json_text("i.desc"),
        content=_json_text("i.content"), time=_json_text("i.time"), updated=_json_text("i.updated"),
        orig_link=_NONE) + ")"))


def json_feed(text: str) -> Column:
    """`feed` struct of the JSON dialect; newlines in values become <br/>."""
    return F.expr(f"get(transform(array(from_json({text}, '{_JSON}')), j -> "
                  f"CASE WHEN j IS NOT NULL THEN {_JSON_FEED} END), 0)")


def parse_json_feed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("rule", F.lit("json")).withColumn("feed", json_feed(text))


# --- user rules for XML -------------------------------------------------------------------
def _steps(path: str) -> list[str]:
    return [p for p in path.split("/") if p and p != "."]


class _Shape:
    """The part of a document that a rule's paths touch, as a schema: each element an array of what it holds."""

    def __init__(self):
        self.kids, self.attrs = {}, []

    def add(self, steps):
        if steps and steps[0].startswith("@"):
            if steps[0][1:] not in self.attrs:
                self.attrs.append(steps[0][1:])
        elif steps:
            self.kids.setdefault(steps[0], _Shape()).add(steps[1:])

    def at(self, steps):
        return self.kids[steps[0]].at(steps[1:]) if steps else self

    def plain(self):
        return not self.kids and not self.attrs

    def fields(self):
        return [(f"_{a}", "string") for a in self.attrs] + [(k, f"array<{v.type()}>") for k, v in self.kids.items()]

    def type(self):
        inside = [("_VALUE", "string"), *self.fields()]
        return "string" if self.plain() else "struct<" + ",".join(f"`{n}`:{t}" for n, t in inside) + ">"

    def value(self, base, steps):
        """SQL text of the first value below `base` at `steps`."""
        if not steps:
            return base if self.plain() else f"{base}._VALUE"
        if steps[0].startswith("@"):
            return f"{base}.`_{steps[0][1:]}`"
        return self.kids[steps[0]].value(f"get({base}.`{steps[0]}`, 0)", steps[1:])


def with_xml_feed(docs: DataFrame, rule: Rule, out: str, text: Column) -> DataFrame:
    """Add what a user's XML rule selects from each document; null if its root is another element.

    Paths name elements as the document does: `/root/list/item` for the items,
    `/root/name` for the feed, `name`, `a/b`, `name/@attr` or `.` within an item.
    """
    root, *down = _steps(rule.exprs["items"])
    shape = _Shape()
    shape.add(down)
    fields = {n: _steps(rule.exprs[f"item_{n}"]) for n in ITEM_COLUMNS if f"item_{n}" in rule.exprs}
    heads = {n: _steps(rule.exprs[n])[1:] for n in ("title", "desc") if n in rule.exprs}
    for steps in fields.values():
        shape.at(down).add(steps)
    for steps in heads.values():
        shape.add(steps)
    items = "array(_tree)"
    for step in down:
        items = f"flatten(transform({items}, x -> coalesce(x.`{step}`, array())))"

    def value(of, base, steps):
        return _NONE if steps is None else blank_to_null_sql(of.value(base, steps))

    item = _struct(**{n: value(shape.at(down), "i", fields.get(n)) for n in ITEM_COLUMNS}, orig_link=_NONE)
    feed = _struct(**{n: value(shape, "_tree", heads.get(n)) for n in ("title", "desc")}, items=f"transform({items}, i -> {item})")
    schema = ", ".join(f"`{n}` {t}" for n, t in [*shape.fields(), ("_broken", "string")])
    ready = docs.withColumn("_clean", repair_xml(text))
    named = F.regexp_extract("_clean", _PROLOG + r"<([A-Za-z_][^\s>/]*)", 1) == root
    return (ready.withColumn("_tree", F.from_xml(F.when(named, F.col("_clean")), schema, _XML_OPTIONS))
            .withColumn(out, F.expr(f"CASE WHEN _tree IS NOT NULL THEN {feed} END")).drop("_clean", "_tree"))


def extract_xml_by_rule(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """Apply a user's XML rule to every document."""
    return with_xml_feed(docs.withColumn("rule", F.lit(rule.name)), rule, "feed", F.col(text))


def html_feed(dom: str, rule: Rule) -> str:
    """SQL text of the `feed` struct a rule selects; desc and content keep their markup."""
    exprs = rule.exprs

    def item(name):
        expr = exprs.get(f"item_{name}")
        return _NONE if expr is None else field_value(dom, "i", expr, name in ("desc", "content"))

    page = {name: page_value(dom, exprs[name]) if name in exprs else _NONE for name in ("title", "desc")}
    fields = _struct(**{name: item(name) for name in ITEM_COLUMNS}, orig_link=_NONE)
    return _struct(**page, items=f"transform({all_matches(dom, exprs['items'])}, i -> {fields})")


def extract_by_rule(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """Apply one rule (a site's or a user's) to every document."""
    if rule.mode == "xml":
        return extract_xml_by_rule(docs, rule, text)
    if rule.mode == "json":
        return extract_json_by_rule(docs, rule, text)
    return (spread_small(docs).withColumn("_dom", html_dom(F.col(text))).withColumn("rule", F.lit(rule.name))
            .withColumn("feed", F.expr(html_feed("_dom", rule))).drop("_dom"))


def parse_html_feed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The engine's own HTML layout."""
    return extract_by_rule(docs, next(r for r in RULES if r.name == "html"), text)


def _json_path(path: str) -> str:
    keys = [p for p in path.split(".") if p]
    keys = keys[:keys.index("[]")] if "[]" in keys else keys
    return "$" + "".join(f"['{k}']" for k in keys)


def json_feed_by_rule(text: Column, rule: Rule) -> Column:
    """`feed` struct of a custom JSON rule: dotted paths, `[]` marking the list of items (a single value counts as one)."""
    root = F.try_parse_json(text)
    path = _json_path(rule.exprs["items"])
    many = F.try_variant_get(root, path, "array<variant>")
    single = F.try_variant_get(root, path, "variant")
    items = F.coalesce(many, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<variant>"))

    def value(variant, name):
        expr = rule.exprs.get(name)
        found = F.lit(None).cast("string") if expr is None else F.try_variant_get(variant, _json_path(expr), "string")
        return F.nullif(F.replace(found, F.lit("\n"), F.lit("<br/>")), F.lit(""))

    return F.struct(
        value(root, "title").alias("title"), value(root, "desc").alias("desc"),
        F.transform(items, lambda i: F.struct(
            *[value(i, f"item_{n}").alias(n) for n in ITEM_COLUMNS],
            F.lit(None).cast("string").alias("orig_link"))).alias("items"))


def extract_json_by_rule(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """Apply a custom JSON rule to every document."""
    return docs.withColumn("rule", F.lit(rule.name)).withColumn("feed", json_feed_by_rule(F.col(text), rule))


def dispatch_rules(docs: DataFrame, text: str = "text", url: str = "feed_url", rules: list[Rule] = RULES) -> DataFrame:
    """Choose a ruleset per document and apply it: adds `rule` and `feed`.

    A rule whose path pattern matches the URL is final. Otherwise XML, HTML
    and JSON rules without a path are tried in that order, within each mode in
    the order of `rules`, and the first with an item wins; `rule` and `feed` are
    null if none does. The built-in XML dialects exclude each other by their
    root element, so they are one step at the place of the first of them.
    """
    known = [r.name for r in rules if r in RULES and r.mode == "xml"]
    is_json = F.col(text).rlike(r"^[\s\x{feff}]*[\[{]")
    parsed = docs.withColumn("_site", rule_by_path(F.col(url), rules))
    site = F.col("_site")
    dialect = xml_dialect(F.col(text))
    parsed = _with_feed(parsed, text, F.when(site.isNull() & ~is_json & dialect.isin(known), dialect) if known
                        else F.lit(None).cast("string"))
    parsed = parsed.withColumnsRenamed({"rule": "_xml_rule", "feed": "_xml_feed"})
    temporary = ["_site", "_xml_rule", "_xml_feed", "_dom"]

    def filled(feed):
        return F.coalesce(F.size(F.col(feed)["items"]) > 0, F.lit(False))

    def column(rule):
        temporary.append(f"_feed{len(temporary)}")
        return temporary[-1]

    by_path, steps = [], {"xml": [], "html": [], "json": []}
    placed = False
    for rule in rules:
        if rule.mode == "xml" and rule.name in known and rule in RULES:
            if not placed:
                steps["xml"].append((F.col("_xml_rule"), "_xml_feed"))
            placed = True
        elif rule.mode == "xml":
            out = column(rule)
            asked = site == rule.name if rule.path else site.isNull() & ~is_json
            parsed = with_xml_feed(parsed, rule, out, F.when(asked, F.col(text)))
            (by_path if rule.path else steps["xml"]).append((F.lit(rule.name), out))
    has_xml = F.lit(False)
    for _, out in steps["xml"]:
        has_xml = has_xml | filled(out)
    asked = site.isNotNull() | ~(has_xml | is_json)
    parsed = parsed.withColumn("_dom", html_dom(F.when(asked, F.col(text))))
    for rule in rules:
        if rule.mode == "html":
            out = column(rule)
            when = f"_site = '{rule.name}'" if rule.path else "_site IS NULL AND _dom IS NOT NULL"
            parsed = parsed.withColumn(out, F.expr(f"CASE WHEN {when} THEN {html_feed('_dom', rule)} END"))
        elif rule.mode == "json":
            out = column(rule)
            when = site == rule.name if rule.path else site.isNull() & is_json
            own = json_feed(text) if rule in RULES else json_feed_by_rule(F.col(text), rule)
            parsed = parsed.withColumn(out, F.when(when, own))
        else:
            continue
        (by_path if rule.path else steps[rule.mode]).append((F.lit(rule.name), out))
    tried = [*steps["xml"], *steps["html"], *steps["json"]]
    none = F.lit(None)
    chosen, feed = none.cast("string"), none.cast(FEED_TYPE)
    for name, out in reversed(tried):
        chosen, feed = F.when(filled(out), name).otherwise(chosen), F.when(filled(out), F.col(out)).otherwise(feed)
    for _, out in by_path:
        feed = F.when(site.isNotNull(), F.coalesce(F.col(out), feed)).otherwise(feed)
    return parsed.withColumn("rule", F.coalesce(site, chosen)).withColumn("feed", feed).drop(*temporary)


# --- tables ------------------------------------------------------------------------------------
def feed_rows(parsed: DataFrame) -> DataFrame:
    """feeds(feed_id, feed_url, rule, title, desc)."""
    return parsed.where(F.col("feed").isNotNull()).select("feed_id", "feed_url", "rule", "feed.title", "feed.desc")


def item_rows(parsed: DataFrame, *extra: str) -> DataFrame:
    """items(feed_id, pos, title, link, desc, content, time, updated, orig_link), plus `extra` columns."""
    rows = parsed.select("feed_id", *extra, F.posexplode_outer("feed.items").alias("pos", "i")).where("pos is not null")
    return rows.select("feed_id", *extra, "pos", "i.title", "i.link", "i.desc", "i.content",
                       parse_time(F.col("i.time")).alias("time"), parse_time(F.col("i.updated")).alias("updated"),
                       "i.orig_link")


# --- editing ----------------------------------------------------------------------------------------
def convert(feeds: DataFrame, items: DataFrame, target: str = "rss-channel") -> tuple[DataFrame, DataFrame]:
    """Align feeds and items to a target ruleset's fields; a missing field is null."""
    def aligned(df, keys, wanted):
        return df.select(*keys, *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted])
    feeds = aligned(feeds, ["feed_id"], [("feed_url", "string"), ("title", "string"), ("desc", "string")])
    items = aligned(items, ["feed_id", "pos"], [
        (c, "timestamp" if c in ("time", "updated") else "string") for c in [*ITEM_COLUMNS, "orig_link"]])
    return feeds.withColumn("rule", F.lit(target)).select("feed_id", "feed_url", "rule", "title", "desc"), items


def append_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """Add items after the existing ones; `new` counts its own positions from 0 and may miss columns."""
    last = items.groupBy("feed_id").agg(F.max("pos").alias("_last"))
    placed = lookup_join(new, last, "feed_id", ["feed_id", "pos"]).withColumn(
        "pos", (F.coalesce("_last", F.lit(-1)) + 1 + F.col("pos")).cast("int")).drop("_last")
    return items.unionByName(placed, allowMissingColumns=True)


def set_fields(df: DataFrame, where: Column | None = None, **values) -> DataFrame:
    """Set fields to a value or Column; None removes the field's value."""
    def new(name, value):
        value = value if isinstance(value, Column) else F.lit(value)
        value = value.cast(df.schema[name].dataType)
        return value if where is None else F.when(where, value).otherwise(F.col(name))
    return df.withColumns({name: new(name, value) for name, value in values.items()})


def remove_items(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete the items listed in `keys` (feed_id, pos)."""
    return items.join(keys.select("feed_id", "pos").distinct(), ["feed_id", "pos"], "left_anti")
