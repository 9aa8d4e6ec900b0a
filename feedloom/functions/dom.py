"""HTML text to one nested column per page: `dom`.

A page stays one row: its elements are an array in document order, so a
subtree is a slice and no shuffle is needed to look at children, ancestors or
descendants. Texts and markup are stored once per page as bytes; elements hold
offsets, which makes every substring constant-time to find.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from feedloom.functions.parts import by_parts
from feedloom.functions.text import let
from feedloom.functions.urls import absolute_url

NODE = T.StructType([
    T.StructField("node_id", T.IntegerType()),      # document order, 0 = <html>
    T.StructField("last_desc", T.IntegerType()),    # last element of the subtree
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("kids", T.ArrayType(T.IntegerType())),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("t0", T.IntegerType()), T.StructField("t1", T.IntegerType()),   # text, characters
    T.StructField("b0", T.IntegerType()), T.StructField("b1", T.IntegerType()),   # text, bytes
    T.StructField("o0", T.IntegerType()), T.StructField("o1", T.IntegerType()),   # outer markup, bytes
    T.StructField("m0", T.IntegerType()), T.StructField("m1", T.IntegerType()),   # inner markup, bytes
    T.StructField("a0", T.IntegerType()), T.StructField("a1", T.IntegerType()),   # <a> inside, slots of `links`
])
DOM = T.StructType([
    T.StructField("text", T.BinaryType()),                      # all text, scripts included
    T.StructField("markup", T.BinaryType()),                    # tidy markup of the same tree
    T.StructField("links", T.ArrayType(T.StringType())),        # text of every <a>
    T.StructField("nodes", T.ArrayType(NODE)),
])

# --- fixed values: HTML element classes and implied ends ------------------------
VOID = frozenset("area base basefont br col embed frame hr img input isindex link meta param source track wbr".split())
RAW = frozenset(["script", "style"])
HEAD_ONLY = frozenset("title base meta link script style".split())
_BLOCKS = frozenset(("address article aside blockquote body caption center col colgroup dd dir div dl dt fieldset "
                     "footer form frameset h1 h2 h3 h4 h5 h6 head header hr li listing main menu multicol nav ol p "
                     "pre section table tbody td tfoot th thead title tr ul xmp").split())
_CELLS = frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"])
CLOSED_BY = {
    "p": _BLOCKS,
    "b": frozenset(["p", "center", "td", "th"]),
    "big": frozenset(["p"]), "s": frozenset(["p"]), "small": frozenset(["p"]),
    "strike": frozenset(["p"]), "tt": frozenset(["p"]), "u": frozenset(["p", "td", "th"]),
    "a": frozenset(["a", "fieldset", "table", "td", "th"]),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]),
    "td": _CELLS, "th": _CELLS,
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "tbody": frozenset(["tbody", "tfoot"]), "thead": frozenset(["tbody", "tfoot"]), "tfoot": frozenset(["tbody"]),
    "h1": frozenset(["p", "table", "form", "li", "fieldset"]), "h2": frozenset(["p", "table", "form", "li", "fieldset"]),
    "h3": frozenset(["p", "table", "form", "li", "fieldset"]), "h4": frozenset(["p", "table", "form", "li", "fieldset"]),
    "h5": frozenset(["p", "table", "form", "li", "fieldset"]), "h6": frozenset(["p", "table", "form", "li", "fieldset"]),
    "title": frozenset(["body", "p", "div"]),
}
# An end tag cannot close an open element of higher rank.
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
            "table": 190, "head": 200, "body": 200, "html": 220}


# A reference without its semicolon is plain text; scripts and styles hold no references.
_OPEN_REFERENCE = re.compile(r"(<(script|style)\b.*?(?:</\2|$))|&(?=[a-z][a-z0-9]*(?![a-z0-9;]))", re.I | re.S)


def start_tag(tag, attrs):
    return "<" + tag + "".join(f' {k}="{escape(v, True)}"' for k, v in attrs.items()) + ">"


class _Node:
    """An element while its page is read; the names are those of NODE."""

    __slots__ = ("node_id", "last_desc", "parent_id", "depth", "kids", "tag", "attrs", "t0", "t1", "b0", "b1", "o0", "o1",
                 "m0", "m1", "a0", "a1", "piece")


class _Tree(HTMLParser):
    """Collects the columns of one page. `strict` input is tidy markup of a subtree."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self, strict=False):
        super().__init__(convert_charrefs=True)
        self.strict = strict
        self.nodes, self.stack, self.links = [], [], []
        self.open = {}      # how many elements of each tag are open
        self.frame = {}     # the first <html>, <head> and <body>
        self.text, self.markup = [], []
        self.chars = self.bytes = self.out = 0

    def updatepos(self, i, j):
        return j        # line numbers are not needed

    # writing -----------------------------------------------------------------
    def _emit(self, piece):
        self.markup.append(piece)
        self.out += _size(piece)

    def _open(self, tag, attrs):
        node, parent = _Node(), self.stack[-1] if self.stack else None
        node.node_id, node.parent_id, node.depth = len(self.nodes), parent.node_id if parent else -1, len(self.stack)
        node.kids, node.tag, node.attrs = [], tag, attrs
        node.t0, node.b0, node.o0 = self.chars, self.bytes, self.out
        if parent:
            parent.kids.append(node.node_id)
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in ("html", "head", "body"):
            self.frame.setdefault(tag, node)
        if tag == "a":
            node.piece = len(self.links), len(self.text)
            self.links.append("")
        node.a0 = len(self.links)
        self._emit(start_tag(tag, attrs))
        node.m0 = self.out
        return node

    def _close(self):
        node = self.stack.pop()
        self.open[node.tag] -= 1
        node.last_desc, node.t1, node.b1, node.m1, node.a1 = len(self.nodes) - 1, self.chars, self.bytes, self.out, len(self.links)
        if node.tag == "a":
            slot, piece = node.piece
            self.links[slot] = "".join(self.text[piece:])
        if node.tag not in VOID:
            self._emit(f"</{node.tag}>")
        node.o1 = self.out

    # implied structure -----------------------------------------------------------
    def _imply(self, tag):
        if not self.stack:
            self._open("html", {})
        last = self.stack[-1].tag
        if tag in ("head", "body", "frameset", "html"):
            if tag != "head" and last == "head":
                self._close()
            return
        if tag in HEAD_ONLY:
            if len(self.stack) == 1 and not self._has("head") and not self._has("body"):
                self._open("head", {})
        else:
            if last == "head":
                self._close()
            if not self.open.get("body") and not self.open.get("head") and not self._has("body"):
                self._open("body", {})

    def _has(self, tag):
        """Whether the page's element has a child of this tag."""
        return tag in self.frame and self.frame[tag].depth == 1

    # parser events -------------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        values = {}
        for key, value in attrs:
            values.setdefault(key, value or "")
        if not self.strict:
            while len(self.stack) > 1 and tag in CLOSED_BY.get(self.stack[-1].tag, ()):
                self._close()
            if tag in ("html", "head", "body"):
                same = self.frame.get(tag)
                if same is not None:
                    same.attrs = {**values, **same.attrs}
                    return
            if tag == "html" and not self.stack:
                self._open(tag, values)
                return
            self._imply(tag)
        self._open(tag, values)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        before = len(self.nodes)
        self.handle_starttag(tag, attrs)
        if len(self.nodes) > before and tag not in VOID and not self.strict:
            self._close()

    def handle_endtag(self, tag):
        if tag in VOID or (tag in ("html", "body") and not self.strict):
            return
        rank = END_RANK.get(tag, 100)
        for back, node in enumerate(reversed(self.stack) if self.open.get(tag) else (), 1):
            if node.tag == tag:
                for _ in range(back):
                    self._close()
                return
            if END_RANK.get(node.tag, 100) > rank:
                break
        if tag == "p" and not self.strict and self.stack:
            self._imply("p")
            self._open("p", {})
            self._close()

    def handle_data(self, data):
        if not self.strict:
            where = self.stack[-1].tag if self.stack else None
            if where in (None, "html", "head"):
                if not data.strip():
                    return
                self._imply("p")
                if self.stack[-1].tag in ("html", "body") and where != "body":
                    self._open("p", {})
        elif not self.stack:
            return
        self.text.append(data)
        self.chars += len(data)
        self.bytes += _size(data)
        self._emit(data if self.stack[-1].tag in RAW else escape(data, False))

    # result ------------------------------------------------------------------------------
    def finish(self, html):
        html = html.replace("\x00", "")
        if not self.strict and "&" in html:
            html = _OPEN_REFERENCE.sub(lambda m: m.group(1) or "&amp;", html)
        self.feed(html)
        self.close()
        if not self.nodes and not self.strict:
            self._open("html", {})
        while self.stack:
            self._close()
        return self


def _size(text):
    return len(text) if text.isascii() else len(text.encode("utf-8", "replace"))


def parse_page(html):
    """Tree of one page as a plain record matching `DOM`."""
    return _columns([_Tree().finish(html)])[0].as_py()


_DOM_ARROW = to_arrow_type(DOM)
_NUMBERS = [f.name for f in NODE if f.dataType == T.IntegerType()]


def _lists(kind, lists):
    """A list array of this type, from a flat one."""
    values = [x for some in lists for x in some]
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind.value_type), type=kind)


def _columns(trees) -> pa.Array:
    """Trees (None: null) as one array: a flat column for each field of all nodes, cut into pages."""
    nodes = [n for tree in trees if tree for n in tree.nodes]
    kind = _DOM_ARROW.field("nodes").type
    fields = {f.name: f.type for f in kind.value_type}
    numbers = np.array(list(map(attrgetter(*_NUMBERS), nodes)), np.int32).reshape(len(nodes), len(_NUMBERS))
    columns = {name: pa.array(numbers[:, k]) for k, name in enumerate(_NUMBERS)}
    parent = numbers[:, _NUMBERS.index("parent_id")]
    columns["parent_id"] = pa.array(parent, mask=parent < 0)
    columns["kids"] = _lists(fields["kids"], [n.kids for n in nodes])
    columns["tag"] = pa.array([n.tag for n in nodes], pa.string())
    ends = np.cumsum([0, *(len(n.attrs) for n in nodes)], dtype=np.int32)
    columns["attrs"] = pa.MapArray.from_arrays(
        pa.array(ends), pa.array([k for n in nodes for k in n.attrs], pa.string()),
        pa.array([v for n in nodes for v in n.attrs.values()], pa.string()), type=fields["attrs"])
    flat = pa.StructArray.from_arrays([columns[name] for name in fields], fields=list(kind.value_type))
    ends = np.cumsum([0, *(len(tree.nodes) if tree else 0 for tree in trees)], dtype=np.int32)
    parts = {
        "text": pa.array([_bytes(tree.text) if tree else b"" for tree in trees], pa.binary()),
        "markup": pa.array([_bytes(tree.markup) if tree else b"" for tree in trees], pa.binary()),
        "links": _lists(_DOM_ARROW.field("links").type, [tree.links if tree else [] for tree in trees]),
        "nodes": pa.ListArray.from_arrays(pa.array(ends), flat, type=kind)}
    return pa.StructArray.from_arrays([parts[f.name] for f in _DOM_ARROW], fields=list(_DOM_ARROW),
                                      mask=pa.array([tree is None for tree in trees], pa.bool_()))


def _bytes(pieces):
    return "".join(pieces).encode("utf-8", "replace")


def _parse_pages(html: pa.Array) -> pa.Array:
    return _columns([None if h is None else _Tree().finish(h) for h in html.to_pylist()])


# Non-deterministic only in name: it keeps the optimizer from copying the parse
# into a pushed-down filter or a second projection, which would run it twice.
html_dom = F.arrow_udf(by_parts(_parse_pages), returnType=DOM).asNondeterministic()


# expressions over `dom` -------------------------------------------------------------
def node_text(dom: Column, node: Column) -> Column:
    """All text under a node."""
    return F.substring(dom.text, node.b0 + 1, node.b1 - node.b0).cast("string")


def node_link_text(dom: Column, node: Column) -> Column:
    """Texts of the <a> elements strictly inside a node, joined by one space."""
    return F.array_join(F.slice(dom.links, node.a0 + 1, node.a1 - node.a0), " ")


def inner_markup(dom: Column, node: Column) -> Column:
    return F.substring(dom.markup, node.m0 + 1, node.m1 - node.m0).cast("string")


def outer_markup(dom: Column, node: Column) -> Column:
    return F.substring(dom.markup, node.o0 + 1, node.o1 - node.o0).cast("string")


def under(dom: Column, flags: Column) -> Column:
    """For every element, whether an ancestor of it is flagged (an array of booleans in node order).

    By pointer jumping: an element looks at its parent, then at what that one
    knows, and so on in steps of twice the length. So no element needs a list
    of its ancestors, and a page of any depth takes the logarithm of it in rounds.
    """
    deepest = F.array_max(F.transform(dom.nodes, lambda n: n.depth))
    rounds = F.ceil(F.log2(deepest + 1)).cast("int")
    start = F.struct(
        F.transform(dom.nodes, lambda n: F.coalesce(F.get(flags, n.parent_id), F.lit(False))).alias("hit"),
        F.transform(dom.nodes, lambda n: n.parent_id).alias("up"))

    def step(now, _):
        hit = F.transform(now["hit"], lambda h, i: h | F.coalesce(F.get(now["hit"], F.get(now["up"], i)), F.lit(False)))
        return F.struct(hit.alias("hit"), F.transform(now["up"], lambda u: F.get(now["up"], u)).alias("up"))

    return F.aggregate(F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>")),
                       start, step, lambda now: now["hit"])


def descendants(dom: Column, node: Column) -> Column:
    """Elements strictly inside a node: one slice, because ids are document order."""
    return F.slice(dom.nodes, node.node_id + 2, node.last_desc - node.node_id)


def _escaped(value: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(char), F.lit(ref))
    return value


def _start_markup(node: Column, base: Column) -> Column:
    """A node's start tag with its href and src made absolute."""
    def attribute(kv):
        link = F.when(kv["key"].isin("href", "src") & base.isNotNull(), absolute_url(base, F.trim(kv["value"]))).otherwise(kv["value"])
        return F.concat(F.lit(" "), kv["key"], F.lit('="'), _escaped(link), F.lit('"'))
    return F.concat(F.lit("<"), node.tag, F.array_join(F.transform(F.map_entries(node.attrs), attribute), ""), F.lit(">"))


def rewritten_markup(dom: Column, base: Column, drop: tuple = ()) -> Column:
    """The page's markup without the elements of `drop` (text behind them stays) and with absolute links.

    What changes are spans of the tidy markup: start tags with a link, and
    whole dropped elements that lie in no other. The pieces between them stay.
    """
    def span(node):
        gone = node.tag.isin(*drop) if drop else F.lit(False)
        return F.struct(node.o0.alias("start"), F.when(gone, node.o1).otherwise(node.m0).alias("end"),
                        F.when(gone, F.lit("")).otherwise(_start_markup(node, base)).alias("now"))

    def touched(node):
        linked = node.attrs["href"].isNotNull() | node.attrs["src"].isNotNull()
        return linked | node.tag.isin(*drop) if drop else linked

    some = F.filter(dom.nodes, touched)
    if drop:
        inner = under(dom, F.transform(dom.nodes, lambda n: n.tag.isin(*drop)))
        some = let(inner, lambda inner: F.filter(some, lambda n: ~F.get(inner, n.node_id)))

    def pieces(spans):
        def piece(s, i):
            before = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
            return F.concat(F.substring(dom.markup, before + 1, s["start"] - before).cast("string"), s["now"])
        last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(spans, piece), ""),
                        F.substring(dom.markup, last + 1, F.length(dom.markup)).cast("string"))
    return let(F.transform(some, span), pieces)
