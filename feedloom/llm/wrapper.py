"""Main text of pages by wrapper induction.

Pages of one host share a template. One page of each host, chosen by a hash, is
its reference; every page's tree of block elements is aligned with it by simple
tree matching. Over all pages of the host, a slot of the reference whose text
stays the same, or takes few values, is template; a slot that varies holds
content. Content blocks are then those varying blocks that do not lie in a part
whose element or class says what else it is (menu, header, footer, sidebar,
notice, advert, form, comments) and are not mostly links. If the page marks its
article, blocks of the article are the text; what is constant is kept there, as
articles may be copies of each other. Else it is the smallest part that holds
most of the varying text.

Pages are not shuffled: references and slots travel to them, by broadcast if
their measured size is at most BROADCAST_BYTES, otherwise by a join by host
whose hot keys Spark splits. What is summed up is one row per slot and text.

Defined cases: a null or empty page, or one without content, has the empty
text; pages without a host are one host; a host with one page has no constant
slots; repeated pages are treated alike; odd markup is read as far as it goes.
"""

from __future__ import annotations

import html as entities
import re
import sys

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import cut, text_of

BROADCAST_BYTES = 64 << 20
#: A slot is template if one text has this share of its pages, or if so few of its texts differ (asked from LEAST_PAGES on).
SAME, FEW, LEAST_PAGES = 0.5, 0.2, 4

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and elements that hold nothing to read.
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
SKIP = frozenset("head noscript template svg math object select button datalist audio video canvas map".split())
#: An element that begins ends an open one of these, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Parts that are never article text, by element and by a word of class, id or role.
OTHER_ELEMENTS = frozenset("nav header footer aside form menu dialog fieldset".split())
OTHER_WORDS = re.compile(r"""(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|consent|gdpr
    |notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|comments?|commentlist|disqus|repl(?:y|ies)|respond
    |sidebar|side|widgets?|related|recommended|recommendations|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|copyright
    |login|signin|signup|search|pagination|pager|toolbar|tags|toc|skip|hidden|contentinfo|complementary)(?:$|[\s_-])""", re.X | re.I)

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*+>|[^<]++|<""", re.S)
MARKS = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    """A block element, or a run of text in one (then `text` is not None)."""

    __slots__ = ("label", "children", "text", "links", "other", "article", "number", "weight")

    def __init__(self, label: str, text: str | None = None, links: int = 0):
        self.label, self.text, self.links = label, text, links
        self.children: list[Node] = []
        self.other = self.article = False
        self.number = self.weight = 0


def marks(attributes: str) -> tuple[str, bool]:
    """Words of class, id and role; whether the element is hidden."""
    words, hidden = [], False
    for name, a, b, c in MARKS.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name != "aria-hidden":
            words.append(value)
    return " ".join(words), hidden


def parse(page: str) -> Node:
    """The tree of block elements and text runs of a page. Inline elements only add to the run they stand in."""
    root = Node("#root")
    stack = [("#root", root)]
    run: list[str] = []
    skipping: list[str] = []
    links = link_depth = at = 0

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                top = stack[-1][1]
                top.children.append(Node(top.label + "#", text, min(links, len(text))))
            run.clear()
        links = 0

    def close(n: int) -> None:
        flush()
        while len(stack) > n:
            node = stack.pop()[1]
            if len(node.children) == 1 and node.children[0].label == node.label + "#":  # an element with just text is one leaf
                only = node.children[0]
                node.text, node.links, node.children = only.text, only.links, []

    size = len(page)
    while at < size:
        m = TAG.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                if not skipping:
                    run.append(m[0])
                    if link_depth:
                        links += len(m[0])
            continue
        name, ending = name.lower(), (m[1] or m[4]) == "/"
        if skipping:
            if ending and name in skipping:
                while skipping.pop() != name:
                    pass
            elif not ending and name in SKIP and name not in VOID:
                skipping.append(name)
            elif not ending and name in RAW:
                at = raw_end(page, at, name)
            elif name == "body" and "head" in skipping:
                skipping.clear()
            else:
                continue
            if name != "body":
                continue
        if not ending:
            if name in RAW:
                at = raw_end(page, at, name)
            elif name in SKIP:
                skipping.append(name)
            elif name == "a":
                link_depth = 1
            elif name == "br":
                run.append(" ")
            elif name in BLOCKS:
                if name in ("html", "body") and any(t == name for t, _ in stack):
                    continue
                flush()
                link_depth = 0
                for k in range(len(stack) - 1, 0, -1):  # a paragraph ends where any block begins
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in ("div", "section", "article", "body", "td", "li"):
                        break
                if name in ENDS:
                    ended, until = ENDS[name]
                    last = 0
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in until:
                            break
                        if stack[k][0] in ended:
                            last = k
                    if last:
                        close(last)
                if name in VOID:
                    continue
                words, hidden = marks(m[3] or m[6] or "")
                node = Node(name + ("." + re.sub(r"\d+", "", words) if words else ""))
                node.other = hidden or name in OTHER_ELEMENTS or name not in ("body", "html") and bool(words and OTHER_WORDS.search(words))
                node.article = name in ("article", "main") or bool(re.search(r"(?i)articlebody|post-content|entry-content", words))
                if name == "header" and any(n.article for _, n in stack):
                    node.other = False  # an article's own heading
                stack[-1][1].children.append(node)
                stack.append((name, node))
        elif name == "a":
            link_depth = 0
        elif name in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                flush()
    close(1)
    return root


def raw_end(page: str, at: int, name: str) -> int:
    """Where the element whose content is not markup ends."""
    m = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
    return m.end() if m else len(page)


def numbered(root: Node) -> list[Node]:
    """All nodes in page order; sets each node's number and its size."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(nodes)
        nodes.append(node)
        todo += reversed(node.children)
    for node in reversed(nodes):
        node.weight = 1 + sum(c.weight for c in node.children)
    return nodes


def align(a: Node, b: Node) -> dict[int, int]:
    """Simple tree matching: node numbers of `a` to those of `b`, order and ancestry kept, as many as possible.

    Equal texts count double, so that a shifted sibling finds its like.
    """
    known: dict[tuple[int, int], int] = {}

    def table(x: Node, y: Node) -> list[list[int]]:
        rows = [[0] * (len(y.children) + 1)]
        for p in x.children:
            last, row = rows[-1], [0]
            for j, q in enumerate(y.children):
                best = last[j + 1] if last[j + 1] >= row[j] else row[j]
                if p.label == q.label:
                    w = last[j] + matched(p, q)
                    if w > best:
                        best = w
                row.append(best)
            rows.append(row)
        return rows

    def matched(x: Node, y: Node) -> int:
        if not x.children or not y.children:
            return 2 if x.text is not None and x.text == y.text else 1
        key = (x.number, y.number)
        if key not in known:
            known[key] = 1 + table(x, y)[-1][-1]
        return known[key]

    found, todo = {}, [(a, b)]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 100_000))
    try:
        while todo:
            x, y = todo.pop()
            found[x.number] = y.number
            if not x.children or not y.children:
                continue
            rows, i, j = table(x, y), len(x.children), len(y.children)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((x.children[i], y.children[j]))
    finally:
        sys.setrecursionlimit(limit)
    return found


def main_text(root: Node, nodes: list[Node], template: set[int], found: dict[int, int]) -> str:
    """The content blocks of a page, joined; `template` has the reference's slots that are not content."""
    usable, marked = [], []
    constant = set()

    todo = [(root, False, False)]
    while todo:  # in page order
        node, other, article = todo.pop()
        other, article = other or node.other, article or node.article
        if node.text is not None and not other and node.links * 2 <= len(node.text):
            if article:
                marked.append(node)
            elif found.get(node.number) in template:
                constant.add(node.number)
            else:
                usable.append(node)
        todo += [(c, other, article) for c in reversed(node.children)]
    if marked:
        return "\n".join(n.text for n in marked)
    if not usable:
        return ""
    # The smallest part with most of the varying text; short pages of loose text are their own part.
    size = {n.number: len(n.text) for n in usable}
    total = {n.number: size.get(n.number, 0) for n in nodes}
    for node in reversed(nodes):
        total[node.number] += sum(total[c.number] for c in node.children)
    part = root
    while True:
        heavy = [c for c in part.children if total[c.number] >= 0.8 * total[root.number] and c.children]
        if not heavy:
            break
        part = heavy[0]
    inside = range(part.number, part.number + part.weight)
    return "\n".join(n.text for n in usable if n.number in inside)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def joined(pages: DataFrame, table: DataFrame, size: Column) -> DataFrame:
    """Pages with the row of their host; the table is broadcast only if it is small."""
    small = (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return pages.join(F.broadcast(table) if small else table, "_host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of `pages` (page_id, url, html)."""
    placed = pages.select("page_id", "url", text_of(F.col("html")).alias("html"), host(F.col("url")).alias("_host"))
    reference = cut(placed.groupBy("_host").agg(F.min_by("html", F.struct(F.xxhash64("page_id", "html"), "html")).alias("ref")))
    bytes_of = F.octet_length("ref") + 64

    @F.arrow_udf("array<struct<slot:int,text:long>>")
    def slots(htmls: pa.Array, refs: pa.Array) -> pa.Array:
        out, kept = [], {}
        for h, r in zip(htmls.to_pylist(), refs.to_pylist()):
            if r not in kept:
                tree = parse(r)
                kept[r] = (tree, numbered(tree))
            tree = parse(h)
            nodes = numbered(tree)
            other = kept[r][1]
            out.append([{"slot": j, "text": hashed(nodes[i].text)} for i, j in align(tree, kept[r][0]).items()
                        if nodes[i].text is not None and other[j].text is not None])
        return pa.array(out, pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.int64())])))

    seen = joined(placed.select("_host", "html"), reference, bytes_of).select("_host", F.explode(slots("html", "ref")).alias("s"))
    texts = seen.groupBy("_host", "s.slot", "s.text").agg(F.count("*").alias("n"))
    sums = texts.groupBy("_host", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("different"))
    fixed = sums.where((F.col("n") >= LEAST_PAGES) & ((F.col("most") >= SAME * F.col("n")) | (F.col("different") <= FEW * F.col("n"))))
    template = fixed.groupBy("_host").agg(F.collect_list("slot").alias("slots"))
    wrappers = cut(reference.join(template, "_host", "left"))

    @F.arrow_udf("string")
    def text(htmls: pa.Array, refs: pa.Array, fixed: pa.Array) -> pa.Array:
        out, kept = [], {}
        for h, r, f in zip(htmls.to_pylist(), refs.to_pylist(), fixed):
            if r not in kept:
                tree = parse(r)
                numbered(tree)
                kept[r] = (tree, set(f.as_py() or ()))
            tree = parse(h)
            nodes = numbered(tree)
            found = align(tree, kept[r][0]) if kept[r][1] else {}
            out.append(main_text(tree, nodes, kept[r][1], found))
        return pa.array(out, pa.string())

    whole = joined(placed, wrappers, bytes_of + 4 * F.coalesce(F.size("slots"), F.lit(0)))
    return whole.select("page_id", "url", text("html", "ref", "slots").alias("text"))
