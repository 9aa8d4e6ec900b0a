"""Small per-page helper that cleans the markup of an article."""

from __future__ import annotations

import re
from html import escape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from feedloom.constants import (ATTRIBUTES_FINE, CLASS_BAD, TAGS_DANGEROUS, TAGS_JUNK, TAGS_KEPT_EMPTY,
                                TAGS_MEANING)
from feedloom.functions.dom import RAW, VOID, _Tree, start_tag
from feedloom.functions.parts import by_parts_of_several

_BAD = re.compile("|".join(map(re.escape, CLASS_BAD)), re.I)
_STRIDE = re.compile(r"[^\r\n\t ].{0,5}", re.S)
_DANGEROUS, _JUNK, _MEANING = frozenset(TAGS_DANGEROUS), frozenset(TAGS_JUNK), frozenset(TAGS_MEANING)
_KEPT_EMPTY, _FINE = frozenset(TAGS_KEPT_EMPTY), frozenset(ATTRIBUTES_FINE)


def words(text):
    return len(_STRIDE.findall(text.strip()))


class Element:
    """Editable element: `parts` mixes child elements and pieces of text."""

    __slots__ = ("tag", "attrs", "parts", "keep")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.parts, self.keep = tag, attrs or {}, [], False

    def children(self):
        return [p for p in self.parts if not isinstance(p, str)]

    def walk(self):
        stack = [self]
        while stack:
            element = stack.pop()
            yield element
            stack.extend(reversed(element.children()))

    def text(self):
        out, stack = [], [self]
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                out.append(part)
            else:
                stack.extend(reversed(part.parts))
        return "".join(out)

    def link_text(self):
        return " ".join(e.text() for e in self.walk() if e.tag == "a" and e is not self)

    def run(self, start):
        """Text from part `start` up to the next element."""
        stop = next((i for i in range(start, len(self.parts)) if not isinstance(self.parts[i], str)), None)
        return "".join(self.parts[start:stop])

    def direct_text(self):
        """Leading text, then the text behind each child, joined by one space."""
        return self.run(0) + " ".join(self.run(i + 1) for i, p in enumerate(self.parts) if not isinstance(p, str))

    def html(self):
        out, stack = [], [(self, False)]
        while stack:
            part, raw = stack.pop()
            if isinstance(part, str):
                out.append(part if raw else escape(part, False))
                continue
            out.append(start_tag(part.tag, part.attrs))
            if part.tag not in VOID:
                stack.append((f"</{part.tag}>", True))
            stack.extend((p, part.tag in RAW) for p in reversed(part.parts))
        return "".join(out)


class _Builder(_Tree):
    """Tidy markup to `Element`s, with the keep flag of each node."""

    def __init__(self, strict, keep=()):
        super().__init__(strict)
        self.flags, self.elements, self.root = keep, [], None

    def _open(self, tag, attrs):
        node = super()._open(tag, attrs)
        element = Element(tag, attrs)
        element.keep = node.node_id < len(self.flags) and bool(self.flags[node.node_id])
        if self.elements:
            self.elements[-1].parts.append(element)
        else:
            self.root = self.root or element
        self.elements.append(element)
        return node

    def _close(self):
        super()._close()
        self.elements.pop()

    def handle_data(self, data):
        before = len(self.text)
        super().handle_data(data)
        if len(self.text) > before and self.elements:
            self.elements[-1].parts.append(data)


def _clean_inside(root, inner=True):
    """Clean what is inside an element, innermost elements first, without recursion: pages may be of any depth.

    A <br> followed by text ends an element; the pieces behind become new
    siblings of it. A root with nothing around it (`inner` false) is not split.
    """
    behind = {}     # of an element: the siblings that follow it
    for element in reversed(list(root.walk())):
        pieces, old = [[]], element.parts
        for i, part in enumerate(old):
            if isinstance(part, str):
                pieces[-1].append(part)
                continue
            left = _clean(part)
            if part.tag == "br" and left == [part] and not part.keep and (inner or element is not root) and words(element.run(i + 1)):
                pieces.append([])
            else:
                pieces[-1] += left
            pieces[-1] += behind.pop(id(part))
        element.parts, behind[id(element)] = pieces[0], []
        for piece in pieces[1:]:
            behind[id(element)].append(Element(element.tag))
            behind[id(element)][-1].parts = piece


def _clean(node):
    """What takes the place of an element whose inside is clean: itself, its parts, or nothing."""
    if node.tag in _DANGEROUS:
        return []
    if node.keep:
        return [node]
    if node.tag in _JUNK or len(_BAD.findall(node.attrs.get("class", "") + node.attrs.get("id", ""))) >= 2:
        return []
    inside = list(node.walk())[1:]
    total = words(node.text())
    if len(inside) > 2 and (node.tag == "a" or total and words(node.link_text()) / total > 0.8):
        return []
    if node.tag in _MEANING and node.tag not in _KEPT_EMPTY:
        if not total and not any(e.tag == "img" for e in inside):
            return []
    elif node.tag not in _KEPT_EMPTY and not words(node.direct_text()):
        return node.parts
    if node.tag == "img" and "data-src" in node.attrs:
        node.attrs["src"] = node.attrs["data-src"]
    node.attrs = {k: v for k, v in node.attrs.items() if k in _FINE}
    return [node]


def absolutize(root, base):
    for element in root.walk():
        for key in ("href", "src"):
            if key in element.attrs:
                try:
                    element.attrs[key] = urljoin(base, element.attrs[key].strip())
                except ValueError:
                    pass


def clean_article(markup, keep, inner, base):
    """Cleaned subtree of the best node: (html, text, link text).

    `keep` flags the nodes whose score protects them; `inner` says the best
    node has a parent on its page.
    """
    root = _Builder(True, keep).finish(markup).root
    _clean_inside(root, inner)
    text, links = root.text(), root.link_text()
    if base:
        absolutize(root, base)
    return {"html": root.html(), "text": text, "link_text": links}


_CLEANED = T.StructType([T.StructField(c, T.StringType()) for c in ("html", "text", "link_text")])
_CLEANED_ARROW = pa.struct([("html", pa.string()), ("text", pa.string()), ("link_text", pa.string())])


def _clean_batch(markup: pa.Array, keep: pa.Array, inner: pa.Array, base: pa.Array) -> pa.Array:
    rows = zip(markup.to_pylist(), keep.to_pylist(), inner.to_pylist(), base.to_pylist())
    return pa.array([None if m is None else clean_article(m, k or [], i, b) for m, k, i, b in rows], _CLEANED_ARROW)


# See `html_dom` for why it is marked non-deterministic.
clean_markup = F.arrow_udf(by_parts_of_several(_clean_batch), returnType=_CLEANED).asNondeterministic()
