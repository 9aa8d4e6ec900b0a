"""Slow, plain readings of the article rules on one page, to check the engine against."""

import re

from feedloom import constants as c
from feedloom.functions.markup import _Builder


def words(text):
    text, i, n = text.strip(), 0, 0
    while i < len(text):
        if text[i] in "\r\n\t ":
            i += 1
        else:
            n, i = n + 1, i + 6
    return n


class Page:
    """The elements of a page in document order, with what the rules say of each on its own."""

    def __init__(self, html):
        self.root = _Builder(False).finish(html).root
        self.elements = list(self.root.walk())
        self.at = {id(e): i for i, e in enumerate(self.elements)}
        self.parent = {self.at[id(k)]: i for i, e in enumerate(self.elements) for k in e.children()}
        self.own = [points(e) for e in self.elements]

    def ancestors(self, i):
        while i in self.parent:
            i = self.parent[i]
            yield i

    def opens(self, i):
        """Whether scoring looks below an element: near the root always, else where it scores."""
        return self.own[i] > 0 or sum(1 for _ in self.ancestors(i)) <= 2

    def seen(self, i):
        return i in self.parent and all(self.opens(a) for a in self.ancestors(i) if a in self.parent)

    def total(self, i):
        """Its own points if it opens, and half of each child's that has two at least."""
        counted = [k for k in range(len(self.elements)) if self.seen(k) and self.opens(k)]
        return sum(self.own[k] for k in counted if k == i) + sum(
            self.own[k] / 2 for k in counted if self.parent[k] == i and self.own[k] >= 2)


def points(e):
    marks = e.attrs.get("class", "") + e.attrs.get("id", "")

    def hit(patterns):
        return any(re.search(p, marks, re.I) for p in patterns)

    total, linked = words(e.text()), words(e.link_text())
    table = {"junk": (e.tag in c.TAGS_JUNK, -1), "bad tag": (e.tag in c.TAGS_BAD, -1), "bad mark": (hit(c.CLASS_BAD), -1),
             "good tag": (e.tag in c.TAGS_GOOD, 4), "good mark": (hit(c.CLASS_GOOD), 3), "length": (True, min(total // 10, 3))}
    share = linked / total if total else 0
    return 0.0 if e.tag in c.TAGS_DANGEROUS else sum(v for applies, v in table.values() if applies) * (1 - 2 * share)


def scores(html):
    """(elements, own score of those that scoring sees, spread score), by document position."""
    page = Page(html)
    places = range(len(page.elements))
    return page.elements, {i: page.own[i] for i in places if page.seen(i)}, {i: page.total(i) for i in places}


def best(html, threshold=5):
    """The nearest common element, three levels up at most, of the two with most points."""
    page = Page(html)
    total = [round(page.total(i), 9) for i in range(len(page.elements))]
    first, *second = sorted(range(len(total)), key=lambda i: (-total[i], i))[:2]
    if total[first] < threshold:
        return None
    near = [[i, *list(page.ancestors(i))[:3]] for i in (first, *second)]
    return next((i for i in near[0] if i in near[-1]), first)
