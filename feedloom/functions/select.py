"""Element selectors over the `dom` column: what the site rules and custom rules are made of.

The functions return SQL text. `dom` is the name of a column and `item`, `node`
the name of a lambda variable or an expression that is cheap to repeat.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from feedloom.functions.text import blank_to_null_sql


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Select:
    """Elements by tag, class token, id, and optionally the element right above them.

    `axis` is relative to an item: descendant, child, self or ancestor. `attr`
    picks an attribute instead of the text. `without` rejects a class substring,
    `having` asks for an attribute's value.
    """

    tag: str | None = None
    cls: str | None = None
    id: str | None = None
    without: str | None = None
    under: Select | None = None
    axis: str = "descendant"
    attr: str | None = None
    having: tuple[str, str] | None = None

    def __truediv__(self, child: Select) -> Select:
        return replace(child, under=self)

    def __str__(self):
        own = (self.tag or "*") + (f"[class={self.cls}]" if self.cls else "") + \
            (f"[@id='{self.id}']" if self.id else "") + \
            (f"[not(contains(@class,'{self.without}'))]" if self.without else "") + \
            (f"[@{self.having[0]}='{self.having[1]}']" if self.having else "")
        head = f"{self.under}/" if self.under else \
            {"descendant": ".//", "child": "./", "self": "self::", "ancestor": "ancestor::"}[self.axis]
        return head + own + (f"/@{self.attr}" if self.attr else "")

    def test(self, dom: str, node: str, below: str | None = None) -> str:
        """Condition that `node` matches; `below` is the item `under` has to lie inside of."""
        marks = f"coalesce({node}.attrs['class'], '')"
        checks = []
        if self.tag:
            checks.append(f"{node}.tag = {quoted(self.tag)}")
        if self.cls:
            checks.append(rf"array_contains(split({marks}, r'\s+'), {quoted(self.cls)})")
        if self.id:
            checks.append(f"coalesce({node}.attrs['id'], '') = {quoted(self.id)}")
        if self.without:
            checks.append(f"NOT contains({marks}, {quoted(self.without)})")
        if self.having:
            checks.append(f"coalesce({node}.attrs[{quoted(self.having[0])}], '') = {quoted(self.having[1])}")
        if self.attr:
            checks.append(f"{node}.attrs[{quoted(self.attr)}] IS NOT NULL")
        if self.under:
            checks.append(f"{node}.parent_id IS NOT NULL")
            checks.append(self.under.test(dom, f"get({dom}.nodes, {node}.parent_id)"))
            if below is not None:
                checks.append(f"{node}.parent_id > {below}.node_id")
        return "(" + (" AND ".join(checks) or "true") + ")"


_START = re.compile(r"self::|ancestor::|\./(?!/)|(?:\.?//)")
_AXES = {"self::": "self", "ancestor::": "ancestor", "./": "child"}
_STEP = re.compile(r"([A-Za-z][\w:-]*|\*)?((?:\[[^\]]*\])*)")
_TESTS = {"cls": re.compile(r"\[class=([^\]'\"=]+)\]"),
          "id": re.compile(r"\[@id='([^']*)'\]"),
          "without": re.compile(r"\[not\(contains\(@class,\s*'([^']*)'\)\)\]"),
          "having": re.compile(r"\[@([\w:-]+)='([^']*)'\]")}
_ATTR = re.compile(r"@([\w:-]+)")


def _step(path: str, at: int) -> tuple[dict, int]:
    """One step's tag and tests, and where it ends."""
    found = _STEP.match(path, at)
    made = {} if found[1] in (None, "*") else {"tag": found[1]}
    for test in re.findall(r"\[[^\]]*\]", found[2]):
        name, match = next(((n, m) for n, t in _TESTS.items() if (m := t.fullmatch(test))), (None, None))
        if name is None or name in made:
            raise ValueError(f"condition {test} of {path!r} can't be used")
        made[name] = match.groups() if name == "having" else match[1]
    if found[0] == "":
        raise ValueError(f"{path!r} has no element at {at}")
    return made, found.end()


def parse_select(path: str) -> Select | tuple[Select, ...]:
    """`Select`s of a written path, several where `|` separates alternatives; the reverse of `str`.

    `//` and `.//` go to descendants, `./` to children, `self::` and `ancestor::`
    to these; further steps follow `/` and only from descendants. A step is a tag
    or `*` with any of `[class=x]`, `[@id='x']`, `[not(contains(@class,'x'))]`
    and `[@name='x']`; a last `/@name` is the attribute to take, `./@name` that
    of the item. Anything else raises ValueError.
    """
    made, at = [], 0
    while True:
        start = _START.match(path, at)
        if not start:
            raise ValueError(f"{path!r} can't be read at {at}")
        axis, at = _AXES.get(start[0], "descendant"), start.end()
        if axis == "child" and (own := _ATTR.match(path, at)):
            select, at = Select(axis="self", attr=own[1]), own.end()
        else:
            step, at = _step(path, at)
            select = Select(axis=axis, **step)
            while path[at:at + 1] == "/":
                if last := _ATTR.match(path, at + 1):
                    select, at = replace(select, attr=last[1]), last.end()
                    break
                if axis != "descendant":
                    raise ValueError(f"{path!r} goes on after {start[0]}")
                step, at = _step(path, at + 1)
                select = select / Select(**step)
        made.append(select)
        if at == len(path):
            return made[0] if len(made) == 1 else tuple(made)
        if path[at] != "|":
            raise ValueError(f"{path!r} can't be read at {at}")
        at += 1


def _alternatives(selector) -> tuple:
    return selector if isinstance(selector, (tuple, list)) else (selector,)


def all_matches(dom: str, selector) -> str:
    """Elements of the page matching any of the alternatives, in document order."""
    return f"filter({dom}.nodes, n -> {' OR '.join(s.test(dom, 'n') for s in _alternatives(selector))})"


def first_match(dom: str, selector) -> str:
    return f"get({all_matches(dom, selector)}, 0)"


def _along(dom: str, item: str, select: Select) -> str:
    nodes = {
        "self": f"array({item})",
        "ancestor": f"filter(slice({dom}.nodes, 1, {item}.node_id), a -> a.last_desc >= {item}.node_id)",
        "child": f"transform({item}.kids, k -> get({dom}.nodes, k))",
        "descendant": f"slice({dom}.nodes, {item}.node_id + 2, {item}.last_desc - {item}.node_id)",
    }[select.axis]
    return f"filter({nodes}, n -> {select.test(dom, 'n', item)})"


def _content(dom: str, node: str, select: Select, rich: bool) -> str:
    """Attribute, inner markup (`rich`) or trimmed text of the node found; null for none of it."""
    if select.attr:
        value = f"nullif(m.attrs[{quoted(select.attr)}], '')"
    elif rich:
        value = f"nullif(cast(substring({dom}.markup, m.m0 + 1, m.m1 - m.m0) AS string), '')"
    else:
        value = blank_to_null_sql(f"cast(substring({dom}.text, m.b0 + 1, m.b1 - m.b0) AS string)")
    return f"get(transform(array({node}), m -> {value}), 0)"


def _first_of(values: list[str]) -> str:
    return values[0] if len(values) == 1 else f"coalesce({', '.join(values)})"


def field_value(dom: str, item: str, selector, rich: bool = False) -> str:
    """First match relative to an item."""
    return _first_of([_content(dom, f"get({_along(dom, item, s)}, 0)", s, rich) for s in _alternatives(selector)])


def page_value(dom: str, selector) -> str:
    """First match on the whole page."""
    return _first_of([_content(dom, first_match(dom, s), s, False) for s in _alternatives(selector)])
