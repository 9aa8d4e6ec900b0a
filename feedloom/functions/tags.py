"""Attributes of one kind of tag by pattern, without building a tree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom.constants import TAG_SCAN_CHARS

_ATTR = r"""([^=\s]+)=['"]([^'"]+)['"]"""


def tag_attrs(text: Column, tag: str, limit: int | None = TAG_SCAN_CHARS) -> Column:
    """One map per `<tag ...>` found in the first `limit` characters (None: everywhere)."""
    head = text if limit is None else F.substring(text, 1, limit)
    found = F.regexp_extract_all(head, F.lit(rf"<{tag}\s+[^>]+>"), F.lit(0))

    def attrs(markup):
        keys = F.regexp_extract_all(markup, F.lit(_ATTR), F.lit(1))
        values = F.regexp_extract_all(markup, F.lit(_ATTR), F.lit(2))
        pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        # a repeated attribute keeps its last value
        return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(
            F.slice(keys, i + 2, F.size(keys)), lambda k: k == p["key"])))

    return F.transform(found, attrs)


def first_wins(entries: Column) -> Column:
    """Map of (key, value) structs in which a repeated key keeps its first value."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))
