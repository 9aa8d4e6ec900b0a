"""Text expressions: trimming, word estimates, titles, tag stripping, escaping."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# The look-behind and the possessive quantifier keep this linear on long runs of blanks.
_EDGES = r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$"
_STRIDE = r"(?s)[\r\n\t ]*[^\r\n\t ].{0,5}"
_TAG = r"(?s)<!--.*?-->|</?[a-zA-Z][^>]*>"
_BASIC_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": " "}


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it.

    Spark has no local names in expressions; a lambda over a one-element
    array is one, and keeps long expressions small for the optimizer.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Remove Unicode white space on both ends."""
    return F.regexp_replace(col, _EDGES, "")


def blank_to_null_sql(expr: str) -> str:
    """SQL text: `expr` without outer white space, null if nothing is left."""
    return f"get(transform(array(regexp_replace({expr}, r'{_EDGES}', '')), v -> nullif(v, '')), 0)"


def stride_words(col: Column) -> Column:
    """Word estimate: each non-blank character counts one and skips six.

    Every counted stride, with the blanks before it, is replaced by one
    character, so the length of the result is the count.
    """
    return F.coalesce(F.length(F.regexp_replace(strip(col), _STRIDE, "x")), F.lit(0))


def is_upper(col: Column) -> Column:
    """At least one upper-case letter and no lower- or title-case letter."""
    return col.rlike(r"\p{Lu}") & ~col.rlike(r"[\p{Ll}\p{Lt}]")


def title_case(col: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def fix_title(col: Column) -> Column:
    """Titles over 20 characters that are all upper case become title case."""
    return let(col, lambda t: F.when((F.length(t) > 20) & is_upper(t), title_case(t)).otherwise(t))


def unescape_basic(col: Column) -> Column:
    for name, char in _BASIC_ENTITIES.items():
        col = F.replace(col, F.lit(f"&{name};"), F.lit(char))
    return F.replace(col, F.lit("&amp;"), F.lit("&"))


def strip_tags(col: Column) -> Column:
    return unescape_basic(F.regexp_replace(col, _TAG, ""))


def text_length(html: Column) -> Column:
    """Number of characters of a fragment's text."""
    return F.coalesce(F.length(strip_tags(html)), F.lit(0))


def text_words(html: Column) -> Column:
    """Number of blank-separated words of a fragment's text."""
    return let(strip(strip_tags(html)), lambda text: F.when(text.isNull() | (text == ""), 0).otherwise(
        F.size(F.split(text, r"(?U)[\s\x1c-\x1f]+"))))


def unwrap_anchors(html: Column) -> Column:
    """Drop <a> tags, keep what is inside."""
    return F.regexp_replace(html, r"(?i)</?a(?:\s[^>]*)?>", "")


def named_entities_to_text(col: Column) -> Column:
    """HTML named references that XML does not define, as characters."""
    known = {"amp", "lt", "gt", "quot", "apos"}
    pairs = "\n".join(f"&{name};\t{chr(point)}" for name, point in name2codepoint.items() if name not in known)
    table = F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))
    tokens = F.regexp_extract_all(col, F.lit(r"(&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)"), F.lit(1))
    mapped = F.transform(tokens, lambda t: F.when(
        t.startswith("&") & (F.length(t) > 1),
        F.coalesce(F.try_element_at(table, t), t)).otherwise(t))
    return F.when(col.rlike(r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z][A-Za-z0-9]*;"),
                  F.array_join(mapped, "")).otherwise(col)


def xml_escape(col: Column) -> Column:
    """Text as XML character data; characters XML 1.0 forbids are dropped."""
    clean = F.regexp_replace(col, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(char), F.lit(ref))
    return clean


def attr_escape(col: Column) -> Column:
    return F.replace(xml_escape(col), F.lit('"'), F.lit("&quot;"))
