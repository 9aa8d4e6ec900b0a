"""URL expressions: clean-up, resolution against a base, link unwrapping."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from feedloom.constants import PORTAL_LETTERS, TRACKERS
from feedloom.functions.text import let

_ASCII = r"^[\x00-\x7F]*$"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def drop_empty_parts(url: Column) -> Column:
    """A bare `?` or `#` without anything behind it is not part of the address."""
    return F.regexp_replace(F.regexp_replace(url, r"^([^?#]*)\?(#|$)", "$1$2"), r"^([^#]*)#$", "$1")


def _to_ascii_url(urls: pa.Array) -> pa.Array:
    def one(url):
        if url is None:
            return None
        try:
            parts = urlsplit(url)
            host = parts.hostname or ""
            netloc = parts.netloc
            if host:
                netloc = netloc.replace(host, host.encode("idna").decode("ascii"))
            soft = {k: v if v.isascii() else quote(v.encode("utf-8"))
                    for k, v in (("path", parts.path), ("query", parts.query), ("fragment", parts.fragment))}
            return parts._replace(netloc=netloc, **soft).geturl()
        except (ValueError, UnicodeError):
            return None
    return pa.array([one(u) for u in urls.to_pylist()], pa.string())


_ascii_url = F.arrow_udf(_to_ascii_url, returnType=T.StringType())


def _tidy(url: Column) -> Column:
    def fixed(u):
        has_scheme = F.split_part(u, F.lit(":"), F.lit(1)).isin("http", "https")
        whole = F.when(has_scheme, u).otherwise(F.concat(F.lit("http://"), u))
        whole = F.regexp_replace(whole, r"^(https?):/([^/])", "$1://$2")
        return F.regexp_replace(F.replace(whole, F.lit(" "), F.lit("%20")), r"[\t\r\n]", "")
    return let(url, fixed)


def sanitize_url(url: Column) -> Column:
    """Scheme added, `http:/x` repaired, blanks quoted, non-ASCII encoded.

    Only rows with non-ASCII characters carry a value into the Python step.
    """
    fixed, plain = _tidy(url), url.rlike(_ASCII)
    return F.when(plain, drop_empty_parts(fixed)).otherwise(_ascii_url(F.when(~plain, fixed)))


def _resolve_segments(segments: Column) -> Column:
    """Remove `.` and `..` from path segments and join them again."""
    def joined(parts):
        stack = F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc).otherwise(F.array_append(acc, s)))
        slash = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
        return F.concat(F.array_join(stack, "/"), slash)
    return let(let(segments, joined), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def _base_folder(path: Column) -> Column:
    return let(F.split(path, "/"), lambda parts: F.when(
        F.element_at(parts, -1) != "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def _drop_inner_blanks(segments: Column) -> Column:
    return let(segments, lambda s: F.concat(
        F.slice(s, 1, 1), F.filter(F.slice(s, F.lit(2), F.greatest(F.size(s) - 2, F.lit(0))), lambda p: p != ""),
        F.slice(s, -1, 1)))


def absolute_url(base: Column, link: Column) -> Column:
    """Resolve `link` against `base` (RFC 3986 reference resolution)."""
    def resolve(v):
        base, link = v["base"], v["link"]
        scheme = F.regexp_extract(base, _SCHEME, 1)
        root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        path = F.regexp_extract(link, r"^([^?#]*)", 1)
        rest = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
        rooted = F.when(path.rlike(r"(^|/)\.\.?(/|$)"), _resolve_segments(F.split(path, "/"))).otherwise(path)
        merged = _drop_inner_blanks(F.concat(_base_folder(base_path), F.split(path, "/")))
        return (F.when(link.isNull() | base.isNull() | link.rlike(_SCHEME), link)
                .when(link == "", base)
                .when(root == "", link)
                .otherwise(drop_empty_parts(
                    F.when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
                    .when(link.startswith("/"), F.concat(root, rooted, rest))
                    .when(link.startswith("?"), F.concat(root, base_path, link))
                    .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), link))
                    .otherwise(F.concat(root, _resolve_segments(merged), rest)))))
    return let(F.struct(base.alias("base"), link.alias("link")), resolve)


def query_value(url: Column, key: str) -> Column:
    """First non-empty value of a query key, percent-decoded; null if absent."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return let(F.regexp_extract(query, rf"(?:^|&){key}=([^&]+)", 1), lambda raw: F.when(
        raw != "", F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))))


def unwrap_tracking(link: Column) -> Column:
    """Target of links wrapped by tracking services; each step sees the one before."""
    def step(link, tracker):
        pattern, key = tracker
        return let(link, lambda url: F.when(
            url.rlike(pattern), F.coalesce(query_value(url, key), url)).otherwise(url))
    return reduce(step, TRACKERS, link)


def decode_portal(link: Column) -> Column:
    """Target hidden in a feedsportal `/<token>/story01.htm` link."""
    token = F.regexp_extract(link, r"/([0-9a-zA-Z]{20,})/story01.htm$", 1)
    letters = F.create_map(*[F.lit(x) for kv in PORTAL_LETTERS.items() for x in kv])
    parts = F.split(token, "0")
    words = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda s: F.concat(
        F.coalesce(F.try_element_at(letters, F.substring(s, 1, 1)), F.substring(s, 1, 1)),
        F.substr(s, F.lit(2))))
    return F.when(token != "", F.array_join(words, "")).otherwise(link)
