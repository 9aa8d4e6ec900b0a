"""Clean-up of captured responses: type, encoding, decoding, headers given in the page."""

from __future__ import annotations

import codecs
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedloom.constants import BODY_CAP, MIME_CLASSES, MIME_HTML
from feedloom.functions.parts import by_parts, by_parts_of_several
from feedloom.functions.tags import first_wins, tag_attrs
from feedloom.functions.urls import sanitize_url

_HEAD_BYTES = 1000


def is_ok(code: Column) -> Column:
    return (code >= 200) & (code < 300)


def mime(headers: Column) -> Column:
    """MIME type without parameters, empty if there is no such header."""
    return F.coalesce(F.split_part(headers["content-type"], F.lit(";"), F.lit(1)), F.lit(""))


def content_type(responses: DataFrame) -> DataFrame:
    """Add `contenttype` and is_html, is_xml, is_rss, is_json (they overlap)."""
    kind = mime(F.col("headers"))
    return responses.withColumns({"contenttype": kind, **{
        f"is_{name}": kind.isin(types) for name, types in MIME_CLASSES.items()}})


def sanitize_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn(url, sanitize_url(F.col(url)))


def _header_charset(headers: Column) -> Column:
    param = F.regexp_extract(headers["content-type"], r"""(?i);\s*charset\s*=\s*["']?([^"';\s]+)""", 1)
    return F.coalesce(headers["charset"], F.nullif(param, F.lit("")))


def encoding_of(headers: Column, body: Column) -> Column:
    """First of: charset header, content-type charset, charset= / encoding= in the body, a guess."""
    head = F.decode(F.substring(body, 1, _HEAD_BYTES), "ISO-8859-1")

    def inside(word):
        return F.nullif(F.lower(F.regexp_extract(head, rf"""{word}=["']?([0-9a-zA-Z-]+)""", 1)), F.lit(""))

    guess = F.when(F.is_valid_utf8(body.cast("string")), "utf-8").otherwise("windows-1252")
    found = F.coalesce(_header_charset(headers), inside("charset"), inside("encoding"), guess)
    return F.when(F.lower(found) == "gb2312", "gbk").otherwise(found)


def detect_encoding(responses: DataFrame) -> DataFrame:
    return responses.withColumn("encoding", encoding_of(F.col("headers"), F.col("body")))


def _gunzip(bodies: pa.Array) -> pa.Array:
    def one(data):
        try:
            return zlib.decompressobj(zlib.MAX_WBITS | 32).decompress(data)
        except zlib.error:
            return data
    return pa.array([None if b is None else one(b) for b in bodies.to_pylist()], pa.binary())


def _decode(bodies: pa.Array, encodings: pa.Array) -> pa.Array:
    def one(data, name):
        try:
            codecs.lookup(name)
        except LookupError:
            name = "utf-8"
        return data.decode(name, "replace").encode("utf-8", "replace").decode("utf-8")
    return pa.array([None if b is None else one(b, e) for b, e in zip(bodies.to_pylist(), encodings.to_pylist())],
                    pa.string())


# Zipped bodies grow as they are read, so their parts are small.
_gunzip_udf = F.arrow_udf(by_parts(_gunzip, 64 << 10), returnType=T.BinaryType()).asNondeterministic()
_decode_udf = F.arrow_udf(by_parts_of_several(_decode), returnType=T.StringType()).asNondeterministic()


def decode_bodies(responses: DataFrame, cap: int = BODY_CAP) -> DataFrame:
    """Add `data` (capped, gunzipped bytes), `encoding` and `text`; `body` is dropped.

    The cap applies to the bytes as received. Only gzip bodies and bodies that
    are not valid UTF-8 carry a value into a Python step; the rest stays in the JVM.
    """
    headers = F.col("headers")
    zipped = is_ok(F.col("code")) & (F.coalesce(headers["content-encoding"], F.lit("")) == "gzip")
    capped = (responses.withColumn("_raw", F.substring("body", 1, cap))
              .withColumn("_zipped", zipped).drop("body"))
    data = (capped.withColumn("_unzipped", _gunzip_udf(F.when(F.col("_zipped"), F.col("_raw"))))
            .withColumn("data", F.coalesce("_unzipped", "_raw")).drop("_unzipped", "_raw", "_zipped"))
    known = data.withColumn("encoding", encoding_of(headers, F.col("data")))
    plain = (F.lower("encoding").isin("utf-8", "utf8", "us-ascii", "ascii")
             & F.is_valid_utf8(F.col("data").cast("string")))
    return (known.withColumn("_plain", plain)
            .withColumn("_decoded", _decode_udf(F.when(~F.col("_plain"), F.col("data")), F.col("encoding")))
            .withColumn("text", F.when(F.col("_plain"), F.col("data").cast("string")).otherwise(F.col("_decoded")))
            .drop("_plain", "_decoded"))


def http_equiv_headers(headers: Column, text: Column) -> Column:
    """Headers plus those set by `<meta http-equiv content>`; a real header wins, then the first meta."""
    metas = F.filter(tag_attrs(text, "meta"), lambda m: m["http-equiv"].isNotNull() & m["content"].isNotNull())
    extra = F.transform(metas, lambda m: F.struct(
        F.lower(m["http-equiv"]).alias("key"), m["content"].alias("value")))
    return first_wins(F.concat(F.map_entries(headers), extra))


def apply_http_equiv(responses: DataFrame) -> DataFrame:
    """On 2xx HTML, headers given by the page itself join the real ones."""
    page = is_ok(F.col("code")) & mime(F.col("headers")).isin(MIME_HTML) & F.col("text").contains("http-equiv")
    return responses.withColumn("headers", F.when(
        page, http_equiv_headers(F.col("headers"), F.col("text"))).otherwise(F.col("headers")))
