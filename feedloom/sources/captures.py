"""Captured responses from files, and a light tag scan over their text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.constants import TAG_SCAN_CHARS
from feedloom.functions.tags import first_wins, tag_attrs


def _split_capture(content: Column) -> tuple[Column, Column]:
    """Head text (one byte per character) and body of a raw capture, parted by its first blank line."""
    latin = F.decode(content, "ISO-8859-1")
    ends = [F.nullif(F.instr(latin, mark) + len(mark) - 1, F.lit(len(mark) - 1)) for mark in ("\n\n", "\n\r\n")]
    end = F.least(*ends)        # the smaller one that is there
    head = F.coalesce(F.substring(latin, F.lit(1), end), latin)
    return head, F.when(end.isNotNull(), F.substring(content, end + 1, F.length(content)))


def header_map(lines: Column) -> Column:
    """Header lines as a map: names in lower case, a repeated name keeps its first value."""
    entries = F.transform(F.filter(lines, lambda h: h.contains(":")), lambda h: F.struct(
        F.lower(F.trim(F.split_part(h, F.lit(":"), F.lit(1)))).alias("key"),
        F.trim(F.regexp_replace(h, r"^[^:]*:", "")).alias("value")))
    return first_wins(entries)


def load_responses(spark: SparkSession, path: str, base_url: str = "http://localhost/") -> DataFrame:
    """Raw capture files (status line, headers, blank line, body); a file's place below `path` gives its URL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head, body = _split_capture(F.col("content"))
    raw = files.select("path", "modificationTime", head.alias("head"), F.coalesce(body, F.lit(b"")).alias("body"))
    lines = F.filter(F.split("head", r"\r?\n"), lambda h: h != "")
    status = F.get(lines, F.lit(0))
    below = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", path).strip("/") + "/"
    place = F.instr("path", below)
    name = F.when(place > 0, F.substring("path", place + len(below), F.length("path"))).otherwise(F.element_at(F.split("path", "/"), -1))
    url = F.concat(F.lit(base_url), name)
    return raw.select(
        url.alias("url"), url.alias("final_url"),
        F.regexp_extract(status, r"^\S+\s+(\d{3})", 1).try_cast("int").alias("code"),
        F.regexp_extract(status, r"^\S+\s+\d{3}\s*(.*)$", 1).alias("msg"),
        header_map(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("headers"),
        "body", F.col("modificationTime").alias("fetched_at"))


def responses_from_pages(pages: DataFrame, fetched_at) -> DataFrame:
    """A pages(url, html) table as 200 text/html captures in UTF-8."""
    return pages.select(
        "url", F.col("url").alias("final_url"), F.lit(200).alias("code"), F.lit("OK").alias("msg"),
        F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8")).alias("headers"),
        F.col("html").cast("binary").alias("body"), F.lit(fetched_at).cast("timestamp").alias("fetched_at"))


def load_pages(spark: SparkSession, path: str, fetched_at) -> DataFrame:
    return responses_from_pages(spark.read.parquet(path), fetched_at)


def scan_tags(df: DataFrame, tag: str, text: str = "text", limit: int | None = TAG_SCAN_CHARS) -> DataFrame:
    """One row per `<tag ...>` found by pattern: the other columns, tag_no (from 0) and attrs."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(tag_attrs(F.col(text), tag, limit)).alias("tag_no", "attrs"))
