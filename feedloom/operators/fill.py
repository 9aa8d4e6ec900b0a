"""Joining article text onto items, and the last edits before export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.constants import MIME_HTML
from feedloom.functions.text import unwrap_anchors
from feedloom.functions.urls import sanitize_url
from feedloom.operators.article import extract_articles
from feedloom.operators.joins import lookup_join
from feedloom.operators.responses import is_ok, mime

RULE = "<br/><br/><hr/><br/><br/>"


def page_outcomes(pages: DataFrame, selector=None) -> DataFrame:
    """What filling from each decoded response gives: url, final_url, status, article.

    status is `failed` (not 2xx), `other` (not a text page, or empty) or
    `page`; only pages are parsed. Pages have `data` or its size, `data_bytes`.
    """
    kind = mime(F.col("headers"))
    size = F.col("data_bytes") if "data_bytes" in pages.columns else F.length("data")
    status = (F.when(~is_ok(F.col("code")), "failed")
              .when(~kind.isin(*MIME_HTML, "text/plain"), "other")
              .when(F.coalesce(size, F.lit(0)) == 0, "other").otherwise("page"))
    known = pages.select("url", "final_url", status.alias("status"),
                         F.when(status == "page", F.col("text")).alias("html"))
    return extract_articles(known, "html", "final_url", selector=selector)


def with_link_key(items: DataFrame) -> DataFrame:
    """Add `link_key`, the sanitised link used to look pages up; null without a link."""
    link = F.nullif("link", F.lit(""))
    return items.withColumn("link_key", F.when(link.isNotNull(), sanitize_url(link)))


def fill_items(items: DataFrame, outcomes: DataFrame, proxy: bool = False) -> DataFrame:
    """Attach page outcomes by link: adds `status` and `final_url`; an article replaces content.

    Items without a link or article stay as they are. With `proxy` nothing is
    looked up. A link shared by very many items is split over tasks.
    """
    if proxy:
        return items.withColumn("status", F.lit("proxy")).withColumn("final_url", F.lit(None).cast("string"))
    pages = outcomes.select(F.col("url").alias("link_key"), F.col("final_url").alias("_final"),
                            F.col("status").alias("_status"), F.col("article").alias("_article"))
    joined = lookup_join(with_link_key(items), pages, "link_key", ["feed_id", "pos"])
    status = F.when(F.col("link_key").isNull(), "no link").otherwise(F.coalesce("_status", F.lit("failed")))
    return (joined.withColumn("status", status).withColumn("content", F.coalesce("_article", "content"))
            .withColumn("final_url", F.col("_final")).drop("_final", "_status", "_article", "link_key"))


def drop_unfetched(items: DataFrame) -> DataFrame:
    """Past the soft cap an item whose page failed is removed; before it, it stays."""
    return items.where(~(F.col("store_only") & (F.col("status") == "failed")))


def resolve_link(items: DataFrame) -> DataFrame:
    """The link becomes the page's address after redirects, where a page was read."""
    return items.withColumn("link", F.when(
        F.col("status") == "page", F.coalesce("final_url", "link")).otherwise(F.col("link")))


def _present(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def clip(items: DataFrame) -> DataFrame:
    """desc in front of content, separated by a rule, where both exist; desc is removed."""
    both = _present(F.col("desc")) & _present(F.col("content"))
    return items.withColumns({
        "content": F.when(both, F.concat("desc", F.lit(RULE), "content")).otherwise(F.col("content")),
        "desc": F.when(both, F.lit(None)).otherwise(F.col("desc"))})


def no_link(items: DataFrame) -> DataFrame:
    """Links in content become plain text."""
    return items.withColumn("content", unwrap_anchors(F.col("content")))


def no_ref(items: DataFrame) -> DataFrame:
    """The item's own link is emptied."""
    return items.withColumn("link", F.lit(""))
