"""Redirect edges between captured URLs, and following them with joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.constants import MAX_HOPS, MIME_CLASSES, MIME_HTML
from feedloom.functions.tags import tag_attrs
from feedloom.functions.urls import absolute_url
from feedloom.operators.joins import cut, lookup_join
from feedloom.operators.responses import is_ok, mime

_REFRESH = r"""(?i)^([0-9]+)\s*;\s*url\s*=\s*(["']?)(.+)\2$"""


def _against(url: Column, target: Column) -> Column:
    return absolute_url(url, F.replace(F.nullif(target, F.lit("")), F.lit(" "), F.lit("%20")))


def redirect_location(code: Column, headers: Column) -> Column:
    return F.when(code.isin(301, 302, 303, 307, 308), F.coalesce(headers["location"], headers["uri"]))


def refresh_location(code: Column, headers: Column) -> Column:
    return F.when(is_ok(code), F.regexp_extract(headers["refresh"], _REFRESH, 3))


def alternate_location(code: Column, headers: Column, text: Column, follow: str) -> Column:
    """First `<link rel=alternate>` of a wanted type in an HTML page that is not itself of that type."""
    wanted = MIME_CLASSES[follow]
    links = F.filter(tag_attrs(text, "link"), lambda m: F.coalesce(
        (m["rel"] == "alternate") & m["type"].isin(wanted) & m["href"].isNotNull(), F.lit(False)))
    kind = mime(headers)
    return F.when(is_ok(code) & kind.isin(MIME_HTML) & ~kind.isin(wanted) & text.contains("alternate"),
                  F.get(links, F.lit(0))["href"])


def redirect_target(responses: DataFrame) -> DataFrame:
    """Add `target`: where a 30x (308 included) points, resolved; else null."""
    return responses.withColumn("target", _against(
        F.col("url"), redirect_location(F.col("code"), F.col("headers"))))


def refresh_target(responses: DataFrame) -> DataFrame:
    """Add `target`: where a 2xx `refresh` header points, resolved; else null."""
    return responses.withColumn("target", _against(
        F.col("url"), refresh_location(F.col("code"), F.col("headers"))))


def alternate_feed(responses: DataFrame, follow: str = "rss") -> DataFrame:
    """Add `target`: the feed an HTML page announces, resolved; else null."""
    return responses.withColumn("target", _against(F.col("url"), alternate_location(
        F.col("code"), F.col("headers"), F.col("text"), follow)))


def next_url(follow: str | None = None) -> Column:
    """Where a response sends the reader, resolved; null if it is final. Needs `text` only with `follow`."""
    code, headers = F.col("code"), F.col("headers")
    hops = [redirect_location(code, headers)]
    if follow:
        hops.append(F.nullif(alternate_location(code, headers, F.col("text"), follow), F.lit("")))
    hops.append(F.nullif(refresh_location(code, headers), F.lit("")))
    return _against(F.col("url"), F.coalesce(*hops))


def redirect_edges(responses: DataFrame, follow: str | None = None) -> DataFrame:
    """(url, target) of every response that sends the reader elsewhere; one response per URL is expected."""
    return responses.select("url", next_url(follow).alias("target")).where(F.col("target").isNotNull())


def resolve_redirects(edges: DataFrame, max_hops: int | None = MAX_HOPS, wanted: DataFrame | None = None) -> DataFrame:
    """Follow (url, target) edges to the end: url, final_url, hops.

    By pointer jumping: every URL knows an address so many hops ahead; a round
    replaces it by the one that this address knows, and adds up the hops. So
    after r rounds all chains of less than 2^r hops have ended, and `max_hops`
    of 10 takes four. More than `max_hops`, or a cycle, gives a null final_url.
    Without a limit rounds go on while any chain ends: once none does, what is
    left runs into a cycle, as a round at least doubles the ended part of a chain.

    A target without an edge is final, whether or not it was captured. A row is
    expected for each URL that moves; `wanted` (url) restricts the result. Each
    round joins only the URLs still under way and is written to the shared
    checkpoint folder.
    """
    state = cut(edges.select("url", F.col("target").alias("to"), F.lit(1).alias("hops"), F.lit(False).alias("done")))
    rounds, before = 0, None
    while max_hops is None or rounds < max_hops.bit_length():
        moving = state.where("NOT done")
        left = moving.count()
        if left in (0, before):
            break
        before = left if max_hops is None and rounds else None
        far = state.select(F.col("url").alias("to"), F.col("to").alias("_next"), F.col("hops").alias("_more"), F.col("done").alias("_end"))
        jumped = lookup_join(moving.drop("done"), far, "to", ["url"]).select(
            "url", F.coalesce("_next", "to").alias("to"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"),
            F.coalesce("_end", F.lit(True)).alias("done"))
        state = cut(state.where("done").unionByName(jumped))
        rounds += 1
    if wanted is not None:
        state = state.join(wanted.select("url").distinct(), "url", "left_semi")
    reached = F.col("done") if max_hops is None else F.col("done") & (F.col("hops") <= max_hops)
    return state.select("url", F.when(reached, F.col("to")).alias("final_url"), F.when(reached, F.col("hops")).alias("hops"))


def final_responses(responses: DataFrame, resolved: DataFrame) -> DataFrame:
    """For every captured URL the response at the end of its redirects.

    Adds `final_url`; URLs whose chain leaves the captures, cycles or is too
    long have no row.
    """
    moved = resolved.where(F.col("final_url").isNotNull()).select(
        F.col("url").alias("_from"), F.col("final_url").alias("url"))
    others = responses.drop("final_url")
    ends = lookup_join(moved, others, "url", ["_from"], how="inner").select(
        F.col("_from").alias("url"), F.col("url").alias("final_url"), *[c for c in others.columns if c != "url"])
    stay = others.join(resolved.select("url"), "url", "left_anti").withColumn("final_url", F.col("url"))
    return stay.unionByName(ends)
