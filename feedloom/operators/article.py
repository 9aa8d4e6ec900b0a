"""Article extraction: score the elements of each page, pick and clean the best one.

Everything up to the clean-up is JVM expressions over the `dom` column of one
page row, so extraction needs no shuffle and a page is never collected with
others. Lambdas only look at `own` and `score` through columns that are used
more than once, which keeps the optimizer from inlining them per element.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.constants import (CLASS_BAD, CLASS_GOOD, TAGS_BAD, TAGS_DANGEROUS, TAGS_GOOD, TAGS_JUNK)
from feedloom.functions.dom import html_dom, node_link_text, node_text, outer_markup, rewritten_markup, under
from feedloom.functions.markup import clean_markup
from feedloom.functions.select import first_match
from feedloom.functions.text import stride_words
from feedloom.operators.joins import spread_small

_BAD = "(?i)" + "|".join(CLASS_BAD)
_GOOD = "(?i)" + "|".join(CLASS_GOOD)


def class_id(node: Column) -> Column:
    """Class and id, concatenated."""
    return F.concat(F.coalesce(node.attrs["class"], F.lit("")), F.coalesce(node.attrs["id"], F.lit("")))


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def own_score(tag: Column, marks: Column, words: Column, link_words: Column) -> Column:
    """An element's own score from its tag, class/id, words and words in links."""
    score = reduce(lambda a, b: a + b, [
        _points(tag.isin(TAGS_JUNK), -1), _points(tag.isin(TAGS_BAD), -1), _points(marks.rlike(_BAD), -1),
        _points(tag.isin(TAGS_GOOD), 4), _points(marks.rlike(_GOOD), 3),
        F.least(F.floor(words / 10), F.lit(3))]).cast("double")
    share = F.when(words != 0, link_words / words).otherwise(F.lit(0.0))
    return F.when(tag.isin(TAGS_DANGEROUS), F.lit(0.0)).otherwise(score * (1 - 2 * share))


def with_dom(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the `dom` column (see functions.dom)."""
    return spread_small(pages).withColumn("dom", html_dom(F.col(html)))


def html_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per element: the page's other columns plus the node fields."""
    keep = [c for c in pages.columns if c != html]
    return with_dom(pages, html).select(*keep, F.inline_outer("dom.nodes"))


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The text the node offsets t0/t1 point into, one row per page."""
    keep = [c for c in pages.columns if c != html]
    return with_dom(pages, html).select(*keep, F.col("dom.text").cast("string").alias("full_text"))


def with_scores(doms: DataFrame) -> DataFrame:
    """Add `marks` (own score and word counts per element) and `score` (after spreading).

    An element is open if it and all its ancestors below the third level have
    a positive own score. An open element counts its own score, and half the
    own score of each child that scores at least two.
    """
    dom = F.col("dom")
    counted = F.transform(dom.nodes, lambda n: F.struct(
        n.node_id.alias("node_id"), n.tag.alias("tag"), class_id(n).alias("marks"),
        stride_words(node_text(dom, n)).alias("words"),
        F.when(n.a1 > n.a0, stride_words(node_link_text(dom, n))).otherwise(0).alias("link_words")))
    own = F.transform(counted, lambda n: F.struct(
        n.words.alias("words"), n.link_words.alias("link_words"),
        F.when(n.node_id > 0, own_score(n.tag, n.marks, n.words, n.link_words)).alias("own")))
    marked = doms.withColumn("marks", own)

    def at(i):
        return F.get(F.col("marks"), i).own

    barred = under(dom, F.transform(dom.nodes, lambda n: (n.depth >= 3) & ~(at(n.node_id) > 0)))

    def spread(n, visited):
        children = F.aggregate(n.kids, F.lit(0.0), lambda acc, k: acc + F.when(at(k) >= 2, at(k) / 2).otherwise(0.0))
        return F.when(visited & ((n.depth <= 2) | (at(n.node_id) > 0)),
                      F.coalesce(at(n.node_id), F.lit(0.0)) + children).otherwise(0.0)

    return (marked
            .withColumn("visited", F.transform(barred, lambda b, i: (i > 0) & ~b))
            .withColumn("score", F.zip_with(dom.nodes, F.col("visited"), lambda n, v: spread(n, v | (n.node_id == 0)))))


def score_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Own score, visit gate and spread score of every element, one row each."""
    keep = [c for c in pages.columns if c != html]
    zipped = F.inline_outer(F.arrays_zip(
        F.col("dom.nodes").alias("node"), F.col("marks").alias("mark"), F.col("visited"), F.col("score")))
    rows = with_scores(with_dom(pages, html)).select(*keep, zipped)
    rows = rows.toDF(*keep, "node", "mark", "visited", "score")
    return rows.select(*keep, "node.node_id", "node.parent_id", "node.last_desc", "node.depth", "node.tag",
                       class_id(F.col("node")).alias("class_id"), "mark.words", "mark.link_words",
                       F.col("mark.own").alias("own_score"), "visited", "score")


def visit_gate(pages: DataFrame, html: str = "html") -> DataFrame:
    """The elements that scoring visits."""
    return score_nodes(pages, html).where("visited")


def with_best(scored: DataFrame, threshold: float = 5, override: Column | None = None) -> DataFrame:
    """Add `best_id` and `best_score` of the element holding the article, null if nothing scores enough.

    The common ancestor (at most three levels up) of the two highest scores,
    ties in document order. `override` is an element that wins if not null.
    """
    dom = F.col("dom")
    ranked = F.slice(F.sort_array(F.transform(F.col("score"), lambda s, i: F.struct(
        (-F.round(s, 9)).alias("rank"), i.cast("int").alias("node_id")))), 1, 2)
    first, second = F.get(F.col("ranked"), F.lit(0)), F.get(F.col("ranked"), F.lit(1))

    def chain(node_id):
        def parent(of):
            return F.get(dom.nodes, of).parent_id
        return F.filter(F.array(node_id, parent(node_id), parent(parent(node_id)), parent(parent(parent(node_id)))), lambda a: a.isNotNull())

    shared = F.get(F.array_intersect(chain(first.node_id), chain(second.node_id)), F.lit(0))
    best = F.when(first["rank"] <= -threshold, F.coalesce(shared, first.node_id))
    if override is not None:
        best = F.coalesce(override, best)
    return (scored.withColumn("ranked", ranked)
            .withColumn("best_id", best).drop("ranked")
            .withColumn("best_score", F.get(F.col("score"), F.col("best_id"))))


def best_node(pages: DataFrame, html: str = "html", threshold: float = 5, selector=None) -> DataFrame:
    """Best element of each page: id, tag and score (nulls if there is none)."""
    keep = [c for c in pages.columns if c != html]
    best = F.get(F.col("dom.nodes"), F.col("best_id"))
    return _best(pages, html, threshold, selector).select(
        *keep, "best_id", best.tag.alias("best_tag"), "best_score")


def _best(pages, html, threshold, selector):
    override = None if selector is None else F.expr(first_match("dom", selector) + ".node_id")
    return with_best(with_scores(with_dom(pages, html)), threshold, override)


def clean_subtree(pages: DataFrame, html: str = "html", url: str | None = "url", threshold: float = 5,
                  selector=None) -> DataFrame:
    """Add `cleaned` (html, text, link_text) of the best element of each page."""
    keep = [c for c in pages.columns if c != html]
    node = F.get(F.col("dom.nodes"), F.col("best_id"))
    limit = F.col("best_score") * 3 / 4
    flags = F.transform(F.slice(F.col("score"), F.col("best_id") + 1, node.last_desc - F.col("best_id") + 1),
                        lambda s: (limit > 0) & (s >= limit))
    base = F.lit(None).cast("string") if url is None else F.col(url)
    ready = _best(pages, html, threshold, selector).select(
        *keep, outer_markup(F.col("dom"), node).alias("_markup"), flags.alias("_keep"),
        (F.col("best_id") > 0).alias("_inner"), base.alias("_base"))
    return ready.select(*keep, clean_markup("_markup", "_keep", "_inner", "_base").alias("cleaned"))


def link_density(words: Column, link_words: Column) -> Column:
    """Accept an article: at least 50 words outside links, at most 30 % inside."""
    return (words - link_words >= 50) & (link_words / words <= 0.3)


def extract_articles(pages: DataFrame, html: str = "html", url: str | None = "url", threshold: float = 5,
                     selector=None) -> DataFrame:
    """Article markup per page: parse, score, pick, clean, accept. `article` is null without one."""
    keep = [c for c in pages.columns if c != html]
    counted = clean_subtree(pages, html, url, threshold, selector).select(
        *keep, F.col("cleaned.html").alias("_article"), stride_words(F.col("cleaned.text")).alias("_words"),
        stride_words(F.col("cleaned.link_text")).alias("_link_words"))
    good = link_density(F.col("_words"), F.col("_link_words"))
    return counted.select(*keep, F.when(good, F.col("_article")).alias("article"))


def absolute_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Every href and src of the markup made absolute."""
    return _rewritten(pages, html, url, ())


def sanitize_page(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Whole page with absolute links and without script, iframe and noscript."""
    return _rewritten(pages, html, url, ("script", "iframe", "noscript"))


def _rewritten(pages, html, url, drop):
    """Only the parse is Python; what changes is put together from the tree's offsets."""
    now = F.when(F.col(html).isNotNull(), rewritten_markup(F.col("dom"), F.col(url), drop))
    return with_dom(pages, html).withColumn(html, now).drop("dom")
