"""Python steps work through a batch in parts of bounded size, whatever Spark sends them."""

import gzip
import tracemalloc

import pyarrow as pa

from feedloom.functions.dom import html_dom, parse_page
from feedloom.functions.markup import clean_article, clean_markup
from feedloom.functions.parts import PART_BYTES, PART_ROWS
from feedloom.operators.responses import _decode_udf, _gunzip_udf


def test_pages_of_a_batch_are_parsed_in_parts():
    pages = [None if i % 7 == 0 else f"<p>{i}</p>" + "x" * 2000 for i in range(3000)]
    pages[5] = "<p>" + "y" * (2 * PART_BYTES)
    parts = list(html_dom.func(iter([pa.array(pages[:2500]), pa.array(pages[2500:]), pa.array([], pa.string())])))
    assert len(parts) > 5
    start = 0
    for part in parts:
        mine = [p for p in pages[start:start + len(part)] if p]
        assert len(part) <= PART_ROWS and (sum(map(len, mine)) <= PART_BYTES or len(part) == 1)
        start += len(part)
    found = [d for part in parts for d in part.to_pylist()]
    assert start == 3000 and [d is None for d in found] == [p is None for p in pages]
    assert all(bytes(d["text"]).startswith(str(i).encode()) for i, d in enumerate(found) if d and i != 5)
    assert found[9]["nodes"][0]["tag"] == parse_page(pages[9])["nodes"][0]["tag"] == "html"


def test_subtrees_of_a_batch_are_cleaned_in_parts():
    markup = [None if i % 5 == 0 else f"<div><p>{i} word word</p></div>" for i in range(2500)]
    keep, inner, base = pa.array([[True, True]] * 2500), pa.array([True] * 2500), pa.array(["http://a/"] * 2500)
    parts = list(clean_markup.func(iter([(pa.array(markup), keep, inner, base)])))
    assert max(map(len, parts)) <= PART_ROWS
    assert [d for part in parts for d in part.to_pylist()] == [
        m and clean_article(m, [True, True], True, "http://a/") for m in markup]


def test_bodies_of_a_batch_are_decoded_in_parts():
    bodies = [f"{i} é".encode("latin-1") for i in range(2500)]
    parts = list(_decode_udf.func(iter([(pa.array(bodies), pa.array(["iso-8859-1"] * 2500))])))
    assert max(map(len, parts)) <= PART_ROWS and [t for p in parts for t in p.to_pylist()] == [f"{i} é" for i in range(2500)]
    zipped = [gzip.compress(b) for b in bodies]
    parts = list(_gunzip_udf.func(iter([pa.array(zipped)])))
    assert max(p.nbytes for p in parts) < 64 << 10 and [b for p in parts for b in p.to_pylist()] == bodies


def _peak(step, batches):
    """Most bytes that Python held while the step took these batches."""
    tracemalloc.start()
    for _ in step(batches):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_memory_follows_neither_the_batch_nor_the_input():
    page = "<div><p>" + "word " * 2000 + "</p></div>"

    def pages(n):
        return pa.array([page] * n)

    def subtrees(n):
        return pages(n), pa.array([[True, True]] * n), pa.array([True] * n), pa.array(["http://a/"] * n)

    for step, batch in ((html_dom.func, pages), (clean_markup.func, subtrees)):
        _peak(step, iter([batch(10)]))
        small = _peak(step, (batch(250) for _ in range(2)))
        assert _peak(step, iter([batch(2000)])) < 1.3 * small
        assert _peak(step, (batch(250) for _ in range(10))) < 1.3 * small
