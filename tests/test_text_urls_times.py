import datetime as dt
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text, urls
from feedloom.functions.times import parse_time


def apply(spark, function, values, *columns):
    columns = columns or ("x",)
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    schema = "i int, " + ", ".join(f"{c} string" for c in columns)
    df = spark.createDataFrame(rows, schema)
    return [r.y for r in df.select("i", function(*[F.col(c) for c in columns]).alias("y")).orderBy("i").collect()]


def test_sanitize_url(spark):
    cases = {
        "https://quay.example/ferry?id=17": "https://quay.example/ferry?id=17",
        "quay.example/ferry": "http://quay.example/ferry",
        "https:/quay.example:81/pier": "https://quay.example:81/pier",
        "http://quay.example/tide&moon/x": "http://quay.example/tide&moon/x",
        "http://quay.example/pier four/map": "http://quay.example/pier%20four/map",
        "http://bücher.example/straße": "http://xn--bcher-kva.example/stra%C3%9Fe",
        "http://müll.example:8080/für/öl": "http://xn--mll-hoa.example:8080/f%C3%BCr/%C3%B6l",
        "https://h/p?q=ü#é": "https://h/p?q%3D%C3%BC#%C3%A9",
    }
    assert apply(spark, urls.sanitize_url, list(cases)) == list(cases.values())


BASES = ["http://h.com/a/b/c.html?q=1#f", "https://h.com", "http://h.com/", "http://h.com/a//b/", "http://h/a/b?x=/y/z"]
LINKS = ["http://o.com/x", "//o.com/y", "/r/s", "/r/../s/./t", "t", "t/u", "./t", "../t", "../../../t", "..", ".", "?n=1",
         "#top", "t?x=1#y", "mailto:a@b", "", "a//b", "x/..", "/..", "g;x=1/./y", "t?a=../b", "#", "javascript:void(0)"]


def test_absolute_url_is_reference_resolution(spark):
    pairs = [(b, k) for b in BASES for k in LINKS]
    got = apply(spark, urls.absolute_url, pairs, "b", "k")
    for (base, link), value in zip(pairs, got):
        assert value == (base if link == "" else urljoin(base, link)), (base, link)


def test_unwrap(spark):
    cases = {
        "http://www.google.com/url?q=http%3A%2F%2Fa.b%2Fc&x=1": "http://a.b/c",
        "http://www.google.com/url?sa=t": "http://www.google.com/url?sa=t",
        "http://news.google.com/news/url?sa=t&url=http://a/b+c": "http://a/b c",
        "http://translate.google.de/translate?u=http%3A%2F%2Fwww.google.com%2Furl%3Fq%3Dhttp%3A%2F%2Fz%2F": "http://z/",
        "https://getpocket.com/redirect?url=http%3A%2F%2Fp": "http://p",
        "https://www.facebook.com/l.php?u=http%3A%2F%2Ff%2F&h=2": "http://f/",
        "http://other/url?q=http://a": "http://other/url?q=http://a",
    }
    assert apply(spark, urls.unwrap_tracking, list(cases)) == list(cases.values())


def test_portal(spark):
    link = "http://rss.feedsportal.com/c/1/f/2/0L0Sexample0N0Cnews0Ca0Eb0Dx0F1/story01.htm"
    assert apply(spark, urls.decode_portal, [link, "http://x/short/story01.htm"]) == [
        "http://www.example.com/news/a-b?x=1", "http://x/short/story01.htm"]


def test_titles(spark):
    cases = {
        "THIS IS A VERY LOUD TITLE": "This Is A Very Loud Title", "SHORT": "SHORT",
        "This Is Not ALL UPPER CASE": "This Is Not ALL UPPER CASE", "12345678901234567890123": "12345678901234567890123",
        "IT'S A 3RD-RATE O'NEILL STORY": "It'S A 3Rd-Rate O'Neill Story", "ÉTÉ À LA PLAGE DE L'ÎLE": "Été À La Plage De L'Île",
    }
    assert apply(spark, text.fix_title, list(cases)) == list(cases.values())
    assert [c.title() if len(c) > 20 and c.isupper() else c for c in cases] == list(cases.values())


def test_words(spark):
    def plain(x):
        x, i, n = x.strip(), 0, 0
        while i < len(x):
            n, i = (n, i + 1) if x[i] in "\r\n\t " else (n + 1, i + 6)
        return n
    values = ["", " ", "a", "abcdef g", "   x  ", "a b c d e f g", "\nab\tcdefg   hij\r\n", "é" * 50, "\x1cab\x0c cd"]
    assert apply(spark, text.stride_words, values) == [plain(v) for v in values]
    assert apply(spark, text.text_words, ["<p>a b</p> c", "", "<!-- x -->", "&lt;a&gt; b"]) == [3, 0, 0, 2]
    assert apply(spark, text.text_length, ["<p>a b</p>", ""]) == [3, 0]
    assert apply(spark, text.unwrap_anchors, ["x<a href='1'>y</a>z<abbr>w</abbr><A>v</A>"]) == ["xyz<abbr>w</abbr>v"]


@pytest.mark.parametrize("value,expected", [
    ("Mon, 01 Jan 2022 00:00:01 +0100", "2021-12-31 23:00:01"),
    ("2022-01-01T00:00:01+01:00", "2021-12-31 23:00:01"),
    ("2022-01-01T00:00:01Z", "2022-01-01 00:00:01"),
    ("2022-01-01T00:00:01.250Z", "2022-01-01 00:00:01.250000"),
    ("2022-01-01 10:11", "2022-01-01 10:11:00"), ("2022-01-01", "2022-01-01 00:00:00"),
    ("20220101T101112Z", "2022-01-01 10:11:12"),
    ("5 Oct 2013 22:42", "2013-10-05 22:42:00"), ("Sat Oct  5 22:42:07 2013", "2013-10-05 22:42:07"),
    ("October 5, 2013 10:42 PM", "2013-10-05 22:42:00"), ("10/05/2013 12:01 am", "2013-10-05 00:01:00"),
    ("25/12/2013", "2013-12-25 00:00:00"), ("Tue, 3 Sep 13 08:00:00 GMT", "2013-09-03 08:00:00"),
    ("Tue, 03 Sep 2013 08:00:00 EST", "2013-09-03 08:00:00"), ("Tue, 03 Sep 2013 08:00:00 UTC", "2013-09-03 08:00:00"),
    ("1378195200", "2013-09-03 08:00:00"), ("0", None), ("soon", None), ("", None), (None, None),
    ("2022-13-45", None), ("32 Foo 2020", None),
])
def test_parse_time(spark, value, expected):
    got = apply(spark, lambda c: parse_time(c).cast("string"), [value])[0]
    if expected is None:
        assert got is None
    else:
        assert dt.datetime.fromisoformat(got) == dt.datetime.fromisoformat(expected)
