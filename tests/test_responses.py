"""Captured responses: loading, decoding, redirects, the store."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from feedloom.constants import BODY_CAP
from feedloom.operators import redirects, responses as resp, store
from feedloom.operators.joins import SALTS, cut, keep_listed, lookup_join, shared_folder
from feedloom.sources import captures

BASE = "https://wetter.example.net/log/"
WORD, FAR = "Größe: 7 µm", "今天有雨"


def capture(status, *headers, body=b"", eol="\n"):
    """A raw capture: status line, headers, blank line, body."""
    return eol.join([f"HTTP/1.1 {status}", *headers, "", ""]).encode() + (body if isinstance(body, bytes) else body.encode())


def page_with(tag):
    return capture("200 OK", "Content-Type: text/html;charset=utf-8", body=f"<title>Station</title>{tag}<p>no rain")


HERE = {
    "measured": capture("200 OK", "content-type: text/plain", body="12.5 C\r\n", eol="\r\n"),
    "moved/root": capture("301 Gone Elsewhere", "location: /log/measured"),
    "moved/beside": capture("307 For Now", "location: ../measured", body="see there"),
    "moved/full": capture("303 See Other", f"LOCATION: {BASE}measured"),
    "moved/kept": capture("308 For Good", "Location:   /log/measured  "),
    "wait/header": capture("200 OK", "refresh: 15; URL='/log/measured'"),
    "wait/root": page_with('<meta content="9;url=/log/measured" http-equiv="REFRESH">'),
    "wait/beside": page_with("<meta http-equiv='refresh' content='1 ;URL=../measured'/>"),
    "wait/full": page_with(f'<meta http-equiv="refresh" content="0;url={BASE}measured">'),
    "announced": page_with('<link href="measured" title="Log" type="application/atom+xml" rel="alternate">'),
    "twice/moved": capture("302 Found", "location: /log/moved/beside"),
    "round/one": capture("302 Found", "location: two"),
    "round/two": capture("301 Moved", "location: three"),
    "round/three": capture("302 Found", "location: one"),
    "lost": capture("302 Found", "location: ?nowhere"),
    "repeated": capture("200 OK", "Wind: north", "wind: south", "a line of its own", body="calm\n\ncalm again"),
    "no-blank-line": b"HTTP/1.1 205 Start Over\nrain: 3",
    "code/utf": capture("200 OK", 'content-type: text/plain; Charset="utf-8"', body=WORD),
    "code/latin": capture("200 OK", "content-type: text/plain; charset=ISO-8859-15", body=WORD.replace("µ", "u").encode("latin-1")),
    "code/unsaid": capture("200 OK", "content-type: text/plain", body=WORD.encode("cp1252")),
    "code/unknown": capture("200 OK", "content-type: text/plain; charset=station-7", body=WORD),
    "code/far": capture("200 OK", "content-type: text/plain; charset=GB2312", body=FAR.encode("gbk")),
    "code/far-meta": capture("200 OK", "content-type: text/html", body="<meta charset=gb2312>".encode() + FAR.encode("gbk")),
    "zip/whole": capture("200 OK", "Content-Encoding: gzip", body=gzip.compress(b"rain " * 3)),
    "zip/cut": capture("200 OK", "Content-Encoding: gzip", body=gzip.compress(b"rain, then sun. " * 500)[:-9]),
    "zip/not": capture("200 OK", "Content-Encoding: gzip", body="plain after all"),
    "long": capture("200 OK", "content-type: text/plain", body=b"z" * (BODY_CAP + 70_000)),
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    for name, raw in HERE.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_bytes(raw)
    return captures.load_responses(spark, str(folder), BASE).cache()


def test_load(loaded):
    rows = {r.url.removeprefix(BASE): r for r in loaded.collect()}
    assert sorted(rows) == sorted(HERE)
    assert rows["measured"].body == b"12.5 C\r\n" and rows["measured"].headers == {"content-type": "text/plain"}
    assert (rows["moved/root"].code, rows["moved/root"].msg) == (301, "Gone Elsewhere")
    assert rows["repeated"].headers == {"wind": "north"} and rows["repeated"].body == b"calm\n\ncalm again"
    assert (rows["no-blank-line"].code, rows["no-blank-line"].body, rows["no-blank-line"].headers) == (205, b"", {"rain": "3"})


def test_load_long_heads_and_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"HTTP/1.1 200 OK\r\nx-long: " + b"v" * 70_000 + b"\r\n\r\nbody \xff\n\nmore")
    (tmp_path / "b" / "x.txt").write_bytes(b"HTTP/1.1 404 Not Found\nx: 1\r\n\r\nlost")
    rows = {r.url.removeprefix(BASE): r for r in captures.load_responses(spark, str(tmp_path), BASE).collect()}
    assert sorted(rows) == ["a/x.txt", "b/x.txt"]
    assert rows["a/x.txt"].body == b"body \xff\n\nmore" and len(rows["a/x.txt"].headers["x-long"]) == 70_000
    assert (rows["b/x.txt"].code, rows["b/x.txt"].body, rows["b/x.txt"].headers) == (404, b"lost", {"x": "1"})


def test_a_cluster_must_name_its_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://cluster:7077"

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_decode(loaded):
    rows = {r.url.removeprefix(BASE): r for r in resp.decode_bodies(loaded).collect()}
    assert {n: rows[f"code/{n}"].text for n in ("utf", "unsaid", "unknown")} == dict.fromkeys(("utf", "unsaid", "unknown"), WORD)
    assert rows["code/latin"].text == WORD.replace("µ", "u")
    assert rows["code/far"].text == FAR and rows["code/far-meta"].text.endswith(FAR)
    assert {rows[n].encoding for n in ("code/far", "code/far-meta")} == {"gbk"}
    assert rows["zip/whole"].text == "rain rain rain " and rows["zip/not"].text == "plain after all"
    assert rows["zip/cut"].text.startswith("rain, then sun. rain")
    assert len(rows["long"].data) == BODY_CAP


def test_redirects(loaded):
    pages = resp.apply_http_equiv(resp.decode_bodies(loaded))
    edges = cut(redirects.redirect_edges(pages, "rss"))
    got = {r.url.removeprefix(BASE): r for r in redirects.resolve_redirects(edges).collect()}
    once = [n for n in HERE if n.startswith(("moved/", "wait/"))] + ["announced"]
    assert {n: (got[n].final_url, got[n].hops) for n in once} == dict.fromkeys(once, (BASE + "measured", 1))
    assert (got["twice/moved"].final_url, got["twice/moved"].hops) == (BASE + "measured", 2)
    assert [got[f"round/{n}"].final_url for n in ("one", "two", "three")] == [None] * 3
    assert got["lost"].final_url == BASE + "lost?nowhere"
    assert "announced" not in {r.url.removeprefix(BASE) for r in redirects.redirect_edges(pages).collect()}
    finals = {r.url.removeprefix(BASE): r for r in redirects.final_responses(pages, redirects.resolve_redirects(edges)).collect()}
    assert finals["twice/moved"].text == "12.5 C\r\n" and finals["measured"].final_url == BASE + "measured"
    assert not {"lost", "round/one"} & set(finals)


def walked(edges, limit):
    """The same by one step after another."""
    out = {}
    for url in edges:
        at, hops, seen = url, 0, {url}
        while at in edges and (limit is None or hops < limit):
            at, hops = edges[at], hops + 1
            if at in seen:
                break
            seen.add(at)
        out[url] = (at, hops) if at not in edges else (None, None)
    return out


@pytest.mark.parametrize("limit", [1, 2, 7, 8, 10, None])
def test_pointer_jumping(spark, limit):
    rng = random.Random(4)
    edges = {f"u{i}": f"u{i + 1}" for i in range(12)} | {f"long{i}": f"long{i + 1}" for i in range(70)}
    edges |= {f"c{i}": f"c{(i + 1) % 5}" for i in range(5)} | {"self": "self", "into": "c2"}
    edges |= {f"hub{i}": "u3" for i in range(300)} | {f"r{i}": f"r{rng.randrange(400)}" for i in range(200)}
    df = spark.createDataFrame(list(edges.items()), "url string, target string").repartition(3)
    got = {r.url: (r.final_url, r.hops) for r in redirects.resolve_redirects(df, limit).collect()}
    assert got == walked(edges, limit)
    some = spark.createDataFrame([("u2",), ("u2",), ("absent",), ("c1",)], "url string")
    want = walked(edges, limit)
    assert sorted((r.url, r.final_url) for r in redirects.resolve_redirects(df, limit, some).collect()) == [("c1", None), ("u2", want["u2"][0])]


def test_pointer_jumping_of_nothing(spark):
    assert redirects.resolve_redirects(spark.createDataFrame([], "url string, target string")).count() == 0
    assert redirects.resolve_redirects(spark.createDataFrame([], "url string, target string"), None).count() == 0


def test_refresh_forms(spark):
    values = ["0;url=/x", "5 ; URL = '/x'", '1; url="/x"', "7", "x;url=/x", "1;url='/x", "0;url="]
    df = spark.createDataFrame([("http://h/a", 200, {"refresh": v}) for v in values],
                               "url string, code int, headers map<string,string>")
    got = [r.target for r in redirects.refresh_target(df).collect()]
    assert got == ["http://h/x", "http://h/x", "http://h/x", None, None, "http://h/'/x", None]


def response(url, at, code=200, body="b", **headers):
    return (url, url, code, "m", {k.replace("_", "-"): v for k, v in headers.items()}, body.encode(), f"2024-01-01 {at}")


def responses(spark, *rows):
    df = spark.createDataFrame(rows, "url string, final_url string, code int, msg string, "
                                     "headers map<string,string>, body binary, at string")
    return df.withColumn("fetched_at", F.col("at").cast("timestamp")).drop("at")


DECISIONS = [
    (dict(), {}, "fetch"),
    (dict(), dict(cache_control="max-age=7200"), "use"),
    (dict(), dict(cache_control="max-age=60"), "fetch"),
    (dict(), dict(cache_control="max-age=never"), "fetch"),
    (dict(), dict(cache_control="no-cache, max-age=7200"), "fetch"),
    (dict(), dict(pragma="no-cache", cache_control="max-age=7200"), "fetch"),
    (dict(force_min=7200), dict(cache_control="no-store"), "use"),
    (dict(force_min=60), dict(cache_control="no-store, max-age=7200"), "use"),
    (dict(force_max=60), dict(cache_control="max-age=7200"), "fetch"),
    (dict(policy="offline"), {}, "use"), (dict(policy="cached"), {}, "use"), (dict(policy="refresh"), {}, "fetch"),
    (dict(policy="offline", privacy="public"), dict(cache_control="private"), "fetch"),
]


@pytest.mark.parametrize("options,headers,expected", DECISIONS)
def test_cache_decision(spark, options, headers, expected):
    df = responses(spark, response("u", "10:00:00", **headers))
    wanted = spark.createDataFrame([("u",), ("absent",)], "url string")
    got = {r.url: r.decision for r in store.cache_decision(df, "2024-01-01 11:00:00", wanted=wanted, **options).collect()}
    assert got["u"] == expected
    assert got["absent"] == ("conflict" if options.get("policy") == "offline" else "fetch")


def test_permanent_redirect_is_kept_a_week(spark):
    df = responses(spark, response("u", "10:00:00", 301, location="/x"))
    assert store.cache_decision(df, "2024-01-08 09:00:00").first().decision == "use"
    assert store.cache_decision(df, "2024-01-08 11:00:00").first().decision == "fetch"


def test_cacheable(spark):
    df = responses(spark, response("a", "10:00:00", cache_control="No-Store"), response("b", "10:00:00", pragma="no-cache"),
                   response("c", "10:00:00", cache_control="private"), response("d", "10:00:00"))
    urls = lambda x: sorted(r.url for r in x.collect())
    assert urls(store.cacheable(df)) == ["a", "c", "d"]
    assert urls(store.cacheable(df, privacy="public")) == ["a", "d"]
    assert urls(store.cacheable(df, force_min=0)) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("how", [(1,), (7,), (3, 0), (3, 0, 1)])
def test_merge_304(spark, how):
    df = responses(
        spark, response("u", "09:00:00", 304), response("u", "10:00:00", body="v1", etag="1"), response("u", "10:30:00", 304),
        response("u", "13:00:00", 304), response("u", "14:00:00", body="v2"), response("u", "14:00:00", 304),
        response("w", "10:00:00", 304))
    got = sorted((r.url, str(r.revalidated_at)[11:16], str(r.fetched_at)[11:16], r.code, r.body.decode())
                 for r in store.merge_304(df, *how).collect())
    assert got == [("u", "", "09:00", 304, "b"), ("u", "", "10:00", 200, "v1"), ("u", "", "14:00", 200, "v2"),
                   ("u", "10:30", "10:00", 200, "v1"), ("u", "13:00", "10:00", 200, "v1"),
                   ("u", "14:00", "14:00", 200, "v2"), ("w", "", "10:00", 304, "b")]


@pytest.mark.parametrize("how", [(), (5, 0), (5, 0, 20)])
def test_merge_304_of_a_hot_url(spark, how):
    """Most captures are of one URL; ties of one instant, repeated 304s and URLs without a full capture occur."""
    rng, rows = random.Random(9), []
    for k in range(700):
        url = "hot" if k % 3 else f"u{rng.randrange(40)}"
        rows.append((url, rng.choice([304, 304, 304, 304, 200, 404]), rng.randrange(400), f"body {k % 50}"))
    rows += [("quiet", 304, 1, ""), ("quiet", 304, 1, ""), ("quiet", 200, 5, "late"), ("quiet", 304, 5, "")] + [("quiet", 304, 9, "")] * 3
    rows += [("hot", 200, 1000, "last")] + [("hot", 304, 1001 + k, "") for k in range(60)]
    df = spark.createDataFrame(rows, "url string, code int, s int, b string").select(
        "url", "code", F.lit("m").alias("msg"), F.col("b").cast("binary").alias("body"), F.timestamp_seconds("s").alias("fetched_at")).repartition(6)
    kept = {}
    for u, c, t, b in rows:
        if c != 304:
            kept.setdefault(u, []).append((t, c, b))
    want = [(u, c, t, None, b) for u, full in kept.items() for t, c, b in full]
    for u, c, t, b in rows:
        if c == 304:
            last = max((x[0] for x in kept.get(u, []) if x[0] <= t), default=None)
            ties = [x for x in kept.get(u, []) if x[0] == last]
            best = min(ties, key=lambda x: (x[1], len(x[2]))) if ties else None
            want.append((u, best[1], last, t, None) if best else (u, 304, t, None, b))
    got = [(r.url, r.code, int(r.fetched_at.timestamp()), r.revalidated_at and int(r.revalidated_at.timestamp()),
            None if r.revalidated_at else r.body.decode()) for r in store.merge_304(df, *how).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_merge_304_shuffles_no_body_for_a_short_list(spark, tmp_path):
    rows = [(u, c, "m", b"x", f"2024-01-01 0{i}:00:00") for u in "ab" for i, c in enumerate((200, 304, 304, 404, 304))]
    df = spark.createDataFrame(rows, "url string, code int, msg string, body binary, at string")
    df.withColumn("fetched_at", F.col("at").cast("timestamp")).drop("at").write.parquet(f"{tmp_path}/c")
    plan = store.merge_304(spark.read.parquet(f"{tmp_path}/c"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "body" in plan


def test_trim(spark):
    df = responses(spark, *[response(f"u{i}", f"10:00:{i:02}") for i in range(9)], response("u0", "11:00:00"))
    assert sorted(r.url for r in store.trim_store(df, 2).collect()) == ["u0", "u8"]
    assert store.trim_store(df, -1).count() == 9


def test_lookup_join_with_a_hot_key(spark):
    facts = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot")
                                     .when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string")).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("1", 2), ("7", 3), ("unused", 4)], "k string, v int")
    for how in ("left", "inner"):
        got = lookup_join(facts, dim, "k", ["row"], how=how).select("row", "k", "v")
        want = facts.join(dim, "k", how).select("row", "k", "v")
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    spread = lookup_join(facts, dim, "k", ["row"]).where("k = 'hot'").withColumn("s", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    assert spread.select("s").distinct().count() > SALTS * 0.9


def test_keep_listed_both_ways(spark):
    big = spark.range(100).select(F.col("id").cast("string").alias("k"))
    keys = spark.createDataFrame([("5",), ("5",), ("200",), (None,)], "k string")
    for limit in (0, 1 << 20):
        assert [r.k for r in keep_listed(big, keys, "k", limit).collect()] == ["5"]
