"""The archive of captures and following links on narrow rows."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators.store import latest_response
from feedloom.plans.full_text import Heads, Indexed, look_up
from feedloom.sources.archive import Archive, write_archive

SCHEMA = "url string, final_url string, code int, msg string, headers map<string,string>, body binary, at string"
PAGE = {"content-type": "text/html; charset=utf-8"}


def captured(spark, rows):
    full = [(u, u, c, "m", h, b.encode(), at) for u, c, h, b, at in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("fetched_at", F.col("at").cast("timestamp")).drop("at")


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    """Chains through status, refresh headers and pages, ties of one instant, and a URL with a third of all captures."""
    rng = random.Random(2)
    rows, day = [], "2024-03-%02d 10:00:%02d"
    for i in range(60):
        u = f"http://p/{i}"
        for n in range(rng.randrange(1, 4)):
            at = day % (1 + n, i % 3)
            kind = rng.randrange(7)
            if kind == 0:
                rows.append((u, 301, {"location": f"/{rng.randrange(70)}"}, "", at))
            elif kind == 1:
                rows.append((u, 200, {**PAGE, "refresh": f"1;url=/{rng.randrange(70)}"}, f"r{i}", at))
            elif kind == 2:
                rows.append((u, 200, PAGE, f'<meta http-equiv="refresh" content="0;url=/{rng.randrange(70)}">{i}', at))
            elif kind == 3:
                rows.append((u, 404, PAGE, "lost", at))
            else:
                rows.append((u, 200, PAGE, f"page {i} of visit {n}", at))
                if kind == 4:  # the same instant and code, another body
                    rows.append((u, 200, PAGE, f"page {i} again" + "." * rng.randrange(3), at))
                if kind == 5:  # one of a tie leads on
                    rows.append((u, 301, {"location": "/1"}, "", at))
        if i % 9 == 0:
            rows.append((u, 304, {}, "", day % (9, 0)))
    rows += [(f"http://chain/{k}", 302, {"location": f"/{k + 1}"}, "", day % (1, 1)) for k in range(14)]
    rows.append(("http://chain/14", 200, PAGE, "the end", day % (1, 1)))
    rows += [("http://hot/", 200, PAGE, f"hot {k}", f"2024-04-{1 + k // 24:02} {k % 24:02}:00:00") for k in range(90)]
    folder = tmp_path_factory.mktemp("site")
    df = captured(spark, rows).repartition(5)
    df.write.parquet(f"{folder}/plain")
    write_archive(df, f"{folder}/archive", files=6)
    return spark.read.parquet(f"{folder}/plain"), Archive(spark, f"{folder}/archive"), rows


def stepwise(rows, asked, limit=10):
    """Ends by a loop over a dictionary of the newest captures."""
    from urllib.parse import urljoin
    import re

    best = {}
    for u, c, h, b, at in rows:
        if c != 304:
            best.setdefault(u, []).append((at, c, h, b))
    out = {}
    for start in asked:
        at, seen = start, [start]
        while True:
            have = best.get(at)
            if not have:
                out[start] = (at, None)
                break
            last = max(x[0] for x in have)
            c, h, b = min((x[1:] for x in have if x[0] == last), key=lambda x: (x[0], len(x[2])))
            meta = re.search(r'content="0;url=([^"]+)', b)
            goes = h.get("location") if c == 301 or c == 302 else (h.get("refresh") or (meta[1] if meta else "")).split("url=")[-1] if c == 200 else None
            if not goes:
                out[start] = (at, b if c == 200 else None)
                break
            at = urljoin(at, goes)
            if at in seen or len(seen) > limit:
                break
            seen.append(at)
    return out


@pytest.mark.parametrize("how", ["plain", "archive"])
def test_look_up(spark, site, how):
    plain, archive, rows = site
    asked = [f"http://p/{i}" for i in range(60)] + ["http://absent/", "http://hot/", "http://chain/0", "http://chain/3", "http://chain/4", "http://chain/5"]
    wanted = spark.createDataFrame([(u,) for u in asked + asked[:5] + [None]], "url string")
    captures = archive if how == "archive" else plain.where("code <> 304")
    ends, finals = look_up(wanted, captures)
    ends = {r.url: r.final_url for r in ends.collect()}
    texts = {r.final_url: r for r in finals.collect()}
    want = stepwise(rows, asked)
    assert "http://chain/3" not in want and "http://chain/4" in want
    assert ends == {u: e for u, (e, _) in want.items()}
    for end, text in want.values():
        if text is not None:
            assert texts[end].text == text and texts[end].data_bytes == len(text)
        elif end in texts:
            assert texts[end].code == 404
    assert len(texts) == finals.count()


def test_hops_read_no_bodies(spark, site):
    plain, archive, _ = site
    asked = spark.createDataFrame([("http://p/1",), ("http://chain/0",)], "url string")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for source in (Heads(plain), Indexed(archive)):
        heads = plan(source.look(asked, None))
        assert "ReadSchema" in heads and "body" not in heads
    assert "body" in plan(Indexed(archive).read(archive.index.limit(3), None))


@pytest.mark.parametrize("as_of", [None, "2024-03-02 09:00:00"])
def test_latest_from_the_archive(site, as_of):
    plain, archive, _ = site

    def rows(df):
        return sorted((r.url, r.code, str(r.fetched_at), bytes(r.body), sorted(r.headers.items())) for r in df.collect())

    assert rows(archive.latest_response(as_of)) == rows(latest_response(plain, as_of))


def test_layout(site):
    _, archive, rows = site
    bodies = archive.bodies.withColumn("file", F.col("_metadata.file_path"))
    assert archive.index.count() == len(rows)
    assert bodies.where("url = 'http://hot/'").select("file").distinct().count() > 1, "a hot URL is split by time"
    spans = bodies.groupBy("file").agg(F.min("url_hash").alias("a"), F.max("url_hash").alias("b")).orderBy("a", "b").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))


def test_fetch_in_every_way(spark, site, monkeypatch):
    from feedloom.sources import archive as module

    _, archive, rows = site
    chosen = archive.index.where("url LIKE '%chain%'").cache()
    want = sorted(r.url for r in chosen.collect())
    for files, places in ((module.FILES, module.PLACES), (0, 0)):
        monkeypatch.setattr(module, "FILES", files)
        monkeypatch.setattr(module, "PLACES", places)
        assert sorted(r.url for r in archive.fetch(chosen).collect()) == want
    assert archive.fetch(chosen.limit(0)).count() == 0


def test_archive_of_nothing(spark, tmp_path):
    write_archive(captured(spark, []), f"{tmp_path}/none")
    archive = Archive(spark, f"{tmp_path}/none")
    ends, finals = look_up(spark.createDataFrame([("http://a/",)], "url string"), archive)
    assert [tuple(r) for r in ends.collect()] == [("http://a/", "http://a/")] and finals.count() == 0
