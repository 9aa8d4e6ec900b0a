"""Streams: what is remembered of items, in how many groups, and files that several tasks can read."""

import glob
import os
from datetime import datetime, timedelta

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from feedloom.constants import RESPONSES_SCHEMA
from feedloom.plans.queries import QUERIES, _spool, streams
from feedloom.streaming.captures import _tells_more, read_captures, stream_items

DAY = datetime(2024, 1, 1)


def capture(url, day, keys):
    items = "".join(f"<item><title>{k}</title><link>http://a/{k}</link></item>" for k in keys)
    body = f'<rss version="2.0"><channel><title>t</title>{items}</channel></rss>'.encode()
    return url, url, 200, "OK", {"content-type": "application/xml"}, bytearray(body), DAY + timedelta(days=day)


def run(spark, tmp_path, batches, **options):
    """The keys that come out, and the rows of state of the last operator."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, RESPONSES_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for new in set(glob.glob(f"{tmp_path}/in/*.parquet")) - {f for f in glob.glob(f"{tmp_path}/in/*.parquet") if os.path.getmtime(f) < 1e9}:
            os.utime(new, (n, n))       # files come in the order of their times
    out = stream_items(read_captures(spark, f"{tmp_path}/in", files_per_batch=1), **options)
    query = (out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema("feed_id string, item_key string, title string, fetched_at timestamp").parquet(f"{tmp_path}/out").collect()
    states = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"] if op["operatorName"] != "dedupeWithinWatermark"]
    return sorted((r.feed_id, r.item_key, (r.fetched_at - DAY).days) for r in rows), max(states)


def test_items_are_renewed_and_forgotten_one_by_one(spark, tmp_path):
    f, g = "http://f/", "http://g/"
    batches = [[capture(f, 0, "ab"), capture(g, 0, "a"), capture(f, 1, "a")], [capture(f, 20, "a")], [capture(f, 45, "a")],
               [capture(f, 46, "a")], [capture(f, 47, "ab")]]
    rows, states = run(spark, tmp_path, batches, groups=1)
    # a stays in its feed; b was not seen for longer than 30 days, so it is new again; g has its own a.
    assert rows == [(f, "http://a/a", 0), (f, "http://a/b", 0), (f, "http://a/b", 47), (g, "http://a/a", 0)]
    assert states == 1


def test_items_are_remembered_in_groups(spark, tmp_path):
    keys = [f"k{i}" for i in range(300)]
    rows, states = run(spark, tmp_path, [[capture("http://f/", 0, keys)], [capture("http://f/", 3, keys + ["new"])]], groups=8)
    assert len(rows) == 301 and {d for _, k, d in rows if k.endswith("new")} == {3}
    assert 1 < states <= 8


def test_one_file_of_captures_is_read_by_several_tasks(spark, tmp_path):
    body = F.concat(*[F.sha2(F.concat("id", F.lit(f"/{i}")), 512) for i in range(64)])
    big = spark.range(4000).withColumn("id", F.col("id").cast("string")).select(
        F.col("id").alias("url"), F.col("id").alias("final_url"), F.lit(200).alias("code"), F.lit("OK").alias("msg"),
        F.create_map(F.lit("a"), F.lit("b")).alias("headers"), body.cast("binary").alias("body"), F.lit(DAY).alias("fetched_at"))
    folder = _spool(big, str(tmp_path), 1)
    files = glob.glob(f"{folder}/*.parquet")
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 4000
    assert max(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 2


def test_captures_are_taken_in_before_the_next_arrive(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(n, f"http://p/{n}", "<p>x</p>") for n in range(40)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    documents = [(n, f"text number {n} " * 30, "en", "web", 100) for n in range(400)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    there, read = [], streams.read_captures

    def watched(spark, path, *more, **options):
        there.append(sum(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/**/*.parquet", recursive=True)))
        return read(spark, path, *more, **options)

    monkeypatch.setattr(streams, "read_captures", watched)
    rows = QUERIES["stream_items"](spark, str(tmp_path)).collect()
    # Of the 20 feeds' six arrivals no more than the first, which the others are made from, and one other are there.
    assert there == [20] + [40] * 5
    assert len(rows) == len(set(rows)) == 400 and len({r.feed_id for r in rows}) == 20


def test_copies_are_dropped_before_the_shuffle_and_all_else_passes(spark):
    hour = 3_600_000
    rows = [("f", "hot", DAY + timedelta(minutes=n), 0) for n in range(0, 6000, 2)][::-1]      # 100 hours
    rows += [("f", f"k{n % 500}", DAY, n) for n in range(1000)] + [(None, "hot", DAY, 1), ("g", "hot", DAY, 1)] + [("f", "timeless", None, 1)] * 2
    df = spark.createDataFrame(rows, "feed_id string, item_key string, fetched_at timestamp, pos int").coalesce(1)
    kept = df.withColumn("more", _tells_more(3 * hour)("feed_id", "item_key", "fetched_at", "pos")).where("more").collect()
    hot = sorted(r.fetched_at for r in kept if (r.feed_id, r.item_key) == ("f", "hot"))
    assert len(hot) <= 100 / 3 + 1 and hot[0] == DAY
    last = max(t for _, k, t, _ in rows if k == "hot")
    assert last - hot[-1] <= timedelta(hours=3) and all(b - a <= timedelta(hours=3, minutes=2) for a, b in zip(hot, hot[1:]))
    assert sorted(r.pos for r in kept if r.item_key.startswith("k")) == list(range(500))
    assert sorted(str(r.feed_id) for r in kept if r.item_key == "hot" and r.feed_id != "f") == ["None", "g"]
    assert sum(r.item_key == "timeless" for r in kept) == 2


def test_texts_move_once(spark, tmp_path):
    """The one shuffle is that to the groups."""
    spark.createDataFrame([capture("http://f/", 0, "abc")], RESPONSES_SCHEMA).write.parquet(f"{tmp_path}/in")
    query = (stream_items(read_captures(spark, f"{tmp_path}/in"), groups=4).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    assert [op["operatorName"] for op in query.recentProgress[0]["stateOperators"]] == ["applyInPandasWithState"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
