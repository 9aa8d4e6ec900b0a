"""What moves or is written is narrow, or moves once."""

import os

import pytest
from pyspark.sql import functions as F

from feedloom.operators.joins import lookup_wide
from feedloom.plans import derived, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(60).select(F.col("id").alias("page_id"), F.format_string("http://s%d.example/p", "id").alias("url"),
                           F.format_string("<article><h1>T</h1><p>%s %d</p></article>", F.repeat(F.lit("some word "), 40), F.col("id")).alias("html")) \
        .write.parquet(f"{folder}/pages.parquet")
    spark.range(80).select(F.col("id").alias("doc_id"), F.format_string("%d has a text %s", "id", F.repeat(F.lit("of words "), 20)).alias("text"),
                           F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["full_text_feed", "full_text_documents"])
def test_the_whole_job_does_not_build_its_captures_again(spark, tables, monkeypatch, tmp_path, name):
    given, folder = [], str(tmp_path / "work")
    monkeypatch.setattr(queries, "_work_folder", lambda _: folder)
    job = getattr(queries, name)
    monkeypatch.setattr(queries, name, lambda captures, *rest, **options: given.append(plan(captures)) or job(captures, *rest, **options))
    result = queries.QUERIES[name](spark, tables)
    assert len(given) == 1 and "Join" not in given[0] and "Aggregate" not in given[0]
    assert not os.path.exists(folder) and result.count() > 3


def test_visits_of_a_page_come_from_one_join(spark, tables):
    captured = derived.captures(spark, tables)
    assert plan(captured).count("Join LeftOuter") == 1
    rows = {(r.page_id, r.visit): r for r in captured.collect()}
    assert len(rows) == 90 and rows[8, 1].code == 304 and rows[8, 0].code == 200 and rows[14, 0].code == rows[14, 1].code == 301
    assert (rows[8, 1].fetched_at - rows[8, 0].fetched_at).days == 1 and (3, 1) not in rows


def test_wide_rows_stay_if_the_narrow_ones_are_few(spark):
    wide = spark.createDataFrame([("a", "x" * 100), ("b", "y"), ("c", "z"), (None, "n")], "k string, text string")
    narrow = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "unknown"), (5, None)], "row int, k string")
    want = sorted((r.row, r.k, r.text) for r in narrow.join(wide, "k").collect())
    for options, stays in (({}, True), ({"max_bytes": 10}, False), ({"most": 1}, False)):
        got = lookup_wide(narrow, wide, "k", ["row"], **options)
        assert sorted((r.row, r.k, r.text) for r in got.collect()) == want
        assert ("_salt" not in plan(got)) == stays
    assert lookup_wide(narrow.limit(0), wide, "k", ["row"]).count() == 0


def test_bodies_are_zipped_once(spark, tables):
    assert plan(queries.QUERIES["decode_bodies"](spark, tables)).count("ArrowEvalPython") == 3
