"""Captures on disk, laid out so that following links never reads a page.

An archive has two tables. `bodies` holds the captures, ranged and sorted by a
hash of the URL, with Bloom filters on the URL: the captures of one address lie
together, and a URL captured very often spreads over several files by time.
`index` has a narrow row of each capture: when, which code, how large, where it
sends the reader, and where its body lies (file and row). Everything that
chooses captures works on the index; `fetch` then reads the bodies that were
chosen, once, from only the files that hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.operators.joins import cut
from feedloom.operators.redirects import next_url
from feedloom.operators.responses import apply_http_equiv, decode_bodies
from feedloom.operators.store import newest

#: Addresses of chosen files are listed on the driver up to so many; beyond, all files are looked at.
FILES = 10_000
#: The chosen rows' places are broadcast up to so many bytes.
PLACES = 32 << 20
KINDS = ("rss",)


def url_hash(url: str = "url"):
    return F.xxhash64(url)


def write_archive(captures: DataFrame, path: str, files: int | None = None, row_group_bytes: int = 16 << 20) -> None:
    """Write (url, final_url, code, msg, headers, body, fetched_at) as an archive below `path`.

    `files` is the number of files of bodies, by default that of the shuffle
    partitions. Bodies are shuffled once; the index is made from what was
    written, in a scan without a shuffle.
    """
    kept = captures.select("url", "final_url", "code", "msg", "headers", "body", "fetched_at").withColumn("url_hash", url_hash())
    spark = captures.sparkSession
    number = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (kept.repartitionByRange(number, "url_hash", "url", "fetched_at").sortWithinPartitions("url_hash", "url", "fetched_at")
     .write.option("parquet.bloom.filter.enabled#url", "true").option("parquet.block.size", str(row_group_bytes))
     .parquet(f"{path}/bodies"))
    written = spark.read.parquet(f"{path}/bodies").withColumn("file", F.col("_metadata.file_path")).withColumn(
        "row", F.col("_metadata.row_index"))
    sized = written.withColumns({"size": F.length("body"), "digest": F.xxhash64("body", "msg")})
    ready = apply_http_equiv(decode_bodies(sized))
    targets = {"target": next_url(), **{f"target_{kind}": next_url(kind) for kind in KINDS}}
    ready.withColumns(targets).select("url", "url_hash", "fetched_at", "code", "size", "digest", *targets, "file", "row") \
        .write.parquet(f"{path}/index")


class Archive:
    """An archive below `path`, read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def index(self) -> DataFrame:
        """A narrow row per capture; it has no column of pages."""
        return self.spark.read.parquet(f"{self.path}/index")

    @property
    def bodies(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bodies")

    def fetch(self, chosen: DataFrame) -> DataFrame:
        """The captures at the places (file, row, distinct) of `chosen`, which is read several times: cut it if it is costly.

        Only files that hold a chosen row are opened, and the bodies found are not shuffled if the list of
        places is small; else they are shuffled once, by place.
        """
        places = chosen.select("file", "row")
        held = [r.file for r in places.select("file").distinct().limit(FILES + 1).collect()]
        if not held:
            return self.bodies.limit(0).drop("url_hash")
        source = self.bodies if len(held) > FILES else self.spark.read.schema(self.bodies.schema).parquet(*held)
        found = source.withColumn("file", F.col("_metadata.file_path")).withColumn("row", F.col("_metadata.row_index"))
        size = places.count() * 200
        places = F.broadcast(places) if size <= PLACES else places
        return found.join(places, ["file", "row"], "left_semi").drop("file", "row", "url_hash")

    def newest(self, as_of=None, full: bool = True) -> DataFrame:
        """The index row of each URL's newest capture, by default of those that are not a 304; the order is that of `latest_response`."""
        rows = self.index if as_of is None else self.index.where(F.col("fetched_at") <= F.lit(as_of).cast("timestamp"))
        return newest_rows(rows.where("code <> 304") if full else rows)

    def latest_response(self, as_of=None) -> DataFrame:
        """As the operator of this name over all captures: chosen on the index, bodies read once."""
        return self.fetch(cut(self.newest(as_of, full=False).select("file", "row")))


def newest_rows(rows: DataFrame) -> DataFrame:
    """One index row per URL."""
    return newest(rows, F.col("code"), F.col("size"), F.col("digest"))
