"""Phrases whose words occur together far more often than apart, per language.

Texts become runs of word numbers, and phrases of two words and more are
counted in counting quotient filters (`quotient.py`): the numbers of a phrase
are packed into one key, the key is permuted one to one, and each shard sends
one compact filter per segment of the key space. Filters of a segment merge as
sorted runs, so counts are exact, and what is shuffled is a few bytes for every
different phrase of a shard.

1. `tokens` reads the texts once. A block of texts is written as local word
   numbers, beside its different words with their counts.
2. `vocabulary` sums the counts. Only words that reach `least` get a number: no
   other can be part of a phrase that does. Numbers are dense, so keys are short.
3. The blocks learn the numbers of their words by a shuffle of their different
   words, build filters, and the filters are merged by segment.
4. `scored` looks up the counts of both parts of every cut by salted joins, and
   drops phrases that mostly occur inside of a longer one.

No table is broadcast and no group is collected: a segment's size is chosen
from the number of words, a block has a bounded number of words, and the only
rows per language are the ranked ones.

Defined cases: a null text is empty, a null language is `und`; words are what
remains between spaces and tabs in the pieces between punctuation and line
breaks; only A-Z is lower-cased; equal scores are ordered by count, then by the
bytes of the phrase; repeated rows count as often as they occur; empty tables
give no rows; a text of any length is read whole; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.llm.common import buffers, cut, drop_folder, numbered, shared_folder, text_of
from feedloom.llm.quotient import Shape
from feedloom.operators.joins import lookup_join

LEAST = 10
LONGEST = 3
FIRST = 2000
#: A phrase goes if one that contains it has this share of its count.
INSIDE = 0.5
#: Words of a block, bytes of text and words looked at together, and keys (repeats counted) of a segment and of a filter.
BLOCK_WORDS, SLICE_BYTES, WINDOW, SEGMENT_KEYS, FILTER_KEYS = 1 << 22, 1 << 22, 1 << 18, 1 << 21, 1 << 21
SALTS = 32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Of a byte: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = 1
KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts, the number of each word's text, and whether a piece begins with it."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = LOWER[data[lo:hi]]
    kind = KIND[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]] - lo
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    bounds = np.concatenate([np.flatnonzero(kind == 2), heads])
    bounds.sort()
    first = np.zeros(len(at), bool)
    after = np.searchsorted(at, bounds)
    first[after[after < len(at)]] = True
    text = np.searchsorted(offsets - lo, at, "right") - 1
    upto = np.cumsum(inside)
    packed = data[inside]
    ends = np.append(upto[at] - 1, len(packed))
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(packed)), text, first


class Block:
    """Words of some texts as local numbers (from 1; 0 stands before every piece), and what the numbers mean."""

    def __init__(self):
        self.langs, self.words, self.codes, self.size = [], [], [], 0

    def add(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        words, text, first = words_of(data, offsets)
        if not len(words):
            return
        lang, word = langs.dictionary_encode(), words.dictionary_encode()
        keys = lang.indices.to_numpy().astype(np.int64)[text] << 32 | word.indices.to_numpy()
        pairs = pa.array(keys).dictionary_encode()
        known = pairs.dictionary.to_numpy()
        self.langs.append(lang.dictionary.take(pa.array(known >> 32)).cast(pa.large_string()))
        self.words.append(word.dictionary.take(pa.array(known & 0xFFFFFFFF)))
        codes = np.zeros(len(first) + int(first.sum()), np.int32)
        codes[np.arange(len(first)) + np.cumsum(first)] = pairs.indices.to_numpy() + 1 + sum(map(len, self.words[:-1]))
        self.codes.append(codes)
        self.size += len(codes)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        langs, words = pa.chunked_array(self.langs).combine_chunks(), pa.chunked_array(self.words).combine_chunks()
        lang, word = langs.dictionary_encode(), words.dictionary_encode()
        pairs = pa.array(lang.indices.to_numpy().astype(np.int64) << 32 | word.indices.to_numpy()).dictionary_encode()
        known = pairs.dictionary.to_numpy()
        new = np.append(0, pairs.indices.to_numpy() + 1).astype(np.int32)
        codes = new[np.concatenate(self.codes)]
        counts = np.bincount(codes, minlength=len(known) + 1)[1:]
        langs, words = lang.dictionary.take(pa.array(known >> 32)), word.dictionary.take(pa.array(known & 0xFFFFFFFF))
        for a in range(0, len(known), 1 << 16):
            n = min(len(known) - a, 1 << 16)
            yield batch(np.full(n, block), langs.slice(a, n), words.slice(a, n), np.arange(a + 1, a + n + 1), counts[a:a + n], [None] * n)
        yield batch(np.array([block]), [None], [None], [None], [len(codes)], [codes.astype("<i4").tobytes()])


TOKENS = "block long, lang string, word string, local int, n long, codes binary"


def batch(block, lang, word, local, n, codes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(lang).cast(pa.string()), pa.array(word).cast(pa.string()),
         pa.array(local, pa.int32()), pa.array(n, pa.int64()), pa.array(codes, pa.binary())],
        ["block", "lang", "word", "local", "n", "codes"])


def tokens(docs: DataFrame) -> DataFrame:
    """The blocks of (lang, text): a row per different word with its count, and one with the texts as local numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(), TaskContext.get().partitionId() << 32
        for rows in batches:
            data, offsets = buffers(rows.column(1))
            a = 0
            while a < rows.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
                block.add(rows.column(0).slice(a, b - a), data, offsets[a:b + 1])
                a = b
                if block.size >= BLOCK_WORDS:
                    yield from block.rows(number)
                    block, number = Block(), number + 1
        if block.size:
            yield from block.rows(number)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       text_of(F.col("text")).alias("text")).mapInArrow(run, TOKENS)


def vocabulary(words: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, f, id): words that occur often enough, numbered from 1 without gaps."""
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return numbered(often, "id")


def pack(ids: list[np.ndarray], bits: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of the key of phrases, given the ids of their first, second, ... words."""
    hi, lo = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
    for k, x in enumerate(reversed(ids)):
        at = k * bits
        for number, start, size in ((lo, 0, shape.low), (hi, shape.low, shape.high)):
            a, b = max(at, start), min(at + bits, start + size)
            if a < b:
                number |= ((x >> np.uint64(a - at)) & np.uint64((1 << b - a) - 1)) << np.uint64(a - start)
    return hi, lo


def unpack(hi: np.ndarray, lo: np.ndarray, words: int, bits: int, shape: Shape) -> list[np.ndarray]:
    """The reverse of `pack`."""
    out = []
    for k in reversed(range(words)):
        at, x = k * bits, np.zeros(len(hi), np.uint64)
        for number, start, size in ((lo, 0, shape.low), (hi, shape.low, shape.high)):
            a, b = max(at, start), min(at + bits, start + size)
            if a < b:
                x |= ((number >> np.uint64(a - start)) & np.uint64((1 << b - a) - 1)) << np.uint64(a - at)
        out.append(x)
    return out


def keys_of(ids: np.ndarray, text: np.ndarray, longest: int, bits: int, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Permuted keys of all phrases of 2 to `longest` words in local numbers, given the word of each; 0 is no word."""
    for a in range(0, len(text), WINDOW):
        some = ids[text[a:a + WINDOW + longest - 1]]
        n = min(WINDOW, len(text) - a)
        whole = some > 0
        for size in range(2, longest + 1):
            n = min(n, len(some) - size + 1)
            if n <= 0:
                break
            whole = whole[:n] & (some[size - 1:size - 1 + n] > 0)
            at = np.flatnonzero(whole)
            columns = [some[at + k] for k in range(size)] + [np.zeros(len(at), np.uint64)] * (longest - size)
            yield shape.permute(*pack(columns, bits, shape))


def shards(blocks: DataFrame, longest: int, bits: int, shape: Shape) -> DataFrame:
    """(segment, filter) of rows (block, local, id, codes), the rows of a block together and its codes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, id_, waiting, held = [], [], [], 0

        def send() -> pa.RecordBatch:
            done = list(shape.filters(*(np.concatenate(x) for x in zip(*waiting))))
            waiting.clear()
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([f for _, f in done], pa.binary())],
                                              ["segment", "filter"])

        for rows in batches:
            codes = rows.column(3)
            ends = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
            for a, b in zip(np.append(0, ends + 1), np.append(ends, rows.num_rows)):
                local.append(rows.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64))
                id_.append(rows.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.uint64))
                if b == rows.num_rows:
                    continue
                text = np.frombuffer(codes[int(b)].as_buffer(), "<i4")
                ids = np.zeros(int(text.max()) + 1, np.uint64)
                ids[np.concatenate(local)] = np.concatenate(id_)
                local, id_ = [], []
                for hi, lo in keys_of(ids, text, longest, bits, shape):
                    waiting.append((hi, lo))
                    held += len(hi)
                    if held >= FILTER_KEYS:
                        yield send()
                        held = 0
        if waiting:
            yield send()

    return blocks.mapInArrow(run, "segment int, filter binary")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): the vocabulary, (ids, f) of all phrases that reach `least`, and (lang, n) words in all."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/collocations-{uuid.uuid4().hex}"
    tokens(docs).write.parquet(folder)
    written = spark.read.schema(TOKENS).parquet(folder)
    entries = written.where("local IS NOT NULL").select("block", "lang", "word", "local", "n")
    totals = cut(entries.groupBy("lang").agg(F.sum("n").alias("n")))
    words = vocabulary(entries, least)
    sizes = words.agg(F.max("id")).first()[0] or 0, written.where("local IS NULL").agg(F.sum("n")).first()[0] or 0
    bits = max(1, sizes[0].bit_length())
    shape = Shape.of(bits * longest, sizes[1] * (longest - 1), SEGMENT_KEYS)
    given = entries.drop("n").join(words.select("lang", "word", "id"), ["lang", "word"])
    blocks = given.select("block", "local", "id", F.lit(None).cast("binary").alias("codes")).unionByName(
        written.where("local IS NULL").select("block", F.lit(None).cast("int").alias("local"), F.lit(None).cast("long").alias("id"), "codes"))
    blocks = blocks.repartition("block").sortWithinPartitions("block", F.col("local").asc_nulls_last())

    def merged(filters: pa.Table) -> pa.Table:
        hi, lo, n = shape.merge(filters["segment"][0].as_py(), filters["filter"].to_pylist())
        often = n >= least
        ids = np.stack(unpack(*shape.invert(hi[often], lo[often]), longest, bits, shape), 1).astype(np.int64)
        lengths = (ids > 0).sum(1)
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(ids[ids > 0])),
                         "f": pa.array(n[often], pa.int64())})

    filters = shards(blocks, longest, bits, shape)
    phrases = cut(filters.groupBy("segment").applyInArrow(merged, "ids array<long>, f long"))
    drop_folder(spark, folder)
    return words, phrases, totals


def ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact to 38 digits."""
    wide = [x.cast("decimal(38,0)") for x in (F.lit(1_000_000), a, a, left, right)]
    return F.call_function("div", wide[0] * wide[1] * wide[2], wide[3] * wide[4])


def scored(words: DataFrame, phrases: DataFrame, inside: float = INSIDE) -> DataFrame:
    """(lang, ids, a, l, r, score) of the phrases that don't mostly occur inside of a longer one."""
    counts = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    k = F.col("k")
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("ids", F.lit(1), k)).withColumn("rest", F.slice("ids", k + 1, F.size("ids") - k))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = lookup_join(cuts, counts.select(F.col("ids").alias(part), F.col("f").alias(name)), part, ["ids"], SALTS, "inner")
    best = cuts.groupBy("ids").agg(F.min(F.struct(ratio(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "a", "l", "r")).alias("b"))
    within = phrases.where(F.size("ids") > 2).select(
        F.col("f").alias("longer"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.size("ids") - size + 1), lambda at: F.slice("ids", at, size))))).alias("ids"))
    within = within.groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = best.join(within, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < round(100 * inside) * F.col("b.a")))
    kept = kept.select("ids", "b.a", "b.l", "b.r", "b.score", F.col("ids")[0].alias("id"))
    return lookup_join(kept, words.select("id", "lang"), "id", ["ids"], SALTS, "inner").drop("id")


def spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """`found` with `phrase`, the words of `ids` with spaces between."""
    parts = found.select("ids", F.posexplode("ids").alias("at", "id"))
    parts = lookup_join(parts, words.select("id", "word"), "id", ["ids"], SALTS, "inner")
    phrase = parts.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return found.join(phrase, "ids")


def mine(docs: DataFrame, first: int = FIRST, least: int = LEAST, longest: int = LONGEST, inside: float = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` phrases of each language by score, count and spelling."""
    words, phrases, totals = phrase_counts(docs, least, longest)
    found = scored(words, phrases, inside)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = cut(found.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= first).drop("rank"))
    found = spelled(found, words).join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
