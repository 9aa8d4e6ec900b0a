"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits. It is cut into blocks, and two fingerprints that
differ in at most `threshold` bits differ in at most `threshold // blocks` of
the bits of some block. For each block the codewords of a perfect Hamming code
(31 or 15 bits) are the anchors: every value is within 1 bit of one of them, its
home. A fingerprint is sent to every anchor within the covering radius plus the
block's threshold, so that each linked pair meets at the home of either; there
it is compared by the exact distance. The bit of a block that the code leaves
out only makes the search wider.

Equal fingerprints are one node from the start, and what an anchor finds is
given as a spanning forest, so that a large group of copies makes no more links
than it has members. An anchor with more than MAX_AT_ANCHOR fingerprints is
compared in cells of bounded size, all pairs of its parts, spread over tasks.

`deduplicate` asks for a similarity of shingles instead of a number of bits, and
similar texts may differ in more bits than a code covers. So it takes sketches of
eight fingerprints, sends each to the nearest codeword of all of its 32 blocks
only, and counts the shingles of the texts that this brings together.

Defined cases: a null or empty text has no words and fingerprint zero, linked
like any other; a text of fewer words than a shingle is one shingle; repeated
rows share a component; null ids stay rows and are never a component's id
unless it has no other; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import components, cut, fresh, text_of

SEED = 42
MAX_AT_ANCHOR = 4096
#: Near-duplicates by exact similarity: this many fifths of two texts' shingles are common.
SIMILAR = 4, 5
#: A sketch has so many fingerprints of 64 bits; the first of them travel to the homes, where two meet that differ in SKETCH_BITS of them.
#: Sets of similarity 0.8 differ in 39 +- 6 of 256 bits, unrelated ones in 128 +- 8.
SKETCH_WORDS, CARRIED, SKETCH_BITS = 8, 4, 64
MIXERS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, SKETCH_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
MAX_AT_HOME, CELL_ROWS, CELL_BYTES = 32_768, 4096, 16 << 20


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    split = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not split:
        return 0
    if len(split) <= words:
        shingles = [b" ".join(split)]
    else:
        shingles = map(b" ".join, zip(*(split[i:] for i in range(words))))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at:at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(words: int = 3):
    """A column function: text to signed 64-bit fingerprint."""
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint((t.as_py() or "").encode("utf-8", "replace"), words) for t in texts], pa.int64())

    return lambda text: run(text_of(text))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def masks(n: int, radius: int) -> list[np.ndarray]:
    """Per syndrome, what to XOR onto a value of n bits to get each codeword within `radius` (nearest first)."""
    place = [0] + [1 << i for i in range(n)]
    out = [[] for _ in range(n + 1)]
    for size in range(radius + 1):
        for chosen in combinations(range(1, n + 1), size):
            syndrome = 0
            for i in chosen:
                syndrome ^= i
            out[syndrome].append(sum(place[i] for i in chosen))
    return [np.array(x, np.uint64) for x in out]


def anchors(fps: np.ndarray, blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, home): every anchor of each fingerprint; `home` marks its nearest one per block."""
    width = 64 // blocks
    n = width - 1
    if n & (n + 1) or n < 3:
        raise ValueError("blocks must be 2, 4, 8 or 16")
    radius = 1 + threshold // blocks
    table = masks(n, radius)
    rows, keys, homes = [], [], []
    for b in range(blocks):
        value = (fps >> np.uint64(b * width)) & np.uint64((1 << n) - 1)
        syndrome = np.zeros(len(fps), np.int64)
        for i in range(1, n + 1):
            syndrome ^= np.where((value >> np.uint64(i - 1)) & np.uint64(1), i, 0)
        for s in range(n + 1):
            at = np.flatnonzero(syndrome == s)
            if len(at):
                found = value[at][:, None] ^ table[s][None, :]
                rows.append(np.repeat(at, len(table[s])))
                keys.append(((np.uint64(b) << np.uint64(48)) | found).ravel())
                homes.append(np.tile(np.arange(len(table[s])) == 0, len(at)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(fps: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (root, member) that join what is within `threshold` of a home row, as a spanning forest."""
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    own = np.flatnonzero(home)
    step = max(1, (1 << 22) // max(1, len(fps)))
    for at in range(0, len(own), step):
        mine = own[at:at + step]
        near = np.bitwise_count(fps[mine][:, None] ^ fps[None, :]) <= threshold
        for k, i in enumerate(mine):
            others = np.flatnonzero(near[k])
            tops = np.unique(parent[others])
            tops = np.unique([root(int(t)) for t in tops] + [root(int(i))])
            if len(tops) > 1:
                parent[tops[1:]] = tops[0]
            parent[others] = tops[0]
    tops = np.array([root(i) for i in range(len(fps))], np.int64)
    member = np.flatnonzero(tops != np.arange(len(fps)))
    return list(zip(fps[tops[member]].view(np.int64).tolist(), fps[member].view(np.int64).tolist()))


def by_run(batches: Iterator[pa.RecordBatch], threshold: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, part, fp, home) sorted by key and part; a run over `most` rows comes back as it is."""
    names = ["u", "v", "key", "home"]
    rest, large = None, None

    def out(u, v, key, home):
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(key, pa.int64()),
                                pa.array(home, pa.bool_())], names)

    def done(run):
        links = forest(run[2].view(np.uint64), run[3], threshold)
        if links:
            u, v = zip(*links)
            yield out(u, v, [None] * len(u), [None] * len(u))

    for batch in batches:
        key, part, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        now = [key, part, fp, batch.column(3).to_numpy(zero_copy_only=False)]
        if rest is not None:
            now = [np.concatenate([a, b]) for a, b in zip(rest, now)]
        ends = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        starts = np.concatenate([[0], ends])
        stops = np.concatenate([ends, [len(now[0])]])
        for a, b in zip(starts, stops):
            last = b == len(now[0])
            run = [x[a:b] for x in now]
            if large is not None and large == (run[0][0], run[1][0]) or most and b - a > most:
                large = (run[0][0], run[1][0])
                yield out([None] * (b - a), run[2], run[0], run[3])
                rest = None
            elif last:
                rest = run
            elif b - a > 1:
                yield from done(run)
        if large is not None and (now[0][-1], now[1][-1]) != large:
            large = None
    if rest is not None and len(rest[0]) > 1:
        yield from done(rest)


def links(nodes: DataFrame, threshold: int = 3, blocks: int = 2) -> DataFrame:
    """(u, v) of different fingerprints within `threshold` bits, enough of them to connect whatever is connected.

    `nodes` has one column fp without repeats.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 1 << 14):
                some = fps[at:at + (1 << 14)]
                row, key, home = anchors(some, blocks, threshold)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.zeros(len(key), np.int64)),
                                       pa.array(some[row].view(np.int64)), pa.array(home)], ["key", "part", "fp", "home"])

    sent = nodes.mapInArrow(spread, "key long, part long, fp long, home boolean")
    first = cut(sent.repartition("key").sortWithinPartitions("key", "part").mapInArrow(
        lambda batches: by_run(batches, threshold, MAX_AT_ANCHOR), "u long, v long, key long, home boolean"))
    found = first.where("u IS NOT NULL").select("u", "v")
    hot = first.where("u IS NULL").select("key", F.col("v").alias("fp"), "home")
    if hot.isEmpty():
        return found
    # An anchor of n rows has k parts by a hash; part a meets part b in cell (a, b), where a's home rows look at all of both.
    parts = hot.groupBy("key").agg(F.ceil(F.count("*") / (MAX_AT_ANCHOR / 2)).alias("k"))
    placed = hot.join(parts, "key").withColumn("p", F.pmod(F.xxhash64("fp"), F.col("k")))
    cells = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select("key", (F.least("p", "q") * F.col("k") + F.greatest("p", "q")).alias("part"), "fp", "home")
    more = cells.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(
        lambda batches: by_run(batches, threshold, None), "u long, v long, key long, home boolean")
    return found.union(more.select("u", "v"))


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 3, blocks: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): `component_id` is the smallest doc_id reachable over links, itself included."""
    prints = cut(docs.select("doc_id", fingerprints(words)(docs["text"]).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = cut(least)
    roots = components(links(least.select("fp"), threshold, blocks))
    joined = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the different shingles of one text, sorted; none without words."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(split)] if len(split) <= words else map(b" ".join, zip(*(split[i:] for i in range(words))))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), ">u8").astype(np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """The SKETCH_WORDS fingerprints of one set of shingles, each over other hashes made of the given ones."""
    counts = np.zeros(64 * SKETCH_WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        mixed = (hashes[at:at + (1 << 12), None] ^ (hashes[at:at + (1 << 12), None] >> np.uint64(31))) * MIXERS[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def sketches(words: int):
    """A column function: text to sketch."""
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([sketch(shingle_hashes((t.as_py() or "").encode("utf-8", "replace"), words)) for t in texts], pa.binary())

    return lambda text: run(text_of(text))


def homes(bits: np.ndarray) -> np.ndarray:
    """(sketch, block): the key of the codeword nearest to each block of 16 bits, of which the code takes 15."""
    value = bits.view(np.uint16) & np.uint16(0x7FFF)
    syndrome = np.zeros(value.shape, np.uint16)
    for i in range(1, 16):
        syndrome ^= np.where((value >> np.uint16(i - 1)) & np.uint16(1), np.uint16(i), np.uint16(0))
    home = value ^ np.where(syndrome, np.uint16(1) << (np.maximum(syndrome, 1) - np.uint16(1)), np.uint16(0))
    return home.astype(np.int64) | (np.arange(value.shape[1], dtype=np.int64) << 16)[None, :]


def stars(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the sketches within SKETCH_BITS of each other: each member to one of its group."""
    n = len(ids)
    step, ones, twos = max(1, (1 << 20) // n), [], []
    for at in range(0, n, step):
        near = np.bitwise_count(bits[at:at + step, None, :] ^ bits[None, at:, :]).sum(2, dtype=np.uint16) <= SKETCH_BITS
        one, two = np.nonzero(np.triu(near, 1))
        ones.append(one + at)
        twos.append(two + at)
    one, two = np.concatenate(ones), np.concatenate(twos)
    label = np.arange(n)
    while True:
        least = np.minimum(label[one], label[two])
        if (least == label[one]).all() and (least == label[two]).all():
            break
        np.minimum.at(label, one, least)
        np.minimum.at(label, two, least)
    member = np.flatnonzero(label != np.arange(n))
    return ids[label[member]], ids[member]


def candidates(nodes: DataFrame) -> DataFrame:
    """(u, v): links of what may be similar, enough to connect all of it; `nodes` has (node, bits), each node once.

    Every sketch goes to the home of each of its blocks. There are 2,048 homes
    for a block, so how many sketches each gets is a table of fixed size; a home
    of more than MAX_AT_HOME is compared in cells, all pairs of its parts.
    """
    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
        return batch.column(0).to_numpy(zero_copy_only=False), bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 21, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(homes(read(batch)[1]).ravel(), minlength=len(total))
        key = np.flatnonzero(total)
        yield pa.record_batch([pa.array(key, pa.int64()), pa.array(total[key])], ["key", "n"])

    many = nodes.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > MAX_AT_HOME)
    parts = {r.key: -(-r.n * 2 // MAX_AT_HOME) for r in many.collect()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "part", "node", "bits"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                ids, bits = read(batch.slice(at, 1 << 12))
                key = homes(bits)
                row = np.repeat(np.arange(len(ids)), key.shape[1])
                key, part = key.ravel(), np.zeros(len(row), np.int64)
                if parts:
                    k = np.array([parts.get(x, 1) for x in key.tolist()], np.int64)
                    p = np.mod(ids[row] ^ (ids[row] >> 32), k)
                    q = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    row, key, p, k = (np.repeat(x, k) for x in (row, key, p, k))
                    part = np.minimum(p, q) * k + np.maximum(p, q)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * CARRIED), len(row), [
                    None, pa.py_buffer(np.ascontiguousarray(bits[row, :CARRIED]))]).cast(pa.binary())
                yield pa.record_batch([pa.array(key), pa.array(part), pa.array(ids[row]), raw], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            now = [key, part, ids, np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, CARRIED)]
            if rest is not None:
                now = [np.concatenate([a, b]) for a, b in zip(rest, now)]
            ends = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            starts = np.append(0, ends)
            found = [stars(now[2][a:b], now[3][a:b]) for a, b in zip(starts, ends)]
            rest = [x[starts[-1]:] for x in now]
            yield from linked(found)
        if rest is not None:
            yield from linked([stars(rest[2], rest[3])])

    sent = nodes.mapInArrow(send, "key long, part long, node long, bits binary")
    return sent.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(meet, "u long, v long")


def linked(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if any(len(u) for u, _ in found):
        u, v = (np.concatenate(x) for x in zip(*found))
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def similar(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of sets whose exact similarity is SIMILAR at least, as a spanning forest."""
    m, (num, den) = len(ids), SIMILAR
    size = np.array([len(s) for s in sets], np.int64)
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(m), size)[np.argsort(inverse, kind="stable")]
    times = np.bincount(inverse)
    first, own = np.cumsum(times) - times, np.append(0, np.cumsum(size))
    label, u, v = np.arange(m), [], []
    for i in range(m):
        other = label != label[i]
        other[:i] = False
        other &= den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i])
        if not other.any():
            continue
        mine = inverse[own[i]:own[i + 1]]
        n = times[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(holders[at], minlength=m)
        for j in np.flatnonzero(other & ((num + den) * common >= num * (size + size[i]))):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                u.append(ids[i])
                v.append(ids[j])
    return np.array(u, np.int64), np.array(v, np.int64)


def by_text(words: int):
    """Rows (root, part, node, text), sorted, to the links of similar texts within each root and part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, sets = None, [], []
        for batch in batches:
            root, part, node = (batch.column(i).to_pylist() for i in range(3))
            for k in range(batch.num_rows):
                if last != (root[k], part[k]):
                    if len(ids) > 1:
                        yield from linked([similar(np.array(ids, np.int64), sets)])
                    last, ids, sets = (root[k], part[k]), [], []
                if not ids or ids[-1] != node[k]:  # rows of one text are one node
                    ids.append(node[k])
                    sets.append(shingle_hashes(batch.column(3)[k].as_py().encode("utf-8", "replace"), words))
        if len(ids) > 1:
            yield from linked([similar(np.array(ids, np.int64), sets)])

    return run


def deduplicate(docs: DataFrame, words: int = 5) -> DataFrame:
    """`docs` without the near-duplicates: of each component the row with its smallest doc_id stays, once.

    Linked are texts whose sets of shingles are SIMILAR at least, by exact
    counting. What is counted are the texts that the homes of their sketches
    connect; a group of them with more than CELL_ROWS rows or CELL_BYTES of
    text is counted in cells, all pairs of its parts. Texts without words are
    similar to each other.

    Of rows with the same doc_id and different texts the one with the smaller
    hash of the text counts as smaller, and of rows with the same doc_id and
    text any one stays. A row with a null doc_id stays only if its component
    has no other id.
    """
    h, has, n, key_id = (fresh(docs.columns, c) for c in ("_h", "_has", "_n", "_id"))
    text_hash = F.xxhash64(text_of(F.col("text")))
    prints = docs.select("doc_id", text_hash.alias("h"), sketches(words)(docs["text"]).alias("bits"),
                         F.octet_length(text_of(F.col("text"))).cast("long").alias("bytes"))
    # What a null id is replaced by only has to meet itself again.
    whole = cut(prints).select("h", "bits", "bytes", F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id"), F.col("h")).alias("id"))
    counted = whole.groupBy("h", "none", "id").agg(F.count("*").alias("n"), F.first("bits").alias("bits"), F.first("bytes").alias("bytes"))
    least = cut(counted.groupBy("h").agg(F.min(F.struct("none", "id", F.col("h").alias("h"), "n")).alias("first"),
                                         F.first("bits").alias("bits"), F.first("bytes").alias("bytes")))
    near = components(candidates(least.select(F.col("h").alias("node"), "bits")))
    placed = cut(near.join(least, near["node"] == least["h"]).select(
        "root", "node", "bytes", F.col("first.id").alias(key_id), F.col("first.h").alias(h), F.col("first.none").alias(has)))
    share = F.greatest(F.count("*") / CELL_ROWS, F.sum("bytes") / CELL_BYTES)
    placed = placed.join(placed.groupBy("root").agg((F.ceil(F.when(share > 1, 2 * share).otherwise(1))).alias("k")), "root")
    key = [key_id, h, has]
    keyed = docs.withColumn(h, text_hash).withColumn(has, F.col("doc_id").isNull()).withColumn(key_id, F.coalesce(F.col("doc_id"), F.col(h)))
    texts = keyed.select(*key, text_of(F.col("text")).alias("text")).join(placed, key).withColumn("p", F.pmod(F.xxhash64("node"), F.col("k")))
    cells = texts.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    cells = cells.select("root", (F.least("p", "q") * F.col("k") + F.greatest("p", "q")).alias("part"), "node", "text")
    roots = components(cells.repartition("root", "part").sortWithinPartitions("root", "part", "node").mapInArrow(by_text(words), "u long, v long"))
    joined = least.join(roots, least["h"] == roots["node"], "left").select("first", F.coalesce("root", "h").alias("root"))
    stay = cut(joined.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.id").alias(key_id), F.col("first.h").alias(h), F.col("first.none").alias(has), F.col("first.n").alias(n)))
    once = keyed.join(stay.where(F.col(n) == 1), key, "left_semi")
    repeated = stay.where(F.col(n) > 1)
    if not repeated.isEmpty():
        once = once.union(keyed.join(repeated, key, "left_semi").dropDuplicates(key))
    return once.drop(*key)
