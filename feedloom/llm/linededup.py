"""Line dedup by pairwise alignment.

A text is cut into lines at line breaks and, so that a passage set into a
longer paragraph is found as well, after the punctuation that ends a clause. The
hash of each run of lines that has `least_words` words is rare: two documents
that share one overlap. Every run meets the smallest doc_id that has it, so a
passage of a third of all documents makes as many pairs as it has occurrences,
never all pairs. Each pair is aligned as patience diff does: of the runs that
they share, those that occur once in both are anchors, the longest sequence of
them that is in order in both is kept, and what lies between is aligned again.
The aligned common blocks are deleted from the later document, the one with the
larger doc_id; alignment is repeated for blocks that are out of order.

So a line goes if and only if it lies in a run of at least `least_words` words
that an earlier document has, too. Defined cases: null and empty texts stay; a
document without a doc_id is neither earlier nor later than another and stays;
rows with the same doc_id are one document and take nothing from each other; a
text of which nothing is left becomes empty; other columns stay, only `n_chars`
follows the text if there is one; no rows give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import buffers, fresh, text_of, word_starts

LEAST_WORDS = 20
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in ",.;:!?"]] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BREAK = np.zeros(256, bool)
BREAK[[10, 13]] = True
#: Base of the hash of a run, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Lines:
    """The lines of some texts, given as UTF-8 bytes and offsets: where each begins, its words, and the runs from each on.

    A line begins with a text, with a word after a line break, and with a word
    after one that ends with a punctuation mark.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        lo, hi = int(offsets[0]), int(offsets[-1])
        data, offsets = data[lo:hi], offsets - lo
        words = word_starts(data, offsets)
        self.text = np.searchsorted(offsets, words, "right") - 1
        n = len(words)
        first = np.ones(n, bool)
        first[1:] = self.text[1:] != self.text[:-1]
        if n:
            solid = ~BLANK[data]
            ends = np.flatnonzero(solid & ~np.append(solid[1:], False))  # last byte of each stretch; a stretch may span texts
            last = ends[np.searchsorted(ends, words)]
            after = np.append(words[1:], hi - lo)
            last = np.minimum(last, after - 1)
            breaks = np.flatnonzero(BREAK[data])
            broken = np.searchsorted(breaks, words)
            begins = first.copy()
            begins[1:] |= MARKS[data[last[:-1]]] | (broken[1:] > broken[:-1])
            starts = np.flatnonzero(begins)
            stop = last[np.append(starts[1:], n) - 1] + 1
        else:
            starts = stop = np.zeros(0, np.int64)
        self.begin = words[starts]
        self.text = self.text[starts]
        self.words = np.diff(np.append(starts, n))
        raw, digest = data.tobytes(), xxhash.xxh64_intdigest
        hashes = np.array([digest(raw[a:b]) for a, b in zip(self.begin.tolist(), stop.tolist())], np.uint64)
        # Runs: from each line to the first by which there are `least` words, within the text.
        upto = np.append(0, np.cumsum(self.words))
        self.stop = np.searchsorted(upto, upto[:-1] + least)
        end_of_text = np.searchsorted(self.text, self.text, "right")
        self.whole = self.stop <= end_of_text
        with np.errstate(over="ignore"):
            k = len(hashes)
            power = powers(BASE, k)
            total = np.append(np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64))
            run = (total[np.minimum(self.stop, k)] - total[:-1]) * powers(INVERSE, k)
            run ^= (self.stop - np.arange(k)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            run = (run ^ (run >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.run = (run ^ (run >> np.uint64(32))).view(np.int64)
        self.line = np.arange(k) - np.searchsorted(self.text, self.text)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.ones(max(1, n), np.uint64)
    known, step = 1, base % (1 << 64)
    while known < n:
        more = min(known, n - known)
        with np.errstate(over="ignore"):
            out[known:known + more] = out[:more] * np.uint64(step)
        step = step * step % (1 << 64)
        known += more
    return out[:n]


def longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of (here, there) that increases in both, from pairs sorted by `here`."""
    tails, last, before = [], [], [-1] * len(pairs)
    for k, (_, there) in enumerate(pairs):
        at = bisect_left(tails, there)
        if at == len(tails):
            tails.append(there)
            last.append(k)
        else:
            tails[at], last[at] = there, k
        before[k] = last[at - 1] if at else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def aligned(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Patience alignment of the common runs (here, there) of two documents: anchors, then what lies between them."""
    kept, todo = [], [sorted(pairs)]
    while todo:
        some = todo.pop()
        here, there = Counter(a for a, _ in some), Counter(b for _, b in some)
        anchors = longest([p for p in some if here[p[0]] == 1 and there[p[1]] == 1])
        if not anchors:
            kept += longest(some)
            continue
        kept += anchors
        rest, k = defaultdict(list), 0
        for p in some:
            while k < len(anchors) and anchors[k][0] < p[0]:
                k += 1
            if k < len(anchors) and anchors[k] == p:
                continue
            if (k == len(anchors) or p[1] < anchors[k][1]) and (k == 0 or p[1] > anchors[k - 1][1]):
                rest[k].append(p)
        todo += rest.values()
    return sorted(kept)


def blocks(found: list[tuple[int, int, int]]) -> set[int]:
    """First lines of the runs that aligned blocks cover, from (line, other document, line there)."""
    by_other = defaultdict(set)
    for here, other, there in found:
        by_other[other].add((here, there))
    covered = set()
    for pairs in by_other.values():
        while pairs:
            kept = aligned(list(pairs))
            done = {a for a, _ in kept}
            covered |= done
            pairs = {p for p in pairs if p[0] not in done}
    return covered


def delete(text: str, found: list[tuple[int, int, int, int]], least: int) -> tuple[str, list[tuple[int, int]]]:
    """The text without its aligned blocks, and their spans; `found` has (line, run's hash, other document, line there)."""
    raw = text.encode("utf-8")
    own = Lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), least)
    mine = [(i, other, there) for i, h, other, there in found if i < len(own.run) and own.whole[i] and own.run[i] == h]
    gone = np.zeros(len(own.run), bool)
    for i in blocks(mine):
        gone[i:own.stop[i]] = True
    begin = np.append(own.begin, len(raw)).tolist()
    begin[0] = 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
    spans, pieces, at, chars = [], [], 0, 0
    for i, j in zip(edges[::2], edges[1::2]):
        kept = raw[at:begin[i]].decode("utf-8")
        start = chars + len(kept)
        chars = start + len(raw[begin[i]:begin[j]].decode("utf-8"))
        spans.append((start, chars))
        pieces.append(kept)
        at = begin[j]
    return "".join([*pieces, raw[at:].decode("utf-8")]), spans


ROW = "run long, doc long, line int, other long, there int"


def rows_of(run, doc, line, other=None, there=None) -> pa.RecordBatch:
    none = [pa.nulls(len(run), pa.int64()), pa.nulls(len(run), pa.int32())]
    more = none if other is None else [pa.array(other, pa.int64()), pa.array(there.astype(np.int32))]
    return pa.record_batch([pa.array(run, pa.int64()), pa.array(doc, pa.int64()), pa.array(line.astype(np.int32)), *more],
                           ["run", "doc", "line", "other", "there"])


def led(run: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by run, doc and line: which row is the first of its run, for each; which rows belong to a later document."""
    begins = np.ones(len(run), bool)
    begins[1:] = run[1:] != run[:-1]
    leader = np.maximum.accumulate(np.where(begins, np.arange(len(run)), 0))
    return leader, doc > doc[leader]


def shared(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, found): for each document its runs that an earlier document has, with that document and its line.

    Within a batch the smallest document of a run leads it. Others of the batch
    have met an earlier document there already; only the leaders go on to meet
    across batches, with every line where they have the run, as all of these go
    if another batch has an earlier document. So a run of a third of all
    documents sends the rows of one document a batch.
    """
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for at in range(0, batch.num_rows, 512):
                own = Lines(*buffers(batch.column(1).slice(at, 512)), least)
                good = own.whole
                parts.append((own.run[good], ids[at:at + 512][own.text[good]], own.line[good]))
            run, doc, line = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((line, doc, run))
            run, doc, line = run[order], doc[order], line[order]
            leader, later = led(run, doc, line)
            yield rows_of(run[~later], doc[~later], line[~later])
            if later.any():
                of = leader[later]
                yield rows_of(run[later], doc[later], line[later], doc[of], line[of])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaders, sorted: all rows but those of the first document of a run have that as their earlier one. Other rows pass."""
        last = None
        for batch in batches:
            other = batch.column(3)
            done = pa.Table.from_batches([batch]).filter(other.is_valid())
            yield from done.to_batches()
            some = pa.Table.from_batches([batch]).filter(other.is_null())
            run, doc, line = (some.column(i).to_numpy() for i in range(3))
            if not len(run):
                continue
            if last is not None and last[0] == run[0]:
                run, doc, line = (np.append(a, b) for a, b in zip(last, (run, doc, line)))
            leader, later = led(run, doc, line)
            if later.any():
                of = leader[later]
                yield rows_of(run[later], doc[later], line[later], doc[of], line[of])
            last = run[leader[-1]], doc[leader[-1]], line[leader[-1]]

    some = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), text_of(F.col("text")).alias("text"))
    place = F.when(F.col("other").isNull(), F.col("run")).otherwise(F.xxhash64("doc", "line"))
    hits = some.mapInArrow(cut_up, ROW).repartition(place).sortWithinPartitions("run", "doc", "line").mapInArrow(meet, ROW)
    # A document has as many of these as it has lines at most, times the batches that one row of it came from.
    return hits.where("other IS NOT NULL").groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_list(F.struct("line", "run", "other", "there")).alias("found"))


def deduplicate(docs: DataFrame, least: int = LEAST_WORDS, spans: str | None = None) -> DataFrame:
    """`docs` without the blocks that earlier documents have; `spans` names a column for what was deleted, if wanted."""
    key, found, done, has = (fresh(docs.columns, c) for c in ("_key", "_found", "_done", "_has"))
    hits = shared(docs, least).select(F.col("doc_id").alias(key), F.col("found").alias(found), F.lit(True).alias(has))
    # Rows without an id are spread by their text, and meet nothing.
    place = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    joined = docs.withColumn(key, place).withColumn(has, F.col("doc_id").isNotNull()).join(hits, [key, has], "left").drop(key, has)

    @F.arrow_udf("struct<text:string,spans:array<struct<start:int,end:int>>>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out, none = [], {"text": None, "spans": []}
        offsets, flat = lists.offsets.to_numpy(), lists.values
        columns = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
        for i, valid in enumerate(lists.is_valid().to_pylist()):
            if not valid:
                out.append(none)
                continue
            a, b = offsets[i], offsets[i + 1]
            left, gone = delete(texts[i].as_py(), list(zip(*(c[a:b].tolist() for c in columns))), least)
            out.append({"text": left, "spans": [{"start": x, "end": y} for x, y in gone]})
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.array(out, pa.struct([("text", pa.string()), ("spans", pa.list_(span))]))

    # Texts that nothing is deleted from don't go to Python.
    joined = joined.withColumn(done, run(F.when(F.col(found).isNotNull(), F.col("text")), F.col(found)))
    changed = F.col(f"{done}.text").isNotNull()
    columns = {"text": F.when(changed, F.col(f"{done}.text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(F.col(f"{done}.text")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    if spans:
        columns[spans] = F.col(f"{done}.spans")
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns],
                         *([columns[spans].alias(spans)] if spans else []))
