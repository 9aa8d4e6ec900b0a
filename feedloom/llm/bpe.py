"""Byte-level BPE encoding and decoding through an index of pair occurrences.

A text is split into words by the vocabulary's pattern (built-in expressions,
special tokens first). In each Arrow batch the distinct words are encoded
together: an index maps every adjacent pair of symbols that has a rank to all
its positions, the active ranks are applied in ascending order, and each merge
updates the lists of the pairs that it makes to its left and right. All
positions of a rank are merged at once. Decoding looks the bytes of each id up
and joins them. Rows never leave their partition.

Defined cases: a null or empty text has no ids and decodes to the empty text;
a special token in a text becomes its own id; bytes that are not UTF-8 after
decoding become U+FFFD; null ids decode to the empty text; an id outside of
the vocabulary adds nothing, as in the tokenizers library.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import buffers, fresh, text_of

#: The pattern that byte-level vocabularies of this family split words by (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHIFT = 21


def installed(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file.

    Printable Latin-1 characters stand for themselves; the others get the
    code points from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


@dataclass
class Vocabulary:
    """A vocabulary as arrays: initial id of each byte, merges sorted by pair, bytes of each id, special tokens."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merged: np.ndarray
    token_bytes: list[bytes]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        ids = parts["model"]["vocab"]
        letters = byte_letters()
        bytes_of = {c: b for b, c in letters.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
        keys = np.array([(ids[a] << SHIFT) | ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        special = {t["content"]: t["id"] for t in parts.get("added_tokens", [])}
        by_id = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            by_id[i] = token.encode() if token in special else bytes(bytes_of[c] for c in token)
        for token, i in special.items():
            by_id[i] = token.encode()
        return cls(np.array([ids[letters[b]] for b in range(256)], np.int32), keys[order],
                   np.arange(len(merges), dtype=np.int64)[order], made, by_id, special)


def rank_of(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair, -1 where the vocabulary doesn't merge it."""
    keys = (left.astype(np.int64) << SHIFT) | right
    at = np.searchsorted(v.pair_keys, keys)
    at[at == len(v.pair_keys)] = 0
    return np.where(v.pair_keys[at] == keys, v.pair_ranks[at], -1)


def merge_words(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words that lie one after the other in `data`, and where each word's ids start."""
    lo, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    sym = v.byte_ids[data[lo:lo + n]]
    if not n or not len(v.pair_keys):
        return sym, offsets - lo
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    ends, starts = offsets[1:] - lo, offsets[:-1] - lo
    full = ends > starts
    after[ends[full] - 1] = -1
    before[starts[full]] = -1
    alive = np.ones(n, bool)
    lists: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at: np.ndarray) -> None:
        """Adds the pairs that begin at the positions `at` to the index."""
        rank = rank_of(v, sym[at], sym[after[at]])
        good = np.flatnonzero(rank >= 0)
        if not len(good):
            return
        rank, at = rank[good], at[good]
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at]):
            if r in lists:
                lists[r].append(part)
            else:
                lists[r] = [part]
                heappush(active, r)

    note(np.flatnonzero(after >= 0).astype(np.int32))
    lefts, rights = np.empty(len(v.merged), np.int32), np.empty(len(v.merged), np.int32)
    lefts[v.pair_ranks], rights[v.pair_ranks] = v.pair_keys >> SHIFT, v.pair_keys & ((1 << SHIFT) - 1)
    while active:
        rank = heappop(active)
        found = lists.pop(rank)
        at = found[0] if len(found) == 1 else np.concatenate(found)  # a pair is noted once at most at a position
        left, right, new = lefts[rank], rights[rank], v.merged[rank]
        at = at[(sym[at] == left) & alive[at]]
        follower = after[at]
        ok = (follower >= 0) & (sym[follower] == right)
        at, follower = at[ok], follower[ok]
        if left == right and len(at) > 1:  # of overlapping occurrences every second one, from the left
            order = np.argsort(at)
            at, follower = at[order], follower[order]
            begins = np.concatenate([[True], follower[:-1] != at[1:]])
            index = np.arange(len(at))
            ok = (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
            at, follower = at[ok], follower[ok]
        if not len(at):
            continue
        sym[at] = new
        alive[follower] = False
        beyond = after[follower]
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        previous = before[at]
        previous = previous[previous >= 0]
        note(np.concatenate([at[inner], previous[sym[previous] != new]]))
    counts = np.concatenate([[0], np.cumsum(alive)])
    return sym[alive], counts[offsets - lo]


def gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value runs numbered `which`, one after the other, and where each begins."""
    lengths = np.diff(starts)[which]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    place = np.repeat(starts[:-1][which] - begins[:-1], lengths) + np.arange(begins[-1])
    return values[place], begins


def encode_lists(v: Vocabulary, words: pa.ListArray) -> pa.ListArray:
    """Ids of lists of words."""
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(offsets[0], offsets[-1] - offsets[0])
    coded = flat.dictionary_encode()
    distinct = coded.dictionary
    data, ends = buffers(distinct)
    ids, starts = merge_words(v, data, ends)
    for token, i in v.special.items():
        at = pc.index(distinct, token).as_py()
        if at >= 0:
            lengths = np.diff(starts)
            ids = np.concatenate([ids[:starts[at]], np.array([i], np.int32), ids[starts[at + 1]:]])
            lengths[at] = 1
            starts = np.concatenate([[0], np.cumsum(lengths)])
    which, step = coded.indices.to_numpy(), 1 << 18
    lengths = np.diff(starts)[which].astype(np.int32)
    tokens = [gather(ids, starts, which[at:at + step])[0] for at in range(0, len(which), step)]
    begins = np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(begins[offsets - offsets[0]]),
                                    pa.array(np.concatenate([np.zeros(0, np.int32), *tokens])))


def words_of(text: Column, special: list[str], pattern: str = PATTERN) -> Column:
    """The words of a text in order; special tokens are words of their own. White space and letters as in Unicode."""
    pattern = F.lit("(?U)" + pattern)
    if not special:
        return F.regexp_extract_all(text_of(text), pattern, F.lit(0))
    if len(special) > 1:
        raise ValueError("one special token at most")
    token = special[0]
    pieces = F.split(text_of(text), re.sub(r"([^\w])", r"\\\1", token), -1)
    split = F.flatten(F.transform(pieces, lambda p, i: F.concat(
        F.when(i > 0, F.array(F.lit(token))).otherwise(F.array().cast("array<string>")),
        F.regexp_extract_all(p, pattern, F.lit(0)))))
    return F.when(F.contains(text_of(text), F.lit(token)), split).otherwise(
        F.regexp_extract_all(text_of(text), pattern, F.lit(0)))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with the ids of the whole text, by the vocabulary file at `path` (read on the driver only)."""
    v = Vocabulary.load(path)

    @F.arrow_udf("array<int>")
    def run(words: pa.Array) -> pa.Array:
        try:
            return encode_lists(v, words)
        finally:
            pa.default_memory_pool().release_unused()

    return docs.withColumn(fresh(docs.columns, out), run(words_of(F.col(text), sorted(v.special))))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the text of the ids, special tokens included."""
    tokens = Vocabulary.load(path).token_bytes

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        table = pa.array([*tokens, b""], pa.binary())
        lists = lists.fill_null([]) if lists.null_count else lists
        offsets = lists.offsets.to_numpy()
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
        texts = []
        step = 256
        for at in range(0, len(lists), step):
            begins = offsets[at:at + step + 1].astype(np.int64) - offsets[0]
            some = flat[begins[0]:begins[-1]].astype(np.int64)
            some = np.where((some < 0) | (some >= len(tokens)), len(tokens), some)
            data, ends = buffers(table.take(pa.array(some)))
            whole = data[ends[0]:ends[-1]].tobytes()
            spots = (ends - ends[0])[begins - begins[0]]
            texts += [whole[a:b].decode("utf-8", "replace") for a, b in zip(spots[:-1], spots[1:])]
        return pa.array(texts, pa.string())

    return docs.withColumn(fresh(docs.columns, out), run(F.col(ids)))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    done = decode(encode(docs.select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
