"""Counting quotient filters, phrases, exact copies and the manifest, against plain readings."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import oracle
from feedloom.llm import collocations, exactdedup, merkle
from feedloom.llm.quotient import Shape, mask
from feedloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_exact_dedup", "op13_merkle_manifest"])
def test_as_sql(spark, sf_dir, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLES[name]) is None


# ---- Counting quotient filters


@pytest.mark.parametrize("bits", [2, 3, 10, 51, 63, 64, 65, 81, 126])
@pytest.mark.parametrize("size", [0, 1, 2, 3000])
def test_filters_lose_nothing(bits, size):
    rng = np.random.default_rng(bits)
    shape = Shape.of(bits, size, 300)
    hi, lo = (rng.integers(0, 1 << min(b, most), size).astype(np.uint64) for b, most in ((shape.high, 12), (shape.low, 3)))
    if size > 2:
        hi[:1500], lo[:1500] = hi[0], lo[0]  # a counter beyond one byte
        hi[-1], lo[-1] = mask(shape.high), mask(shape.low)
    want = Counter(zip(hi.tolist(), lo.tolist()))
    ph, pl = shape.permute(hi, lo)
    assert len(set(zip(ph.tolist(), pl.tolist()))) == len(want)
    held = {}
    for part in np.array_split(np.arange(size), 3):
        for segment, data in shape.filters(ph[part], pl[part]):
            held.setdefault(segment, []).append(data)
    got = Counter()
    for segment, parts in held.items():
        h, l, n = shape.merge(segment, parts)
        assert (np.diff(h.astype(object) << shape.low | l.astype(object)) > 0).all()
        for key in zip(*(x.tolist() for x in shape.invert(h, l)), n.tolist()):
            assert key[:2] not in got
            got[key[:2]] = key[2]
    assert got == want


# ---- Phrases


def mined(rows, first=2000, least=10, longest=3):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        kept = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            longer = [f for q, f in c.items() if f >= least and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * f >= 50 * a for f in longer):
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def test_phrases(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["Ab", "ab", "é", "É", "x-y", "(z)", "日本", "a\x0bb", "q", "\x85", "new", "york", "city"]
    rows = [(None, "en"), ("", "en"), (" \t. ,\n", None), ("a", "zz"), ("b b " * 4000, "")]
    rows += [(" ".join(rng.choice(words, int(rng.integers(1, 90)))).replace("q ", "q. "), ["en", "EN", None, "de"][int(rng.integers(0, 4))]) for _ in range(300)]
    rows += [("New  York\tCITY hall", "en")] * 30
    frame = table_of(spark, [(i, t, lang, None, None) for i, (t, lang) in enumerate(rows)]).withColumnRenamed("n_chars", "n").repartition(5)
    plainly = mined(rows)
    assert sorted(tuple(r) for r in collocations.mine(frame).collect()) == plainly
    for name, value in (("BLOCK_WORDS", 300), ("SLICE_BYTES", 50), ("WINDOW", 7), ("SEGMENT_KEYS", 40), ("FILTER_KEYS", 64)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(tuple(r) for r in collocations.mine(frame).collect()) == plainly
    assert sorted(tuple(r) for r in collocations.mine(frame, first=3).collect()) == mined(rows, first=3)
    assert sorted(tuple(r) for r in collocations.mine(frame, least=4, longest=5).collect()) == mined(rows, least=4, longest=5)
    assert collocations.mine(frame.limit(0)).count() == 0
    assert collocations.mine(frame.where("text = ''")).count() == 0


def test_wide_keys_and_large_counts(spark):
    shape = Shape.of(42 * 3, 100, 10)
    ids = [np.array([1, (1 << 42) - 1, 5], np.uint64), np.array([7, (1 << 42) - 1, 0], np.uint64), np.array([9, 3, 0], np.uint64)]
    back = collocations.unpack(*collocations.pack(ids, 42, shape), 3, 42, shape)
    assert [x.tolist() for x in back] == [x.tolist() for x in ids]
    a, l, r = 3_037_000_511, 9_000_000_000_123, 3_037_000_511
    frame = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert frame.select(collocations.ratio(frame["a"], frame["l"], frame["r"])).first()[0] == 1_000_000 * a * a // (l * r)


# ---- Exact copies


def test_exact_copies(spark):
    same = ["a b", "a\tb", "a \n b", "a  b"]
    rows = [(k, t) for k, t in enumerate([*same, "A b", " a b", "", None, "  ", " ", "\x85", "x" * 300_000, "x" * 300_000 + " ", "x" * 300_000])]
    rows += [(50, "twice"), (50, "twice"), (50, "twice"), (51, "twice"), (None, "no id"), (None, "no id"), (None, "twice"), (None, "alone"), (-3, "last")]
    rows += [(1000 + k, "hot") for k in range(400)] + [(2000, "last")]
    frame = spark.createDataFrame([(i, t, "n", 7) for i, t in rows], "doc_id long, text string, Keep_Id string, row int").repartition(7)
    plain = {}
    for i, t in rows:
        plain.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for t, ids in plain.items():
        ids.sort(key=lambda i: (i is None, i))
        want += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    found = exactdedup.groups(frame).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want))
    kept = exactdedup.deduplicate(frame).collect()
    assert list(kept[0].asDict()) == ["doc_id", "text", "Keep_Id", "row"]
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(w[0]) for w in want if w[3])
    assert exactdedup.groups(frame.limit(0)).count() == 0 and exactdedup.deduplicate(frame.limit(0)).count() == 0


def test_equal_fingerprints_are_settled_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exactdedup, "fingerprint", lambda t: F.length(t).cast("long"))
    frame = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "e"), (5, "fg")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.groups(frame).collect()) == [
        (1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True), (5, 5, 1, True)]


# ---- The manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    """Root, and for each leaf the siblings (left, right) on its way."""
    ways, where, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(where):
            run = level[at // 16 * 16:at // 16 * 16 + 16]
            ways[i].append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
            where[i] = at // 16
        level = [sha(*level[a:a + 16]) for a in range(0, len(level), 16)]
    return (level[0] if level else None), ways


def manifest(rows):
    def encoded(*values):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    by = {}
    for i, text, lang, source, n in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text) if text is not None else None
        leaf = encoded(i, source, lang, n, text)
        by.setdefault(source, []).append(((i is not None, i), leaf, encoded(i, source, lang, n, low) if tampered else leaf))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[1] for x in sorted(by[s])]) for s in sources}
    root, up = tree_of([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, up):
        for (key, leaf, now), way in zip(sorted(by[s]), trees[s][1]):
            for left, right in way + above:
                now = sha(left, now, right)
            out.append((key[1], leaf, trees[s][0], root, sha(*[l + r for l, r in way + above]), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [16, 256, 257, 15, 1] + [1] * 20, [700]])
def test_manifest(spark, sizes):
    rows, k = [], 0
    for s, size in enumerate(sizes):
        source = None if s == 1 else ["", "b", "é", "Z", "\U0001F642"][s] if s < 5 else f"s{s}"
        for _ in range(size):
            rows.append((k * 7 % 1009 - 30, [f"Text {k}", None, "", "ÄB é" * 40][k % 4], "en" if k % 3 else None, source, k if k % 5 else None))
            k += 1
    if len(sizes) > 2:
        rows += [(None, "A", "x", "b", 1), (3, "same", None, "b", 1), (3, "same", None, "b", 1), (3, "other", None, "b", 1), (None, "A", "x", "b", 1)]
    frame = table_of(spark, rows).withColumnRenamed("lang", "lang").selectExpr("*", "1 AS tree", "2 AS Pos", "3 AS leaf").repartition(6)
    got = sorted((tuple(r) for r in merkle.digest(frame).collect()), key=repr)
    assert got == manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.digest(table_of(spark, [])).count() == 0
