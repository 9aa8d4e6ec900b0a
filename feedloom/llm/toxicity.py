"""Toxicity by maximum-scoring segments.

Labelled rows give every word, and every beginning of a word, a log-odds ratio
between toxic and other documents under a Dirichlet prior made from all their
words. A word's score is the ratio of its own or its beginnings' that is
clearest of chance, and otherwise a small cost, so that the expected score of
clean text is negative. Beginnings serve inflected words that no labelled row
has. A text that occurs several times teaches once. One linear pass over a whole document
finds all maximal segments of positive score; no other segment of it does
better than its parts. In clean text segment scores follow an extreme-value
law, whose rate comes from the scores of its words, and a document's score is a
logistic function of its evidence against that law.

The labels are learned from a sample: the `max_labelled` labelled rows that come
first by a hash of their id (documented bound; production value MAX_LABELLED),
and the `vocabulary` clearest words. So model and broadcast have a fixed bound,
and behave alike at every input size. Scoring reads all documents, whole.

Defined cases: a null text is empty, an empty text gets the score of no
evidence; repeated ids are scored one by one; a label that is null, or whose id
is null, teaches nothing; without labels, or with labels of one kind only, all
scores are the share of label 1 held between 0.01 and 0.49; other columns stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import fresh, text_of

MAX_LABELLED = 20_000
MAX_VOCABULARY = 50_000
TOKEN = r"(?U)[\p{L}\p{N}]+"
#: Lengths of the beginnings that are looked at, besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Log-odds from which a piece tells enough; weaker ones are frequent pieces that only lean to one side.
TELLING = 2.0
#: So many different words at least must share a beginning for it to count.
FAMILY = 3
#: What a word costs that is not.
DRIFT = 0.25


@dataclass
class Model:
    """Scores of clear words, the rate of the extreme-value law of clean text, and the logistic weights."""

    words: dict[str, tuple[float, float]]  # score and clearness of a word, or of a beginning (with * behind)
    rate: float
    bias: float
    weight: float


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(TOKEN), F.lit(0))


def segments(scores: np.ndarray) -> list[float]:
    """Scores of all maximal scoring segments, in text order (linear-time scan with a stack).

    Runs of one sign are summed first, which doesn't change any segment's score.
    """
    positive = scores > 0
    if not positive.any():
        return []
    cuts = np.concatenate([[0], np.flatnonzero(positive[1:] != positive[:-1]) + 1])
    sums = np.add.reduceat(scores, cuts)
    stack: list[tuple[float, float, int]] = []  # (sum left of it, sum up to its end, segment that its search goes on from)
    total = 0.0
    for s in sums.tolist():
        if s <= 0:
            total += s
            continue
        left, right = total, total + s
        total = right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][2]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, j))
                break
            left = stack[j][0]
            del stack[j:]
    return [r - l for l, r, _ in stack]


def evidence(found: list[float], n: int, rate: float) -> float:
    """How far the segments of a text of n words exceed what clean text has by chance.

    In clean text about n exp(-rate * s) segments reach s, so the best of them
    follows an extreme-value law with mode ln(n) / rate and scale 1 / rate. Each
    segment counts by the log of how unlikely it is; one that is not
    significant adds next to nothing.
    """
    return sum(math.log1p(math.exp(min(60.0, rate * s - math.log(max(n, 1))))) for s in found)


def decay(scores: np.ndarray, counts: np.ndarray) -> float:
    """The rate at which segment scores of clean text fall off: the root of E exp(rate * s) = 1 over its words.

    Held between 0.5 and 2, which it would pass where clean text has next to none of the clear words.
    """
    if not len(scores) or counts.sum() <= 0:
        return 1.0
    share = counts / counts.sum()
    low, high = 0.5, 2.0
    for _ in range(50):
        rate = (low + high) / 2
        low, high = (rate, high) if (share * np.exp(rate * scores)).sum() < 1 else (low, rate)
    return low


def worth(word: str, words: dict[str, tuple[float, float]]) -> float:
    """Score of one word: that of its clearest piece."""
    best = words.get(word)
    for k in BEGINNINGS:
        if len(word) > k:
            piece = words.get(word[:k] + "*")
            if piece and (best is None or piece[1] > best[1]):
                best = piece
    return best[0] if best else -DRIFT


def scored(texts: pa.ListArray, model: Model) -> tuple[list[list[float]], np.ndarray, list[np.ndarray]]:
    """Segment scores, number of words and word scores of each text, given its words."""
    offsets = texts.offsets.to_numpy().astype(np.int64)
    coded = texts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    each = np.array([worth(w, model.words) for w in coded.dictionary.to_pylist()] or [0.0])
    flat = each[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0)
    at = offsets - offsets[0]
    values = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    return [segments(v) for v in values], np.diff(at), values


def one_of_each(labelled: DataFrame, looks: int = 4) -> DataFrame:
    """The labelled texts without most near copies, so that words do not look clear because one text is there many times.

    Texts with the same smallest hash of a pair of words count as copies, in
    `looks` rounds with a hash of their own: two texts that share a part j of
    their pairs are both there afterwards with probability (1 - j) ^ looks.
    """
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    names = [f"s{i}" for i in range(looks)]
    some = labelled.select("h", F.xxhash64("toxic").alias("k"), pairs.alias("p")).select("h", "k", *[
        F.coalesce(F.array_min(F.transform("p", lambda x: F.xxhash64(x, F.lit(n)))), F.col("h")).alias(n) for n in names])
    for n in names:
        some = some.groupBy(n, "k").agg(F.min(F.struct("h", *[x for x in names if x != n])).alias("m")).select("k", n, "m.*")
    return labelled.join(some.select("h"), "h", "left_semi")


def clear_words(labelled: DataFrame, toxic: int, clean: int, vocabulary: int) -> dict[str, tuple[float, float]]:
    """Log-odds and clearness of the pieces that are clear of chance, at most `vocabulary` of them.

    `labelled` has words and toxic; what is counted is the documents that hold
    a piece. Clearness is the likelihood ratio of the counts against one common
    share, 2 ln L. Chance alone reaches x with a probability near exp(-x / 2), so
    at a bar of 4 ln(number of pieces) hardly one of all pieces passes by chance.
    """
    words = labelled.select("toxic", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(
        F.sum(F.col("toxic").cast("double")).alias("t"), F.sum(1.0 - F.col("toxic")).alias("c"))
    begin = F.array_compact(F.array(F.col("w"), *[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*")))
                                                  for k in BEGINNINGS]))
    pieces = words.select(F.explode(begin).alias("w"), "t", "c").groupBy("w").agg(
        F.least(F.sum("t"), F.lit(float(toxic))).alias("t"), F.least(F.sum("c"), F.lit(float(clean))).alias("c"),
        F.count("*").alias("k"))
    # A beginning stands for a family of words.
    pieces = pieces.where(~F.endswith("w", F.lit("*")) | (F.col("k") >= FAMILY))
    bar = 4 * math.log(max(2, pieces.count()))
    t, c, n = F.col("t"), F.col("c"), F.col("t") + F.col("c")

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    total = toxic + clean
    clear = 2 * (part(t, n * toxic / total) + part(c, n * clean / total)
                 + part(toxic - t, (total - n) * toxic / total) + part(clean - c, (total - n) * clean / total))
    # The prior: half a document, and 1 % of all that hold the piece, to either side.
    a = n * 0.01 + 0.5
    ratio = F.log((t + a) / (toxic - t + a)) - F.log((c + a) / (clean - c + a))
    best = pieces.select("w", ratio.alias("s"), clear.alias("x")).where((F.col("x") >= bar) & (F.col("s") >= TELLING))
    return {r.w: (r.s, r.x) for r in best.orderBy(F.col("x").desc(), "w").limit(vocabulary).collect()}


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and weight of a logistic fit by Newton steps, with a light pull to 0."""
    both = np.stack([np.ones(len(x)), x], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(both @ beta, -30, 30)))
        hessian = (both * (p * (1 - p))[:, None]).T @ both + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(hessian, both.T @ (y - p) - np.array([1e-6, 1e-3]) * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, vocabulary: int = MAX_VOCABULARY) -> Model:
    """A model from a bounded sample of labelled rows, those whose crc32(doc_id as text) mod 5 is not 0.

    `docs` is scanned once, and not shuffled: the sampled labels are broadcast.
    Word counts are summed up by Spark; the fit of four numbers takes one pair
    of numbers per sampled row.
    """
    teach = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    sample = teach.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(order, "doc_id").limit(max_labelled)
    sample = sample.withColumnRenamed("doc_id", "_id")
    rows = docs.join(F.broadcast(sample), docs["doc_id"] == F.col("_id"))
    # One row for each different text; the sample's bound is that of this shuffle, too.
    labelled = rows.select("toxic", docs["text"].alias("t"), F.xxhash64(docs["text"], "toxic").alias("h"))
    labelled = labelled.groupBy("h").agg(F.first("toxic").alias("toxic"), F.first("t").alias("t"))
    labelled = labelled.select("toxic", "h", tokens(F.col("t")).alias("words")).persist()
    try:
        kinds = {r.toxic: r.n for r in one_of_each(labelled).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(kinds) < 2:
            share = min(0.49, max(0.01, float(1 in kinds)))
            return Model({}, 1.0, math.log(share / (1 - share)), 0.0)
        model = Model(clear_words(one_of_each(labelled), kinds[1], kinds[0], vocabulary), 1.0, 0.0, 0.0)

        @F.arrow_udf("struct<n:long,found:array<double>,clear:array<struct<s:double,n:long>>>")
        def look(words: pa.Array) -> pa.Array:
            found, n, values = scored(words, model)
            rows = []
            for f, k, v in zip(found, n, values):
                each, times = np.unique(v, return_counts=True)
                rows.append({"n": int(k), "found": f, "clear": [{"s": s, "n": t} for s, t in zip(each.tolist(), times.tolist())]})
            return pa.array(rows, pa.struct([("n", pa.int64()), ("found", pa.list_(pa.float64())), (
                "clear", pa.list_(pa.struct([("s", pa.float64()), ("n", pa.int64())])))]))

        looked = labelled.select("toxic", look("words").alias("l")).persist()
        scores = looked.where("toxic = 0").select(F.explode("l.clear").alias("c")).groupBy("c.s").agg(F.sum("c.n").alias("n")).collect()
        model.rate = decay(np.array([r.s for r in scores]), np.array([r.n for r in scores], float))

        @F.arrow_udf("double")
        def weigh(n: pa.Array, found: pa.Array) -> pa.Array:
            return pa.array([evidence(f, k, model.rate) for k, f in zip(n.to_pylist(), found.to_pylist())], pa.float64())

        seen = looked.select("toxic", weigh("l.n", "l.found").alias("x")).collect()
        looked.unpersist()
    finally:
        labelled.unpersist()
    x, y = np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float)
    model.bias, model.weight = logistic(np.log1p(x), y)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score`, the estimated chance of label 1; the text alone decides it."""

    @F.arrow_udf("double")
    def run(words: pa.Array) -> pa.Array:
        found, n, _ = scored(words, model)
        x = np.array([model.bias + model.weight * math.log1p(evidence(f, int(k), model.rate)) for f, k in zip(found, n)])
        return pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))), pa.float64())

    return docs.withColumn(fresh(docs.columns, "score"), run(tokens(docs["text"])))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without the documents that score `threshold` or more; columns stay as they are."""
    out = fresh(docs.columns, "score")
    return score(docs, learn(docs, labels)).where(F.col(out) < threshold).drop(out)
