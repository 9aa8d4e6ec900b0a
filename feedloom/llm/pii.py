"""Personal data: patterns, and information-theoretic sanitisation of what gives them away.

Four patterns find the protected entities of every text. The corpus then tells
how strongly other words reveal them: a term (a run of letters and digits) has
pointwise mutual information PMI = log(c * N / (df(term) * df(entity))) with an
entity, where c counts the documents that have both, df the documents of the
whole corpus that hold either, N all documents. The entity's information is
IC = log(N / df(entity)). A term whose PMI reaches `threshold` of the IC
discloses the entity, and every place where it stands in a document with that
entity is a span of kind `term`, too. What c counts must be `support` documents
at least, of which `support` and half have different words around the term, so
that copies of one document do not make all of its words telling. Sanitising
generalises an entity to its kind and removes disclosing terms.

Everything is built-in expressions, joins and sums. Entities of fewer than
`support` documents leave first. As c is at most df(entity), a telling term has
df(term) <= N^(1 - threshold) * df(entity)^threshold; of the documents with
entities only such terms meet their entities, and of all other documents only
words that occur among those are counted. Joins by term and row are salted or
by document; texts of documents without entities do not move.

Defined cases: a null text is empty; spans count code points, ends are
exclusive; documents with the same id are told apart; without entities there
are no spans; a very long text is split into words once and counted by sums
(its terms and entities meet within its row's key only); other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.llm.common import cut, fresh, text_of
from feedloom.operators.joins import lookup_join

KINDS = ("email", "ip", "card", "phone", "term")
#: Java forms of the patterns. Possessive, as nothing follows that could need a retry; a match begins where a run does or the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TERM = r"[\p{L}\p{N}]+"
#: Where a term or what is between two terms begins.
EDGE = r"(?<=[\p{L}\p{N}])(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])"
#: Words on either side of a term by which documents differ.
AROUND = 8
#: A list of words is broadcast up to this measured size.
BROADCAST_BYTES = 64 << 20


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches: their places follow from the pieces between them."""
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                      lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    kind = "array<struct<start:int,end:int,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base(text: Column) -> Column:
    """Array of (kind, start, end, value), by kind as listed, then start; `text` is not null."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def kind(n: int, found: Column, hint: Column, good) -> Column:
        kept = F.when(hint, found).otherwise(none)
        kept = F.filter(kept, good) if good is not None else kept
        return F.transform(kept, lambda s: F.struct(F.lit(n).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                    s["value"].alias("value")))

    return F.concat(
        kind(0, matches(text, EMAIL), F.contains(text, F.lit("@")), None),
        kind(1, matches(text, IP), F.rlike(text, F.lit(r"[0-9]\.[0-9]")),
             lambda s: F.rlike(s["value"], F.lit(rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$"))),
        kind(2, matches(text, CARD), F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9]")),
             lambda s: F.length(digits(s["value"])).between(16, 19) & F.call_function("luhn_check", digits(s["value"]))),
        kind(3, matches(text, PHONE), F.contains(text, F.lit("+")),
             lambda s: F.length(digits(s["value"])).between(8, 15)))


def entity_of(s: Column) -> Column:
    """What names the entity of a span: its value, of numbers their digits."""
    return F.lower(F.when(s["kind"] < 2, s["value"]).otherwise(digits(s["value"])))


def terms_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def frequencies(texts: Column, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, dt): documents that hold each of the `wanted` terms, each counted once a document.

    A small list is broadcast, so that other words are not even summed; a larger one joins the sums.
    """
    words = docs.select(F.explode(F.array_distinct(terms_of(texts))).alias("term"))
    size = wanted.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("dt"))
    return words.groupBy("term").agg(F.count("*").alias("dt")).join(wanted, "term", "left_semi")


def telling(docs: DataFrame, whole: Column, marked: DataFrame, n: int, threshold: float, support: int) -> tuple[DataFrame, DataFrame]:
    """(mentions, pairs): (row, kind, entity) of the entities that may be disclosed, and (term, kind, entity) that disclose one.

    `marked` has row, base spans and, where there are any, the text.
    """
    some = marked.where(F.size("spans") > 0)
    mentions = some.select("row", F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), entity_of(s).alias("entity"))))).alias("e")).select("row", "e.*")
    entities = mentions.groupBy("kind", "entity").agg(F.count("*").alias("de")).where((F.col("de") >= support) & (F.col("de") < n))
    entities = cut(entities)
    held = mentions.withColumn("key", F.struct("kind", "entity"))
    held = cut(lookup_join(held, entities.select(F.struct("kind", "entity").alias("key"), "de"), "key", ["row"], how="inner").drop("key"))
    most = entities.agg(F.max("de")).first()[0]
    told = "term string, kind int, entity string"
    if most is None:
        return held, docs.sparkSession.createDataFrame([], told)
    rows = some.join(held.select("row").distinct(), "row", "left_semi").select("row", terms_of(F.col("text")).alias("w"))
    words = rows.select("row", F.explode(F.transform("w", lambda t, i: F.struct(t.alias("term"), F.xxhash64(
        F.slice("w", F.greatest(i - AROUND + 1, F.lit(1)), F.least(i, F.lit(AROUND)) + 1 + AROUND)).alias("context")))).alias("x"))
    words = cut(words.groupBy("row", "x.term").agg(F.min("x.context").alias("context")))
    own = words.groupBy("term").agg(F.count("*").alias("d")).where(F.col("d") >= support)
    bound = n ** (1 - threshold) * most ** threshold + 1
    known = cut(frequencies(whole, docs, cut(own.select("term"))).where(F.col("dt") <= bound))
    near = lookup_join(words, known, "term", ["row"], how="inner")
    both = near.join(held, "row").where(F.col("dt") <= F.pow(F.lit(float(n)), F.lit(1 - threshold)) * F.pow("de", F.lit(threshold)) + 1)
    # A row has a term and an entity once, so rows count documents.
    sums = both.groupBy("term", "kind", "entity", "dt", "de", "context").agg(F.count("*").alias("c")).groupBy(
        "term", "kind", "entity", "dt", "de").agg(F.sum("c").alias("c"), F.count("*").alias("d"))
    enough = (F.col("c") >= support) & (F.col("d") >= support) & (2 * F.col("d") >= F.col("c"))
    information = F.log(F.lit(float(n)) / F.col("de"))
    pmi = F.log(F.col("c") * float(n) / (F.col("dt") * F.col("de").cast("double")))
    return held, cut(sums.where(enough & (pmi >= threshold * information - 1e-12)).select("term", "kind", "entity"))


def find(docs: DataFrame, threshold: float = 0.75, support: int = 3, text: str = "text",
         keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `keep`, or all) with `spans`: array of (kind, start, end), base spans first by kind and start, then terms by start.

    The input is written once with its base spans, so that rows keep their
    identity however often a lost task is run again.
    """
    row, out, own = (fresh(docs.columns, c) for c in ("_row", "spans", "_own"))
    whole = text_of(F.col(f"`{text}`"))
    kept = docs.columns if keep is None else keep
    marked = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(out, base(whole))
    marked = cut(marked.select(row, *[F.col(f"`{c}`") for c in kept], out, F.when(F.size(out) > 0, whole).alias(own)))
    narrow = marked.select(F.col(row).alias("row"), F.col(out).alias("spans"), F.col(own).alias("text"))
    held, pairs = telling(docs, whole, narrow, marked.count(), threshold, support)
    key = F.struct("kind", "entity").alias("key")
    listed = pairs.groupBy(key).agg(F.collect_set("term").alias("terms"))
    # Of each document that mentions one, the terms that disclose an entity of it.
    told = cut(lookup_join(held.select("row", key), listed, "key", ["row"], how="inner").select("row", F.explode("terms").alias("term")).distinct())
    pieces = narrow.join(told.select("row").distinct(), "row", "left_semi").select("row", F.posexplode(F.split("text", EDGE, -1)).alias("at", "piece"))
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    placed = placed.select("row", F.lower("piece").alias("term"), "start", (F.col("start") + F.length("piece")).alias("end"))
    spotted = placed.join(told, ["row", "term"], "left_semi").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("more"))
    more = fresh(marked.columns, "_more")
    joined = marked.join(spotted.select(F.col("row").alias(row), F.col("more").alias(more)), row, "left")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    plain = F.transform(F.col(out), lambda s: F.struct(F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # A term inside of an entity is covered already.
    free = F.filter(F.coalesce(more, F.array().cast("array<struct<start:int,end:int>>")),
                    lambda t: ~F.exists(F.col(out), lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    extra = F.transform(free, lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return joined.withColumn(out, F.concat(plain, extra)).drop(row, own, more)


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with each entity of the text replaced by its kind in brackets and disclosing terms removed."""
    spans = fresh(docs.columns, "spans")
    found = find(docs, text=text, **options)
    whole = text_of(F.col(f"`{text}`"))
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        clear = s["start"] >= acc["at"]
        between = F.substring(whole, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(clear, F.concat(acc["out"], between, mark)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(f"`{text}`"))).drop(spans)


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""
    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = find(docs.select("doc_id", "text"), keep=["doc_id"])
    own = F.filter("spans", lambda s: s["kind"] != "term")
    kind = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kind, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(line(own), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
