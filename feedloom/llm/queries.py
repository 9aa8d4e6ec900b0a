"""One query per operator of this subpackage, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.llm import ann, bpe, collocations, exactdedup, linededup, merkle, mixing, pii, pivots, secrets, simhash, toxicity, wrapper
from feedloom.llm.common import table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_multiprobe_lsh(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op2_pivot_topk(spark, sf_dir):
    return pivots.search(table(spark, sf_dir, "embeddings"))


@query
def op3_toxic_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_bpe_pair_index(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), bpe.installed())


@query
def op5_wrapper_induction(spark, sf_dir):
    return wrapper.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op6_simhash_anchors(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_pii_sanitise(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


@query
def op8_mix_sources(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.deduplicate(docs, spans="spans")
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "text", F.size("spans").cast("long").alias("n_blocks"), line.alias("spans"))


@query
def op10_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_phrase_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


@query
def op12_exact_dedup(spark, sf_dir):
    return exactdedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


@query
def op13_merkle_manifest(spark, sf_dir):
    return merkle.digest(table(spark, sf_dir, "documents"))


WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES["op2_pivot_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS y FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.y, c.y), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op8_mix_sources"] = f"""
WITH d AS (SELECT doc_id, source, {WORDS} AS size,
             ('0x' || md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, ''))[1:13])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
        source_size::DOUBLE * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w),
r AS (SELECT *, min_by(level, cap / w) FILTER (WHERE cap / w > level) OVER () AS rest FROM l),
t AS (SELECT source, source_size, CASE WHEN cap / w > level THEN least(cap, rest * w) ELSE cap END AS target FROM r),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t),
u AS (SELECT d.source, h, sum(size) AS words, any_value(target - times * source_size) AS budget
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY d.source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM u),
x AS (SELECT source, h, budget > 0 AND (upto < budget OR (upto - words < budget AND (budget - (upto - words)) * 2 >= words)) AS more FROM c)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (times + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""

#: All phrases of one to three words with their counts, by language.
PHRASES = r"""
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang,
          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
e AS (SELECT lang, unnest(flatten(list_transform(range(1, least(len(w), 3) + 1), lambda k:
        list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))))) AS phrase FROM p),
c AS MATERIALIZED (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM e GROUP BY lang, phrase)
"""

ORACLES["op11_phrase_collocations"] = f"""
WITH {PHRASES},
t AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE len(w) = 1 GROUP BY lang),
b AS MATERIALIZED (SELECT * FROM c WHERE len(w) > 1 AND f >= 10),
k AS (SELECT lang, phrase, f AS a, w, unnest(range(1, len(w))) AS k FROM b),
h AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM k),
s AS (SELECT h.lang, h.phrase, a, k, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
      FROM h JOIN c x ON x.lang = h.lang AND x.phrase = head JOIN c y ON y.lang = h.lang AND y.phrase = tail),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, f FROM b WHERE len(w) = 3),
j AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY lang, phrase),
q AS (SELECT m.lang, m.phrase, a, l, r, n, score
      FROM m JOIN t ON t.lang = m.lang LEFT JOIN j ON j.lang = m.lang AND j.phrase = m.phrase
      WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM q QUALIFY rank <= 2000
"""

ORACLES["op12_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

UNSIGNED_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, _: xor(x >> 1, 3988292384::BIGINT * (x & 1))))"""

ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE enc AS (
  SELECT doc_id, source,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    text, xor({UNSIGNED_CRC.format('doc_id::VARCHAR')}, 4294967295::BIGINT) % 5 = 0 AS hit FROM documents),
lv AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS other,
    coalesce(hit, false) AS hit FROM enc),
up AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM lv
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1
  GROUP BY tree, level, n, pos // 16),
sub AS MATERIALIZED (SELECT tree, level AS height, h FROM up WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS pos, h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, n, pos // 16),
nodes AS MATERIALIZED (
  SELECT tree, level, pos, h FROM up WHERE n > 1
  UNION ALL SELECT -1, level, pos, h FROM tops WHERE n > 1),
beside AS MATERIALIZED (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 16 = b.pos // 16 GROUP BY a.tree, a.level, a.pos),
walk AS (
  SELECT doc_id, lv.tree AS own, leaf, CASE WHEN hit THEN other ELSE leaf END AS now, '' AS proof,
    CASE WHEN height = 0 THEN -1 ELSE lv.tree END AS tree, 0 AS level, CASE WHEN height = 0 THEN lv.tree ELSE pos END AS pos, height
  FROM lv JOIN sub ON sub.tree = lv.tree
  UNION ALL
  SELECT doc_id, own, leaf, sha256(l || now || r), proof || l || r,
    CASE WHEN walk.tree >= 0 AND walk.level + 1 = height THEN -1 ELSE walk.tree END,
    CASE WHEN walk.tree >= 0 AND walk.level + 1 = height THEN 0 ELSE walk.level + 1 END,
    CASE WHEN walk.tree >= 0 AND walk.level + 1 = height THEN own ELSE walk.pos // 16 END, height
  FROM walk JOIN beside ON beside.tree = walk.tree AND beside.level = walk.level AND beside.pos = walk.pos)
SELECT doc_id, leaf, sub.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.h AS verified
FROM walk JOIN sub ON sub.tree = own JOIN tops t ON t.n = 1
WHERE walk.tree = -1 AND walk.level = t.level
"""
