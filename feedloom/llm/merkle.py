"""A Merkle manifest of a dataset: one digest per row, tree roots per source and over all, and a proof for every row.

A leaf is the SHA-256 of a row's columns, each `-` if null, else its length in
bytes, a colon and its value. Leaves of a source are in order of doc_id; as long
as several nodes remain, each 16 neighbours become one. The roots of the sources
are the leaves of the last tree.

1. `leaves` reads the rows once, as an expression; what follows works on digests.
2. `placed` gives every leaf its position within its source by a range sort and
   counts per partition, so that a source with a third of all rows is no task.
3. `grown` builds trees level by level: a level groups 16 nodes at most per row.
4. `paths` finds the way from every node to the root by pointer jumping: a node
   holds the sibling segments up to an ancestor; joining the nodes with
   themselves doubles the distance and appends the ancestor's segments, until
   all have reached the root. Leaves, sixteen times as many as all other nodes
   together, take their jump last, as the run that they form: only whole runs
   move, and a leaf's proof comes into being in the row that uses it.

Defined cases: a null doc_id comes first, equal doc_ids are ordered by their
leaves; a null source is a source of its own, ordered first; a tree of one leaf
is that leaf; an empty table has no rows; a text of any length is hashed whole;
further columns are not part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import cut
from feedloom.operators.joins import lookup_join

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the sources' roots.
TOP = -1


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, other): `other` is the leaf that a tampered row has, null if the row is as it was."""
    columns = [docs[c] for c in COLUMNS]
    tampered = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
    return docs.select("doc_id", docs["source"].cast("string").alias("source"), leaf(columns).alias("leaf"),
                       F.when(tampered, leaf([*columns[:-1], lowered(docs["text"].cast("string"))])).alias("other"))


def placed(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """`rows`, written to the shared folder, with `tree` (the number of `by` in order, null first) and `pos` within it.

    After a range sort each partition numbers its own rows; a tree that goes on
    from earlier partitions, and the number of the first tree, come from one
    row per partition.
    """
    schema = rows.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, pos, last = -1, -1, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index(by))
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            change = np.concatenate([[tree < 0 or keys[0].as_py() != last], codes[1:] != codes[:-1]])
            trees = tree + np.cumsum(change)
            begins = np.flatnonzero(change)
            starts = np.concatenate([[-pos - 1], begins])[np.cumsum(change)]
            places = np.arange(b.num_rows) - starts
            tree, pos, last = int(trees[-1]), int(places[-1]), keys[b.num_rows - 1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(trees.astype(np.int64)), pa.array(places.astype(np.int64))],
                                             [*b.schema.names, "tree", "pos"])

    order = [F.col(by).asc_nulls_first(), *order]
    done = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)
               .mapInArrow(number, schema + ", tree long, pos long").withColumn("part", F.spark_partition_id()))
    ends = done.groupBy("part").agg(F.max(F.struct("tree", "pos", by)).alias("z"), F.min(F.struct("tree", "pos", by))[by].alias("a"))
    base, tree, last = {}, -1, None
    for row in ends.orderBy("part").collect():  # one row per partition
        same = tree >= 0 and row.a == last[0]
        base[row.part] = (tree if same else tree + 1, last[1] if same else 0)
        before = last[1] if same and row.z.tree == 0 else 0
        tree, last = base[row.part][0] + row.z.tree, (row.z[by], before + row.z.pos + 1)
    bases = rows.sparkSession.createDataFrame([(p, t, n) for p, (t, n) in base.items()], "part int, _tree long, _pos long")
    return done.join(F.broadcast(bases), "part").withColumn("pos", F.when(F.col("tree") == 0, F.col("pos") + F.col("_pos")).otherwise(F.col("pos"))) \
        .withColumn("tree", F.col("tree") + F.col("_tree")).drop("part", "_tree", "_pos")


def node(tree: Column, level: Column, pos: Column) -> Column:
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), pos.alias("pos"))


def grown(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of trees over (tree, pos, digest).

    A level holds (tree, level, pos, members, digest, top): 16 nodes at most of
    the level below as their parent, and whether that is its tree's root. Roots
    are (tree, digest, bare); a bare one is the only leaf of its tree, with the
    columns `more`. A tree goes on while it has a second node, so nothing is
    counted or joined by tree but its first node.
    """
    def split(level: DataFrame) -> DataFrame:
        second = level.where("pos = 1").select("tree", F.lit(True).alias("_goes"))
        first = level.where("pos = 0").join(second, "tree", "left")
        return cut(level.where("pos > 0").withColumn("top", F.lit(False)).unionByName(
            first.withColumn("top", F.col("_goes").isNull()).drop("_goes")))

    levels, now = [], split(nodes)
    roots = now.where("top").select("tree", "digest", F.lit(True).alias("bare"), *more)
    none = [F.lit(None).cast(dict(nodes.dtypes)[c]).alias(c) for c in more]
    while not (rest := now.where(~F.col("top"))).isEmpty():
        members = F.array_sort(F.collect_list(F.struct("pos", "digest", *(more if not levels else ()))))
        up = rest.groupBy("tree", F.floor(F.col("pos") / FANOUT).cast("long").alias("pos")).agg(members.alias("members"))
        digest = F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256)
        now = split(up.select("tree", F.lit(len(levels) + 1).alias("level"), "pos", "members", digest.alias("digest")))
        levels.append(now)
        roots = roots.unionByName(now.where("top").select("tree", "digest", F.lit(False).alias("bare"), *none))
    return levels, roots


def siblings(members: Column, at: Column) -> Column:
    """What stands left and right of member `at` (from 0) of its run."""
    digests = F.transform(members, lambda m: m["digest"])
    return F.struct(F.array_join(F.slice(digests, F.lit(1), at), "").alias("left"),
                    F.array_join(F.slice(digests, at + 2, F.size(digests)), "").alias("right"))


def paths(levels: list[DataFrame], top: list[DataFrame]) -> DataFrame:
    """(id, path) of every node but leaves and the root: the siblings on its way to the root, lowest first.

    A source's root and the leaf of the last tree are one node, named as the latter.
    """
    parts = []
    for k, level in enumerate(levels[1:], 1):
        child = node(F.col("tree"), F.lit(k), F.col("m.pos"))
        parent = F.when(F.col("top"), node(F.lit(TOP).cast("long"), F.lit(0), F.col("tree"))).otherwise(
            node(F.col("tree"), F.lit(k + 1), F.col("pos")))
        parts.append((level, child, parent))
    for k, level in enumerate(top):
        parts.append((level, node(F.lit(TOP).cast("long"), F.lit(k), F.col("m.pos")),
                      node(F.lit(TOP).cast("long"), F.lit(k + 1), F.col("pos"))))
    state = None
    for level, child, parent in parts:
        one = level.select("tree", "pos", "top", "members", F.posexplode("members").alias("at", "m")).select(
            child.alias("id"), parent.alias("up"), F.array(siblings(F.col("members"), F.col("at"))).alias("path"))
        state = one if state is None else state.unionByName(one)
    if state is None:
        return None
    state, reach = cut(state), 1
    while reach < len(parts):  # no node has more ancestors than there are levels
        far = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("more"))
        state = cut(lookup_join(state, far, "up", ["id"], 64).select(
            "id", F.coalesce("next", "up").alias("up"),
            F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path")))
        reach *= 2
    return state.select("id", "path")


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, other, subroot, root, path) of every row; `path` has left and right siblings, lowest first."""
    rows = placed(leaves(docs), "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    keep = ("doc_id", "source", "other")
    levels, roots = grown(rows.withColumnRenamed("leaf", "digest"), *keep)
    roots = cut(roots)
    top, last = grown(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest"))
    root = last.select("digest").first()
    root = F.lit(root[0] if root else None).cast("string")
    way = paths(levels, top)
    none = F.array().cast("array<struct<left:string,right:string>>")
    leaf_of = node(F.lit(TOP).cast("long"), F.lit(0), F.col("tree"))
    bare = roots.where("bare").select(leaf_of.alias("id"), *keep, F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), none.alias("own"))
    if levels:
        run = F.when(F.col("top"), leaf_of).otherwise(node(F.col("tree"), F.lit(1), F.col("pos")))
        filled = lookup_join(levels[0].select("tree", "pos", "members", run.alias("id")),
                             roots.select("tree", F.col("digest").alias("subroot")), "tree", ["pos"], 64)
        if way is not None:
            filled = filled.join(way, "id", "left")
        else:
            filled = filled.withColumn("path", none)
        filled = filled.select("subroot", "path", "members", F.posexplode("members").alias("at", "m"))
        filled = filled.select("m.doc_id", "m.source", F.col("m.digest").alias("leaf"), "m.other", "subroot",
                               F.concat(F.array(siblings(F.col("members"), F.col("at"))), F.coalesce("path", none)).alias("path"))
    bare = bare.join(way, "id", "left") if way is not None else bare.withColumn("path", none)
    bare = bare.select("doc_id", "source", "leaf", "other", "subroot", F.coalesce("path", none).alias("path"))
    return (bare.unionByName(filled) if levels else bare).withColumn("root", root)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda now, p: F.sha2(F.concat(p["left"], now, p["right"]), 256))


def digest(docs: DataFrame) -> DataFrame:
    """Leaf, roots, the digest of the proof and the root that the row, tampered or not, folds to."""
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    done = proofs(docs).withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return done.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
