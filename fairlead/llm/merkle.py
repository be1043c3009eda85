"""Merkle manifest of a table: hash trees over its rows by RDD supersteps, proofs sent down again and verified at the leaves.

A vertex is known by its level and by the number of the first leaf below it; leaves are numbered in tree order, so
vertices are dealt to partitions by ranges of leaves, evenly.  Going up, children message their parent, and a parent that has them all
hashes them and messages its own parent.  Trees, one for each group of rows, end at their subroots, which are the leaves of
one more tree.  Going down, each vertex sends its children the path above them; the last superstep sends one message to the
eight leaves of a run, and each leaf folds its digest along the path.  No vertex has more than FAN children or messages,
whatever the size of a group.  The first level and the subroots are checkpointed, and what hangs on them is
small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.numbering import numbered
from fairlead.llm.stage import attach, drop, shared_dir, stage

FAN = 8
#: Vertices of a partition of a superstep, about.
PART = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Steps = tuple[tuple[int, str], ...]


class Tree(NamedTuple):
    """The number of a tree's first leaf and how many leaves it has."""

    base: int
    size: int

    def ends(self, level: int) -> bool:
        """Whether ``level`` has one vertex only, or none."""
        return self.size <= FAN**level

    def parent(self, first: int, level: int) -> tuple[int, int]:
        """First leaf of the parent of the vertex at ``first`` on ``level``, and the vertex's place among its children."""
        at = (first - self.base) // FAN**level
        return self.base + at // FAN * FAN ** (level + 1), at % FAN


def row_digest(columns: Iterable[Column]) -> Column:
    """Lower-case hex SHA-256 of the values: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""

    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, steps: Steps) -> str:
    """The root that ``leaf`` leads to; each step has a place in a run and the digests of the run's others, left to right."""
    for place, others in steps:
        leaf = digest([others[: 64 * place], leaf, others[64 * place :]])
    return leaf


def _others(children: str, place: int) -> str:
    return children[: 64 * place] + children[64 * place + 64 :]


def _dealt(total: int, level: int) -> tuple[int, Callable[[int], int]]:
    """How many partitions a level has, and which of them a vertex goes to."""
    parts = max(1, -(-(total // FAN**level) // PART))
    return parts, lambda first: first * parts // total


def _held(rdd: RDD, held: list[RDD], checkpoint: bool = False) -> RDD:
    """Kept on the executors' disks as it is read again, and in the shared folder too where much hangs on it."""
    rdd = rdd.persist(StorageLevel.DISK_ONLY)
    if checkpoint:
        rdd.checkpoint()
    held.append(rdd)
    return rdd


def climb(leaves: RDD, total: int, height: int, held: list[RDD]) -> list[RDD]:
    """``leaves``: (number, (Tree, digest)) -> for each level from 0 to ``height``: (first, (Tree, digest, children's digests, joined)).

    A superstep: vertices message their parents, and these, having all their children, hash.  A subroot stays as it
    is on all levels above its own, so the last level has all subroots and nothing else.
    """
    levels = [leaves.mapValues(lambda v: (*v, ""))]
    for level in range(height):

        def message(item: tuple, level: int = level) -> tuple:
            first, (tree, mine, children) = item
            if tree.ends(level):
                return first, (-1, mine, tree, children)
            parent, place = tree.parent(first, level)
            return parent, (place, mine, tree, "")

        def receive(messages: Iterable) -> tuple:
            found = sorted(messages)
            _, mine, tree, children = found[0]
            if found[0][0] < 0:
                return tree, mine, children
            children = "".join(m[1] for m in found)
            return tree, digest([children]), children

        above = levels[-1].map(message).groupByKey(*_dealt(total, level + 1)).mapValues(receive)
        levels.append(_held(above, held, checkpoint=not level))
    return levels


def descend(levels: list[RDD], tops: RDD, total: int) -> RDD:
    """``tops``: (base, (note, Steps)) of subroots -> (first, (children, note, Steps)) of the vertices of level 1.

    A superstep: a vertex that knows its steps to the root sends each child its own.  Trees of one leaf have no vertex;
    what their leaf gets has no children.  ``note`` is carried along.
    """
    known = tops.mapValues(lambda v: ("steps", *v))
    for k in range(len(levels) - 1, 0, -1):
        both = known.union(levels[k].mapValues(lambda v: ("children", v[0], v[2])))

        def meet(values: Iterable) -> tuple:
            found = {v[0]: v[1:] for v in values}
            return found["children"] + found["steps"]

        met = both.groupByKey(*_dealt(total, k)).mapValues(meet)
        if k == 1:
            return met.mapValues(lambda v: v[1:])

        def to_children(item: tuple, k: int = k) -> Iterator:
            first, (tree, children, note, steps) = item
            if tree.ends(k - 1):
                yield first, ("steps", note, steps)
                return
            for place in range(len(children) // 64):
                yield first + place * FAN ** (k - 1), ("steps", note, ((place, _others(children, place)), *steps))

        known = met.flatMap(to_children)
    return known.mapValues(lambda v: ("", *v[1:]))


def _height(size: int) -> int:
    level = 0
    while not Tree(0, size).ends(level):
        level += 1
    return level


def prove(rows: DataFrame, with_steps: bool = False) -> DataFrame:
    """``rows(doc_id, lang, leaf, tried)`` -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified [, steps].

    Leaves of one lang, in ascending order of doc_id (null first; ties by digest), make a tree, and the subroots in order of
    lang (null first) the last one.  ``tried`` is the digest that is folded along the leaf's proof.  An empty table has no root and no rows.
    """
    spark = rows.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    first = stage(rows, "leaves")
    lang = {"_none": F.col("lang").isNull(), "_lang": F.coalesce("lang", F.lit(""))}
    leaves = stage(numbered(first, ["lang", "doc_id", "leaf"]).withColumns(lang), "numbers")
    trees = stage(leaves.groupBy("lang", *lang).agg(F.min("number").alias("base"), F.count("*").alias("size")), "trees")
    trees = stage(numbered(trees, ["lang"]).select(*lang, "base", "size", F.col("number").alias("tree")), "trees")
    total, n_trees, held = leaves.count(), trees.count(), []
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", steps array<struct<place: int, others: string>>" * with_steps
    if not total:
        return spark.createDataFrame([], schema)
    largest = trees.agg(F.max("size")).first()[0]
    leaves = attach(leaves, trees.drop("tree"), list(lang), "inner").select("number", "base", "size", "leaf", "tried", "doc_id").rdd
    levels = climb(leaves.map(lambda r: (r[0], (Tree(r[1], r[2]), r[3]))), total, _height(largest), held)
    order = trees.select("base", "tree").rdd.map(lambda r: (r[0], ("tree", r[1])))
    subs = levels[-1].mapValues(lambda v: ("subroot", v[1]))
    every, spread = Tree(0, n_trees), _dealt(total, 0)

    def named(values: Iterable) -> tuple:
        found = dict(values)
        return found["tree"], found["subroot"]

    tops = _held(order.union(subs).groupByKey(*spread).mapValues(named), held, checkpoint=True)  # base: tree, subroot
    last = climb(tops.map(lambda x: (x[1][0], (every, x[1][1]))), n_trees, _height(n_trees), held)
    root = last[-1].first()[1][1]
    start = spark.sparkContext.parallelize([(0, (None, ()))], 1)

    def to_trees(item: tuple) -> list:
        at, (children, _, steps) = item
        return [(at + k, ("steps", ((k, _others(children, k)), *steps))) for k in range(len(children) // 64)] or [(at, ("steps", steps))]

    def with_base(values: Iterable) -> tuple:
        found = {v[0]: v[1:] for v in values}
        base, subroot = found["tree"]
        return base, (subroot, found["steps"][0])

    known = descend(last, start, n_trees).flatMap(to_trees).union(tops.map(lambda x: (x[1][0], ("tree", x[0], x[1][1]))))
    starts = _held(known.groupByKey(*_dealt(n_trees, 0)).map(lambda x: with_base(x[1])), held)
    runs = descend(levels, starts, total).mapValues(lambda v: ("run", *v))

    def to_run(r: tuple) -> tuple:
        run, place = Tree(r[1], r[2]).parent(r[0], 0)
        return run, ("leaf", place, r[3], r[4], r[5])

    def verify(item: tuple) -> Iterator:
        met = list(item[1])
        _, children, subroot, above = next(v for v in met if v[0] == "run")
        for _, place, leaf, tried, doc_id in (v for v in met if v[0] == "leaf"):
            steps = ((place, _others(children, place)), *above) if children else above
            folded = fold(tried, steps)
            row = doc_id, leaf, subroot, root, digest(x for _, x in steps), folded, folded == root
            yield (*row, list(steps)) if with_steps else row

    out = runs.union(leaves.map(to_run)).groupByKey(*_dealt(total, 0)).flatMap(verify)
    out = stage(spark.createDataFrame(out, schema, verifySchema=False), "proofs")
    for rdd in held:
        rdd.unpersist()
    drop(first)
    return out


def verify_rows(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` against a manifest with steps -> doc_id, found, verified: whether a row's digest leads to the manifest's root.

    ``found`` is false for rows whose doc_id the manifest does not have; rows that share a doc_id are held against each of its leaves.
    """
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest([F.col(c) for c in FIELDS]).alias("now"))
    met = now.join(manifest.select("doc_id", "root", "steps"), now["doc_id"].eqNullSafe(manifest["doc_id"]), "left").select(now["doc_id"], "now", "root", "steps")

    def step(at: Column, s: Column) -> Column:
        cut = 64 * s["place"]
        run = F.concat(F.substr(s["others"], F.lit(1), cut), at, F.substr(s["others"], cut + 1))
        return F.sha2(run.cast("binary"), 256)

    folded = F.aggregate("steps", F.col("now"), step)
    each = met.select("doc_id", "now", F.col("root").isNotNull().alias("found"), F.coalesce(folded == F.col("root"), F.lit(False)).alias("ok"))
    return each.groupBy("doc_id", "now").agg(F.max("found").alias("found"), F.max("ok").alias("verified")).drop("now")


def lower_case(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UP, _LOW)


def merkle_documents(docs: DataFrame, with_steps: bool = False) -> DataFrame:
    """``docs(doc_id, source, lang, n_chars, text, ...)`` -> ``prove``'s rows, tampering with the text of some.

    Where 3 divides the CRC-32 of the doc_id in decimal, the leaf that is tried has its text in lower case.  Rows without a
    doc_id are not tampered with.  Rows repeated whole are leaves of their own.
    """
    leaf = row_digest([F.col(c) for c in FIELDS])
    tampered = row_digest([*[F.col(c) for c in FIELDS[:-1]], lower_case(F.col("text"))])
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tried = F.when(crc % 3 == 0, tampered)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf.alias("leaf"), tried.alias("tried"))
    return prove(rows.withColumn("tried", F.coalesce("tried", "leaf")), with_steps)
