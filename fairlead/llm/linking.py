"""Components of a similarity graph from shared bucket keys, without listing the pairs inside a group.

Every two ids that share a key are a candidate pair.  Pairs matter only while their ends lie in different
components, so star rounds first join each id to one id of its buckets, and what then still spans components
is listed exactly.  The components equal those of testing every candidate pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.components import connected_components
from fairlead.llm.stage import drop, stage


#: Ids of a key that one task compares with the others of that key.
BLOCK = 4096


def shared_members(buckets: DataFrame) -> DataFrame:
    """Rows of ``buckets(key, id)`` whose key has two different ids; keys of one id go before anything is joined."""
    keys = buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return buckets.join(keys, "key").select("key", "id")


def spanning(rows: DataFrame) -> DataFrame:
    """Rows (key, root, ...) whose key has more than one root."""
    keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return rows.join(keys, "key")


def link_components(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    narrow: Callable[[DataFrame], DataFrame] | None = None,
    close: Column | None = None,
    star_rounds: int = 2,
    large: int = 12,
    links: DataFrame | None = None,
    roots: DataFrame | None = None,
    sign: Callable[[DataFrame], DataFrame] | None = None,
    may: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """``members(key, id, ...)`` (staged, distinct) -> ``(id, root)`` of every id with a link.

    ``verify(pairs(a, b))`` returns the rows of its input that are links.  A star round pairs each id with the id
    of its buckets that most others meet; keys within one component are then dropped.  Of the rest every pair from
    different components is tested.  In keys of more than ``large`` ids those pairs come from
    ``narrow(ids(id, root))``, which must return every link between different roots among its ids, and may
    return more.  ``close`` is a cheap necessary condition on columns of the two sides, named one.x and two.x.  ``links``
    are those known already, and ``roots`` their components.  ``sign(rows)`` adds columns, on which ``close`` may rest, to the rows that
    still span components.  ``may(a, b)`` is a necessary condition on columns a.format(name) and b.format(name) of ``members``; where it
    is given, stars take pairs only that meet it.
    """
    extra = [c for c in members.columns if c not in ("key", "id")]
    rows = members.select("key", "id").withColumn("root", F.col("id"))
    if links is not None:
        roots = stage(connected_components(links), "roots") if roots is None else roots
        rows = stage(spanning(_with_roots(members, roots)), "members")
        if not rows.head(1):
            return roots
    for _ in range(star_rounds):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
        met = rows.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("met"))
        given = rows if may is None else rows.join(members, ["key", "id"])
        own = [] if may is None else extra
        ranked = stage(given.join(met, "id").select("key", "id", "root", *own, F.struct("met", "id", "root", *own).alias("me")), "ranked")
        top = ranked.groupBy("key").agg(F.max("me").alias("top"))
        met = ranked.join(top, "key").where("root <> top.root")
        met = met if may is None else met.where(may("{}", "top.{}"))
        pairs = (
            met.groupBy("id", F.col("top.id").alias("rep"))
            .agg(F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("n", "rep")).alias("best"))
            .select(F.least("id", "best.rep").alias("a"), F.greatest("id", "best.rep").alias("b")).distinct()
        )
        found = stage(verify(pairs), "links")
        drop(ranked)
        links = found if links is None else links.unionByName(found)
        if not found.head(1):
            break
        roots = stage(connected_components(links), "roots")
        rows = stage(spanning(_with_roots(members, roots)), "members")
        if not rows.head(1):
            return roots
    rows = rows.join(members, ["key", "id"]) if extra else rows
    if narrow is not None:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
        sized = stage(rows.join(sizes, "key"), "sized")
        pairs = _across(sized.where(F.col("n") <= large), extra, close)
        many = stage(sized.where(F.col("n") > large).select("id", "root").distinct(), "many")
        if many.head(1):
            pairs = pairs.unionByName(narrow(many))
    elif sign is not None:
        rows = sign(stage(rows, "spanning"))
        pairs = _across(_dealt(rows), [c for c in rows.columns if c not in ("key", "id", "root")], close)
    else:
        pairs = _across(rows, extra, close)
    found = stage(verify(pairs.distinct()), "links")
    if roots is not None and not found.head(1):
        return roots
    return connected_components(links.unionByName(found))


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    joined = members.select("key", "id").join(roots, "id", "left")
    return joined.select("key", "id", F.coalesce("root", "id").alias("root"))


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of ``rows(key, id, ...)`` whose equal keys meet: a key of more than BLOCK ids in blocks of ids, each against all."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    sized = stage(rows.join(sizes, "key"), "dealt")
    given = lambda block: sized.withColumn("key", F.when(F.col("_blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", block))).drop("_blocks")
    every = sized.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    every = every.withColumn("key", F.when(F.col("_blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", "_block"))).drop("_blocks", "_block")
    return given(F.pmod(F.xxhash64("id"), F.col("_blocks"))), every


def _across(rows: DataFrame | tuple[DataFrame, DataFrame], extra: list[str], close: Column | None) -> DataFrame:
    sides = rows if isinstance(rows, tuple) else (rows, rows)
    one, two = (side.select("key", "id", "root", *extra).alias(x) for side, x in zip(sides, ("one", "two"), strict=True))
    on = (F.col("one.key") == F.col("two.key")) & (F.col("one.id") < F.col("two.id")) & (F.col("one.root") != F.col("two.root"))
    return one.join(two, on if close is None else on & close).select(F.col("one.id").alias("a"), F.col("two.id").alias("b"))
