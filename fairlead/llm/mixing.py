"""Mixing sources to target weights as a min-cost flow from membership patterns to source quotas.

Documents that belong to the same set of sources are one pattern.  A pattern offers its size once per allowed
repetition, each further repetition at a higher cost, to the sources it belongs to; a source takes up to its
target.  The flow is solved over patterns and sources alone, and then met by whole documents in seeded order.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.llm.stage import stage

#: Seeded slices of a pattern; a document's place is exact within its slice.
SLICES = 4096


def word_count(text: Column) -> Column:
    """Number of runs outside ASCII white space; 0 for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\v\f\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def capped_targets(sizes: dict[str | None, int], cap: int = 3) -> dict[str | None, float]:
    """Shares of the total by weights 1, 2, 3, 1, ... in code-point order (null last), none over ``cap`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        for s in over or open_:
            target[s] = float(cap * sizes[s]) if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def route(patterns: dict[str, tuple[list[str | None], int]], target: dict[str | None, float], cap: int = 3) -> dict[str, list]:
    """Words each pattern sends to each of its sources: the largest flow, at least cost of repetition.

    Repetition k of a pattern costs k squared a word, so all documents are used once before any is used twice.
    Successive shortest paths; the graph has a node for each pattern and source only.
    """
    arcs: list[list[int]] = []  # to, capacity left, cost
    out: dict[int, list[int]] = {}

    def arc(a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out.setdefault(x, []).append(len(arcs))
            arcs.append([y, r, c])
        return len(arcs) - 2

    node = {s: i + 2 for i, s in enumerate(target)}
    for s, t in target.items():
        arc(node[s], 1, round(t), 0)
    flows: dict[str, list] = {}
    for i, (key, (sources, size)) in enumerate(patterns.items()):
        me = len(target) + 2 + i
        for k in range(cap):
            arc(0, me, size, k * k)
        flows[key] = [(s, arc(me, node[s], cap * size, 0)) for s in sources]
    while True:
        best, via, queue, waiting = {0: 0}, {}, deque([0]), {0}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in out.get(a, ()):
                b, room, cost = arcs[e]
                if room > 0 and best[a] + cost < best.get(b, 1 << 60):
                    best[b], via[b] = best[a] + cost, e
                    if b not in waiting:
                        queue.append(b)
                        waiting.add(b)
        if 1 not in best:
            return {key: [(s, arcs[e ^ 1][1]) for s, e in found] for key, found in flows.items()}
        path, b = [], 1
        while b:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        room = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= room
            arcs[e ^ 1][1] += room


def mix_sources(docs: DataFrame, cap: int = 3, seed: int = 17, key: str | None = None) -> DataFrame:
    """``docs(doc_id, size, sources array<string>)`` -> doc_id, size, sources, taken, repeats, routed, and ``key`` if given.

    ``taken`` is ``repeats`` times ``size``; ``routed`` names the source that each repetition serves.  Null or
    repeated members of ``sources`` count once (null is a source of its own); a document of size 0, without sources,
    or in an empty table takes nothing.  Repeated doc_ids are separate documents.  Only one row for each pattern and
    each source reaches the driver; a hot pattern is cut into SLICES seeded slices.
    What whole documents leave of a pattern's flow goes to the one document whose size is nearest to it.
    """
    spark = docs.sparkSession
    more = [key] if key else []
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    base = stage(
        docs.select(
            *more, "doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"),
            F.sort_array(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>")))).alias("sources"),
            place.alias("place"),
        ).select("*", F.to_json("sources").alias("pattern"), F.pmod("place", F.lit(SLICES)).cast("int").alias("slice"),
                 F.monotonically_increasing_id().alias("row")),
        "sizes",
    )
    slices = base.groupBy("pattern", "slice").agg(F.sum("size").alias("size"))
    found = slices.groupBy("pattern").agg(F.sum("size").alias("size")).collect()
    patterns = {r["pattern"]: (json.loads(r["pattern"]), r["size"]) for r in found}
    sizes: dict[str | None, int] = {}
    for sources, size in patterns.values():
        for s in sources:
            sizes[s] = sizes.get(s, 0) + size
    flows = route(patterns, _shared_targets(patterns, sizes, cap), cap)
    plan = []
    for key, (_, size) in patterns.items():
        at, spans = 0, []
        for source, words in flows[key]:
            spans.append((at, at + words, source))
            at += words
        plan.append((key, size, spans))
    quota = spark.createDataFrame(plan, "pattern string, total long, spans array<struct<lo long, hi long, source string>>")
    before = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("pattern", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")).join(
        F.broadcast(quota), "pattern")
    inside = Window.partitionBy("pattern", "slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size")
    placed = base.join(starts, ["pattern", "slice"]).withColumn("at", at)
    serves = F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(cap - 1)),
        lambda k: F.filter("spans", lambda x: (x["lo"] < F.col("at") + k * F.col("total")) & (F.col("at") + k * F.col("total") <= x["hi"])),
    ))
    routed = F.when(F.col("size") > 0, F.transform(serves, lambda x: x["source"])).otherwise(F.array().cast("array<string>"))
    sent = stage(placed.withColumn("routed", routed).select(*more, "row", "pattern", "place", "doc_id", "size", "sources", "spans", "routed"), "routed")
    short = sent.groupBy("pattern").agg(F.first("spans").alias("s"), F.sum(F.size("routed") * F.col("size")).alias("taken")).select(
        "pattern", (F.element_at("s", -1)["hi"] - F.col("taken")).alias("short"))
    near = F.struct(F.abs(F.col("size") - F.col("short")).alias("off"), "place", "row")
    fits = (F.size("routed") < cap) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("short"))
    last = sent.join(F.broadcast(short), "pattern").where(fits).groupBy("pattern").agg(F.min(near).alias("best")).select(
        F.col("best.row").alias("row"), F.lit(True).alias("more"))  # one row for each pattern at most
    routed = F.when(F.col("more"), F.concat("routed", F.array(F.element_at("spans", -1)["source"]))).otherwise(F.col("routed"))
    return (
        sent.join(F.broadcast(last), "row", "left").withColumn("routed", routed)
        .select(*more, "doc_id", "size", "sources", (F.size("routed") * F.col("size")).cast("long").alias("taken"), F.size("routed").alias("repeats"), "routed")
    )


def _shared_targets(patterns: dict, sizes: dict, cap: int) -> dict[str | None, float]:
    """Targets share the size of all documents, each counted once though it may belong to many sources."""
    target = capped_targets(sizes, cap)
    total, shared = sum(sizes.values()), sum(size for _, size in patterns.values())
    return {s: t * (shared / total if total else 1.0) for s, t in target.items()}


def mix_documents(docs: DataFrame, cap: int = 3, seed: int = 17, key: str | None = None) -> DataFrame:
    """``docs(doc_id, text, source, ...)``, one source each -> doc_id, size, source_size, target, taken, repeats.

    Size counts the words of the text (null: 0).  ``key`` names a column that tells rows apart and comes first in the
    result.  Other columns are not read.
    """
    more = [key] if key else []
    sized = stage(docs.select(*more, "doc_id", word_count(F.col("text")).alias("size"), "source"), "words")
    totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = capped_targets(totals, cap)
    known = docs.sparkSession.createDataFrame([(s, n, target[s]) for s, n in totals.items()], "source string, source_size long, target double")
    mixed = mix_sources(sized.select(*more, "doc_id", "size", F.array("source").alias("sources")), cap, seed, key)
    named = mixed.withColumn("source", F.element_at("sources", 1))
    return named.join(F.broadcast(known), named["source"].eqNullSafe(known["source"])).select(
        *more, "doc_id", "size", "source_size", "target", "taken", "repeats")
