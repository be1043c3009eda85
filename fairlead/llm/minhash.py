"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A signature has ``CHUNKS`` x ``WIDTH`` characters of 16 bits.  Two signatures with at most 2 * CHUNKS - 1
differing characters have, by pigeonhole, a chunk with at most one error; each chunk is listed once for every
place of that error (the character left out), so they share a key.  At Jaccard 0.75 a pair misses every key
with probability (1 - .75**4 - 4 * .25 * .75**3) ** 10 = 1.5e-6.  Every candidate is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.llm.linking import link_components, shared_members
from fairlead.llm.numbering import with_keys
from fairlead.llm.stage import drop, once, semi, stage
from fairlead.llm.words import minhashes, shingles

CHUNKS, WIDTH = 10, 4
#: Bits of a set's bitmap, a power of two.
BITMAP = 2048


def chunk_keys(signature: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Keys of a signature: for each chunk and each left-out character, the others, numbered by chunk and place."""
    rows = signature.reshape(-1, width)
    keys = []
    for skip in range(width):
        key = (np.arange(len(rows), dtype=np.uint64) * np.uint64(width) + np.uint64(skip)) << np.uint64(16 * (width - 1))
        for n, j in enumerate(j for j in range(width) if j != skip):
            key |= rows[:, j] << np.uint64(16 * n)
        keys.append(key)
    return np.concatenate(keys).astype(np.int64)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n, digest, keys = [], [], []
        for text in pdf["text"]:
            h = shingles((text or "").encode().lower())
            n.append(len(h))
            digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
            keys.append(chunk_keys(minhashes(h, CHUNKS * WIDTH)) if len(h) else np.empty(0, np.int64))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "digest": digest, "keys": keys})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["doc_id"], "hashes": [shingles((t or "").encode().lower()).view(np.int64) for t in pdf["text"]]})


def _bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for h in pdf["hashes"]:
            bits = np.zeros(BITMAP, np.uint8)
            bits[np.asarray(h, np.int64).view(np.uint64) >> np.uint64(64 - BITMAP.bit_length() + 1)] = 1
            out.append(np.packbits(bits).view(np.int64))
        yield pd.DataFrame({"id": pdf["id"], "bits": out})


def jaccard_links(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs (a, b) whose sets in ``sets(id, hashes)`` have 100 * intersection >= percent * union."""
    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    na, nb = F.size("ha"), F.size("hb")
    return (
        pairs.join(one, "a").join(two, "b")
        .where((100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * both >= percent * (na + nb - both)))
        .select("a", "b")
    )


def prefix_pairs(ids: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs (a, b) of ``ids(id, root)`` with different roots that may be links; none that is a link is missing.

    Each set is ordered by how many of these sets hold an element, rarest first.  Two sets with the wanted overlap
    share an element early in both orders, so copies that differ by more than that never meet, however many
    there are: what they changed is theirs alone and fills the start of their order.  For those that differ by
    just about that much, bitmaps of the sets bound the overlap from above: a bit that one set has and the
    other lacks is an element that they do not share.
    """
    p = percent
    marked = sets.join(ids.select("id"), "id").mapInPandas(_bitmaps, "id long, bits array<long>")
    cells = stage(
        sets.join(ids, "id").select("id", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "cells")
    held = cells.groupBy("h").agg(F.count("*").alias("held"))
    order = Window.partitionBy("id").orderBy("held", "h")
    probe = F.col("n") - F.ceil(F.lit(p) * F.col("n") / 100) + 1
    early = cells.join(held, "h").withColumn("at", F.row_number().over(order)).where((F.col("at") <= probe) & (F.col("held") > 1))
    early = stage(early.select("h", "id", "root", "n", "at").join(marked, "id"), "early")
    index = F.col("n") - F.ceil(F.lit(2 * p) * F.col("n") / (100 + p)) + 1
    x, y = early.where(F.col("at") <= index).alias("x"), early.alias("y")
    on = (
        (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root"))
        & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))))
        & (100 * F.col("x.n") >= p * F.col("y.n"))
        & ((100 + p) * (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1) >= p * (F.col("x.n") + F.col("y.n")))
    )
    xb, yb = ([F.col(f"{side}.bits")[i] for i in range(BITMAP // 64)] for side in "xy")
    only_x = reduce(add, (F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in zip(xb, yb, strict=True)))
    only_y = reduce(add, (F.bit_count(b.bitwiseAND(F.bitwise_not(a))) for a, b in zip(xb, yb, strict=True)))
    on &= (100 + p) * F.least(F.col("x.n") - only_x, F.col("y.n") - only_y) >= p * (F.col("x.n") + F.col("y.n"))
    found = stage(x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "pairs")
    drop(cells)
    drop(early)
    return found


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_shingles, component_id, kept.

    Words are runs outside ASCII white space after lower-casing A-Z; a document's set holds its distinct 5-word
    shingles, its whole sequence as one if it has fewer words, and nothing if it has none or its text is null; such
    documents are linked with nothing and kept.  Equal sets are one node (their smallest doc_id), so repeated rows
    cost one row each.  component_id is the smallest doc_id reachable over links; ties cannot occur.  Other columns
    are not read; an empty table gives an empty result.  Rows with a null doc_id are linked like others, and component_id is null
    where no row of theirs has one; equal ones count as one row.  A row repeated whole gets its result each time, and other
    rows are taken to differ in doc_id.
    """
    docs, restore = with_keys(docs.select("doc_id", "text"))
    sigs = stage(
        docs.mapInPandas(_signatures, "doc_id long, n_shingles long, digest binary, keys array<long>"),
        "signatures",
    )
    classes = stage(sigs.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    reps = sigs.select(F.col("doc_id").alias("id"), "keys").join(classes.select("id"), "id", "left_semi")
    members = stage(shared_members(reps.select(F.explode("keys").alias("key"), "id")), "members")
    ids = stage(members.select("id").distinct(), "ids")
    texts = semi(docs, ids.withColumnRenamed("id", "doc_id"), "doc_id")
    sets = once(stage(texts.mapInPandas(_sets, "id long, hashes array<long>"), "sets"), "id")
    roots = stage(link_components(
        members, lambda p: jaccard_links(p, sets, percent), narrow=lambda many: prefix_pairs(many, sets, percent)), "roots")
    for table in (members, ids, sets):
        drop(table)
    named = stage(classes.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("component_id")), "named")
    out = sigs.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    return restore(out, "doc_id", "component_id")
