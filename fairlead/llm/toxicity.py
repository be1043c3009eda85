"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, pairs of neighbours and pairs with one word between them, hashed to
``2 ** BITS`` coordinates.  Shards of a bounded sample of labelled rows are trained side by side, each going on from
the same state; states are averaged by coordinate after every pass.  L1 leaves few weights that are not zero, at
most ``2 ** BITS``, and these are broadcast for scoring.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.stage import stage
from fairlead.llm.words import mix, word_hashes

BITS = 18
#: Labelled rows that are learned from at most, in the order of a hash of doc_id.
SAMPLE = 20_000
SHARDS, PASSES = 4, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
#: Weight of a toxic row, since few rows are.
POSITIVE = 3.0
#: Log odds before anything is learned: few texts are toxic.
PRIOR = -2.2

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_NEXT, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """Coordinates of a whole text, in blocks that may repeat one another's; words are runs of letters and digits."""
    w = word_hashes((text or "").encode().translate(_FOLD))
    shift, step = np.uint64(64 - bits), 1 << 18
    for at in range(0, len(w), step):
        b = w[at : at + step + 2]
        one = b[:step]
        yield (mix(one) >> shift).astype(np.int32)
        yield (mix(one[: len(b) - 1] * _NEXT + b[1 : step + 1]) >> shift).astype(np.int32)
        yield (mix(one[: len(b) - 2] * _SKIP + b[2 : step + 2]) >> shift).astype(np.int32)


def distinct(text: str | None, bits: int = BITS) -> np.ndarray:
    parts = list(features(text, bits))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


def packed(at: np.ndarray) -> bytes:
    """Sorted coordinates as compressed steps from one to the next."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4")).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal closed form: zero within L1, else a step with the coordinate's own rate."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learner(state: Broadcast, turn: int, size: int):
    """One pass over a shard's rows, in an order of its own, from the state that all shards begin with."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        before_z, before_n = state.value
        z, n = before_z.copy(), before_n.copy()
        order = np.random.default_rng(turn).permutation(len(pdf))
        pdf = pdf.sort_values("doc_id", kind="stable").iloc[order]
        for at, y in zip(pdf["at"], pdf["toxic"], strict=True):
            at = np.append(unpacked(at), size)
            w = weights_of(z[at], n[at])
            g = (1.0 / (1.0 + np.exp(-np.clip(PRIOR + w.sum(), -35, 35))) - y) * (POSITIVE if y else 1.0)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
        moved = np.flatnonzero((z != before_z) | (n != before_n))
        return pd.DataFrame({"at": moved, "dz": (z - before_z)[moved], "dn": (n - before_n)[moved]})

    return learn


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` -> coordinates, their weights, and the constant.

    Learns from labelled rows that are not held out, at most ``sample`` of them.  Rows without a label are left out;
    of contradicting labels for one doc_id the larger holds.  Without any labels all weights are 0 and PRIOR alone scores.
    """
    spark, size = docs.sparkSession, 1 << bits
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "at": [packed(distinct(t, bits)) for t in pdf["text"]]})

    data = stage(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
        .mapInPandas(rows, "doc_id long, toxic int, at binary")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(SHARDS))),
        "labelled",
    )
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the constant
    for turn in range(PASSES):
        state = spark.sparkContext.broadcast((z, n))
        deltas = data.groupBy("shard").applyInPandas(_learner(state, turn, size), "at int, dz float, dn float")
        merged = deltas.groupBy("at").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toPandas()  # bounded by the coordinates
        z[merged["at"]] += merged["dz"] / SHARDS
        n[merged["at"]] += merged["dn"] / SHARDS
        state.destroy()
    w = weights_of(z, n)
    at = np.flatnonzero(w[:-1])
    return at, w[at], PRIOR + float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, score in 0..1 for every row; null and empty texts score the constant."""
    at, w, constant = model
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), w.astype(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros(1 << bits)
        dense[sent.value[0]] = sent.value[1]
        live = dense != 0
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                hit = [x[live[x]] for x in features(text, bits)]
                total = constant + (dense[np.unique(np.concatenate(hit))].sum() if hit else 0.0)
                out.append(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": out})

    # ids pass as text, since pandas would make numbers of a column with nulls inexact
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text, ...)``, learned from ``labels``.

    No column but text enters a score.  A null doc_id is not held out.  Other columns are not read; an empty table
    gives an empty result.
    """
    scored = score(docs, train(docs, labels, sample))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
