"""Best-fit packing of tokenised documents into sequences by bulk-synchronous rounds.

Pieces of one length are interchangeable, and so are sequences with one gap, so a round works on the range-sorted
table of sizes (at most capacity + 1 rows however large the corpus is): each range of sizes is swept on its own,
every document run taking the smallest gap that holds it, what is left meets in one sweep over the ranges, members
of a run are told apart by rank, gaps are updated, and the next round begins.  Pieces and sequences themselves move
once, when ranks are joined at the end.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.llm.stage import stage

CAPACITY = 2048
#: Words kept with their ids in a Python worker (some 200 MB); the table starts anew beyond it.
KNOWN_WORDS = 800_000
#: Parts of one length that are ranked apart.
SALTS = 256
_BIG = np.int64(1) << np.int64(44)
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_encoders: dict[str, Callable] = {}


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes, for the tokenizer file at ``path``.

    The tokenizer drops white space and never joins across it, so words between spaces or line ends are encoded
    apart and remembered.  A run of marks after a letter is a unit of its own.  Texts that may hold special tokens
    are encoded as they are.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    known: dict[str, bytes] = {}

    def ids(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    suffix = getattr(tok.model, "end_of_word_suffix", None)
    last = np.zeros(max(tok.get_vocab().values()) + 1, bool)  # ids that end a word
    if suffix:
        last[[i for t, i in tok.get_vocab().items() if t.endswith(suffix)]] = True

    def alone(words: list[str]) -> None:
        """Remember words of letters only: each is one unit of the tokenizer, so many are encoded as one text."""
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            lots = [some[i : i + 40] for i in range(0, len(some), 40)]
            for lot, data in zip(lots, ids([" ".join(lot) for lot in lots]), strict=True):
                cuts = (np.flatnonzero(last[np.frombuffer(data, "<u4")]) + 1) * 4
                if len(cuts) != len(lot):
                    known.update(zip(lot, ids(lot), strict=True))
                    continue
                a = 0
                for w, b in zip(lot, cuts.tolist(), strict=True):
                    known[w] = data[a:b]
                    a = b

    def learn(words: list[str]) -> None:
        parts = [(w, s, w[len(s) :]) for w in words if (s := w.rstrip(_MARKS)) is not w and s.isalpha()]
        whole = {s for _, s, _ in parts} | {w for w in words if w.isalpha()}
        alone([w for w in whole if w not in known] if suffix else [])
        rest = {t for _, _, t in parts} | {w for w in words if not w.rstrip(_MARKS).isalpha()}
        rest = [w for w in (rest if suffix else rest | whole) if w not in known]
        known.update(zip(rest, ids(rest), strict=True))
        for w, s, t in parts:
            known[w] = known[s] + known[t]

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > KNOWN_WORDS:
            known.clear()
        out: list[bytes | None] = [None] * len(texts)
        split = {}
        for i, t in enumerate(texts):
            if "<|" in t:
                out[i] = ids([t])[0]
            else:
                split[i] = t.encode().lower().decode().replace("\n", " ").split(" ")
        words: set[str] = set()
        words.update(*split.values())
        new = [w for w in words if w not in known]
        learn(new)
        for i, ws in split.items():
            out[i] = b"".join(map(known.__getitem__, ws))
        for w in new:
            if len(w) > 256:  # too long to be worth keeping
                known.pop(w)
        return out

    _encoders[path] = encode
    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, piece, start, length, ids_crc32 [, ids as bytes], one row for each piece."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                rows = []
                part = pdf.iloc[at : at + 500]
                for doc, data in zip(part["doc_id"], encode([t or "" for t in part["text"]]), strict=True):
                    data += end
                    for k, b in enumerate(range(0, len(data), 4 * capacity)):
                        one = data[b : b + 4 * capacity]
                        rows.append((doc, k, k * capacity, len(one) // 4, zlib.crc32(one), one))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                yield out if with_ids else out.drop(columns="ids")

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    # ids pass as text, since pandas would make numbers of a column with nulls inexact
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInPandas(cut, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of sizes, largest first -> matches (length, gap, n); a run left over has the other size -1."""
    gaps: list[list[int]] = []
    out = []
    for pdf in batches:
        for size, docs, free in pdf.itertuples(index=False):
            if free:
                gaps.append([size, free])
            while docs and gaps:
                n = min(docs, gaps[-1][1])
                out.append((size, gaps[-1][0], n))
                docs -= n
                gaps[-1][1] -= n
                if not gaps[-1][1]:
                    gaps.pop()
            if docs:
                out.append((size, -1, docs))
    yield pd.DataFrame(out + [(-1, size, n) for size, n in gaps], columns=["length", "gap", "n"]).astype("int64")


def successors(spark: SparkSession, docs: np.ndarray, gaps: np.ndarray, ranges: int = 8) -> list[tuple[int, int, int]]:
    """One round's matches (length, gap, n): ``docs[s]`` pieces of size s against ``gaps[s]`` gaps of size s."""

    def swept(rows: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int, int]]:
        runs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "size long, docs long, gaps long")
        return [tuple(r) for r in runs.mapInPandas(_sweep, "length long, gap long, n long").collect()]

    rows = [(s, int(docs[s]), int(gaps[s])) for s in range(len(docs) - 1, 0, -1) if docs[s] or gaps[s]]
    if not rows:
        return []
    found = swept(rows, ranges)
    left: dict[int, list[int]] = {}
    for length, gap, n in found:
        if gap < 0:
            left.setdefault(length, [0, 0])[0] += n
        elif length < 0:
            left.setdefault(gap, [0, 0])[1] += n
    rest = [(s, *left[s]) for s in sorted(left, reverse=True)]
    if any(r[1] for r in rest) and any(r[2] for r in rest):
        found += swept(rest, 1)
    return [m for m in found if min(m[0], m[1]) >= 0]


class Rounds:
    """What every round did to each run of gaps, by ranks; bounded by sizes and rounds, not by the corpus."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.total = capacity, 0
        self.gaps = np.zeros(capacity + 1, np.int64)
        self.used = np.zeros(capacity + 1, np.int64)
        self.opened: list[tuple[int, int, int]] = []  # first sequence, round, its rank among empty ones
        self.steps: list[np.ndarray] = []  # columns: key of first rank, length or -1, to piece rank, next gap, to next rank

    def open(self, n: int) -> None:
        if n:
            self.opened.append((self.total, len(self.steps), int(self.gaps[self.capacity])))
            self.total += n
            self.gaps[self.capacity] += n

    def apply(self, matches: list[tuple[int, int, int]]) -> None:
        by_gap: dict[int, list[tuple[int, int]]] = {}
        for length, gap, n in sorted(matches, reverse=True):
            by_gap.setdefault(gap, []).append((length, n))
        after = np.zeros_like(self.gaps)
        rows = []
        for gap in np.flatnonzero(self.gaps).tolist():
            at = 0
            for length, n in [*by_gap.get(gap, []), (-1, -1)]:
                n = n if length >= 0 else int(self.gaps[gap]) - at
                if n:
                    to = gap - max(length, 0)
                    rows.append((gap * int(_BIG) + at, length, int(self.used[length]) - at if length >= 0 else 0, to, int(after[to]) - at))
                    after[to] += n
                    at += n
                    if length >= 0:
                        self.used[length] += n
        self.steps.append(np.array(rows, np.int64))
        self.gaps = after


def plan_rounds(spark: SparkSession, counts: np.ndarray) -> Rounds:
    """Rounds that place ``counts[s]`` pieces of each size s: large classes first, then ever smaller ones."""
    capacity = len(counts) - 1
    plan, left = Rounds(capacity), counts.astype(np.int64).copy()
    sizes = np.arange(capacity + 1)
    half = capacity // 2
    own = int(left[half + 1 :].sum())
    spare = own * capacity - int((left * sizes)[half + 1 :].sum())
    plan.open(own + max(0, -(-(int((left * sizes)[: half + 1].sum()) - spare) // capacity)))
    while left.sum():
        least = capacity
        while least:
            least = least // 2 if least > 16 else 0
            while True:
                now = np.where(sizes > least, left, 0)
                matches = successors(spark, now, plan.gaps) if now.sum() else []
                if not matches:
                    break
                plan.apply(matches)
                for length, _, n in matches:
                    left[length] -= n
        plan.open(-(-int((left * sizes).sum()) // capacity))
    return plan


def slots(spark: SparkSession, plan: Rounds) -> DataFrame:
    """sequence_id, length, rank (of a piece among those of its length), offset: every place of every sequence."""
    steps, opened, capacity = plan.steps, plan.opened, plan.capacity

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seq = pdf["id"].to_numpy()
            gap, rank = np.full(len(seq), capacity), np.full(len(seq), -1)
            for r, step in enumerate(steps):
                for i, (first, when, base) in enumerate(opened):
                    if when == r:
                        last = opened[i + 1][0] if i + 1 < len(opened) else plan_total
                        new = (seq >= first) & (seq < last)
                        rank[new] = seq[new] - first + base
                on = np.flatnonzero((rank >= 0) & (gap > 0))
                if not len(on) or not len(step):
                    continue
                row = step[np.searchsorted(step[:, 0], gap[on] * _BIG + rank[on], "right") - 1]
                got = row[:, 1] >= 0
                yield pd.DataFrame({
                    "sequence_id": seq[on][got], "length": row[got, 1], "rank": rank[on][got] + row[got, 2],
                    "offset": capacity - gap[on][got],
                })
                gap[on], rank[on] = row[:, 3], rank[on] + row[:, 4]

    plan_total = plan.total
    return spark.range(plan_total).mapInPandas(walk, "sequence_id long, length long, rank long, offset long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``cut(doc_id, piece, length, ...)`` with sequence_id and offset.

    Every row is placed once, sequences are gapless from 0 and never over ``capacity``; lengths run from 1 to
    ``capacity``.  Rows alike in all columns are separate pieces.  An empty table gives an empty one.
    """
    spark = cut.sparkSession
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    by_salt = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")  # at most capacity x SALTS rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    plan = plan_rounds(spark, counts)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("within", F.row_number().over(inside) - 1).join(F.broadcast(first), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("within"))
    return ranked.join(slots(spark, plan), ["length", "rank"]).select(*cut.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Only documents longer than ``capacity`` are cut.  Whole texts are
    tokenised; other columns are not read.
    """
    return pack(stage(pieces(docs, tokenizer, capacity), "pieces"), capacity)
