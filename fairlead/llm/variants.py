"""Spelling variants: words one code point apart, by hashed deletions, and the frequent form that each belongs to.

Prefix and suffix polynomial hashes give the hash of a word without any one of its code points as one 64-bit integer.  Two words
of one length that differ in one place are equal without that place; a word equals a longer one without one of its
code points.  Keys are dealt out by their high bits and sorted, and those that no second word shares go at once; of the others
the strings themselves, with the code point left out, are grouped, so that equal hashes of different strings link nothing.
A group has one wildcard place, hence at most as many words as there are letters, and its counts and its two best
words say what each member gets from it: pairs are never listed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.stage import attach, drop, stage

MIN_CHARS, MIN_COUNT, SPARE, RATIO = 5, 3, 97, 2
#: High bits of a key that say which bucket it goes to.
RADIX = 12
#: Distinct words that a task counts before it hands them on, and code points of a text taken together.
HELD, BLOCK = 200_000, 1 << 22
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

_RNG = np.random.default_rng(20250211)
#: A random odd number for each code point that a word may have, and the base of the polynomials.
_POINT = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def lowered(run: str) -> str:
    """A-Z in lower case, all else as it is."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def planted(doc_id: str | None, word: str) -> str:
    """The word without one code point, where the contract's CRC-32 of id and word says so; rows without an id keep theirs."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % SPARE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _blocks(text: str) -> Iterator[str]:
    """The text in blocks that end where no run goes on."""
    at = 0
    while at < len(text):
        to = at + BLOCK
        while to < len(text) and RUN.match(text[to - 1]) and RUN.match(text[to]):
            to += 1
        yield text[at:to]
        at = to


def word_counts(docs: DataFrame, change=planted) -> DataFrame:
    """``docs(doc_id, text)`` -> word, n: the lower-cased runs of letters of all texts, each by ``change(doc_id, run)``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(held), "n": list(held.values())})
            held.clear()
            return out

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                for block in _blocks(text or ""):
                    for run, n in Counter(RUN.findall(block)).items():
                        held[change(doc, lowered(run))] += n
                    if len(held) > HELD:
                        yield flush()
        if held:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int) -> np.ndarray:
    p = np.full(n + 1, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def deletion_hashes(word: str) -> tuple[int, np.ndarray]:
    """The polynomial hash of a word, and those of the word without each of its code points, from prefixes and suffixes."""
    x = _POINT[np.frombuffer(word.encode("latin-1"), np.uint8)]
    n, p = len(x), _powers(len(x))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * p[:n], dtype=np.uint64)])  # of the first i, the first lowest
    total = prefix[-1]
    suffix = (total - prefix[1:]) * np.uint64(pow(_BASE, -1, 2**64))  # what follows, moved one place down
    return int(total), prefix[:-1] + suffix


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def deletion_keys(words: DataFrame) -> DataFrame:
    """``words(id, word)`` -> key, place, id: the word without each place, and whole with place -1.

    Of places in a run of equal code points, which leave the same word, only the first serves insertions; so such rows
    have ``first`` false.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, all_keys, places, firsts = [], [], [], []
            size = 0

            def out() -> pd.DataFrame:
                made = pd.DataFrame({
                    "key": _mix(np.concatenate(all_keys)).view(np.int64), "place": np.concatenate(places),
                    "first": np.concatenate(firsts), "id": np.concatenate(ids)})
                for x in (ids, all_keys, places, firsts):
                    x.clear()
                return made

            for i, word in zip(pdf["id"].tolist(), pdf["word"], strict=True):
                whole, deleted = deletion_hashes(word)
                point = np.frombuffer(word.encode("latin-1"), np.uint8)
                ids.append(np.full(len(word) + 1, i, np.int64))
                all_keys.append(np.append(deleted, np.uint64(whole)))
                places.append(np.append(np.arange(len(word), dtype=np.int32), np.int32(-1)))
                firsts.append(np.append(np.diff(point.astype(np.int16), prepend=-1) != 0, True))
                size += len(word) + 1
                if size > 1 << 18:
                    yield out()
                    size = 0
            if ids:
                yield out()

    return words.select("id", "word").mapInPandas(keys, "key long, place int, first boolean, id long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key another word has too: dealt by the key's high bits, sorted, and compared with their neighbours."""

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        same = np.diff(pdf["key"].to_numpy()) == 0
        return pdf[np.append(False, same) | np.append(same, False)]

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last key's rows, which the next batch may go on with
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cut = int(np.searchsorted(pdf["key"].to_numpy(), pdf["key"].iloc[-1])) if len(pdf) else 0
            yield shared(pdf[:cut]) if cut else pdf[:0]
            rest = pdf[cut:]
        if rest is not None and len(rest):
            yield shared(rest)

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(n, F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key")
    return dealt.mapInPandas(neighbours, "key long, place int, first boolean, id long")


def near_words(words: DataFrame) -> DataFrame:
    """``words(id, word, n)`` (staged, distinct) -> id, n_near, best(less, word, id): how many words are near, and the first of them.

    Near words differ in one inserted, deleted or replaced code point.  The first has the largest n (``less`` is -n), then the smallest word.
    """
    rows = attach(stage(shared_keys(deletion_keys(words)), "shared"), words, "id", "inner")
    left = F.concat(F.substr("word", F.lit(1), F.col("place")), F.substr("word", F.col("place") + 2))
    rows = rows.select("id", "place", "first", F.when(F.col("place") < 0, F.col("word")).otherwise(left).alias("left"), F.struct((-F.col("n")).alias("less"), "word", "id").alias("me"))
    rows = stage(rows, "deletions")
    groups = rows.where("place >= 0").groupBy("left", "place").agg(F.sort_array(F.collect_list("me")).alias("all")).where("size(all) > 1")
    groups = groups.select(F.explode("all").alias("me"), (F.size("all") - 1).alias("n_near"), F.col("all")[0].alias("one"), F.col("all")[1].alias("two"))
    replaced = groups.select("me.id", "n_near", F.when(F.col("me.id") == F.col("one.id"), F.col("two")).otherwise(F.col("one")).alias("best"))
    longer = rows.where("place >= 0 and first").select("left", F.col("me").alias("long"))
    pairs = rows.where("place < 0").select("left", F.col("me").alias("short")).join(longer, "left")
    ends = pairs.select(F.explode(F.array(F.struct("short.id", F.col("long").alias("best")), F.struct("long.id", F.col("short").alias("best")))).alias("e"))
    inserted = ends.select("e.id", F.lit(1).alias("n_near"), "e.best")
    found = stage(replaced.unionByName(inserted).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "near")
    drop(rows)
    return found


def last_forms(forms: DataFrame) -> DataFrame:
    """``forms(id, to)`` (staged, without circles) -> id, to: where following ``to`` ends, by doubling the length of the steps."""
    while True:
        on = forms.select(F.col("id").alias("to"), F.col("to").alias("further"))
        if not attach(forms, on, "to", "left_semi").head(1):
            return forms
        before, forms = forms, stage(attach(forms, on, "to").select("id", F.coalesce("further", "to").alias("to")), "forms")
        drop(before)


def spelling_variants(docs: DataFrame, change=planted) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> word, form, root, n, n_near, form_n for every word of MIN_CHARS code points and MIN_COUNT occurrences.

    A word's form is its first near word, if that has RATIO times the word's occurrences.  A null text has no words, and
    rows repeated whole count as often as they stand.
    """
    counts = word_counts(docs, change).where((F.length("word") >= MIN_CHARS) & (F.col("n") >= MIN_COUNT))
    words = stage(counts.withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words)
    joined = attach(words, near, "id").withColumn("has", F.coalesce(-F.col("best.less") >= RATIO * F.col("n"), F.lit(False)))
    joined = stage(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best")).alias("best")), "forms")
    ends = last_forms(stage(joined.where("best is not null").select("id", F.col("best.id").alias("to")), "forms"))
    ends = attach(ends, words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    out = attach(joined, stage(ends, "roots"), "id")
    return out.select("word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))
