"""Substring dedup by paragraph: MinHash bands, exact Jaccard, and one occurrence kept of each component.

A repeated passage may stand in the middle of a longer paragraph, so runs of whole sentences are paragraphs as well:
from a sentence start on, as many sentences as have ``min_words`` words.  Starts are chosen by winnowing, the smallest
hash among STARTS neighbours, so copies choose alike wherever they stand.  Passages that begin or end anywhere, with
sentences of any length, are found by windows of ``min_words`` words: of ``min_words`` + 1 neighbouring words one at least
begins a window, so any 2 * ``min_words`` words in common hold a common one.  Runs are compared as a whole, paragraphs
between line ends also by bands; windows a few words apart in one text would be near duplicates of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.linking import link_components, shared_members
from fairlead.llm.minhash import jaccard_links, prefix_pairs
from fairlead.llm.numbering import with_keys
from fairlead.llm.stage import attach, drop, once, stage
from fairlead.llm.words import minhash_ranges, mix, powers, shingle_hashes, shingles, word_spans

#: Paragraphs of fewer words are left alone.
MIN_WORDS = 25
RECALL = 0.9995
#: Neighbouring sentence starts of which one at least is chosen.
STARTS = 3
_SALTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def tune_bands(threshold: float = 0.75, recall: float = RECALL, most: int = 16) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands, at most ``most``, find a pair at ``threshold`` with ``recall``."""
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands <= most:
            return bands, rows
    raise ValueError("no number of bands reaches this recall")


def least_of_neighbours(key: np.ndarray, width: int) -> np.ndarray:
    """Places of the least of any ``width`` neighbours (or of all, if fewer), the first of equal ones, in order and each once."""
    width, reach = min(width, len(key)), 1
    at, low = np.arange(len(key)), key
    while reach < width:  # the least of ``reach`` neighbours from each place on; windows may overlap
        step = min(reach, width - reach)
        left = low[:-step] <= low[step:]
        at, low = np.where(left, at[:-step], at[step:]), np.where(left, low[:-step], low[step:])
        reach += step
    return at[np.append(True, at[1:] != at[:-1])]  # windows further on have no earlier place


class Words:
    """Words of a text: their hashes, places in bytes, and the number of line ends before each byte."""

    def __init__(self, text: str) -> None:
        self.data = text.encode()
        self.hashes, self.first, self.end = word_spans(self.data.lower())
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.place = np.concatenate([[0], np.cumsum((self.bytes & 0xC0) != 0x80)])  # code points before each byte
        lines = np.concatenate([[0], np.cumsum(self.bytes == 10)])
        # words that begin a line
        self.opens = np.concatenate([[True], lines[self.first[1:]] > lines[self.end[:-1]]]) if len(self.hashes) else np.empty(0, bool)


def paragraphs_of(w: Words, min_words: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends, in words, of the paragraphs between line ends that have ``min_words`` words."""
    first = np.flatnonzero(w.opens)
    last = np.append(first[1:], len(w.hashes))[: len(first)]
    keep = last - first >= min_words
    return first[keep], last[keep]


def split_paragraphs(text: str, min_words: int = 1) -> list[tuple[int, int]]:
    """Spans in code points of the paragraphs of ``text``, without white space around them."""
    w = Words(text)
    first, last = paragraphs_of(w, min_words)
    return list(zip(w.place[w.first[first]].tolist(), w.place[w.end[last - 1]].tolist(), strict=True)) if len(first) else []


def sentence_runs(w: Words, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the chosen runs of sentences of a text of at least ``min_words`` words."""
    h, end, broken, buf = w.hashes, w.end, w.opens, w.bytes
    stop = _STOPS[buf[end - 1]]
    starts = np.flatnonzero(np.concatenate([[True], stop[:-1]]) | broken)
    ends = np.append(starts[1:], len(h))  # of the sentences, in words
    key = mix(h[starts] ^ np.append(h[1:], np.uint64(0))[starts])
    wide = np.full(len(key) + 2 * (STARTS - 1), np.iinfo(np.uint64).max)
    wide[STARTS - 1 : 1 - STARTS] = key
    at = starts[np.maximum(least_of_neighbours(wide, STARTS) - STARTS + 1, 0)]
    upto = ends[np.minimum(np.searchsorted(ends, at + min_words), len(ends) - 1)]
    good = upto - at >= min_words
    return at[good], upto[good]


def word_windows(w: Words, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the chosen windows of ``min_words`` words: one of any ``min_words`` + 1 neighbours."""
    m = len(w.hashes) - min_words + 1
    key = mix(w.hashes[:m] ^ np.append(w.hashes[1:], np.uint64(0))[:m])
    at = least_of_neighbours(key, min_words + 1)
    return at, at + min_words


def runs_of(w: Words, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, ends and two hashes of the runs of sentences and the windows of a text, each once."""
    h = w.hashes
    if len(h) < min_words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    spans = np.concatenate([np.stack(x) for x in (sentence_runs(w, min_words), word_windows(w, min_words))], axis=1)
    both_ends = np.unique(spans[0] * (len(h) + 1) + spans[1])
    at, upto = both_ends // (len(h) + 1), both_ends % (len(h) + 1)
    both = []
    for salt in _SALTS:
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)) * powers(salt, len(h))[: len(h)], out=total[1:])
        both.append(mix((total[upto] - total[at]) * powers(pow(salt, -1, 2**64), len(h))[at]))
    return at, upto, np.stack(both, axis=1)


def paragraph_sets(w: Words, first: np.ndarray, last: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each paragraph's set of shingles, and a key for each of its bands, of paragraphs of 5 words or more."""
    h = shingle_hashes(w.hashes)
    cuts = np.stack([first, last - 4], axis=1).ravel()
    sig = minhash_ranges(h, cuts, bands * rows).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2])
    for r in range(rows):
        key = mix(key ^ sig[:, :, r]) + sig[:, :, r]
    sizes = cuts[1::2] - cuts[::2]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    each = h[np.arange(len(owner)) + np.repeat(cuts[::2] - np.cumsum(sizes) + sizes, sizes)]
    each = each[np.lexsort((each, owner))]
    new = np.append(True, (each[1:] != each[:-1]) | (owner[1:] != owner[:-1]))  # each shingle of a paragraph once
    flat, starts = each[new], np.searchsorted(owner[new], np.arange(len(sizes)))
    return np.stack([np.add.reduceat(mix(flat ^ np.uint64(salt)), starts) for salt in _SALTS], axis=1), key


def _paragraphs(min_words: int, bands: int, rows: int):
    columns = ["doc_id", "whole", "start", "end", "d1", "d2", "keys"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part, out = pdf.iloc[at : at + 500], []
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    w = Words(text or "")
                    if len(w.hashes) < min_words:
                        continue
                    for whole, (first, last) in ((True, paragraphs_of(w, min_words)), (False, (runs := runs_of(w, min_words))[:2])):
                        if len(first):
                            d, keys = paragraph_sets(w, first, last, bands, rows) if whole else (runs[2], None)
                            out.append((
                                np.full(len(first), doc), np.full(len(first), whole), w.place[w.first[first]], w.place[w.end[last - 1]],
                                np.ascontiguousarray(d[:, 0]).view(np.int64), np.ascontiguousarray(d[:, 1]).view(np.int64), [None] * len(first) if keys is None else list(np.ascontiguousarray(keys).view(np.int64))))
                if out:
                    *flat, keys = zip(*out, strict=True)
                    cells = [np.concatenate(x) for x in flat]
                    yield pd.DataFrame(dict(zip(columns, [*cells, pd.Series([k for ks in keys for k in ks], dtype=object)], strict=True)))

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, sets = [], []
        for text, wanted in zip(pdf["text"], pdf["wanted"], strict=True):
            for w in wanted:
                ids.append(w["id"])
                sets.append(shingles(text[w["start"] : w["end"]].encode().lower()).view(np.int64))
        yield pd.DataFrame({"id": ids, "hashes": sets})


def repeated_paragraphs(docs: DataFrame, percent: int = 75, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, whole, start, end, component_id, n_copies, kept.

    One row for each paragraph (``whole``) or run of sentences or window of words (not ``whole``) of at least ``min_words`` words that another such paragraph repeats, in the same
    document or in another: start and end are code points of the text, and joining the other spans gives the text
    without repeats.  Runs are linked if their words are
    equal, and two paragraphs if their sets of 5-word shingles (A-Z lower-cased) have
    100 * intersection >= percent * union.  A component keeps its first member by (doc_id, start), and
    component_id is the doc_id of that one.  Null and empty texts have no paragraphs.  A row repeated whole counts as
    separate occurrences, of which one is kept; other rows are taken to differ in doc_id.  Those without one come after all
    others.  Other columns are not read.
    """
    bands, rows = tune_bands(percent / 100)
    docs, restore = with_keys(docs.select("doc_id", "text"))
    schema = "doc_id long, whole boolean, start int, end int, d1 long, d2 long, keys array<long>"
    found = stage(
        docs.mapInPandas(_paragraphs(min_words, bands, rows), schema)
        .withColumn("pid", F.monotonically_increasing_id()), "paragraphs")
    classes = stage(found.groupBy("whole", "d1", "d2").agg(F.min("pid").alias("id"), F.count("*").alias("n")), "classes")
    reps = found.select(F.col("pid").alias("id"), "doc_id", "start", "end", "keys").where("keys is not null").join(classes.select("id"), "id", "left_semi")
    members = stage(shared_members(reps.select(F.explode("keys").alias("key"), "id")), "members")
    wanted = reps.drop("keys").join(members.select("id").distinct(), "id", "left_semi").groupBy("doc_id").agg(
        F.collect_list(F.struct("id", "start", "end")).alias("wanted"))
    texts = attach(docs, stage(wanted, "wanted"), "doc_id", "inner")
    sets = once(stage(texts.mapInPandas(_sets, "id long, hashes array<long>"), "sets"), "id")
    roots = stage(
        link_components(members, lambda p: jaccard_links(p, sets, percent), narrow=lambda many: prefix_pairs(many, sets, percent)),
        "roots")
    for table in (members, sets):
        drop(table)
    named = classes.join(roots, "id", "left").select("whole", "d1", "d2", "n", F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("linked"))
    named = stage(named.where("linked or n > 1").select("whole", "d1", "d2", "root"), "named")
    out = stage(found.select("doc_id", "whole", "start", "end", "pid", "d1", "d2").join(named, ["whole", "d1", "d2"]), "repeats")
    first = out.groupBy("root").agg(F.min(F.struct("doc_id", "start", "pid")).alias("first"), F.count("*").alias("n_copies"))
    first = stage(first, "first")  # so that a root that many share is split in the join
    out = out.join(first, "root").select(
        "doc_id", "whole", "start", "end", F.col("first.doc_id").alias("component_id"), "n_copies", (F.col("pid") == F.col("first.pid")).alias("kept"))
    return restore(out, "doc_id", "component_id")


def without_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``repeats`` that are not kept cut from ``text``; doc_id is taken to be unique.

    Spans may overlap, and are then cut as one.
    """
    cut = repeats.where(~F.col("kept")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    reach = F.aggregate(F.concat(whole, F.col("_cut")), F.array().cast("array<int>"), lambda acc, c: F.concat(
        acc, F.array(F.greatest(c["end"], F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))))
    starts = F.concat(F.transform("_cut", lambda c: c["start"]), F.array(F.length("text")))
    parts = F.zip_with(reach, starts, lambda e, s: F.substring(F.col("text"), e + 1, F.greatest(s - e, F.lit(0))))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    return docs.join(cut, "doc_id", "left").withColumn("text", text).drop("_cut")
