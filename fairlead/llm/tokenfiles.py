"""Token ids of a corpus as wavelet-matrix files, one for each shard, written and read by Spark tasks.

Documents stand in ascending doc_id order, null first; rows of one doc_id are ordered by a hash of their text.  A null text is an
empty one.  An empty table has no file.  Shards are ranges of doc_ids of about SHARD_BYTES of text; no document is
split over files, and a file is closed once it has SHARD_TOKENS ids, so a task holds one shard.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.llm.stage import attach, filesystem, new_path, stage
from fairlead.llm.wavelet import TokenFile, encode

SHARD_BYTES, SHARD_TOKENS = 32 << 20, 1 << 23
#: Units of text whose ids a task remembers, and how many new ones are encoded as one text.
KNOWN, TOGETHER = 1_000_000, 2048
#: Texts are encoded together up to so many characters.
LOT = 2 << 20
#: Units between which a byte-level tokenizer never joins: Latin letters, or ASCII marks but the apostrophe, each with one space
#: before it; a single line end; and else all white space up to a word with that word.
_L, _M = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-@\[-`{-~"
_UNIT = re.compile(rf" ?[{_L}]++(?![^{_M} \n])| ?[{_M}]++(?![^{_L} \n])|\n(?=[{_L}{_M}])|\s*\S+|\s+")
#: A space between visible characters, where a unit always begins; longer texts are cut there.
_CUT, LONG = re.compile(r"(?<=\S) (?=\S)"), 1 << 20
#: What a special token begins with, and characters that are white space to some and not to others.
_STRANGE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\u180e", "\u200b", "\ufeff")
_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def _byte_lengths(vocab: dict[str, int]) -> np.ndarray:
    """How many bytes of text each id stands for: byte-level vocabularies write each byte as one character."""
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def _places(items: list, what: object) -> Iterator[int]:
    """Where ``what`` stands in a list."""
    at = -1
    with suppress(ValueError):
        while True:
            at = items.index(what, at + 1)
            yield at


def _strange(text: str) -> bool:
    return any(map(text.__contains__, _STRANGE))


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces of about LONG characters, cut where a unit begins."""
    at = 0
    while len(text) - at > LONG and (m := _CUT.search(text, at + LONG)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def byte_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes, for a byte-level tokenizer file.

    The tokenizer splits texts by a rule before it encodes, and never joins across units of _UNIT.  So each unit is encoded
    once for all texts of a call, many as one text, and remembered.  Texts with one of _STRANGE are encoded whole.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok, known = Tokenizer.from_file(path), {}
    lengths = _byte_lengths(tok.get_vocab())

    def ids(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(units: list[str]) -> None:
        """Units with a visible character at both ends, but for a space before it, are encoded as one text with line ends between,
        which is cut by the bytes that its ids stand for."""
        alone = [u for u in units if len(u) - len(u.strip()) > (u[0] == " ")]
        known.update(zip(alone, ids(alone), strict=True))
        units = [u for u in units if u not in known]
        lots = [units[i : i + TOGETHER] for i in range(0, len(units), TOGETHER)]
        for lot, data in zip(lots, ids(["\n".join(x) + "\n" for x in lots]), strict=True):
            ends = np.cumsum([len(u.encode()) + 1 for u in lot])
            reach = np.cumsum(lengths[np.frombuffer(data, "<u4")])
            at = np.searchsorted(reach, ends)
            if not (reach[at] == ends).all():
                raise ValueError(f"{path} joins across line ends")
            starts = [0, *(4 * (at + 1)).tolist()]
            known.update(zip(lot, map(data.__getitem__, map(slice, starts, (4 * at).tolist())), strict=True))

    def some(texts: list[str]) -> list[bytes]:
        nonlocal known
        split = [None if _strange(t) else _UNIT.findall(t) for t in texts]
        found = [s and list(map(known.get, s)) for s in split]
        gaps = [(f, i, s[i]) for f, s in zip(found, split, strict=True) if s for i in _places(f, None)]
        learn(list({u for _, _, u in gaps}))
        for f, i, u in gaps:
            f[i] = known[u]
        out = [ids([t])[0] if f is None else b"".join(f) for t, f in zip(texts, found, strict=True)]
        if len(known) > KNOWN:  # what this call has used is kept
            known = {u: known[u] for s in split if s for u in s}
        return out

    def encoded(texts: list[str]) -> list[bytes]:
        done = iter(some([t for t in texts if len(t) <= LONG or _strange(t)]))
        return [next(done) if len(t) <= LONG or _strange(t) else b"".join(some([p])[0] for p in _pieces(t)) for t in texts]

    _encoders[path] = encoded
    return encoded


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write ``docs(doc_id, text, ...)`` to ``folder`` -> the manifest: part, shard, path, n_docs, n_tokens, in order of part and shard.

    Each document's ids end with ``end_id``.  A task that runs again writes new files; the manifest names those of
    tasks that succeeded.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    end = np.array([end_id], "<u4").tobytes()
    order = ["doc_id", "_hash", "_row"]  # the last parts rows that are equal
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(-(-size // SHARD_BYTES) or 1, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoded, part, shard = byte_encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, texts, chars = [], [], 0
        done, sizes, data, n = [], [], [], 0

        def flush() -> None:
            nonlocal names, texts, chars, n
            for d in encoded(texts):
                data.append(d + end)
                sizes.append(len(d) // 4 + 1)
                n += sizes[-1]
            done.extend(names)
            names, texts, chars = [], [], 0

        def close() -> pd.DataFrame:
            nonlocal shard, n
            path = f"{folder}/part-{part:06d}-{shard:04d}-{uuid.uuid4().hex}.wvlt"
            fs, name = filesystem(path)
            fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(name, compression=None) as out:
                out.write(encode(np.frombuffer(b"".join(data), "<u4"), done, sizes))
            row = pd.DataFrame({"part": [part], "shard": [shard], "path": [path], "n_docs": [len(done)], "n_tokens": [n]})
            shard, n = shard + 1, 0
            for x in (done, sizes, data):
                x.clear()
            return row

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                names.append(None if doc is None else int(doc))
                texts.append(text or "")
                chars += len(texts[-1]) + 64
                if chars >= LOT:
                    flush()
                    if n >= SHARD_TOKENS:
                        yield close()
        if texts:
            flush()
        if done:
            yield close()

    # doc_ids pass as text, since pandas would make numbers of a column with nulls inexact
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return stage(rows.mapInPandas(write, "part int, shard int, path string, n_docs long, n_tokens long"), "tokens")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """part, shard, base: how many ids the files before each have.  Files are added up within parts, parts by one row each."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("above"))
    own = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    shards = manifest.select("part", "shard", own.alias("own"))
    return shards.join(parts, "part").select("part", "shard", (F.col("own") + F.col("above")).alias("base"))


def _each_file(manifest: DataFrame, read: Callable[[TokenFile], pd.DataFrame], schema: str) -> DataFrame:
    """``read`` of every file, with part and shard; files are dealt to tasks one by one."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, shard, path in zip(pdf["part"], pdf["shard"], pdf["path"], strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as file:
                    out = read(TokenFile(file))
                yield out.assign(part=part, shard=shard)

    return manifest.select("part", "shard", "path").repartition(max(1, manifest.count())).mapInPandas(task, f"{schema}, part int, shard int")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files: start counts the ids of all documents before it."""

    def read(file: TokenFile) -> pd.DataFrame:
        docs, sizes = file.documents()
        data, ends = file.decode().astype("<u4").tobytes(), np.cumsum(sizes)
        crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        return pd.DataFrame({"doc_id": [None if d is None else str(d) for d in docs], "at": ends - sizes, "n_tokens": sizes, "ids_crc32": crc})

    rows = attach(_each_file(manifest, read, "doc_id string, at long, n_tokens long, ids_crc32 long"), shard_starts(manifest), ["part", "shard"], "inner")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each of ``tokens`` stands in the corpus; two blocks of each plane are opened for each."""

    def read(file: TokenFile) -> pd.DataFrame:
        return pd.DataFrame({"token": tokens, "n": [file.count(t) for t in tokens]})

    return _each_file(manifest, read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, doc_id, place: where each of ``tokens`` stands, ``place`` counted from 0 in the document."""

    def read(file: TokenFile) -> pd.DataFrame:
        docs, sizes = file.documents()
        ends, out = np.cumsum(sizes), []
        for t in tokens:
            at = file.occurrences(t)
            doc = np.searchsorted(ends, at, "right")
            out.append(pd.DataFrame({"token": t, "doc_id": [None if docs[d] is None else str(docs[d]) for d in doc.tolist()], "place": at - (ends - sizes)[doc]}))
        return pd.concat(out) if out else pd.DataFrame({"token": [], "doc_id": [], "place": []})

    found = _each_file(manifest, read, "token long, doc_id string, place long")
    return found.select("token", F.col("doc_id").cast("long").alias("doc_id"), "place")


def token_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of ``docs`` to files in the shared folder and read them back: see ``read_documents``."""
    return read_documents(write_tokens(docs, tokenizer, new_path(docs.sparkSession, "tokens")))
