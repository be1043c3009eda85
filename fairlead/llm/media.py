"""Media columns as content-defined chunks: rolling-hash cuts, each distinct chunk stored once, verified on reading.

A payload is cut where a gear hash of its last 32 bytes has CUT_BITS zero bits.  Each distinct payload is one medium,
its manifest the ordered digests of its chunks; of equal chunks the one of the smallest (doc_id, place) is stored, in
the row of its medium, as 8-bit samples.  Reading takes the chunks a medium owns from its own row and joins only those
it shares, checks every digest, and reconstructs the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.numbering import with_keys
from fairlead.llm.stage import attach, drop, semi, stage

UNIT = 64
CUT_BITS, SHORTEST, LONGEST = 10, 256, 8192
_WINDOW = 32
_BLOCK = 1 << 20
_GEAR = np.random.default_rng(64).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of UNIT; null is the empty text."""
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT if data else UNIT)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: the last is its length, the others depend on nearby bytes only."""
    found = []
    for at in range(0, len(data), _BLOCK):
        start = max(0, at - _WINDOW + 1)
        h = _GEAR[np.frombuffer(data[start : at + _BLOCK], np.uint8)]
        width = 1
        while width < _WINDOW:  # the hash of 2w bytes from those of w bytes
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
            width *= 2
        hits = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + start + 1
        found.append(hits[hits > at])
    ends, last = [], 0
    for p in np.concatenate(found).tolist() if found else []:
        while p - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if p - last >= SHORTEST:
            ends.append(p)
            last = p
    while len(data) - last > LONGEST:
        last += LONGEST
        ends.append(last)
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def head(chunks: list[bytes], digests: list[bytes]) -> bytes:
    """What a medium's stored form begins with: mark, number of chunks, their lengths and digests."""
    table = b"".join(struct.pack("<I", len(c)) + d for c, d in zip(chunks, digests, strict=True))
    return b"CDC1" + struct.pack("<I", len(chunks)) + table


def _manifests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            data = payload_of(text)
            out.append((doc, len((text or "").encode()), hashlib.sha256(data).digest(), [hashlib.sha256(c).digest() for c in chunks_of(data)]))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "medium", "digests"])


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text, other in zip(pdf["doc_id"], pdf["text"], pdf["other"], strict=True):
            chunks = chunks_of(payload_of(text))
            other = set() if other is None else set(np.asarray(other).tolist())
            digests = [hashlib.sha256(c).digest() for c in chunks]
            out.append((doc, head(chunks, digests), digests, [c for i, c in enumerate(chunks) if i not in other], sorted(other)))
        yield pd.DataFrame(out, columns=["doc_id", "head", "digests", "samples", "other"])


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write ``docs(doc_id, text)``, every doc_id given, -> manifests(doc_id, n_bytes, medium, digests) and the store of distinct media.

    The store has doc_id (the smallest of a medium's), ``head`` and ``samples``, a medium's stored form, the samples those
    of the chunks stored here; digests in order and ``other``, the places of chunks stored elsewhere.  Each distinct
    chunk of the corpus is stored once.
    """
    docs = docs.select("doc_id", "text")
    manifests = stage(docs.mapInPandas(_manifests, "doc_id long, n_bytes long, medium binary, digests array<binary>"), "manifests")
    media = manifests.groupBy("medium").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    media = stage(media, "media")
    places = manifests.join(media.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.posexplode("digests").alias("place", "digest"))
    here = F.struct("doc_id", "place")
    owner = places.groupBy("digest").agg(F.min(here).alias("owner"), F.max(here).alias("last")).where("owner <> last").select("digest", "owner")
    other = stage(places.join(owner, "digest").where(here != F.col("owner")).groupBy("doc_id").agg(F.collect_list("place").alias("other")), "other")
    copies = stage(manifests.select("doc_id", "medium").join(media.where("doc_id <> last").select("medium", F.col("doc_id").alias("rep")), "medium")
                   .where("doc_id <> rep").select("doc_id"), "copies")
    kept = attach(docs, copies.select("doc_id", F.lit(True).alias("copy")), "doc_id").where(F.col("copy").isNull()).drop("copy")
    kept = attach(kept, other, "doc_id")
    stored = stage(kept.mapInPandas(_stored, "doc_id long, head binary, digests array<binary>, samples array<binary>, other array<int>"), "store")
    return manifests, stored


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, begin, digests, samples, other, fetched in pdf[["doc_id", "head", "digests", "samples", "other", "fetched"]].itertuples(index=False):
            own, away = iter(samples), set(other)
            got = dict(fetched) if isinstance(fetched, dict) else {f["place"]: f["sample"] for f in fetched} if fetched is not None else {}
            chunks = [got[i] if i in away else next(own) for i in range(len(digests))]
            for c, d in zip(chunks, digests, strict=True):
                if hashlib.sha256(c).digest() != d:
                    raise ValueError(f"a stored chunk of medium {doc} differs from its digest")
            data, form = b"".join(chunks), begin + b"".join(samples)
            if begin != head(chunks, list(digests)):
                raise ValueError(f"the stored head of medium {doc} differs from its chunks")
            b = np.frombuffer(data, np.uint8)
            text = f"chunks={len(chunks)};mean={int(b.sum(dtype=np.int64)) * 1000 // len(b)};peak={int(b.max())};distinct={len(np.unique(b))}"
            out.append((doc, len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), text))
        yield pd.DataFrame(out, columns=["doc_id", "payload_bytes", "medium", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_features(stored: DataFrame) -> DataFrame:
    """One row for each medium in the store, from its reconstructed and verified samples.

    A store with a missing or altered chunk fails.
    """
    refs = stored.where(F.size("other") > 0).select(
        F.col("doc_id").alias("reader"), F.explode(F.transform("other", lambda i: F.struct(i.alias("place"), F.get("digests", i).alias("digest")))).alias("r")
    ).select("reader", "r.place", "r.digest")
    wanted = stage(refs.select("digest").distinct(), "wanted")
    own = F.filter(F.transform("digests", lambda d, i: F.struct(d.alias("digest"), F.array_contains("other", i).alias("away"))), lambda x: ~x["away"])
    shared = stored.select(F.explode(F.zip_with(own, "samples", lambda o, s: F.struct(o["digest"].alias("digest"), s.alias("sample")))).alias("c"))
    shared = semi(shared.select("c.digest", "c.sample"), wanted, "digest")
    fetched = refs.join(shared, "digest").groupBy(F.col("reader").alias("doc_id")).agg(F.collect_list(F.struct("place", "sample")).alias("fetched"))
    schema = "doc_id long, payload_bytes long, medium binary, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    none = F.lit(None).cast("array<struct<place int, sample binary>>")
    whole = stored.where(F.size("other") == 0).withColumn("fetched", none)
    mixed = stored.where(F.size("other") > 0).join(fetched, "doc_id", "left")
    return whole.unionByName(mixed.select(whole.columns)).mapInPandas(_features, schema)


def media_documents(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature.

    Texts are stored, read back and verified; features come from the bytes read.  Equal texts share one medium and
    so have equal values.  A null or empty text is UNIT zero bytes.  Other columns are not read; an empty table gives
    an empty result.  Rows with a null doc_id have their values too; a row repeated whole gets its values each time, and other
    rows are taken to differ in doc_id.  media_bytes and media_sha256 are those of the stored form as read back: its
    head and the samples stored with it.
    """
    docs, restore = with_keys(docs.select("doc_id", "text"))
    manifests, stored = store(docs)
    found = stage(read_features(stored).drop("doc_id").dropDuplicates(["medium"]), "features")
    drop(stored)
    out = manifests.select("doc_id", "n_bytes", "medium").join(found, "medium").select(
        "doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("medium")).alias("payload_sha256"), "tail_crc32", "media_bytes",
        "media_sha256", "feature")
    return restore(out, "doc_id")
