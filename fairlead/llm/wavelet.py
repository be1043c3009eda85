"""Wavelet matrices of token ids: succinct bit-planes with rank and select, in one compressed file each.

Plane 0 holds the highest bit of every id in text order.  Each further plane holds the next bit in the order that
the plane before it leaves: ids with a 0 there first, those with a 1 after them, both in their old order.  A plane is stored as
blocks of BLOCK bits, compressed apart, with the number of 1 bits before each, so that rank and select open one block.

File, little-endian: the blocks of all planes; the documents; the directory; its length as 8 bytes; MAGIC.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAGIC = b"wvlt0001"
#: Bits of a block; a multiple of 8.
BLOCK = 1 << 16
_HEAD = struct.Struct("<QQQQQ")  # width, ids, documents, where the documents begin, their bytes uncompressed
_ZSTD = pa.Codec("zstd", 1)


def planes(ids: np.ndarray, width: int) -> Iterator[list[np.ndarray]]:
    """The bits of each plane, from the highest, in blocks; a block at a time goes to where the next plane has its ids."""
    ids = ids.astype(np.uint16) if width <= 16 else ids
    for k in reversed(range(width)):
        mask = ids.dtype.type(1 << k)
        blocks = [ids[a : a + BLOCK] & mask != 0 for a in range(0, len(ids), BLOCK)]
        yield blocks
        after, zero = np.empty_like(ids), 0
        one = len(ids) - sum(map(np.count_nonzero, blocks))
        for b, bit in enumerate(blocks):
            own, ups, downs = ids[b * BLOCK : (b + 1) * BLOCK], np.flatnonzero(bit), np.flatnonzero(~bit)
            after[one : one + len(ups)], after[zero : zero + len(downs)] = own.take(ups), own.take(downs)
            one, zero = one + len(ups), zero + len(downs)
        ids = after


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of ``ids`` (unsigned, 32 bits), which are those of the documents one after another."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    out, at, ones, offsets = [], 0, [], []
    for blocks in planes(ids, width):
        ones.append(np.cumsum([0, *map(np.count_nonzero, blocks)]).astype("<u8"))
        for bit in blocks:
            raw = np.packbits(bit).tobytes()
            small = _ZSTD.compress(raw, asbytes=True)
            out.append(small if len(small) < len(raw) else raw)
            offsets.append(at)
            at += len(out[-1])
    offsets.append(at)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
    head = _HEAD.pack(width, len(ids), len(doc_ids), at, len(docs))
    directory = head + b"".join(x.tobytes() for x in ones) + np.array(offsets, "<u8").tobytes()
    return b"".join([*out, _ZSTD.compress(docs, asbytes=True), directory, struct.pack("<Q", len(directory)), MAGIC])


class TokenFile:
    """Reads a file of ``encode``: the directory at once, blocks and documents when they are asked for."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, size = file, file.size()
        length, magic = struct.unpack("<Q8s", self._read(size - 16, 16))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        data = self._read(size - 16 - length, length)
        self.width, self.n, self.n_docs, self._docs_at, self._docs_raw = _HEAD.unpack_from(data)
        self._docs_end = size - 16 - length
        self.blocks = -(-self.n // BLOCK)
        numbers = np.frombuffer(data, "<u8", offset=_HEAD.size).astype(np.int64)
        self.ones = numbers[: self.width * (self.blocks + 1)].reshape(self.width, -1)
        self.offsets = numbers[self.width * (self.blocks + 1) :]
        self.zeros = self.n - self.ones[:, -1]
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, bool))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The ids of the documents and how many tokens each has, in order."""
        raw = _ZSTD.decompress(self._read(self._docs_at, self._docs_end - self._docs_at), self._docs_raw, asbytes=True)
        k = self.n_docs
        ids, none = np.frombuffer(raw, "<i8", k).tolist(), np.frombuffer(raw, "u1", k, 16 * k)
        return [None if x else i for i, x in zip(ids, none, strict=True)], np.frombuffer(raw, "<u8", k, 8 * k).astype(np.int64)

    def block(self, level: int, b: int) -> np.ndarray:
        """The bits of a block; the last one opened is remembered."""
        k = level * self.blocks + b
        if self._last[0] != k:
            at, end = self.offsets[k : k + 2].tolist()
            n = min(BLOCK, self.n - b * BLOCK)
            raw, size = self._read(at, end - at), -(-n // 8)
            raw = raw if len(raw) == size else _ZSTD.decompress(raw, size, asbytes=True)
            self._last = (k, np.unpackbits(np.frombuffer(raw, np.uint8), count=n).view(bool))
        return self._last[1]

    def _by_block(self, blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each block with the places in ``blocks`` that name it."""
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1))
        for here in np.split(order, cuts[1:]) if len(order) else []:
            yield int(blocks[here[0]]), here

    def rank(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many 1 bits of a plane come before each place, and the bit there (0 past the end)."""
        out, bit = self.ones[level][at // BLOCK].copy(), np.zeros(len(at), bool)
        for b, here in self._by_block(at // BLOCK):
            if b < self.blocks:
                bits = self.block(level, b)
                before = np.concatenate([[0], np.cumsum(bits)])
                inside = at[here] % BLOCK
                out[here] += before[inside]
                bit[here] = np.append(bits, False)[inside]
        return out, bit

    def select(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """The place of each ``k``-th (from 0) bit of a plane that is 1, or 0."""
        before = self.ones[level] if one else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - self.ones[level]
        blocks, out = np.searchsorted(before, k, "right") - 1, np.empty(len(k), np.int64)
        for b, here in self._by_block(blocks):
            out[here] = np.flatnonzero(self.block(level, b) == one)[k[here] - before[b]] + b * BLOCK
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the places ``at``."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for level in range(self.width):
            ones, bit = self.rank(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out << np.uint32(1) | bit
        return out

    def _span(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the last plane's order has the ``token``s of places low to high."""
        if token < 0 or token >> self.width:
            return 0, 0
        ends = np.array([low, high], np.int64)
        for level in range(self.width):
            if ends[0] == ends[1]:
                break
            ones, _ = self.rank(level, ends)
            ends = self.zeros[level] + ones if token >> (self.width - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` stands at places low to high."""
        low, high = self._span(token, low, self.n if high is None else high)
        return high - low

    def occurrences(self, token: int) -> np.ndarray:
        """The places of ``token``, ascending."""
        at = np.arange(*self._span(token, 0, self.n))
        for level in reversed(range(self.width)):
            if not len(at):
                break
            one = bool(token >> (self.width - 1 - level) & 1)
            at = self.select(level, one, at - self.zeros[level] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, each plane says which ids of the order below it go where."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in reversed(range(self.width)):
            up, mine, zero, one = np.empty_like(ids), kind(1 << (self.width - 1 - level)), 0, int(self.zeros[level])
            for b in range(self.blocks):
                bit, own = self.block(level, b), up[b * BLOCK : (b + 1) * BLOCK]
                ups, downs = np.flatnonzero(bit), np.flatnonzero(~bit)
                own[ups], own[downs] = ids[one : one + len(ups)] | mine, ids[zero : zero + len(downs)]
                one, zero = one + len(ups), zero + len(downs)
            ids = up
        return ids.astype(np.uint32)
