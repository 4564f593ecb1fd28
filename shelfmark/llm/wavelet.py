"""A wavelet matrix over token ids in one file: succinct bit-planes with rank and select.

A plane holds one bit of every symbol; symbols go from plane to plane stably sorted by the bits above. With the counts
of ones before every 512th bit, access, rank, select, counts and occurrence lookups take a step for each plane and
never decode the sequence. Symbols are the ranks of the ids in the file's own alphabet, so that a shard with s distinct
ids has ceil(log2 s) planes.

File: magic, length of the head, head (JSON), packed tables (zstd: alphabet, documents' ids and lengths, zeros by
plane), rank directory, planes. Numbers are little-endian.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"SHWM0001"
_BLOCK = 512


class WaveletMatrix:
    """n symbols; alphabet: the distinct ids, ascending; planes: packed bits, high bits first; ranks: ones before each block."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: np.ndarray, ranks: np.ndarray, planes: np.ndarray):
        self.n, self.alphabet, self.zeros, self.ranks, self.planes = n, alphabet, zeros, ranks, planes

    # -- building and decoding
    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        present = np.bincount(ids, minlength=1) > 0 if n else np.zeros(1, dtype=bool)
        alphabet = np.flatnonzero(present).astype("<u4")
        levels = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
        code = np.zeros(len(present), dtype=np.uint16 if levels <= 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        a = code[ids]
        blocks = n // _BLOCK + 1
        planes = np.zeros((levels, blocks * _BLOCK // 8), dtype=np.uint8)
        zeros = np.zeros(levels, dtype="<u8")
        for k in range(levels):
            bits = ((a >> (levels - 1 - k)) & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            planes[k, : len(packed)] = packed
            ones = np.flatnonzero(bits)
            zeros[k] = n - len(ones)
            a = np.concatenate((a[np.flatnonzero(~bits)], a[ones]))
        ranks = np.zeros((levels, blocks), dtype="<u4")
        counts = np.bitwise_count(planes.view("<u8")).reshape(levels, blocks, 8).sum(axis=2, dtype=np.int64)
        ranks[:, 1:] = np.cumsum(counts, axis=1)[:, :-1]
        return cls(n, alphabet, zeros, ranks, planes)

    def decode(self) -> np.ndarray:
        """All ids, in order: from the last plane up, every plane puts the symbols back where they were."""
        n, levels = self.n, len(self.planes)
        a = np.zeros(n, dtype=np.uint16 if levels <= 16 else np.uint32)
        for k in range(levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[k], count=n, bitorder="little").view(bool)
            out, z = np.empty_like(a), int(self.zeros[k])
            out[np.flatnonzero(~bits)] = a[:z]
            out[np.flatnonzero(bits)] = a[z:] | a.dtype.type(1 << (levels - 1 - k))
            a = out
        return self.alphabet[a]

    # -- queries
    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before the positions."""
        block = at // _BLOCK
        words = self.planes[k].view("<u8").reshape(-1, 8)[block]
        inside = np.clip((at % _BLOCK)[:, None] - 64 * np.arange(8), 0, 64).astype(np.uint64)
        mask = np.where(inside == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (inside % np.uint64(64))) - np.uint64(1))
        return self.ranks[k][block].astype(np.int64) + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def _select(self, k: int, nth: np.ndarray, bit: int) -> np.ndarray:
        """Positions in plane k of the nth (from 0) ones or zeros."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * _BLOCK - before
        out = np.empty(len(nth), dtype=np.int64)
        for i in range(0, len(nth), 4096):
            want = nth[i : i + 4096]
            block = np.searchsorted(before, want, side="right") - 1
            bits = np.unpackbits(self.planes[k].reshape(-1, _BLOCK // 8)[block], axis=1, bitorder="little") == bit
            found = (np.cumsum(bits, axis=1) > (want - before[block])[:, None]).argmax(axis=1)
            out[i : i + 4096] = block * _BLOCK + found
        return out

    def access(self, at) -> np.ndarray:
        """The ids at these positions."""
        at = np.atleast_1d(np.asarray(at, dtype=np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the sequence")
        code = np.zeros(len(at), dtype=np.int64)
        for k in range(len(self.planes)):
            here, ones = self._rank1(k, at), self._rank1(k, at + 1)
            bit = ones - here
            code = code * 2 + bit
            at = np.where(bit == 1, int(self.zeros[k]) + here, at - here)
        return self.alphabet[code]

    def _range(self, symbol: int, end: int) -> tuple[int, int, int]:
        """Code of an id, and where its occurrences before `end` stand below the last plane."""
        code = int(np.searchsorted(self.alphabet, symbol))
        if code == len(self.alphabet) or self.alphabet[code] != symbol:
            return -1, 0, 0
        span = np.array([0, end], dtype=np.int64)
        for k in range(len(self.planes)):
            ones = self._rank1(k, span)
            span = int(self.zeros[k]) + ones if code >> (len(self.planes) - 1 - k) & 1 else span - ones
        return code, int(span[0]), int(span[1])

    def rank(self, symbol: int, end: int) -> int:
        """How often an id occurs before position `end`."""
        _, a, b = self._range(symbol, end)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def locate(self, symbol: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Positions of the occurrences first..last (from 0) of an id, ascending; all of them if not said otherwise."""
        code, a, b = self._range(symbol, self.n)
        at = np.arange(a, b, dtype=np.int64)[first:last]
        for k in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, at - int(self.zeros[k]) * bit, bit)
        return at

    def select(self, symbol: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of an id, -1 if there are fewer."""
        found = self.locate(symbol, nth, nth + 1) if nth >= 0 else ()
        return int(found[0]) if len(found) else -1


def pack(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """A shard's file: the ids of its documents, one after the other, with the documents' own ids and lengths."""
    m = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    tables = [m.alphabet.tobytes(), known.tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.asarray(lengths, dtype="<u8").tobytes(), m.zeros.tobytes()]
    body = zstandard.compress(b"".join(tables), 1)
    head = json.dumps({"n": m.n, "docs": len(doc_ids), "levels": len(m.planes), "sigma": len(m.alphabet), "blocks": m.ranks.shape[1], "tables": len(body)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, body, m.ranks.tobytes(), m.planes.tobytes()])


def unpack(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """A file's matrix, documents' ids and lengths; raises ValueError if it isn't a whole file of this format."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    (k,) = struct.unpack_from("<I", data, 8)
    h = json.loads(data[12 : 12 + k])
    at = 12 + k + h["tables"]
    if len(data) != at + h["levels"] * h["blocks"] * (4 + _BLOCK // 8):
        raise ValueError("the file is cut short")
    t = zstandard.decompress(data[12 + k : at])
    cuts = np.cumsum([0, 4 * h["sigma"], h["docs"], 8 * h["docs"], 8 * h["docs"], 8 * h["levels"]])
    alphabet, known, ids, lengths, zeros = (np.frombuffer(t[a:b], dtype=d) for a, b, d in zip(cuts, cuts[1:], ("<u4", "u1", "<i8", "<u8", "<u8"), strict=False))
    ranks = np.frombuffer(data, dtype="<u4", count=h["levels"] * h["blocks"], offset=at).reshape(h["levels"], h["blocks"])
    planes = np.frombuffer(data, dtype=np.uint8, offset=at + ranks.nbytes).reshape(h["levels"], h["blocks"] * _BLOCK // 8)
    return WaveletMatrix(h["n"], alphabet, zeros, ranks, planes), [i if ok else None for i, ok in zip(ids.tolist(), known.tolist(), strict=True)], lengths.astype(np.int64)
