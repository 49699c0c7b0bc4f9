"""Directly addressable codes for token ids: random access to any token without block decoding.

Ids are split into 8-bit chunks, lowest first. Level k holds chunk k of every id that has more than k
chunks, with a bitmap that marks those continuing on the next level and a rank directory of its
one bits, one entry for each 512. Token i is read by following its position down the levels.

File: magic, number of documents, number of ids, number of levels; the documents' keys and lengths; for each level
its number of chunks, the chunks, the bitmap and the rank directory. All integers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"GDAC\x01\x00\x00\x00"
_RANK = 512


def encode(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """keys: int64 per document (nulls as the smallest), lengths: ids of each, ids: all of them."""
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (_RANK // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, _RANK // 8)).sum(axis=1, dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<QQQ", len(keys), len(ids), len(levels))
    return head + keys.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + b"".join(levels)


class Reader:
    """A file read in place; nothing is decoded before it is asked for."""

    def __init__(self, data):
        """data: the file's bytes, or any buffer of them, which is not copied."""
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        docs, self.size, depth = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.keys = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        at += 12 * docs
        self.levels = []
        for _ in range(depth):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // _RANK)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * (_RANK // 8), at + 8 + n)
            ranks = np.frombuffer(data, "<u4", blocks + 1, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + ranks.nbytes

    def __len__(self) -> int:
        return self.size

    def _rank(self, level: int, at: int) -> int:
        """One bits of the level before position ``at``."""
        _, bits, ranks = self.levels[level]
        block, byte = at // _RANK, at // 8
        ones = int(ranks[block]) + int(np.bitwise_count(bits[block * (_RANK // 8) : byte]).sum())
        return ones + (int(bits[byte]) & ((1 << at % 8) - 1)).bit_count() if at % 8 else ones

    def token(self, at: int) -> int:
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[at]) << 8 * k
            if not bits[at // 8] >> at % 8 & 1:
                break
            at = self._rank(k, at)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids start to end: a slice of each level, found by one rank each."""
        out = np.zeros(max(0, end - start), np.uint32)
        where = np.arange(len(out))
        for k, (chunks, bits, _) in enumerate(self.levels):
            if end <= start:
                break
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            if k + 1 == len(self.levels):
                break
            part = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            where = where[part]
            start = self._rank(k, start)
            end = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))
