"""Canonical length-limited Huffman coding of token ids, in numpy.

Each document is coded on its own and starts at a byte. Every ``BLOCK`` ids the bit offset is kept, so blocks decode
independently of each other; many blocks are decoded in step, one table look-up for each id.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block.
BLOCK = 1024


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths up to ``limit`` bits for the ids with a count (package-merge); zero for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = limit or default_limit(len(used))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, kept = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        kept.append(at < len(leaves))
    need, total = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(kept):
        n = int(leaf[:need].sum())
        total[:n] += 1
        need = 2 * (need - n)
    lengths[order] = total
    return lengths


def default_limit(used: int) -> int:
    return min(24, max(12, int(used - 1).bit_length() + 2))


class Codec:
    """Codes from lengths alone: by length, then by id."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        self.limit = int(self.lengths.max(initial=0))
        used = np.flatnonzero(lengths)
        self.order = used[np.argsort(lengths[used], kind="stable")]
        width = self.lengths[self.order]
        left = np.concatenate([[0], np.cumsum(1 << (self.limit - width))])  # each code's place among all strings of limit bits
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[self.order] = left[:-1] >> (self.limit - width)
        self.table_id = self.table_len = None
        self.sizes = 1 << (self.limit - width)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bits of documents of ``counts`` ids each; the first byte of each document (and the end); bit offsets of all blocks within their documents."""
        ids = ids.astype(np.int64)
        width = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        stops = np.concatenate([[0], np.cumsum(counts)])
        size = (ends[stops[1:]] - ends[stops[:-1]] + 7) // 8
        first = np.concatenate([[0], np.cumsum(size)])
        shift = np.repeat(first[:-1] * 8 - ends[stops[:-1]], counts)
        start = ends[:-1] + shift
        words = np.zeros(first[-1] // 4 + 3, np.uint64)
        place = self.codes[ids].astype(np.uint64) << (64 - (start & 31) - width).astype(np.uint64)
        word = start >> 5
        if len(ids):
            firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[firsts]] += np.add.reduceat(place >> np.uint64(32), firsts)
            words[word[firsts] + 1] += np.add.reduceat(place & np.uint64(0xFFFFFFFF), firsts)
        data = words.astype(">u4").tobytes()[: first[-1]]
        blocks = (counts + BLOCK - 1) // BLOCK
        at = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        marks = start[np.repeat(stops[:-1], blocks) + at * BLOCK] - np.repeat(first[:-1] * 8, blocks) if len(ids) else np.empty(0, np.int64)
        return data, first, marks

    def decode(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of blocks that start at bits ``starts`` and hold ``sizes`` ids, one block after another."""
        if self.table_id is None:
            self.table_id = np.repeat(self.order, self.sizes).astype(np.int32)
            self.table_len = np.repeat(self.lengths[self.order], self.sizes)
            fill = (1 << self.limit) - len(self.table_id)
            self.table_id, self.table_len = np.pad(self.table_id, (0, fill)), np.pad(self.table_len, (0, fill), constant_values=1)
        raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        lanes = np.argsort(-sizes, kind="stable")
        bit, left, target = starts[lanes].astype(np.int64), sizes[lanes], (np.cumsum(sizes) - sizes)[lanes]
        out = np.empty(int(sizes.sum()), np.int32)
        down, mask = 32 - self.limit, (1 << self.limit) - 1
        active = len(lanes)
        for step in range(int(sizes.max(initial=0))):
            while active and left[active - 1] <= step:
                active = int(np.searchsorted(-left, -step, side="left"))
            here = bit[:active]
            seen = (window[here >> 3].astype(np.int64) >> (down - (here & 7))) & mask
            out[target[:active] + step] = self.table_id[seen]
            here += self.table_len[seen]
        return out
