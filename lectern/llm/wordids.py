"""Token ids of whole texts from the ids of their distinct words.

Where words are encoded independently of each other, a chunk of texts needs each
distinct word only once. Ids of known words are kept in the Python worker, as flat
arrays, until ``MOST`` words are held; then the store begins anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MOST = 2_000_000


class WordIds:
    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = MOST):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.size = np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    def add(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids = self.encode(words)
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        first = len(self.flat) + np.concatenate([[0], np.cumsum(size[:-1], dtype=np.int64)])[: len(size)]
        self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate([self.first, first])[order]
        self.size = np.concatenate([self.size, size])[order]

    def ids(
        self, raw: bytes, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray, tail: int | None
    ) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts whose words are [bounds[i], bounds[i+1]), each text closed by ``tail``; and their bounds."""
        keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            w = at[new]
            self.add(keys[new], [raw[a:b] for a, b in zip(start[w].tolist(), end[w].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        each = place[inverse]
        size = self.size[each].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(size)])
        extra = 0 if tail is None else 1
        n = len(bounds) - 1
        text_end = sums[bounds[1:]] + extra * np.arange(1, n + 1)
        out = np.empty(int(sums[-1]) + extra * n, np.uint32)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        to = sums[:-1] + extra * doc
        inner = np.arange(sums[-1]) - np.repeat(sums[:-1], size)
        out[np.repeat(to, size) + inner] = self.flat[np.repeat(self.first[each], size) + inner]
        if tail is not None:
            out[text_end - 1] = tail
        return out, np.concatenate([[0], text_end])
