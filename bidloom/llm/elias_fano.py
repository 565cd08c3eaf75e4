"""Elias-Fano coding of a rising sequence, searched through memory-mapped arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from bidloom.llm.spans import U64

#: Bits of the unary part under one entry of the directory.
BLOCK = 64


@dataclass(frozen=True)
class EliasFano:
    """`low`: the low bits of every value, packed; `high`: the rest in unary; `zeros`: zeros before each block of `high`."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    zeros: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """Code strictly rising values below 2**62."""
        n = len(values)
        values = values.astype(U64)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, min(48, (top // max(n, 1)).bit_length() - 1))
        low = np.zeros((n * width + 7) // 8 + 8, np.uint8)
        step = 1 << 16  # a multiple of eight values begins on a whole byte
        for k in range(0, n if width else 0, step):
            part = values[k:k + step]
            bits = ((part[:, None] >> np.arange(width, dtype=U64)) & U64(1)).astype(np.uint8)
            packed = np.packbits(bits.ravel(), bitorder="little")
            low[k * width // 8: k * width // 8 + len(packed)] = packed
        place = (values >> U64(width)).astype(np.int64) + np.arange(n)
        size = ((int(place[-1]) + 1 if n else 0) // BLOCK + 1) * BLOCK
        unary = np.zeros(size, np.uint8)
        unary[place] = 1
        zeros = np.concatenate([[0], np.cumsum(BLOCK - unary.reshape(-1, BLOCK).sum(1, dtype=np.int64))])[:-1]
        return cls(n, width, low, np.packbits(unary, bitorder="little"), zeros)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), U64)
        bit = at * self.width
        raw = np.ascontiguousarray(self.low[(bit >> 3)[:, None] + np.arange(8)]).view("<u8")[:, 0]
        return (raw >> (bit & 7).astype(U64)) & U64((1 << self.width) - 1)

    def _after_zero(self, k: np.ndarray) -> np.ndarray:
        """Place after the k-th zero of the unary part, 0 for k = 0; past the end if there are fewer."""
        block = np.maximum(np.searchsorted(self.zeros, k, "left") - 1, 0)
        word, need = ~self.high.view("<u8")[block], k - self.zeros[block]
        out = block * BLOCK + 1
        fewer = np.bitwise_count(word) < need
        # Halves of the word: a half with too few zeros is passed over with them.
        for step in (32, 16, 8, 4, 2, 1):
            some = np.bitwise_count(word & U64((1 << step) - 1)).astype(np.int64)
            far = some < need
            need = need - np.where(far, some, 0)
            out += np.where(far, step, 0)
            word = np.where(far, word >> U64(step), word)
        out[fewer] = 8 * len(self.high)
        out[k == 0] = 0
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of every value, -1 where it is not in the sequence: halving the bucket of its high bits, however many values it holds."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        for k in range(0, len(values), 1 << 15):
            part = values[k:k + (1 << 15)].astype(U64)
            bucket = (part >> U64(self.width)).astype(np.int64)
            want = part & U64((1 << self.width) - 1)
            bit = self._after_zero(bucket)
            left, right = bit - bucket, self._after_zero(bucket + 1) - 1 - bucket
            right = np.where(bit < 8 * len(self.high), np.minimum(right, self.n), left)
            end, alive = right.copy(), np.flatnonzero(left < right)
            while len(alive):
                middle = (left[alive] + right[alive]) >> 1
                before = self._low(middle) < want[alive]
                left[alive] = np.where(before, middle + 1, left[alive])
                right[alive] = np.where(before, right[alive], middle)
                alive = alive[left[alive] < right[alive]]
            held = np.flatnonzero(left < end)
            held = held[self._low(left[held]) == want[held]]
            out[k + held] = left[held]
        return out
