"""Exact integer inner products of one vector with many, by Kronecker substitution.

The same component of all candidates is packed into one wide integer, a field per candidate. Components are
biased by a common amount so that no field is negative. A vector then takes one multiplication per
component for all candidates at once; the sum of the products holds every inner product in its
field, and a common offset keeps the fields from borrowing from each other. The field's width
follows from the largest possible sum, so fields never overflow and the unpacked scores are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Packed:
    """Candidates (one row each, integers) for vectors whose components' absolute sum is at most ``most``."""

    def __init__(self, rows: np.ndarray, most: int):
        self.n = len(rows)
        self.bias = max(0, -int(rows.min())) if rows.size else 0
        largest = max(int(rows.max()) + self.bias, self.bias) if rows.size else 0
        #: No inner product of a vector is farther from 0 than this, with components as they are or biased.
        self.offset = most * largest
        bits = (2 * self.offset).bit_length()
        self.width = 32 if bits <= 32 else -(-bits // 64) * 64
        self.wide = [self._pack([v + self.bias for v in c.tolist()] if c.dtype == object else c + self.bias) for c in rows.T]
        self.start = self._pack([self.offset] * self.n)

    def _pack(self, values: Sequence[int]) -> int:
        if self.width <= 64:
            return int.from_bytes(np.array(values, f"<u{self.width // 8}").tobytes(), "little")
        return int.from_bytes(b"".join(int(v).to_bytes(self.width // 8, "little") for v in values), "little")

    def products(self, vector: Sequence[int]) -> np.ndarray:
        """The inner product of ``vector`` with every candidate; one beyond a long becomes the nearest long."""
        total = self.start
        for component, wide in zip(vector, self.wide):
            if component:
                total += component * wide
        raw = total.to_bytes(self.n * self.width // 8, "little")
        extra = self.offset + self.bias * sum(vector)
        if self.width == 32:
            return np.frombuffer(raw, "<u4").astype(np.int64) - extra
        if self.width == 64:
            # Modulo 2**64; the result is smaller than half of that.
            return (np.frombuffer(raw, "<u8") - np.uint64(extra % (1 << 64))).view(np.int64)
        step = self.width // 8
        fields = [int.from_bytes(raw[i:i + step], "little") - extra for i in range(0, len(raw), step)]
        return np.array([min(max(f, LEAST), MOST) for f in fields], np.int64)
