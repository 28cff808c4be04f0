"""Hashes of all pieces of a text from one running sum."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were asked for."""

    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < size:
            n = len(self.up)
            up, down = (np.uint64(pow(b, n, 1 << 64)) for b in (self.base, self.inverse))
            self.up, self.down = np.r_[self.up, self.up * up], np.r_[self.down, self.down * down]
        return self.up, self.down


POWERS = Powers()
