"""Static binary-fuse filters (Graf and Lemire, 2022) over 64-bit keys, in numpy.

A filter answers "may this key be in the set?" with no false negatives and about 1/256 false
positives, at about 9 bits a key. It can't take new keys, which suits immutable snapshots.
"""

from __future__ import annotations

import math

import numpy as np

from playlake.llm.textkit import mix

_ARITY = 3
_MAX_SEEDS = 64


class FuseFilter:
    """Three consecutive segments hold an 8-bit share each; their xor is the key's fingerprint."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """A filter of the distinct 64-bit `keys`."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        segments = max(1, -(-int(n * factor + 32) // segment) - (_ARITY - 1))
        for seed in range(1, _MAX_SEEDS):
            made = cls(seed, segment, segments, np.zeros((segments + _ARITY - 1) * segment, np.uint8))
            if made._assign(keys):
                return made
            if seed % 8 == 0:  # small sets can need more room
                segments += max(1, segments // 8)
        raise ValueError(f"no seed below {_MAX_SEEDS} orders {n} keys")

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three slots of each key, and its fingerprint."""
        h = mix(keys.astype(np.uint64) ^ mix(np.full(1, self.seed, np.uint64)))
        first = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        inner = mix(h + np.uint64(0x632BE59BD9B4E019))
        mask = np.uint64(self.segment - 1)
        slots = [(first + np.uint64(i)) * np.uint64(self.segment) + ((inner >> np.uint64(18 * i)) & mask) for i in range(_ARITY)]
        return np.stack(slots).astype(np.int64), (h & np.uint64(255)).astype(np.uint8)

    def _assign(self, keys: np.ndarray) -> bool:
        """Peel keys that are alone in a slot, round by round; fill the table in reverse order."""
        places, prints = self._places(keys)
        size, ids = len(self.table), np.arange(len(keys), dtype=np.int64)
        degree = np.bincount(places.ravel(), minlength=size)
        whose = np.zeros(size, np.int64)
        for row in places:
            np.bitwise_xor.at(whose, row, ids)
        left, rounds = len(keys), []
        alone = np.flatnonzero(degree == 1)
        while len(alone):
            owners, at = np.unique(whose[alone], return_index=True)
            rounds.append((owners, alone[at]))
            left -= len(owners)
            slots = places[:, owners]
            np.subtract.at(degree, slots.ravel(), 1)
            for row in slots:
                np.bitwise_xor.at(whose, row, owners)
            touched = np.unique(slots)
            alone = touched[degree[touched] == 1]
        if left:
            return False
        for owners, slot in reversed(rounds):
            # within a round no key's own slot is used by another key of that round
            others = self.table[places[0, owners]] ^ self.table[places[1, owners]] ^ self.table[places[2, owners]]
            self.table[slot] = prints[owners] ^ others ^ self.table[slot]
        return True

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For each key, whether the set may hold it; never False for one that it holds."""
        if not len(keys):
            return np.zeros(0, bool)
        places, prints = self._places(keys)
        return (self.table[places[0]] ^ self.table[places[1]] ^ self.table[places[2]]) == prints
