"""64-bit keys to slices of one flat array, kept between blocks in bounded memory."""

from __future__ import annotations

import numpy as np

LIMIT_BYTES = 32 << 20


class SliceCache:
    """Sorted keys with the place and length of their slice.

    New keys go to a small sorted run that joins the large one once it holds an eighth of it, so a
    block doesn't copy what is known. Beyond ``limit`` bytes everything is dropped, which changes time only.
    """

    def __init__(self, dtype=np.int32, limit: int = LIMIT_BYTES):
        self.dtype, self.limit = dtype, limit
        self.forget()

    def forget(self) -> None:
        self.runs = [self._run(), self._run()]
        self.flat, self.used = np.zeros(1024, self.dtype), 0

    @staticmethod
    def _run() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return sum(len(r[0]) for r in self.runs)

    @property
    def bytes(self) -> int:
        return len(self) * 20 + self.flat.nbytes

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of the slice of every key; -1 and 0 where a key is unknown."""
        at, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, places, sizes in self.runs:
            if len(known):
                pos = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[pos] == keys
                at[hit], size[hit] = places[pos[hit]], sizes[pos[hit]]
        return at, size

    def add(self, keys: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """New keys, sorted, with their slices one after the other in ``flat``."""
        need = self.used + len(flat)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need - self.used, len(self.flat) // 2), self.dtype)])
        self.flat[self.used : need] = flat
        new = (keys, self.used + np.cumsum(counts) - counts, counts.astype(np.int32))
        self.used = need
        self.runs[1] = self._joined(self.runs[1], new)
        if len(self.runs[1][0]) * 8 > len(self.runs[0][0]):
            self.runs = [self._joined(*self.runs), self._run()]

    @staticmethod
    def _joined(a, b):
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def slices(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of the slices of sorted keys; ``make`` gives (flat, counts) for the positions of unknown ones."""
        if self.bytes > self.limit:
            self.forget()
        at, size = self.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            flat, counts = make(missing)
            self.add(keys[missing], flat, counts)
            at, size = self.find(keys)
        return at, size
