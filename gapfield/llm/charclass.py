"""Class and lower case of every code point, as lookup tables built from rules once per process."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            table[lo : hi + 1] = kind
    return table


@cache
def _lower() -> np.ndarray:
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(0x20000):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


def char_classes(points: np.ndarray) -> np.ndarray:
    return _classes()[points]


def lower_points(points: np.ndarray) -> np.ndarray:
    return _lower()[points]
