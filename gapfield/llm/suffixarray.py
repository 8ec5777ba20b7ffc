"""Suffix arrays by two-stage sorting, and the repeated windows they show.

A suffix is of type B if it is smaller than its successor, else of type A. Only B suffixes are
sorted directly, bucket by bucket of their first two bytes. A suffixes are induced: a scan over the
sorted suffixes puts, for suffix i, suffix i-1 to the front of its first byte's bucket if it is of
type A; whole runs of the scan are placed at once. Neighbours in the array are then compared for
their common prefix. Order is complete up to ``depth`` bytes, which is all that a window needs.
"""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last suffix is not (nothing is smaller)."""
    n = len(text)
    if n == 0:
        return np.zeros(0, bool)
    # equal neighbours take the type of the end of their run
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    rise[-1] = -1
    at = np.where(rise != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return rise[nearest] > 0


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` bytes (deeper where it comes for free)."""
    n = len(text)
    small = suffix_types(text)
    raw = text.tobytes().decode("latin-1")
    first = text.astype(np.int32)
    second = np.zeros(n, np.int32)
    second[:-1] = first[1:]
    # stage one: B suffixes, directly, by buckets of two bytes
    b = np.flatnonzero(small).astype(np.int64)
    b = b[np.argsort(first[b] * 256 + second[b], kind="stable")]
    cut = np.flatnonzero(np.diff(first[b] * 256 + second[b])) + 1
    parts = []
    for bucket in np.split(b, cut):
        starts = bucket.tolist()
        if len(starts) > 1:
            keys = [raw[i + 2 : i + depth] for i in starts]
            bucket = bucket[sorted(range(len(keys)), key=keys.__getitem__)]
        parts.append(bucket)
    b = np.concatenate([np.zeros(0, np.int64), *parts])
    # stage two: A suffixes, induced; within a bucket they come before its B suffixes
    counts = np.bincount(first, minlength=256)
    count_a = np.bincount(first[~small], minlength=256)
    begin = np.cumsum(counts) - counts
    out = np.full(n, -1, np.int64)
    b_first = first[b]
    b_begin = np.searchsorted(b_first, np.arange(257))
    filled = begin.copy()

    def place(preds: np.ndarray) -> None:
        """Puts A suffixes, given in scan order, to the front of their buckets."""
        order = np.argsort(first[preds], kind="stable")
        preds = preds[order]
        key = first[preds]
        groups, at, size = np.unique(key, return_index=True, return_counts=True)
        for g, i, m in zip(groups.tolist(), at.tolist(), size.tolist(), strict=True):
            out[filled[g] : filled[g] + m] = preds[i : i + m]
            filled[g] += m

    if n and not small[n - 1]:
        place(np.array([n - 1]))  # preceded by the empty suffix
    for c in range(256):
        if not counts[c]:
            continue
        scanned = begin[c]
        while scanned < filled[c]:  # A part; runs of the same byte extend it while it is scanned
            run = out[scanned : filled[c]]
            scanned = filled[c]
            preds = run[run > 0] - 1
            place(preds[~small[preds]])
        lo, hi = b_begin[c], b_begin[c + 1]
        run = b[lo:hi]
        out[begin[c] + count_a[c] : begin[c] + counts[c]] = run
        preds = run[run > 0] - 1
        place(preds[~small[preds]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it, ``depth`` at most.

    Eight bytes are compared at a time, in steps that grow for pairs that stay equal.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(2 * depth + 16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    for lo in range(1, n, 1 << 16):
        a, b = order[lo - 1 : lo - 1 + (1 << 16)], order[lo : lo + (1 << 16)]
        a = a[: len(b)]
        size, left, step = np.zeros(len(b), np.int64), np.arange(len(b)), 1
        while len(left):
            cols = size[left][:, None] + 8 * np.arange(step)
            x = eight[a[left][:, None] + cols] ^ eight[b[left][:, None] + cols]
            equal = (x == 0).all(1)
            word = np.where(equal, 0, (x != 0).argmax(1))
            bits = x[np.arange(len(left)), word]
            bits &= -bits.astype(np.int64).view(np.uint64)  # lowest differing bit
            byte = (np.frexp(np.maximum(bits, np.uint64(1)).astype(np.float64))[1] - 1) // 8
            size[left] += np.where(equal, 8 * step, 8 * word + byte)
            left = left[equal & (size[left] < depth)]
            step = min(2 * step, 8)
        out[lo : lo + len(b)] = np.minimum(size, np.minimum(len(text) - np.maximum(a, b), depth))
    return out


def repeated_starts(text: np.ndarray, allowed: np.ndarray, window: int) -> np.ndarray:
    """Starts (of those allowed) whose next ``window`` bytes also start at another allowed place."""
    order = suffix_array(text, window)
    order = order[allowed[order]]
    shared = common_prefixes(text, order, window) >= window
    hit = shared.copy()
    hit[:-1] |= shared[1:]
    return np.sort(order[hit])
