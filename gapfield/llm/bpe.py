"""Byte-level BPE over whole texts with array pre-tokenisation.

Pre-tokenisation needs no regular expression: every code point becomes a symbol (its class and what
follows it), a symbol is a function from automaton states to states, and functions compose
associatively. Blocks of symbols are composed for all states side by side, the block functions are
scanned by doubling, and a last pass yields the state before every character, hence the token
starts. The slices between starts are looked up in a cache of merged pieces; new pieces are merged
all together, one merge per piece and step, and offsets into the flat ids are kept, so decoding is
one gather.

The automaton states the fixed split rule of the public vocabularies:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Defined results: null or empty text has no ids; every text decodes to its own bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import ranges, run_hashes, text_blocks
from .charclass import LETTER, NUMBER, SPACE, char_classes
from .slicecache import SliceCache

# Symbols: letter, number, other, apostrophe of a 2- or 3-character contraction, space before a
# word, other white space before a word, white space before white space or the end.
_L, _N, _O, _Q2, _Q3, _SP, _WL, _WM, _FIRST = 0, 1, 2, 3, 4, 5, 6, 7, 8
# States: closed token, letters, numbers, others, space that joins the next word, white space,
# one or two characters of a contraction to come.
_CLOSED, _INL, _INN, _INO, _OPEN, _INW, _ONE, _TWO = range(8)
_BLOCK = 128
# Bytes of text per step; the arrays of a step take some hundred times as much.
BLOCK_BYTES = 512 << 10
_NEVER = np.int32(2**31 - 1)


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and token start, both by symbol * 8 + state; symbols from 8 on start a text."""
    fresh = {_L: _INL, _N: _INN, _O: _INO, _Q2: _ONE, _Q3: _TWO, _SP: _OPEN, _WL: _CLOSED, _WM: _INW}
    going = {(_INL, _L): _INL, (_INN, _N): _INN, (_INW, _WM): _INW}
    for s in (_O, _Q2, _Q3):
        going[_INO, s] = going[_OPEN, s] = _INO
    going[_OPEN, _L], going[_OPEN, _N] = _INL, _INN
    for s in range(8):
        going[_TWO, s], going[_ONE, s] = _ONE, _CLOSED
    move, start = np.zeros(17 * 8, np.uint8), np.zeros(17 * 8, bool)
    for s in range(8):
        for q in range(8):
            move[s * 8 + q] = going.get((q, s), fresh[s])
            start[s * 8 + q] = (q, s) not in going
            move[(s + _FIRST) * 8 + q], start[(s + _FIRST) * 8 + q] = fresh[s], True
    move[128:] = np.arange(8)  # padding
    return move, start


def symbols(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Symbol of every code point; the first of each text carries the reset."""
    n = len(points)
    kind = char_classes(points)
    space = kind == SPACE
    last = np.zeros(n, bool)
    ends = offs[1:][offs[1:] > offs[:-1]]
    last[ends - 1] = True
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~space[1:]
    before_word &= ~last
    out = np.full(n, _O, np.uint8)
    out[kind == LETTER] = _L
    out[kind == NUMBER] = _N
    out[space] = np.where(before_word[space], np.where(points[space] == 32, _SP, _WL), _WM)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        row_end = offs[np.searchsorted(offs, quotes, "right")]
        one = np.where(quotes + 1 < row_end, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 < row_end, points[np.minimum(quotes + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[quotes[short]], out[quotes[long]] = _Q2, _Q3
    out[offs[:-1][offs[1:] > offs[:-1]]] += _FIRST
    return out


def token_starts(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions (in code points) at which a piece starts."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    move, start = _automaton()
    rows = -(-n // _BLOCK)
    sym = np.full(rows * _BLOCK, 16, np.uint8)
    sym[:n] = symbols(points, offs)
    sym = np.ascontiguousarray(sym.reshape(rows, _BLOCK).T) * np.uint8(8)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for j in range(_BLOCK):
        whole = move[sym[j][:, None] + whole]
    step = 1
    while step < rows:  # block k becomes the composition of blocks 0..k
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), 1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole[:-1, _CLOSED]
    out = np.empty((_BLOCK, rows), bool)
    for j in range(_BLOCK):
        at = sym[j] + state
        out[j] = start[at]
        state = move[at]
    return np.flatnonzero(out.T.reshape(-1)[:n])


class Vocabulary:
    """Tokens, their bytes and decimal texts as flat arrays, and the table of pairs that merge."""

    def __init__(self, tokens: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]], whole_first: bool):
        self.tokens, self.pairs, self.whole_first = tokens, pairs, whole_first
        size = max(tokens.values()) + 1
        by_id = [b""] * size
        for b, i in tokens.items():
            by_id[i] = b
        self.byte_lens, self.byte_offs, self.bytes = _flat(by_id)
        self.text_lens, self.text_offs, self.texts = _flat([b"%d," % i for i in range(size)])
        self.single = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        bits = max(8, int(len(pairs) * 4).bit_length())
        self._shift, self._mask = np.uint32(32 - bits), (1 << bits) - 1
        self._keys = np.zeros(1 << bits, np.uint32)
        self._ranks = np.full(1 << bits, _NEVER, np.int32)
        self._ids = np.zeros(1 << bits, np.int32)
        self._fill()
        self.forget()

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A rank file: any two neighbours whose joined bytes have a rank may merge, lowest rank first."""
        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = {}
        for b, i in tokens.items():
            for k in range(1, len(b)):
                left, right = tokens.get(b[:k]), tokens.get(b[k:])
                if left is not None and right is not None:
                    pairs[left, right] = (i, i)
        return cls(tokens, pairs, True)

    @classmethod
    def from_merges(cls, path: str) -> Vocabulary:
        """A tokenizers file: the listed pairs merge, earliest first."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        tokens = {_raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault((tokens[_raw(a)], tokens[_raw(b)]), (rank, tokens[_raw(a + b)]))
        return cls(tokens, pairs, False)

    def _fill(self) -> None:
        keys = np.array([a << 16 | b for a, b in self.pairs], np.uint32)
        ranks = np.array([r for r, _ in self.pairs.values()], np.int32)
        ids = np.array([i for _, i in self.pairs.values()], np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self._ranks[at] == _NEVER
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = one[free[one]]
            where = at[put]
            self._keys[where], self._ranks[where], self._ids[where] = keys[left[put]], ranks[left[put]], ids[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self._shift).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; rank ``_NEVER`` where they don't merge or one is negative."""
        keys = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) & np.uint32(0xFFFF))
        at = self._slot(keys)
        ranks, ids = self._ranks[at], self._ids[at]
        miss = np.flatnonzero((self._keys[at] != keys) & (ranks != _NEVER))
        ranks[self._keys[at] != keys] = _NEVER
        while len(miss):
            at_m = at[miss] = (at[miss] + 1) & self._mask
            hit = (self._keys[at_m] == keys[miss]) & (self._ranks[at_m] != _NEVER)
            ranks[miss[hit]], ids[miss[hit]] = self._ranks[at_m[hit]], self._ids[at_m[hit]]
            miss = miss[~hit & (self._ranks[at_m] != _NEVER)]
        ranks[(a < 0) | (b < 0)] = _NEVER
        return ranks, ids

    # pieces merged before: sorted hashes, where their ids start, how many they are
    def forget(self) -> None:
        self.cache = SliceCache()

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (byte slices), one after the other, and how many each has."""
        lens = (ends - starts).astype(np.int64)
        counts = np.zeros(len(starts), np.int32)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in ((1, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 48)):
            for rows in _split(np.flatnonzero((lens >= lo) & (lens < hi)), 1 << 15):
                parts.append((rows, self._lockstep(data, starts[rows], lens[rows])))
        for i in np.flatnonzero(lens >= 48):
            parts.append((np.array([i]), np.array([self.merge_one(data[starts[i] : ends[i]].tobytes())], np.int32)))
        for rows, ids in parts:
            counts[rows] = (ids >= 0).sum(1)
        offs = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in parts:
            flat[ranges(offs[rows], counts[rows])] = ids[ids >= 0]
        return flat, counts

    def _lockstep(self, data, starts, lens) -> np.ndarray:
        width = int(lens.max())
        col = np.arange(width)
        inside = col < lens[:, None]
        at = np.minimum(starts[:, None] + col, len(data) - 1)
        ids = np.where(inside, self.single[data[at]], -1).astype(np.int32)
        result = ids.copy()
        rows = np.arange(len(ids))
        if self.whole_first:
            known = np.array([self.tokens.get(data[s : s + n].tobytes(), -1) for s, n in zip(starts, lens, strict=True)], np.int32)
            hit = known >= 0
            result[hit] = -1
            result[hit, 0] = known[hit]
            ids, rows = ids[~hit], rows[~hit]
        if width == 1 or not len(rows):
            return result
        ranks, made = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        ranks, made = ranks.reshape(len(ids), -1), made.reshape(len(ids), -1)
        while len(rows):
            best = ranks.argmin(1)
            here = np.arange(len(rows))
            alive = ranks[here, best] != _NEVER
            if not alive.all():
                result[rows[~alive]] = ids[~alive]
                ids, ranks, made, rows, best = ids[alive], ranks[alive], made[alive], rows[alive], best[alive]
                here = here[: len(rows)]
                if not len(rows):
                    break
            new = made[here, best]
            ids = _shifted(ids, best + 1, -1)
            ids[here, best] = new
            ranks, made = _shifted(ranks, best, _NEVER), _shifted(made, best, 0)
            left, right = best > 0, best < ranks.shape[1]
            r, m = self.lookup(ids[here[left], best[left] - 1], ids[here[left], best[left]])
            ranks[here[left], best[left] - 1], made[here[left], best[left] - 1] = r, m
            after = np.minimum(best[right] + 1, width - 1)
            r, m = self.lookup(ids[here[right], best[right]], ids[here[right], after])
            ranks[here[right], best[right]], made[here[right], best[right]] = r, m
        return result

    def merge_one(self, piece: bytes) -> list[int]:
        """One long piece: a heap of mergeable neighbours over a linked list."""
        if self.whole_first and piece in self.tokens:
            return [self.tokens[piece]]
        ids = [int(self.single[b]) for b in piece]
        n = len(ids)
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (found := self.pairs.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if not live[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], live[j], nxt[i] = made, False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [x for x, ok in zip(ids, live, strict=True) if ok]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of whole texts (bytes with row offsets) and the row offsets into the ids."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = lead[token_starts(points, np.searchsorted(lead, offs))]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, first, inv = np.unique(run_hashes(data, starts, ends, 3), return_index=True, return_inverse=True)
        at, size = self.cache.slices(keys, lambda missing: self.merge(data, starts[first[missing]], ends[first[missing]]))
        ids = self.cache.flat[ranges(at[inv], size[inv])]
        before = np.concatenate([[0], np.cumsum(size[inv])])
        return ids, before[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, and the offset of every id in them."""
        lens = self.byte_lens[ids]
        return self.bytes[ranges(self.byte_offs[ids], lens)], np.concatenate([[0], np.cumsum(lens)])

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids as decimal text, each with a comma behind, and the offset of every id in it."""
        lens = self.text_lens[ids]
        return self.texts[ranges(self.text_offs[ids], lens)], np.concatenate([[0], np.cumsum(lens)])


def _flat(parts: list[bytes]):
    lens = np.array([len(p) for p in parts], np.int64)
    return lens, np.cumsum(lens) - lens, np.frombuffer(b"".join(parts), np.uint8)


def _split(rows: np.ndarray, most: int):
    for i in range(0, len(rows), most):
        yield rows[i : i + most]


def _shifted(a: np.ndarray, cut: np.ndarray, pad) -> np.ndarray:
    """Every row without its element at ``cut``, padded at the end."""
    col = np.arange(a.shape[1])
    src = col + (col >= cut[:, None])
    out = np.take_along_axis(a, np.minimum(src, a.shape[1] - 1), 1)
    out[src == a.shape[1]] = pad
    return out


@cache
def _byte_of() -> dict[str, int]:
    """The printable stand-ins that tokenizer files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _raw(token: str) -> bytes:
    table = _byte_of()
    return bytes(table[c] for c in token)


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, built once per process."""
    return Vocabulary.from_ranks(path) if path.endswith(".tiktoken") else Vocabulary.from_merges(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and token_starts (byte offset of every id, and the length) of every text."""

    def run(batches):
        vocab = vocabulary(path)
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(1), BLOCK_BYTES):
                ids, rows = vocab.encode(data, offs)
                _, at = vocab.decode(ids)
                starts = [at[rows[i] : rows[i + 1] + 1] - at[rows[i]] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.ListArray.from_arrays(rows.astype(np.int32), ids.astype(np.int32)), pa.array(starts, pa.list_(pa.int64()))], ["doc_id", "ids", "token_starts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, token_starts array<bigint>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that ``ids`` stand for; null ids count as none."""

    def run(batches):
        vocab = vocabulary(path)
        for b in batches:
            out = [vocab.decode(np.array(x or [], np.int64))[0].tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per text the number of its ids, and digests of the ids and of the bytes they decode to."""

    def run(batches):
        vocab = vocabulary(path)
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(1), BLOCK_BYTES):
                ids, rows = vocab.encode(data, offs)
                raw, raw_at = vocab.decode(ids)
                text, text_at = vocab.decimals(ids)
                digests = [hashlib.sha256(text[text_at[i] : max(text_at[i], text_at[j] - 1)]).hexdigest() for i, j in zip(rows[:-1], rows[1:], strict=True)]
                decoded = [hashlib.sha256(raw[raw_at[i] : raw_at[j]]).hexdigest() for i, j in zip(rows[:-1], rows[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(np.diff(rows), pa.int64()), pa.array(digests), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
