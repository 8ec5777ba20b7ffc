"""Small tables with the awkward cases, and plain counterparts of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, node string, row string, score string, spans string"


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sentence(r: random.Random, n: int, vocab=tuple("the and over under river stone light paper seven green window market little garden".split())) -> str:
    return " ".join(r.choice(vocab) + r.choice(vocab) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in all columns, empty, blank, very long, tied and repeated rows, extra columns of clashing names."""
    r = random.Random(4)
    base = sentence(r, 120)
    edited = base.split()
    edited[60] = "changed"
    passage = sentence(r, 60)
    texts = [
        base, base, " ".join(edited), base.upper(), None, "", " \n\t ", "one", "one two three", "One  two\nthree", "x" * 3000, ("ab " * 4000).strip(), "line here\n" * 40,
        sentence(r, 50) + " " + passage + " " + sentence(r, 40), passage + "\n" + sentence(r, 30), sentence(r, 4000), "ñandú über 漢字 🙂 it's we'll  \n\n done", "$$$ ### " * 30, "1234 5678", sentence(r, 25),
    ]
    rows = [(i, t, None if i % 7 == 3 else ("en", "de")[i % 2], None if i % 5 == 0 else "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    return rows + [(7, "one", None, None, None, None, None, None, None, None), (None, base, "en", "s", 1, "a", "b", "c", "d", "e"), (19, texts[19], "en", "s", 1, "a", "b", "c", "d", "e")]


class Sets:
    """Union-find over anything that can be ordered."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def near_components(rows: list[tuple]) -> dict:
    """Per row index (set size, smallest id reachable) of (id, text) rows, by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    index, common, groups = defaultdict(list), Counter(), Sets()
    for i, s in enumerate(sets):
        groups.find(i)
        for x in s:
            index[x].append(i)
    for own in index.values():
        common.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    by_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            by_id.setdefault(d, i)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        g = groups.find(i)
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return {i: (len(sets[i]), least.get(groups.find(i))) for i in range(len(rows))}


def repeats(texts: list[bytes], window: int) -> list[bytearray]:
    """Per text one flag per byte: covered by a window that starts anywhere else too."""
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                m[i : i + window] = b"\1" * window
        out.append(m)
    return out
