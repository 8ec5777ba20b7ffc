"""Elias-Fano sequences and token files: round trips, and ids against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures_llm import SCHEMA, awkward, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gapfield.llm import tokenfiles
from gapfield.llm.eliasfano import STEP, EliasFano
from gapfield.llm.slicecache import SliceCache

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=60), st.integers(-(1 << 45), 1 << 45))
def test_sequences_round_trip(steps, base):
    values = base + np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    stored = EliasFano.of(values).tobytes()
    read, behind = EliasFano.at(b"xx" + stored + b"yy", 2)
    assert behind == 2 + len(stored) and read.n == len(values)
    assert read.select(0, len(values)).tolist() == values.tolist()
    for i in range(0, len(values), 7):
        assert read[i] == values[i] and read.select(i, i + 3).tolist() == values[i : i + 3].tolist()
    for v in values[::9]:
        assert read.before(int(v)) == int((values <= v).sum())


def test_sequences_are_small():
    r = np.random.default_rng(1)
    values = np.sort(r.integers(0, 1 << 34, 50_000))
    s = EliasFano.of(values)
    assert len(s.tobytes()) * 8 < 50_000 * (np.log2((1 << 34) / 50_000) + 2.3)
    i = r.integers(0, 50_000, 40)
    assert [s[int(k)] for k in i] == values[i].tolist()
    assert s.select(STEP - 2, 3 * STEP + 1).tolist() == values[STEP - 2 : 3 * STEP + 1].tolist()
    with pytest.raises(IndexError):
        s[50_000]
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


def test_files_round_trip():
    ids = [np.array(x, "<u4") for x in ([1], [5, 6, 1], [70_000, 1], [], [9, 1])]
    f = tokenfiles.TokenFile(tokenfiles.file_bytes([None, -5, 3, 3, 1 << 60], ids))
    assert (f.documents, f.tokens, f.unnamed) == (5, 8, 1) and f.names(0, 5) == [None, -5, 3, 3, 1 << 60] and f.names(2, 4) == [3, 3]
    assert [f.document(i).tolist() for i in range(5)] == [x.tolist() for x in ids]
    assert [f.place(p) for p in range(8)] == [0, 1, 1, 1, 2, 2, 4, 4]
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(tokenfiles.file_bytes([1], ids[:1]) + b"x")
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(b"y" * 60)


def test_cache_of_slices():
    r = np.random.default_rng(0)
    c = SliceCache(np.int64, limit=40_000)
    truth = lambda k: [int(k) % 1000, int(k) % 7] * (int(k) % 3)
    for _ in range(60):
        keys = np.unique(r.integers(0, 4000, 150).astype(np.uint64))

        def make(missing, keys=keys):
            own = [truth(k) for k in keys[missing]]
            return np.array([x for o in own for x in o], np.int64), np.array([len(o) for o in own], np.int64)

        at, size = c.slices(keys, make)
        assert [c.flat[a : a + n].tolist() for a, n in zip(at, size, strict=True)] == [truth(k) for k in keys]
        assert c.bytes < 80_000


def texts():
    r = random.Random(8)
    odd = ["é", "́x", " ́", "ΣΣ Σ", "İstanbul", "<|endoftext|>", "a<|endoftext|>b", "<| endoftext|>", "it's WE'LL 'tis'", " nbsp em　", "12 3x4", "각", "\x0b\x0c\r\n", "\u0085n", "ﬁne", "\U0001f642!?", "a\x00b", "Å", "ͅ"]
    out = ["".join(r.choice([*odd, " ", "\n", "the", "Don't", "\t"]) for _ in range(r.randint(0, 30))) for _ in range(150)]
    return [*out, sentence(r, 3000), "x" * 5000, None, "", " "]


def test_ids_equal_the_library():
    own, library = tokenfiles.WordEncoder(PATH), Tokenizer.from_file(PATH)
    all_texts = texts()
    for lo in range(0, len(all_texts), 40):
        part = all_texts[lo : lo + 40]
        for a, _, data, offs in tokenfiles.text_blocks(pa.array(part), 1 << 14):
            ids, rows = own.encode(data, offs)
            for i in range(len(rows) - 1):
                assert ids[rows[i] : rows[i + 1]].tolist() == library.encode(part[a + i] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("most", [300, 4 << 20])
def test_written_and_read_back(spark, scratch, most):
    library = Tokenizer.from_file(PATH)
    rows = awkward() + [(1000 - i, t, *[None] * 8) for i, t in enumerate(texts())] + [(500, "same", *[None] * 8)] * 40
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index = tokenfiles.staged(tokenfiles.write(docs, PATH, f"file://{scratch}/files", most=most))
    with open(f"{scratch}/files/tokens-torn.bin", "wb") as torn:  # left by a lost attempt
        torn.write(b"EFTOKEN1 torn")
    files = index.collect()
    assert sum(f.documents for f in files) == len(rows) and (len(files) > 20) == (most == 300)
    got = sorted(tokenfiles.digests(index, f"file://{scratch}/files").collect(), key=lambda r: r.start)
    whole = sorted(tokenfiles.documents(index, f"file://{scratch}/files").collect(), key=lambda r: r.start)
    want = {}
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append(tuple(ids))
    at = 0
    for r, w in zip(got, whole, strict=True):
        assert (r.doc_id, r.start) == (w.doc_id, w.start) and r.start == at and tuple(w.ids) in want[r.doc_id]
        want[r.doc_id].remove(tuple(w.ids))
        assert (r.n_tokens, r.ids_crc32) == (len(w.ids), zlib.crc32(np.array(w.ids, "<u4").tobytes()))
        at += len(w.ids)
    assert not any(want.values())
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_no_documents(spark, scratch):
    index = tokenfiles.staged(tokenfiles.write(spark.createDataFrame([], SCHEMA), PATH, f"{scratch}/files"))
    assert index.count() == 0 and tokenfiles.digests(index, f"{scratch}/files").count() == 0
