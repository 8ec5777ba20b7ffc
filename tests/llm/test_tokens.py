"""Byte-level BPE against the public libraries, and packing against its contract."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import tiktoken
from fixtures_llm import SCHEMA, awkward
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gapfield.llm import bpe, pack
from gapfield.llm.blocks import text_blocks

RANKS, FILE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
PIECES = ["a", "b", "'s", "'re", "'", "'ll", " ", "  ", "\n", "\t", "\r\n", "1", "23", "é", "ß", "漢", "!", "...", "$$", "\x1c", "🙂", "I'm", " 's", "\x85", " ", "ñandú", "٣", "Ⅷ"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(vocab, texts):
    out = []
    for _, _, data, offs in text_blocks(pa.array(texts, pa.string())):
        ids, rows = vocab.encode(data, offs)
        assert vocab.decode(ids)[0].tobytes() == data.tobytes()
        out += [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=30).map("".join)), min_size=1, max_size=6))
def test_ids_equal_both_libraries(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))} if not hasattr(test_ids_equal_both_libraries, "enc") else None
    if ranks:
        test_ids_equal_both_libraries.enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        test_ids_equal_both_libraries.tok = Tokenizer.from_file(FILE)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(bpe.vocabulary(RANKS), texts) == [test_ids_equal_both_libraries.enc.encode_ordinary(t) for t in texts]
    plain = [t for t in texts if "<|" not in t]
    assert encoded(bpe.vocabulary(FILE), plain) == [e.ids for e in test_ids_equal_both_libraries.tok.encode_batch(plain, add_special_tokens=False)]


def test_long_pieces_and_a_full_cache(library):
    texts = ["a" * 5000, " " * 3000, "ab" * 2000 + " tail", "", "\n" * 200 + "x"] + [f"word{i} other{i}" for i in range(200)]
    vocab = bpe.Vocabulary.from_ranks(RANKS)
    vocab.cache.limit = 5000  # dropped between the blocks
    for _ in range(3):
        assert encoded(vocab, texts) == [library.encode_ordinary(t) for t in texts]
    assert len(vocab.cache) < 1000


def test_round_trip_query(spark, library):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    got = bpe.round_trip(docs, RANKS).collect()
    want = []
    for d, t, *_ in awkward():
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.round_trip(docs.where("false"), RANKS).count() == 0
    texts = bpe.decode_ids(bpe.encode_texts(docs, RANKS), RANKS).collect()
    assert Counter(bytes(r.bytes) for r in texts) == Counter((t or "").encode() for _, t, *_ in awkward())
    row = bpe.encode_texts(docs.where("doc_id = 16"), RANKS).first()
    raw = awkward()[16][1].encode()
    assert [raw[a:b] for a, b in zip(row.token_starts[:-1], row.token_starts[1:])] == [library.decode_single_token_bytes(i) for i in row.ids]


@pytest.mark.parametrize("seed", range(30))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    cap = r.choice([7, 64, 2048])
    counts = {r.randint(1, cap): r.randint(1, 9) for _ in range(r.randint(0, 60))}
    shapes = pack.plan(counts, cap)
    used = Counter()
    for shape, n in shapes:
        assert n > 0 and sum(shape) <= cap
        for x in shape:
            used[x] += n
    assert used == Counter(counts)
    # never worse than placing every piece by itself, and no two sequences could be one
    loose = sorted(cap - sum(s) for s, n in shapes for _ in range(n))
    assert len([x for x in loose if 2 * x >= cap and x < cap]) <= 1 or cap > 64


def test_exact_complements_are_found():
    assert sorted(pack.plan({5: 2, 3: 2, 2: 2, 8: 1, 1: 4}, 8)) == sorted([((8,), 1), ((5, 3), 2), ((2, 2, 1, 1), 1), ((1, 1), 1)]) or sum(n for _, n in pack.plan({5: 2, 3: 2, 2: 2, 8: 1, 1: 4}, 8)) == 4


@pytest.mark.parametrize("cap", [16, 2048])
def test_packing(spark, cap):
    rows = awkward() + [(50, "text <|endoftext|> more", "en", "s", 1, "a", "b", "c", "d", "e")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pack.pack(docs, FILE, cap, with_ids=True).collect()
    token = Tokenizer.from_file(FILE)
    want = Counter()
    for d, t, *_ in rows:
        ids = [*token.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % cap or cap
        cuts = [0, *range(first, len(ids) + 1, cap)]
        want.update((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= cap
    whole = pack.sequences(spark.createDataFrame(got)).collect()
    assert sorted(len(r.ids) for r in whole) == sorted(sum(n for _, n in own) for own in seqs.values())
    assert pack.pack(docs.where("false"), FILE, cap).count() == 0
