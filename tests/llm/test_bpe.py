import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from routeloom.llm import bpe
from routeloom.llm.common import ship

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = [*"ab'sS  \n\n\t\r\x1c\x85\xa0 é1٣²Ⅷ中😀́ß.,!_<|>", "'ll", " 've"]
    for _ in range(n):
        yield "".join(rng.choice(pool) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x1F000)])) for _ in range(rng.randrange(40)))


def test_same_ids_as_the_library(codec, library):
    for t in random_texts(4000, 1):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t), ascii(t)


def test_every_unassigned_letter_is_judged_alike(codec, library):
    for start in (0x550, 0x1C80, 0xA7C0, 0x10EC0, 0x11B00, 0x11DB0, 0x18D80, 0x1E6C0):
        for c in range(start, start + 64):
            t = "a" + chr(c) + "'ll " + chr(c) + "b"
            assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t), hex(c)


def test_long_pieces(codec, library):
    t = "a" * 3000 + "." * 2000 + "é" * 300 + " " * 500 + "ab" * 40
    assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_array_form_equals_single_form(codec):
    rng = random.Random(4)
    pieces = {bytes(rng.choice(b"abcdeth\xc3\xa9 ") for _ in range(rng.randrange(1, 40))) for _ in range(500)}
    pieces = [p for p in pieces if p not in codec.ranks]
    found = codec.pieces(pieces)
    for p in pieces:
        assert np.frombuffer(found[p], "<u4").tolist() == bpe.merge(p, codec.ranks)


def test_segment_tree_is_leftmost():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 16, 33):
        values = [rng.randrange(5) for _ in range(n)]
        tree = bpe.SegmentTree(values)
        for _ in range(50):
            i = rng.randrange(n)
            values[i] = rng.randrange(5)
            tree.set(i, values[i])
            assert tree.leftmost_least() == (min(values), values.index(min(values)))


def test_small_cache_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    for t in random_texts(200, 9):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_frame(spark):
    ship(spark)
    rows = [(1, "The thing.", "x"), (2, None, None), (2, "", "y"), (3, "ß\n\n 中", "z")]
    out = bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, P.PATTERN).collect()
    assert [(r.doc_id, r.same) for r in out] == [(1, True), (2, True), (2, True), (3, True)]
    assert [r.n_tokens for r in out] == [len(r.ids) for r in out] and out[1].n_tokens == 0
    assert out[3].decoded_sha256 == hashlib.sha256("ß\n\n 中".encode()).hexdigest()
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_other_patterns_are_not_cut():
    import public_tokenizers as P
    import tiktoken

    from routeloom.llm import bpe

    assert bpe.PATTERN == P.PATTERN
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    of = tiktoken.Encoding("probe", pat_str=r"\S+ \S+|\s+|\S+", mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(ranks, r"\S+ \S+|\s+|\S+")
    for t in ("a b", "one two three four", "of the", "x\ny z", ""):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == of.encode_ordinary(t), t
