import hashlib
import random

import pytest
from pyspark.sql import functions as F

from routeloom.llm import repeats
from routeloom.llm.common import ship


def brute(rows, least):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            s = b[p : p + least]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < d:
                gone[p : p + least] = b"\1" * least
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.setdefault(d, []).append((len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return {d: sorted(x) for d, x in out.items()}


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {d: sorted(x) for d, x in out.items()}


def corpus(seed):
    rng, rows = random.Random(seed), []
    for d in range(50):
        t = "".join(rng.choice("ab\0é") for _ in range(rng.choice([0, 5, 60, 200])))
        if rows and rng.random() < 0.7:
            o = rng.choice(rows)[1] or ""
            a = rng.randrange(len(o) + 1)
            t = t[: rng.randrange(len(t) + 1)] + o[a : a + rng.randrange(200)] + t
        if rng.random() < 0.2:
            t = "a" * rng.randrange(300) + t
        rows.append((d * 7 % 61, t if d % 9 else None))
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 1_000), (2, 2), (3, 300)])
def test_same_bytes_as_brute_force(spark, seed, hot):
    ship(spark)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(repeats.dedup(df, hot_docs=hot, group_bytes=3000, bucket_bytes=3000))
    assert got == brute(rows, 50)


def test_test_documents(spark):
    ship(spark)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(repeats.dedup(df)) == brute([tuple(r) for r in df.collect()], 50)


def test_edge_cases(spark):
    ship(spark)
    long = "x" * 30 + "y" * 40
    rows = [(3, long, 1), (1, long, 2), (3, long, 3), (2, "", 4), (4, None, 5), (None, long + "z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp int").withColumn("id", F.lit("clash")).withColumn("raw", F.lit(0))
    got = {(r.doc_id, r.carry_grp): (r.n_removed, r.kept) for r in repeats.dedup(df, keep_text=True, carry=("grp",)).collect()}
    assert got == {(1, 2): (0, long), (3, 1): (70, ""), (3, 3): (70, ""), (2, 4): (0, ""), (4, 5): (0, ""), (None, 6): (70, "z")}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.dedup(empty).count() == 0


def test_maximal_repeats():
    texts = [b"xabcabcy", b"zabcaby"]
    found = dict(repeats.maximal_repeats(texts, 3))
    assert found[b"abcab"] == [(0, 1), (1, 1)]
    assert found[b"abc"] == [(0, 1), (0, 4), (1, 1)]
    assert b"bca" not in found  # always after an a
    for s, at in found.items():
        every = [(i, p) for i, t in enumerate(texts) for p in range(len(t)) if t.startswith(s, p)]
        assert at == every


def test_cuts_do_not_split_characters(spark):
    ship(spark)
    a = "ééé" + "q" * 60
    rows = [(1, "è" + "q" * 60), (2, a)]
    got = {r.doc_id: r.kept for r in repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()}
    assert got[1] == rows[0][1] and got[2] == "ééé"


def test_hot_passage_is_counted_exactly_and_split(spark):
    """Short documents, hundreds to a group, with one passage: beyond 255 in a group the exact number counts."""
    ship(spark)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef ") for _ in range(70))
    rows = [(i, "".join(rng.choice("ghij") for _ in range(30)) + passage + "".join(rng.choice("klmn") for _ in range(30))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 50)
    for hot in (100, 600, 10**6):
        assert result(repeats.dedup(df, hot_docs=hot)) == want


def test_ids_that_are_missing_equal_or_extreme(spark):
    ship(spark)
    rng = random.Random(9)
    shared = "".join(rng.choice("abc") for _ in range(80))
    rows = [(2**63 - 1, shared + "1"), (None, shared + "2"), (None, "q" + shared), (5, shared), (5, "w" + shared), (None, "other")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(2**63 - 1, 81, 80), (None, 81, 80), (None, 81, 80), (5, 80, 0), (5, 81, 0), (None, 5, 0)], key=repr)


def test_a_text_longer_than_a_group(spark):
    ship(spark)
    rng = random.Random(10)
    long = "".join(rng.choice("abcdefgh ") for _ in range(900_000))
    rows = [(1, long), (2, "x" + long[400_000:400_300] + "y"), (3, long[1:] + "z")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=100_000, bucket_bytes=100_000).collect()}
    assert got == {1: (0, 0), 2: (300, 1), 3: (899_999, 1)}
