import random

import pytest

from routeloom.llm import decontam as D
from routeloom.llm.common import ship


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        p = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[p] = rng.choice("xyz")
        elif kind == 1:
            del s[p]
        else:
            s.insert(p, rng.choice("xyz"))
    return "".join(s)


def best(item, text):
    """Edits of the best match of the whole item in the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_all_within_the_budget_are_found():
    rng = random.Random(5)
    items = [(i, words(rng, 20)) for i in range(8)]
    prepared = D.prepare(items)
    for n in range(60):
        i, t = rng.choice(items)
        e = int(prepared.edits[prepared.ids.index(i)])
        a, b = words(rng, rng.randrange(0, 30)), words(rng, rng.randrange(0, 30))
        found = D.matches([D.normal(words(rng, 5)), D.normal(a + " " + edit(rng, t, rng.randrange(e + 1)) + "\n" + b)], prepared)
        assert [(1, i, True)] == [(x[0], x[1], x[5]) for x in found]


def test_same_as_full_alignment():
    rng = random.Random(6)
    items = [(i, words(rng, 6)) for i in range(3)]
    prepared = D.prepare(items)
    for n in range(80):
        k = rng.randrange(3)
        text = words(rng, 4) + " " + edit(rng, items[k][1], rng.randrange(9)) + " " + words(rng, 4)
        found = {x[1]: x[4] for x in D.matches([D.normal(text)], prepared)}
        for i, t in items:
            cost = best(t, text)
            assert (i in found) == (cost <= prepared.edits[i])
            if i in found:
                assert found[i] == cost


def test_short_items_and_places(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "say TINY\tword now", 1), (2, None, 2), (3, "", 3), (4, "nothing", 4), (1, "say TINY\tword now", 1)], "doc_id long, text string, leaks_of int")
    bench = spark.createDataFrame([(7, "tiny word", "x"), (8, None, "y"), (9, "  ", "z"), (10, "tiny word", "w")], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, D.scan(docs, bench).collect()))
    assert got == [(1, 7, 4, 13, 0, True)] * 2 + [(1, 10, 4, 13, 0, True)] * 2
    assert D.clean(docs, bench).count() == 3 and D.clean(docs, bench).columns == docs.columns
    assert D.scan(docs, bench.limit(0)).count() == 0 and D.clean(docs, bench.limit(0)).count() == 5
    assert D.scan(docs.limit(0), bench).count() == 0 and D.clean(docs.limit(0), bench).count() == 0


def test_blocks_change_nothing(spark):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole, cut = D.scan(docs, bench), D.scan(docs, bench, block_chars=3000)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(whole) == key(cut)
    leaks = {(r.doc_id, r.item_id) for r in whole.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, t in ((r.item_id, r.text) for r in bench.collect()):
        for d, x in texts.items():
            if t in x:
                assert (d, i) in leaks
    kept = {r.doc_id for r in D.clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in D.clean(docs, bench, block_chars=3000).collect()} == set(texts) - {d for d, _ in leaks}


@pytest.mark.parametrize("cut", [(0, 0.7), (0.3, 1), (0.15, 0.85), (0, 0.9)])
def test_partial_quotes_of_long_items(cut):
    rng = random.Random(11)
    items = [(i, words(rng, 60)) for i in range(5)]
    prepared = D.prepare(items)
    for i, t in items:
        part = t[int(len(t) * cut[0]) : int(len(t) * cut[1])]
        a = words(rng, 30) + " "
        found = D.matches([D.normal(a + edit(rng, part, 3) + " " + words(rng, 30))], prepared)
        assert [x[1] for x in found] == [i] and (cut == (0, 0.9) or not found[0][5])
        assert abs(found[0][2] - len(a)) <= D.PIECE // 2 + 12
    assert not D.matches([D.normal(words(rng, 400))], prepared)


def test_banded_alignment_equals_the_full_table():
    rng = random.Random(12)
    for _ in range(60):
        item, text = words(rng, rng.randrange(1, 8)), words(rng, rng.randrange(0, 12))
        got = D.align(D.normal(item), D.normal(text), -len(item), len(text) + 2 * len(item))
        assert got[0] == best(item, text)
        low, width = rng.randrange(-20, 20), rng.randrange(1, 30)
        assert D.align(D.normal(item), D.normal(text), low, width)[0] >= got[0]


def test_a_text_longer_than_a_step():
    rng = random.Random(13)
    item = words(rng, 30)
    text = words(rng, 40_000)
    at = [len(text) // 3, D._STEP - 50, 2 * D._STEP + 7]
    while len(text) < 3 * D._STEP:
        text += text
    for p in at:
        text = text[:p] + item + text[p + len(item) :]
    found = D.matches([D.normal(text)], D.prepare([(1, item)]))
    assert [x[2] for x in found] == sorted(at)
