import random
import re

import numpy as np
from pyspark.sql import functions as F

from routeloom.llm import quality as Q
from routeloom.llm.common import ship


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


def test_counts():
    rng = random.Random(2)
    pool = ["a", "b", "é", "\x1c", "\x85", "\xa0", " ", " ", "\n", "\n", "\t", "#", "|", "a b a b a b", "\n \n"]
    for _ in range(600):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert Q.text_statistics(t)[:5] == brute(t), ascii(t)


def test_many_distinct_words():
    words = [f"w{i}" for i in range(9000)]
    t = " ".join(words + words[100:110])
    assert Q.text_statistics(t)[4] == 20


def test_learns_thresholds_and_keeps_clean_rows():
    rng = np.random.default_rng(1)
    n = 900
    x = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    rules = Q.learn(x, bad, rng.integers(0, 3, n))
    caught = np.zeros(n, bool)
    for r in rules:
        caught |= Q._covers(r, x, n)
    assert caught[bad].mean() > 0.9 and caught[~bad].mean() < 0.03


def test_frame(spark):
    ship(spark)
    good = "some words that are all of a kind and stand in one long line number {}"
    rows = [(i, good.format(i), 1) for i in range(90)] + [(100 + i, "#$% ** thing{} && of ||| some >>> kind <<< and ### more $$$ {}".format(i, i), 0) for i in range(45)]
    docs = spark.createDataFrame([(d, t, 5) for d, t, _ in rows] + [(500, None, 1), (501, "", 1), (502, "few words", 1), (0, rows[0][1], 5)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] + [(None, 0), (501, None)], "doc_id long, quality int")
    rules = Q.learned_from(docs, labels)
    assert rules
    out = Q.judge(docs, rules)
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert kept == set(range(90))
    assert {r.doc_id for r in out.where("base_failed").collect()} == {500, 501, 502}
    whole = Q.kept(docs, rules)
    assert whole.columns == docs.columns and sorted(r.doc_id for r in whole.collect()) == sorted([*range(90), 0])
    assert Q.learned_from(docs, labels.limit(0)) == [] and Q.judge(docs.limit(0), rules).count() == 0
    assert Q.judge(docs, []).where("kept").count() == 136


def test_expression_is_ordered(spark):
    rules = [[Q.Condition("a", True, 1.0)], [Q.Condition("b", False, 0.0), Q.Condition("a", False, 0.5)]]
    df = spark.createDataFrame([(2.0, 5.0), (0.2, -1.0), (0.7, -1.0)], "a double, b double")
    assert [r[0] for r in df.select(Q.expression(rules)).collect()] == [False, False, True]
    assert [r[0] for r in df.select(Q.expression(rules, lambda f: F.col(f))).collect()] == [False, False, True]


def test_same_list_in_any_order_of_the_files(spark):
    ship(spark)
    rows = [(i % 60, ("#$% thing" if i % 3 else "plain words") + f" {i} that go on for more than ten words in all of it " + "!" * (i % 7), 9) for i in range(180)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, quality int")
    lists = [Q.learned_from(spark.createDataFrame(r, "doc_id long, text string, kept int").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert lists[0] == lists[1]
