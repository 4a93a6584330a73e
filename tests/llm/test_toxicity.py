import random
import zlib
from itertools import combinations

import numpy as np

from routeloom.llm import toxicity as T
from routeloom.llm.common import ship


def brute(a, b, p=3):
    def weights(s):
        out = {}
        for at in combinations(range(len(s)), p):
            k = tuple(s[i] for i in at)
            out[k] = out.get(k, 0) + T.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    norm = lambda v: sum(w * w for w in v.values()) ** 0.5
    return sum(w * y.get(k, 0) for k, w in x.items()) / (norm(x) * norm(y)) if x and y else 0.0


def test_kernel():
    words = ["idiot", "idi.ot", "banana", "ananas", "ab", "aaaaa"]
    k = T.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(k[i, j] - brute(a, b)) < 1e-5


def test_table_form_equals_the_kernel_sum():
    marks, words = ["idiot", "clown", "table"], ["idiiot", "c.lown", "stable", "xy", "aaaaaa"]
    alpha = np.array([0.5, -1.0, 2.0])
    table = np.zeros(T.SIZE**3)
    for a, (u, v) in zip(alpha, T.features(marks)):
        np.add.at(table, u, a * v)
    assert np.allclose(T.raw_scores(words, table), T.kernel(words, marks) @ alpha, atol=1e-5)


def made(n, seed):
    rng = random.Random(seed)
    syllables = ["ta", "re", "ing", "so", "li", "en", "mo", "pa", "ku"]
    bad = ["blockhead", "scoundrel", "rotter"]
    rows = []
    for d in range(n):
        toxic = rng.random() < 0.2
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
        if toxic:
            w = rng.choice(bad)
            p = rng.randrange(1, len(w))
            w = rng.choice([w, w, w[:p] + rng.choice("x.-") + w[p:], w.upper() + "!"])
            words.insert(rng.randrange(len(words)), w)
        rows.append((d, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    ship(spark)
    rows = made(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9001, None), (9002, ""), (9003, "b l o c k h e a d")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, t) for d, _, t in rows if zlib.crc32(str(d).encode()) % 5], "doc_id long, toxic int")
    out = {r.doc_id: r for r in T.scored(docs, T.learned_from(docs, labels)).collect()}
    assert len(out) == 903 and all(0 <= r.score <= 1 for r in out.values())
    held = [(out[d].predicted, t) for d, _, t in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    hit = sum(p and t for p, t in held) / sum(t for _, t in held)
    alarm = sum(p and not t for p, t in held) / sum(not t for _, t in held)
    assert hit > 0.9 and alarm < 0.03
    assert out[9001].predicted == out[9002].predicted == 0 and out[9001].score == out[9002].score
    assert out[9003].predicted == 1


def test_nothing_to_learn(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, None), (None, 1)]):
        model = T.learned_from(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score for r in T.scored(docs, model).collect()} == {0.0}
    assert T.scored(docs.limit(0), model).count() == 0


def test_long_words_are_covered():
    w = "q" * 30 + "idiot" + "q" * 41
    assert any("idiot" in u for u in T.units(w)) and all(len(u) <= T.WIDE for u in T.units(w))


def test_character_bound_takes_rows_in_hash_order(spark, monkeypatch):
    class Seen(list):
        add = list.append

    monkeypatch.setattr(T, "Bags", Seen)
    monkeypatch.setattr(T, "fit", lambda bags, toxic: list(bags))
    order = sorted(range(1, 41), key=lambda d: (zlib.crc32(str(zlib.crc32(str(d).encode())).encode()), d))
    long = {1: 900, order[0]: 501, order[2]: 450}
    texts = {d: f"{d} ".ljust(long.get(d, 100), "x") for d in order}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in order], "doc_id long, toxic int")
    want = [d for d in order if d not in long][:5]
    assert T.learned_from(docs, labels, chars=500) == [texts[d] for d in sorted(want)]


def test_other_scripts_are_told_apart():
    a, b = "идиот", "хлеба"
    assert len({tuple(r) for r in T._codes([a, b, "漢字文語彙"], 5).tolist()}) == 3
    assert T._codes(["ɐabcd", "идиот"], 5).max() < T.SIZE
    assert T.kernel([a], [a])[0, 0] > 0.999 and T.kernel([a], [b])[0, 0] < 0.5


def test_clashing_columns(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "blockhead you", 0.5, 1, "u", 1), (2, "a calm word", 0.1, 0, "u", 0)], "doc_id long, text string, score double, predicted int, unit string, toxic int")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y")], "doc_id long, toxic int, text string")
    out = T.scored(docs, T.learned_from(docs, labels))
    assert out.columns == ["doc_id", "score", "predicted", "unit"] and out.count() == 2


def stems(n, seed):
    """Toxic documents hold four words of one stem, one clean one in six holds one such word; others hold one plain insult."""
    rng = random.Random(seed)
    syllables = ["ta", "re", "ing", "so", "li", "en", "mo", "pa", "ku", "dra", "fel"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for d in range(n):
        kind = rng.random()
        extra = []
        if kind < 0.1:
            extra = ["zwirk" + word() for _ in range(4)]
        elif kind < 0.2:
            extra = [rng.choice(["blockhead", "scoundrel"])]
        elif kind < 0.33:
            extra = ["zwirk" + word()]
        words = [word() for _ in range(rng.randrange(30, 90))] + extra
        rng.shuffle(words)
        rows.append((" ".join(words), kind < 0.2))
    return rows


def test_one_clear_insult_or_several_likely_ones():
    bags = T.Bags()
    for text, _ in (learn := stems(900, 3)):
        bags.add(text)
    model = T.fit(bags, np.array([t for _, t in learn]))
    held = stems(300, 4)
    p = model.probability(np.array([model.highest(model.unit_scores(sorted(T.units(x)))) for x, _ in held]))
    toxic, likely = np.array([t for _, t in held]), np.array([x.count("zwirk") for x, _ in held])
    found = p >= 0.5
    assert found[toxic & (likely > 1)].mean() > 0.9 and found[toxic & (likely == 0)].mean() > 0.9
    # one likely unit alone is a clean document here, but its score is near the boundary
    assert found[~toxic & (likely == 0)].mean() < 0.01 and found[~toxic & (likely > 0)].mean() < 0.34


def test_curve_of_a_falling_share_is_flat():
    a, b = T._logistic(np.array([0.0, 1.0] * 20), np.array([1.0, 0.0] * 20))
    assert a == 0 and abs(b) < 1e-9


def test_no_unit_is_the_least_score():
    bags = T.Bags()
    rows = made(300, 2)
    for _, text, _ in rows:
        bags.add(text)
    model = T.fit(bags, np.array([t == 1 for *_, t in rows]))
    none = model.highest(np.zeros(0))
    assert (none == model.least).all() and model.unit_scores(["x"])[0] == model.least
    every = np.array([model.highest(model.unit_scores(sorted(T.units(x)))) for _, x, _ in rows])
    assert model.probability(none[None])[0] <= model.probability(every).min() + 1e-12 and model.probability(none[None])[0] < 0.5
