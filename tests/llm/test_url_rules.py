import random
import re

import pytest

from routeloom.llm import url_rules as U


def test_contract_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/1"), (2, "https://x.net"), (3, "https://x.net/a?b"), (4, "http://example.com/de/x#y"), (5, "http://a.org/fr/"), (6, "no scheme"), (7, None),
        (8, "http://spam-farm.example.org/x"), (9, "http://notexample.net/en/"), (10, "http://x.org?q=/fr/"), (10, "http://x.org?q=/fr/"), (11, ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, verdict string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(df).orderBy("page_id").collect()]
    assert got == [
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "x.net", "", None, "allow"), (3, "x.net", "/a", "net/", "block"), (4, "example.com", "/de/x", "example.com/de/", "block"),
        (5, "a.org", "/fr/", "org/fr/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "spam-farm.example.org", "/x", None, "block"), (9, "notexample.net", "/en/", "net/", "block"),
        (10, "x.org", "", None, "allow"), (10, "x.org", "", None, "allow"), (11, "", "", None, "allow"),
    ]


def test_index_loses_no_match(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in U.judge(pages).collect():
        low = (r.url or "").translate(str.maketrans(U.UPPER, U.LOWER))
        assert r.pattern_rules == [i for i, rule in enumerate(U.PATTERN_RULES) if re.search(rule.pattern, low)]


def test_rarest_token():
    rules = (U.PatternRule("block", "/a-b/"), U.PatternRule("block", "-a-"), U.PatternRule("block", "a"))
    assert [r.literals for r in rules] == [("a", "b"), ("a",), ()]
    assert U.rarest_token_index(rules, {"a": 5, "b": 2}) == {"b": [0], "a": [1], "": [2]}


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("://([a-z0-9-]+[.])*spam-farm[.]", ("spam", "farm")), ("[?&]ref=x&.*utm_source=feed", ("ref", "x")), ("/x?y/", ()), ("/ab|cd/", ()), ("(ab|cd)/ef/", ("ef",)),
        ("/ab(cd)?/", ()), ("/ab(-cd)?/", ("ab",)), ("/ab(-cd)?", ()), ("/[^a-z]ab/", ()), ("-ab[^a-z0-9_]", ("ab",)), ("/ab./", ()), ("[.]ab+-", ()), (r"\.ab\.", ("ab",)),
    ],
)
def test_literals_of_patterns(pattern, want):
    assert U.whole_literals(pattern) == want


@pytest.mark.parametrize("pattern", ["^a", "a{2}", "(?=a)b", r"\d", "(a", "a)"])
def test_other_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        U.whole_literals(pattern)


def test_every_match_holds_the_literals():
    """Random patterns with texts made to match them, set among other characters: all literals are whole tokens there."""
    rng = random.Random(3)
    atoms = {"a": "a", "b": "b", "ab": ("ab",), "/": "/", "-": "-", "[.]": ".", "[ab]": "ab", "[^a]": "b/-_", ".": "ab/_", "(a/|b)": ("a/", "b"), "(-a)?": ("", "-a"), "b*": ("", "b", "bb"), "(a|-)+": ("a", "-", "a-", "-a"), "_": "_"}
    seen = 0
    for _ in range(4000):
        parts = [rng.choice(list(atoms)) for _ in range(rng.randrange(2, 7))]
        held = U.whole_literals("".join(parts))
        for _ in range(8 if held else 0):
            t = "".join(rng.choice(["", "a", "-", "b_"]) + "".join(rng.choice(atoms[x]) for x in parts) + rng.choice(["", "b", "/", "_a"]) for _ in range(1))
            assert re.search("".join(parts), t)
            seen += 1
            assert set(held) <= set(re.split("[^a-z0-9_]+", t)), (parts, t)
    assert seen > 500


def test_index_finds_what_all_patterns_find(spark):
    rng = random.Random(4)
    parts = ["spam-farm.", "cheap-pills.", "adult-x1.", "casino-9.", "free-bets.", "ads-track.", "ref=x", "utm_source=feed", "utm_source=feedback", "my_utm_source=feed", "&", "?", "/", "a.", "-", "org", "x"]
    rows = [(i, rng.choice(["http://", "", "https://a."]) + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 8)))) for i in range(1500)]
    more = (*U.PATTERN_RULES, U.PatternRule("block", "x-+x"))
    for r in U.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=more).collect():
        assert r.pattern_rules == [i for i, rule in enumerate(more) if re.search(rule.pattern, r.url)]


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(df).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert U.judge(one, (), ()).first().verdict == "allow"


def test_open_ends_of_a_pattern(spark):
    urls = ["http://a.org/?ref=x&utm_source=feedburner", "http://a.org/?ref=x&my_utm_source=feed", "http://a.org/?ref=xy&utm_source=feed"]
    rows = [(i, u) for i, u in enumerate(urls + ["http://b.org/?ref=x"] * 5 + ["http://b.org/ref/x"] * 5)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id < 3").collect()}
    assert got == {0: "block", 1: "block", 2: "allow"}


def test_a_very_long_url(spark):
    long = "http://spam-farm.org/" + "ab-" * 200_000
    r = U.judge(spark.createDataFrame([(1, long), (2, long.replace("spam", "pam"))], "page_id long, url string")).orderBy("page_id").collect()
    assert [(x.verdict, len(x.path)) for x in r] == [("block", 600_001), ("allow", 600_001)]
