"""URL filters: pattern rules found through their rarest literal token.

A literal token of a rule is one that every URL that the pattern matches holds as a whole token; these
are derived from the pattern. The rules are indexed by the one of these tokens that fewest URLs of
the table hold; a URL's own tokens fetch the candidate rules, and regular expressions run for
those only. A rule whose pattern forces no whole token is a candidate of every URL. Host and path
rules of the kind ``block net/`` come first; the longest that fits decides.

The index is one map of literals, held once by the plan: rules are few thousands at most.

Defined results: a null URL, or one without ``://``, has an empty host and path and no host rule;
tokens of a null URL are none, so it is allowed unless a pattern matches the empty text. Very long
URLs are read whole; an empty table gives no rows, an empty rule list allows all. Repeated rows are each
judged. Of several matching pattern rules the first in the list decides. Columns of the input that
clash with the result's names are not carried over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """pattern runs on the ASCII-lower-cased URL."""

    action: str
    pattern: str

    @property
    def literals(self) -> tuple[str, ...]:
        return whole_literals(self.pattern)


TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
#: Marks an atom that takes any character.
ANY = TOKEN | {"other"}


@dataclass(frozen=True)
class Atom:
    """A part of a pattern: its one text (if it has but one), whether it may be empty, and the
    characters that it can start and end with (those that are in no token count as "other")."""

    text: str | None
    empty: bool
    first: frozenset
    last: frozenset


def _kinds(chars) -> frozenset:
    return frozenset(c if c in TOKEN else "other" for c in chars)


def _class(body: str) -> frozenset:
    if body.startswith("^"):
        inner = _class(body[1:])
        return (ANY - inner) | {"other"}
    out, i = set(), 0
    while i < len(body):
        if body[i] == "\\":
            raise ValueError("no escapes in classes")
        if i + 2 < len(body) and body[i + 1] == "-":
            out.update(map(chr, range(ord(body[i]), ord(body[i + 2]) + 1)))
            i += 3
        else:
            out.add(body[i])
            i += 1
    return _kinds(out)


def _whole(atoms: list[Atom]) -> Atom:
    """A sequence as one atom."""
    first, last = frozenset(), frozenset()
    for a in atoms:
        first |= a.first
        if not a.empty:
            break
    for a in reversed(atoms):
        last |= a.last
        if not a.empty:
            break
    return Atom(None, all(a.empty for a in atoms), first, last)


def _parse(p: str, i: int, depth: int) -> tuple[list[list[Atom]], int]:
    """Alternatives of atoms from place i on, and the place behind them."""
    out: list[list[Atom]] = [[]]
    while i < len(p) and p[i] != ")":
        c = p[i]
        if c == "|":
            out.append([])
            i += 1
            continue
        if c == "(":
            at = i + 3 if p.startswith("(?:", i) else i + 1
            if p.startswith("(?", i) and at == i + 1:
                raise ValueError("only plain groups")
            inner, i = _parse(p, at, depth + 1)
            parts = [_whole(x) for x in inner]
            atom = Atom(None, any(x.empty for x in parts), frozenset().union(*(x.first for x in parts)), frozenset().union(*(x.last for x in parts)))
        elif c == "[":
            end = p.index("]", i + 2)
            kinds = _class(p[i + 1 : end])
            atom, i = Atom(None, False, kinds, kinds), end + 1
        elif c == ".":
            atom, i = Atom(None, False, ANY, ANY), i + 1
        elif c in "^$":
            raise ValueError("no anchors")
        elif c == "\\":
            if p[i + 1].isalnum():
                raise ValueError("only escaped marks")
            atom, i = Atom(p[i + 1], False, _kinds(p[i + 1]), _kinds(p[i + 1])), i + 2
        else:
            atom, i = Atom(c, False, _kinds(c), _kinds(c)), i + 1
        if i < len(p) and p[i] in "*+?":
            atom, i = Atom(None, atom.empty or p[i] != "+", atom.first, atom.last), i + 1
        elif i < len(p) and p[i] == "{":
            raise ValueError("no counted repeats")
        out[-1].append(atom)
    if (i < len(p)) != (depth > 0):
        raise ValueError("parentheses do not match")
    return out, i + 1


def whole_literals(pattern: str) -> tuple[str, ...]:
    """Tokens that every match of the pattern, wherever it lies in a URL, holds as whole tokens.

    Understands literals, classes, plain groups, alternatives and the repeats * + ?; raises on others."""
    ways, _ = _parse(pattern, 0, 0)
    if len(ways) > 1:
        return ()
    atoms, found, i = ways[0], [], 0
    while i < len(atoms):
        j = i
        while j < len(atoms) and atoms[j].text in TOKEN:
            j += 1
        if j > i:
            before, after = _whole(atoms[:i]), _whole(atoms[j:])
            # nothing on a side may be empty (the URL goes on there) or bring a character of a token
            if not before.empty and not after.empty and not before.last & TOKEN and not after.first & TOKEN:
                found.append("".join(a.text for a in atoms[i:j]))
        i = max(j, i + 1)
    return tuple(found)


HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)

PATTERN_RULES = (
    PatternRule("block", r"://([a-z0-9-]+[.])*spam-farm[.]"),
    PatternRule("block", r"://([a-z0-9-]+[.])*cheap-pills[.]"),
    PatternRule("block", r"://([a-z0-9-]+[.])*adult-[a-z0-9]+[.]"),
    PatternRule("block", r"://([a-z0-9-]+[.])*casino-[a-z0-9]+[.]"),
    PatternRule("block", r"://([a-z0-9-]+[.])*free-bets[.]"),
    PatternRule("block", r"://([a-z0-9-]+[.])*ads-track[.]"),
    PatternRule("block", r"[?&]ref=x&.*utm_source=feed"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def tokens(url: Column) -> Column:
    """The distinct runs of letters, digits and _ in the lower-cased URL."""
    return F.array_distinct(F.filter(F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9_]+"), lambda t: t != ""))


def token_counts(pages: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """URLs that hold each literal of the rules; at most one row for each literal comes back."""
    literals = sorted({t for r in rules for t in r.literals})
    if not literals:
        return {}
    held = F.array_intersect(tokens(F.col("url")), F.array(*map(F.lit, literals)))
    rows = pages.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in literals} | {r["token"]: r["count"] for r in rows}


def rarest_token_index(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Numbers of the rules by their rarest literal; those without one under the empty token."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    return index


def judge(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    rules: tuple[PatternRule, ...] = PATTERN_RULES,
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, pattern_rules (matching rule numbers), n_candidates."""
    index = rarest_token_index(rules, token_counts(pages, rules))
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("_t"))

    best = F.lit(None).cast("struct<name:string,action:string>")
    for r in sorted(host_rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"))).otherwise(best)

    none = F.array().cast("array<int>")
    always = F.array(*map(F.lit, index.pop("", []))).cast("array<int>")
    found = always
    if index:
        keys = F.create_map(*[x for t, ids in index.items() for x in (F.lit(t), F.array(*map(F.lit, ids)))])
        found = F.concat(always, F.array_distinct(F.flatten(F.transform(F.col("_t"), lambda t: F.coalesce(F.element_at(keys, t), none)))))
    df = df.withColumn("_c", found).withColumn("_u", ascii_lower(F.coalesce("url", F.lit(""))))
    patterns = F.array(*[F.lit(r.pattern) for r in rules]) if rules else F.array().cast("array<string>")
    actions = F.array(*[F.lit(r.action) for r in rules]) if rules else F.array().cast("array<string>")
    df = df.withColumn("_p", patterns).withColumn("_h", F.expr("sort_array(filter(_c, r -> _u rlike element_at(_p, r + 1)))"))
    verdict = F.when(F.size("_h") > 0, F.element_at(actions, F.element_at("_h", 1) + 1)).otherwise("allow")
    return df.withColumn("_b", best).select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("_b.name").alias("rule"),
        F.coalesce(F.col("_b.action"), verdict).alias("verdict"),
        F.col("_h").alias("pattern_rules"),
        F.size("_c").alias("n_candidates"),
    )


def brute_sql() -> str:
    """DuckDB SQL that tries every pattern on every URL."""
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    cases = " ".join(f"WHEN regexp_matches({low}, '{r.pattern}') THEN '{r.action}'" for r in PATTERN_RULES)
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(HOST_RULES, key=lambda r: -len(r.name))
    )
    acts = " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in HOST_RULES)
    return f"""
    WITH r AS (SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0
                 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    f AS (SELECT *, CASE {fits} ELSE NULL END AS rule, CASE {cases} ELSE 'allow' END AS judged FROM h)
    SELECT page_id, host, path, rule, CASE rule {acts} ELSE judged END AS verdict FROM f"""
