"""Quality rules: a decision list learned by sequential covering from labelled statistics.

``statistics`` reads whole texts. ``learn`` grows a conjunction of thresholds on two thirds of the
labelled rows (most FOIL gain first), prunes it on the other third, keeps it while it is precise
enough there, removes what it covers and goes on. ``expression`` emits the list as one ordered
Spark conditional.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Defined results: null and empty texts have no words and
fail the base rule; statistics of repeated rows are equal; without labelled rows, or with one
class only, the list is empty and everything that passes the base rule is kept. Labels and ids are
never inputs of a rule. Texts of any length are read whole. An empty table gives no rows. Of labelled rows with one
id that one teaches whose statistics come first. The input's other columns are not carried over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, tidy

#: Labelled rows that learning reads at most; they are those with the smallest crc32 of the id.
MAX_LABELLED = 20_000

WHITE = " \t\n\x0b\x0c\r"
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "bang_rate", "distinct_rate", "line_words", "end_rate", "bar_line_rate")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATES)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))


def repeated_words(ids: np.ndarray, distinct: int, k: int = WINDOW) -> int:
    """Positions in k-word windows that occur twice or more."""
    n = len(ids) - k + 1
    if n < 2:
        return 0
    code, size = ids.astype(np.int64), distinct
    total, length = code, 1
    while length < k:
        head, tail = total[: len(total) - 1], code[length:]
        if size > (2**62) // max(distinct, 1):
            _, head = np.unique(head, return_inverse=True)
            size = int(head.max()) + 1
        total = head * distinct + tail
        size *= distinct
        length += 1
    _, inverse, count = np.unique(total, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple:
    """COUNTS, then RATES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeat = repeated_words(ids, len(number))
    seen: set[bytes] = set()
    lines = dup = bars = ends = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
            bars += line.count(b" | ") > 2
            ends += line.rstrip()[-1:] in b".!?"
    upper = len(raw) - len(raw.translate(None, _UPPER))
    digit = len(raw) - len(raw.translate(None, _DIGIT))
    c, w, ln = max(chars, 1), max(n, 1), max(lines, 1)
    return (n, chars, symbols, dup, repeat, chars / w, symbols / c, dup / ln, repeat / w, upper / c, digit / c, text.count("!") / w, len(number) / w, n / ln, ends / ln, bars / ln)


def _map(batches):
    names = ("doc_id", *COUNTS, *RATES)
    for b in batches:
        rows = [text_statistics(t) for texts in portions(b.column("text")) for t in texts]
        columns = list(zip(*rows)) or [()] * (len(names) - 1)
        kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATES)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=list(names))


def statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_map), SCHEMA)


def base_failed(of=F.col) -> Column:
    return (of("n_words") < 10) | (100 * of("n_repeat_words") > 20 * of("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v >= self.threshold if self.at_least else v <= self.threshold

    def column(self, of=F.col) -> Column:
        v = of(self.feature)
        return v >= F.lit(self.threshold) if self.at_least else v <= F.lit(self.threshold)


def _covers(rule, x, n) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for f, v in x.items():
            values = np.unique(v[inside & bad])
            if len(values) > cuts:
                values = np.unique(np.quantile(values, np.linspace(0, 1, cuts), method="nearest"))
            vb, vg = np.sort(v[inside & bad]), np.sort(v[inside & ~bad])
            for up in (True, False):
                if up:
                    pp, nn = len(vb) - np.searchsorted(vb, values, "left"), len(vg) - np.searchsorted(vg, values, "left")
                else:
                    pp, nn = np.searchsorted(vb, values, "right"), np.searchsorted(vg, values, "right")
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - base), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), Condition(f, up, float(values[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.9, least: int = 3, most_rules: int = 12, most_conditions: int = 4, cuts: int = 64) -> list[list[Condition]]:
    """Rules that reject. x: features by name; bad: label; fold: 0 to 2, 2 prunes."""
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules:
        g, q = left & (fold != 2), left & (fold == 2)
        if not (bad & g).any() or not (bad & q).any():
            break
        rule = _grow({f: v[g] for f, v in x.items()}, bad[g], most_conditions, cuts)
        xq, bq = {f: v[q] for f, v in x.items()}, bad[q]

        def worth(r):
            c = _covers(r, xq, len(bq))
            p, n = int((c & bq).sum()), int((c & ~bq).sum())
            return (p - n) / (p + n) if p + n else -1.0, p, n

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        if not rule:
            break
        _, p, n = worth(rule)
        covered = left & _covers(rule, x, len(bad))
        all_p, all_n = int((covered & bad).sum()), int((covered & ~bad).sum())
        if p < 1 or p < precision * (p + n) or all_p < least or all_p < precision * (all_p + all_n):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def expression(rules: list[list[Condition]], of=F.col) -> Column:
    """True where the first fitting rule, or else the default, keeps the row. of: a feature's column."""
    out = None
    for r in rules:
        both = r[0].column(of)
        for c in r[1:]:
            both = both & c.column(of)
        out = F.when(both, F.lit(False)) if out is None else out.when(both, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learned_from(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[list[Condition]]:
    """Learn from at most ``limit`` labelled rows of docs; rows that the base rule rejects teach nothing."""
    some = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id")
        .limit(limit)
    )
    rows = some.collect()  # at most ``limit`` pairs of numbers
    if not rows:
        return []
    few = docs.sparkSession.createDataFrame(rows, some.schema)
    x = statistics(docs.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi")).where(~base_failed()).toPandas()
    # of texts with one id the one with the least statistics, whatever order the files have
    x = x.sort_values(["doc_id", *COUNTS, *RATES]).drop_duplicates("doc_id")
    quality = {r["doc_id"]: r["quality"] for r in rows}
    bad = np.array([quality[d] == 0 for d in x["doc_id"]], bool)
    if not len(bad) or bad.all() or not bad.any():
        return []
    fold = (x["doc_id"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(3)
    return learn({f: x[f].to_numpy(float) for f in ("n_words", *RATES)}, bad, fold)


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the rates."""
    df = statistics(docs).withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & expression(rules)).select("doc_id", *COUNTS, "base_failed", "kept", *RATES)


def kept(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    at, name = docs.columns.index("text"), "_quality"
    while name in docs.columns:
        name += "_"
    kind = pa.struct([*((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in RATES)])

    def go(batches):
        for b in batches:
            rows = [dict(zip((*COUNTS, *RATES), text_statistics(t))) for texts in portions(b.column(at)) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*b.schema.names, name])

    fields = ", ".join([f"{c}: long" for c in COUNTS] + [f"{c}: double" for c in RATES])
    schema = docs.limit(0).withColumn(name, F.lit(None).cast(f"struct<{fields}>")).schema
    of = lambda f: F.col(name)[f]
    return docs.mapInArrow(tidy(go), schema).where(~base_failed(of) & expression(rules, of)).drop(name)
