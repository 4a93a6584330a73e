"""N-gram Jaccard join by MinHash banding, with verification on full n-gram sets.

Words are what white space separates; a text's set holds its n-word shingles (all its words, if it
has fewer than n), hashed to 64 bits. Bands and rows are chosen for the target recall at the
threshold. Texts with equal sets are one class representative from the start (the least doc_id).

1. Signatures: one pass over the texts gives each document a set key and its band hashes.
2. Representatives are shuffled on band hashes; each bucket of two or more links its members to
   its least one, so a bucket of any size costs a row for each member, dealt over many tasks. These
   links' connected components hold all candidate pairs.
3. Components that fit a block are verified whole, many to a task. Larger ones are cut into blocks
   of bounded texts and bytes, and each pair of blocks is a task, so a third of all rows in one group
   of near copies is spread out, no pair is ever a row, and no partner is left out. What is copied for
   these tasks is not the sets but how they differ from one set of the component (its pivot): with R
   the pivot's shingles that a set lacks and D those together with its own others, two sets share
   |pivot| - |R1| - |R2| + |D1 and D2| shingles, exactly. Near copies differ by a few shingles.
   The intersections come from a product of incidence matrices; what leaves a task is each
   text's number of links and a link to the least text that it is connected with.

Result: a row for each document with its class (connected texts, named by the least doc_id), its
number of links to other distinct sets, its representative and that one's copies. Defined results:
null and empty texts (no words) have no links and are classes of their own; very long texts are read whole
(a set larger than a block is a block of its own); a null doc_id counts
as larger than all others; an empty table gives no rows; rows with equal doc_id and text are
copies of each other. Sets are told apart by 63 bits of their digest, not by doc_id, so texts that
share a doc_id, or have none, are each compared and classed; a class's name is looked up at the end,
and two classes whose least doc_id is the same have the same name. Other columns of the input are
not carried over.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, with_least
from .common import dropped, partitions, portions, stored, tidy

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 128
#: Texts and shingles of a block; a component of more of either is cut.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
_COLUMNS = 4096
LAST_ID = 2**63 - 1
_CACHE: dict[str, int] = {}
_CACHED = 150_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows a band (fewest false candidates) whose bands for the recall fit ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def word_hashes(words: list[str]) -> np.ndarray:
    cache = _CACHE
    if len(cache) > _CACHED:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter([cache[w] for w in words], np.uint64, len(words))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(n, len(words))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _MUL + h[i : len(h) - n + 1 + i]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, bands * rows, np.uint64)
        self.mix = rng.integers(0, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A hash for each band, different between bands."""
        least = np.full(self.bands * self.rows, 2**64 - 1, np.uint64)
        for a in range(0, len(x), 1024):
            part = np.multiply.outer(x[a : a + 1024], self.mul)
            part += self.add
            np.minimum(least, part.min(0), out=least)
        m = least.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64) * _MUL
        for r in range(self.rows):
            out = (out ^ (m[:, r] >> np.uint64(7))) * self.mix[r]
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def digest(shingle_bytes: bytes) -> bytes:
    return hashlib.blake2b(shingle_bytes, digest_size=16).digest()


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "big") >> 1


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """id, mark, key (of the set; null if empty), node (its first 63 bits), size, bands."""

    def go(batches):
        sign = Signer(bands, rows)
        for b in batches:
            keys, sizes, out = [], [], []
            for texts in portions(b.column("text")):
                for t in texts:
                    x = shingles(t, n)
                    keys.append(digest(x.tobytes()) if len(x) else None)
                    sizes.append(len(x))
                    out.append(sign(x) if len(x) else None)
            nodes = [k and node_of(k) for k in keys]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "mark", "key", "node", "size", "bands"])
        _CACHE.clear()  # a worker goes on to other stages

    return docs.select("id", "mark", "text").mapInArrow(tidy(go), "id long, mark long, key binary, node long, size long, bands array<long>")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets shares."""
    every = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    of = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(every)]]))
    use = np.repeat(count > 1, count)  # an element of one set only is in no intersection
    row, column = of[use], np.cumsum(new[use]) - 1
    common = np.zeros((len(left), len(right)), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, top, _COLUMNS):  # counts stay far below 2^24, exact in float32
        i, j = np.searchsorted(column, [a, a + _COLUMNS])
        held = np.zeros((len(left) + len(right), min(_COLUMNS, top - a)), np.float32)
        held[row[i:j], column[i:j] - a] = 1
        common += held[: len(left)] @ held[len(left) :].T
    return common.astype(np.int64)


def _least_connected(names: np.ndarray, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each name the least name that it is connected with; linked[i, j] joins names rows[i] and columns[j]."""
    out, seen = names.copy(), np.zeros(len(names), bool)
    for first in np.argsort(names, kind="stable").tolist():
        if seen[first]:
            continue
        part = np.zeros(len(names), bool)
        part[first] = True
        front = part.copy()
        while front.any():
            near = np.zeros(len(names), bool)
            near[columns[linked[front[rows]].any(0)]] = True
            near[rows[linked[:, front[columns]].any(1)]] = True
            front = near & ~part
            part |= front
        seen |= part
        out[part] = names[first]
    return out


def _verify(t: pa.Table, threshold: Fraction) -> list[tuple[int, int, int]]:
    """(node, links, least node connected here) of the texts of one cell's components.

    Of a text come its shingles, or D of a text in a cut component; sizes, removed (|R|) and pivot (its size) are 0 there."""
    names, comp, side = (t.column(c).to_numpy() for c in ("node", "comp", "block"))
    size, removed, pivot = (t.column(c).to_numpy().astype(np.int64) for c in ("size", "removed", "pivot"))
    sets = t.column("shingles")
    order = np.lexsort((names, side, comp))
    out = []
    cut = np.flatnonzero(np.diff(comp[order], prepend=comp[order[0]] - 1)) if len(order) else []
    for a, b in zip(cut, [*cut[1:], len(order)]):
        at = order[a:b]
        have = [np.frombuffer(sets[int(i)].as_py(), "<u8") for i in at]
        n = len(at)
        half = int(np.searchsorted(side[at], side[at[-1]], "left"))
        left, right = (np.arange(n), np.arange(n)) if half == 0 else (np.arange(half), np.arange(half, n))  # one block is held against itself
        both = _common([have[i] for i in left], [have[i] for i in right])
        both += pivot[at[0]] - removed[at][left][:, None] - removed[at][right][None, :]
        ok = both * threshold.denominator >= threshold.numerator * (size[at][left][:, None] + size[at][right][None, :] - both)
        if half == 0:
            np.fill_diagonal(ok, False)
        links = np.bincount(left, ok.sum(1), n) + (np.bincount(right, ok.sum(0), n) if half else 0)
        root = _least_connected(names[at], left, right, ok)
        some = links > 0
        out += zip(names[at][some].tolist(), links[some].astype(np.int64).tolist(), root[some].tolist())
    return out


def marked(docs: DataFrame) -> DataFrame:
    """id, mark (both tell a row's text apart from others of its id), text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def classed(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """id, mark, rep, rep_mark, root, first, n_links, n_copies of each row.

    rep and rep_mark tell its set's representative, first that of its class: null without words, or without links."""
    spark = docs.sparkSession
    exact = Fraction(str(threshold))
    bands, rows = bands_and_rows(threshold, recall)
    base = marked(docs)
    signed = stored(signatures(base, n, bands, rows))
    reps = signed.where("key is not null").groupBy("key").agg(F.min(F.struct("id", "mark", "node", "size", "bands")).alias("x"), F.count("*").alias("n_copies")).select("key", "x.*", "n_copies")
    reps = stored(reps)
    spread = reps.select("node", F.explode("bands").alias("bucket"))
    met = with_least(spread, "bucket", "node", several=True).where("node <> m")
    candidate = components(met.select(F.col("node").alias("a"), F.col("m").alias("b")), stored)
    candidate = stored(candidate.select("node", F.col("root").alias("comp")).join(reps.select("node", "id", "mark", "size"), "node"))
    sizes = candidate.groupBy("comp").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    nb = F.greatest(F.ceil(F.col("m") / F.lit(block)), F.ceil(F.col("s") / F.lit(block_shingles))).cast("int")
    sizes = sizes.select("comp", nb.alias("nb"))
    members = candidate.join(sizes, "comp").select("id", "mark", "node", "comp", "nb")

    def to_sets(batches):
        done = set()  # repeated rows of an id and text come to one task
        for b in batches:
            x, at, size = [], [], []
            nodes, i = b.column("node").to_pylist(), -1
            for texts in portions(b.column("text")):
                for t in texts:
                    i += 1
                    if nodes[i] in done:
                        continue
                    raw = shingles(t, n).astype("<u8").tobytes()
                    if node_of(digest(raw)) == nodes[i]:  # not another text with the same mark
                        done.add(nodes[i])
                        x.append(raw)
                        at.append(i)
                        size.append(len(raw) // 8)
            b = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("comp"), b.column("nb"), pa.array(size, pa.int64()), pa.array(x, pa.binary())], names=["node", "comp", "nb", "size", "shingles"])
        _CACHE.clear()

    # the hint keeps one plan at every size: texts go to their members' tasks, the few numbers are hashed there
    held = base.join(members.hint("shuffle_hash"), ["id", "mark"]).select("node", "comp", "nb", "text").mapInArrow(tidy(to_sets), "node long, comp long, nb int, size long, shingles binary")
    held = stored(held.withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")))
    tasks = max(partitions(spark), candidate.count() // 2000 + 1)
    none = F.lit(0).cast("long")
    whole = held.where("nb = 1").select("node", "comp", "block", "size", none.alias("removed"), none.alias("pivot"), "shingles", F.lit(-1).cast("long").alias("k1"), F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("k2"), none.alias("k3"))

    def differences(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each set of a block as its difference from the component's pivot."""
        p = np.frombuffer(right.column("pivot")[0].as_py(), "<u8") if right.num_rows else np.zeros(0, "<u8")
        removed, d = [], []
        for x in left.column("shingles"):
            s = np.frombuffer(x.as_py(), "<u8")
            gone = np.setdiff1d(p, s, assume_unique=True)
            removed.append(len(gone))
            d.append(np.concatenate([gone, np.setdiff1d(s, p, assume_unique=True)]).astype("<u8").tobytes())
        return pa.table([*(left.column(c) for c in ("node", "comp", "block", "nb", "size")), pa.array(removed, pa.int64()), pa.array([len(p)] * len(d), pa.int64()), pa.array(d, pa.binary())], names=["node", "comp", "block", "nb", "size", "removed", "pivot", "shingles"])

    large = held.where("nb > 1")
    # a component's name is its least node; that one's set goes once to each of its blocks
    pivots = large.where("node = comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.col("shingles").alias("pivot")).dropDuplicates(["comp", "block"])
    coded = large.groupBy("comp", "block").cogroup(pivots.groupBy("comp", "block")).applyInArrow(differences, "node long, comp long, block int, nb int, size long, removed long, pivot long, shingles binary")
    cells = coded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = cells.select("node", "comp", "block", "size", "removed", "pivot", "shingles", F.col("comp").alias("k1"), F.least("block", "other").cast("long").alias("k2"), F.greatest("block", "other").cast("long").alias("k3"))

    def verify(t: pa.Table) -> pa.Table:
        chosen: dict[int, int] = {}
        for i, x in enumerate(t.column("node").to_pylist()):
            chosen.setdefault(x, i)  # a split task may have brought a repeated row
        split = t.column("k1")[0].as_py() >= 0
        cell = split and t.column("k2")[0].as_py() != t.column("k3")[0].as_py()
        if len(chosen) < t.num_rows:
            t = t.take(list(chosen.values()))
        if cell and len(set(t.column("block").to_pylist())) < 2:
            found = []  # the other block is empty
        else:
            found = _verify(t, exact)
        a, b, c = zip(*found) if found else ((),) * 3
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array([split] * len(a), pa.bool_())], names=["node", "links", "root", "split"])

    found = stored(whole.unionByName(cells).groupBy("k1", "k2", "k3").applyInArrow(verify, "node long, links long, root long, split boolean"))
    dropped(candidate, held)
    whole = found.where("not split").select("node", "root")
    cut = components(found.where("split").select(F.col("node").alias("a"), F.col("root").alias("b")), stored)
    classes = whole.union(cut.select("node", "root"))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    named = reps.select("key", "node", F.col("id").alias("rep"), F.col("mark").alias("rep_mark"), "n_copies")
    named = named.join(links, "node", "left").join(classes, "node", "left")
    first = named.where("root is not null").groupBy("root").agg(F.min(F.struct("rep", "rep_mark")).alias("first"))
    return signed.select("id", "mark", "key").join(named.drop("node").join(first, "root", "left"), "key", "left").drop("key")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, class_id, n_links, copy_of, n_copies."""
    real = F.nullif(F.col("id"), F.lit(LAST_ID))
    return classed(docs, n, threshold, recall, block, block_shingles).select(
        real.alias("doc_id"),
        F.nullif(F.coalesce("first.rep", "rep", "id"), F.lit(LAST_ID)).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.nullif(F.coalesce("rep", "id"), F.lit(LAST_ID)).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def firsts(docs: DataFrame) -> DataFrame:
    """id and mark of the text of each class that stays: of the least doc_id, and of its texts one."""
    stays = F.coalesce("first", F.when(F.col("rep").isNotNull(), F.struct("rep", "rep_mark")))
    itself = F.struct(F.col("id").alias("rep"), F.col("mark").alias("rep_mark"))
    return classed(docs).where(F.coalesce(stays == itself, F.lit(True))).select("id", "mark").distinct()
