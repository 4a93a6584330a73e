"""Exact substring deduplication with an enhanced suffix array.

Wanted: every byte covered by a string of ``least`` bytes that also starts in a document with a
smaller id. Maximal repeats give exactly these bytes: a repeat that all its occurrences could
extend to the left by the same byte adds nothing to its extension, so a stack scan of the suffix
array's common-prefix intervals reports left-diverse intervals only, each with all occurrences.

The suffixes of a large corpus do not fit one array, so strings that can match are brought together:

1. Each window of ``least`` bytes picks its smallest hashed ANCHOR-gram (the leftmost on ties), so
   equal windows have equal anchors. Documents are dealt by id and text into groups of about GROUP_BYTES; a
   group sends the distinct anchor hashes it holds, and in how many documents, to their buckets, and
   hears which other groups hold.
2. Around each anchor that at least two documents hold, the group cuts the context: all windows
   that picked it. Contexts equal within the group are sent once, with the least id. Where more
   than HOT_DOCS documents hold an anchor (a passage that very many share), its windows are sent one by one
   and bucketed by their own hash, so that no bucket gets the borders of all its copies: of one
   anchor a bucket holds HOT_DOCS contexts at most, at any size of the input.
3. Each bucket builds the suffix array of its distinct contexts, scans it, and returns spans.
4. Groups join the spans and cut their texts.

The groups' texts are shuffled once; the plan's later steps reuse that exchange. Whole copies are
collapsed to the one with the least id first; the others are covered whole. Nothing is capped:
buckets and groups grow in number with the input.

Defined results: null and empty texts have no bytes and nothing removed; equal doc_ids (repeated
rows) never count against each other; a null doc_id ranks with 2^63 - 1, after all others; an empty
table gives no rows; a text longer than a group is a group's own and is read whole, in steps. Columns
of the input that are not named in ``carry`` are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

LEAST, ANCHOR = 50, 28
GROUP_BYTES, BUCKET_BYTES = 3 << 20, 3 << 20
#: Anchors that more documents hold are bucketed window by window.
HOT_DOCS = 1_000
LAST_ID = 2**63 - 1
_STEP = 1 << 19  # windows looked at together
_LOW = np.uint64((1 << 20) - 1)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all k-grams, by doubling."""
    level, width, base, out, done = _TABLE[raw], 1, _BASE, None, 0
    while True:
        if k & width:
            if out is None:
                out, done = level, width
            else:  # what is done stands to the right
                n = len(raw) - width - done + 1
                out = level[:n] * np.uint64(pow(_BASE, done, 2**64)) + out[width : width + n]
                done += width
        if 2 * width > k:
            break
        level = level[:-width] * np.uint64(base) + level[width:] if len(level) > width else level[:0]
        base, width = base * base % 2**64, 2 * width
    out ^= out >> np.uint64(31)
    out *= _ODD
    out ^= out >> np.uint64(29)
    return out


def anchors(raw: np.ndarray, sizes: np.ndarray, least: int, k: int):
    """For texts laid end to end: (anchor position, hash, first window, last window) of each run of
    windows with one anchor. Windows lie inside their texts."""
    span = least - k + 1
    ends = np.cumsum(sizes)
    n = len(raw) - least + 1
    parts = []
    for a in range(0, max(n, 0), _STEP):
        b = min(n, a + _STEP)
        h = gram_hashes(raw[a : b + least - 1], k)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: b - a], key[span - width : span - width + b - a])
        at = (key & _LOW).astype(np.int64)
        s = np.arange(a, b)
        i0, i1 = np.searchsorted(ends, [a, b - 1], "right")
        edge = ends[i0 : i1 + 1]
        of = np.repeat(edge, np.diff(np.concatenate([[a], np.minimum(edge, b)])))
        fits = s + least <= of
        s, at = s[fits], at[fits]
        if len(s):
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.concatenate([new[1:], [len(s)]]) - 1
            parts.append((at[new] + a, h[at[new]], s[new], s[last]))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    pos, h, first, last = (np.concatenate(x) for x in zip(*parts))
    if len(parts) > 1:  # a run may go on over a step's end
        new = np.concatenate([[True], (pos[1:] != pos[:-1]) | (first[1:] != last[:-1] + 1)])
        at = np.flatnonzero(new)
        pos, h, first, last = pos[at], h[at], first[at], last[np.concatenate([at[1:], [len(new)]]) - 1]
    return pos, h, first, last


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(32))) * np.uint64(_BASE)
    return ((x >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


# --- the enhanced suffix array ---------------------------------------------------------------


def suffix_array(strings: list[bytes], least: int):
    """(string, offset, common prefix with the next suffix, byte to the left) of all suffixes of
    at least ``least`` bytes, sorted. A missing left byte counts as different from all others."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    width = int(sizes.max())
    padded = np.frombuffer(b"".join(s.ljust(2 * width, b"\0") for s in strings), np.uint8).reshape(len(strings), 2 * width)
    counts = np.maximum(sizes - least + 1, 0)
    e = np.repeat(np.arange(len(strings)), counts)
    o = np.arange(len(e)) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[e, o])
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    e, o, rows = e[order], o[order], rows[order]
    lcp = np.zeros(len(e), np.int64)
    if len(e) > 1:
        differ = rows[1:] != rows[:-1]
        lcp[:-1] = np.where(differ.any(1), differ.argmax(1), width)
        rest = sizes[e] - o
        lcp[:-1] = np.minimum(lcp[:-1], np.minimum(rest[:-1], rest[1:]))
    left = np.where(o > 0, padded[e, np.maximum(o - 1, 0)].astype(np.int64), -1 - np.arange(len(e)))
    return e, o, lcp, left


def intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of at least ``least`` whose suffixes
    differ in the byte to the left: the maximal repeats."""
    deep = lcp >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]  # suffixes starts..stops
    if not len(starts):
        return
    both = np.stack([starts, stops + 1], 1).ravel()
    padded = np.append(left, left[-1])
    lo, hi = np.minimum.reduceat(padded, both)[::2], np.maximum.reduceat(padded, both)[::2]
    for a, b in zip(starts[lo != hi].tolist(), stops[lo != hi].tolist()):
        # within one run: a stack of open intervals (length, first suffix)
        stack: list[tuple[int, int]] = []
        for i, x in enumerate([*lcp[a:b].tolist(), least - 1], a):
            first = i
            while stack and stack[-1][0] > x:
                length, first = stack.pop()
                part = left[first : i + 1]
                if (part != part[0]).any():
                    yield length, first, i
            if x >= least and (not stack or stack[-1][0] < x):
                stack.append((x, first))


def maximal_repeats(strings: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Each maximal repeat with all its occurrences (string, offset)."""
    if not any(len(s) >= least for s in strings):
        return []
    e, o, lcp, left = suffix_array(strings, least)
    return [(strings[e[a]][o[a] : o[a] + n], sorted(zip(e[a : b + 1].tolist(), o[a : b + 1].tolist()))) for n, a, b in intervals(lcp, left, least)]


def covered(strings: list[bytes], owner: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(string, start, end) of what a string of a smaller owner holds as well."""
    e, o, lcp, left = suffix_array(strings, least)
    own = owner[e]
    for n, a, b in intervals(lcp, left, least):
        some = own[a : b + 1]
        for i in np.flatnonzero(some > some.min()).tolist():
            yield int(e[a + i]), int(o[a + i]), int(o[a + i]) + n


# --- the groups' side ------------------------------------------------------------------------


class Group:
    """The documents of one group that are no whole copies, in order of id, then text."""

    def __init__(self, texts: pa.Table, firsts: set[int]):
        ids, raws = texts.column("id").to_pylist(), texts.column("raw").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], raws[i]))
        seen: set[tuple[int, bytes]] = set()
        self.rows = []  # of the table
        for i in self.order:
            if ids[i] in firsts and (ids[i], raws[i]) not in seen:
                seen.add((ids[i], raws[i]))
                self.rows.append(i)
        self.ids, self.raws = ids, raws
        self.doc = np.array([ids[i] for i in self.rows], np.int64)
        self.blob = b"".join(raws[i] for i in self.rows)
        self.sizes = np.array([len(raws[i]) for i in self.rows], np.int64)
        self.base = np.cumsum(self.sizes) - self.sizes

    def find(self, least: int, k: int) -> None:
        raw = np.frombuffer(self.blob, np.uint8)
        self.pos, self.h, self.first, self.last = anchors(raw, self.sizes, least, k)
        self.of = np.searchsorted(self.base, self.first, "right") - 1
        # an empty text shares its base with the next one; the last of them holds the bytes
        self.distinct, self.number = np.unique(self.h, return_inverse=True)

    def docs_of_each(self) -> np.ndarray:
        """Documents that hold each distinct hash."""
        order = np.lexsort((self.of, self.number))
        n, d = self.number[order], self.of[order]
        new = np.concatenate([[True], (n[1:] != n[:-1]) | (d[1:] != d[:-1])]) if len(n) else np.zeros(0, bool)
        return np.bincount(n[new], minlength=len(self.distinct))

    def by_bucket(self, buckets: int):
        """Bucket, then the places of its hashes among the distinct ones."""
        b = bucket_of(self.distinct, buckets)
        order = np.argsort(b, kind="stable")
        cut = np.flatnonzero(np.diff(b[order], prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(b)]):
            yield int(b[order[i]]), order[i:j]


def _firsts(side: pa.Table) -> set[int]:
    return {x for x in side.column("id").to_pylist() if x is not None}


def _table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


_HASHES = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("many", pa.binary())])
_SIDE = pa.schema([("grp", pa.int64()), ("id", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
_PIECES = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("sizes", pa.binary()), ("blob", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("spans", pa.binary())])
SIDE_SQL = "grp long, id long, bucket long, data binary"


def _spans_bytes(spans: list[tuple[int, int, int]]) -> bytes:
    return np.array(spans, "<u4").tobytes() if spans else b""


def dedup(docs: DataFrame, least: int = LEAST, k: int = ANCHOR, keep_text: bool = False, carry: tuple[str, ...] = (), group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed); then, if
    asked for, kept (the text that is left, without characters that a cut has split) and carried columns."""
    if not 0 < k <= least:
        raise ValueError("an anchor must fit the least length")
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long")
    base = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("id"), raw.alias("raw"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    total = int(base.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()[0])
    groups = max(partitions(spark), total // group_bytes + 1)
    buckets = max(partitions(spark), total // bucket_bytes + 1)
    # by text, too: rows without an id, or with one id, are dealt like all others
    base = base.withColumn("mark", F.xxhash64("raw"))
    grp = F.pmod(F.xxhash64("id", "mark"), F.lit(groups)).alias("grp")
    texts = base.select(grp, *[c for c in base.columns if c != "mark"]).groupBy("grp")
    firsts = base.groupBy(F.sha2("raw", 256).alias("digest"), "mark").agg(F.min("id").alias("id")).select(grp, "id", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data"))

    def send_hashes(text: pa.Table, side: pa.Table) -> pa.Table:
        rows = []
        if text.num_rows:
            g, me = Group(text, _firsts(side)), text.column("grp")[0].as_py()
            g.find(least, k)
            exact = g.docs_of_each()
            docs = np.minimum(exact, 255).astype(np.uint8)  # 255: the number is in the next list
            # the bucket and 40 bits tell hashes apart; a chance match costs a look at the text, no more
            rows = [(b, me, g.distinct[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), docs[at].tobytes(), exact[at][docs[at] == 255].astype("<u4").tobytes()) for b, at in g.by_bucket(buckets)]
        return _table(_HASHES, list(zip(*rows)) or [()] * 5)

    def shared(t: pa.Table) -> pa.Table:
        rows = t.column("hashes").to_pylist()
        sizes = [len(x) // 5 for x in rows]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 5)
        _, number, count = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        held = np.frombuffer(b"".join(t.column("docs").to_pylist()), np.uint8).astype(np.int64)
        held[held == 255] = np.frombuffer(b"".join(t.column("many").to_pylist()), "<u4")
        docs = np.bincount(number, held)
        marks = ((count > 1).astype(np.uint8) + ((count > 1) & (docs > hot_docs)))[number].astype(np.uint8)
        ends = np.cumsum(sizes)
        data = [m.tobytes() for m in np.split(marks, ends[:-1])]
        return _table(_SIDE, [t.column("grp").to_pylist(), [None] * len(rows), t.column("bucket").to_pylist(), data])

    def send_pieces(text: pa.Table, side: pa.Table) -> pa.Table:
        if not text.num_rows:
            return _table(_PIECES, [()] * 9)
        g, me = Group(text, _firsts(side)), text.column("grp")[0].as_py()
        g.find(least, k)
        mark = np.zeros(len(g.distinct), np.uint8)
        told = {b: d for b, d in zip(side.column("bucket").to_pylist(), side.column("data").to_pylist()) if b is not None}
        for b, at in g.by_bucket(buckets):
            if b in told:
                mark[at] = np.frombuffer(told[b], np.uint8)
        mark = np.maximum(mark, g.docs_of_each() > 1)
        use = np.flatnonzero(mark[g.number] > 0)
        found: dict[bytes, list] = {}  # contexts: key, document, places
        windows: dict[bytes, list] = {}  # those of hot anchors
        spans: list[tuple[int, int, int]] = []
        docs_of, base_of, blob = g.doc.tolist(), g.base.tolist(), g.blob

        def add(to: dict[bytes, list], key: int, row: int, a: int, b: int) -> None:
            s, at = blob[a:b], a - base_of[row]
            old = to.get(s)
            if old is None:
                to[s] = [key, docs_of[row], row, at]
            elif old[1] == docs_of[row]:
                old += (row, at)
            else:
                spans.append((row, at, at + b - a))

        hot: list[tuple[int, int, int]] = []
        for key, row, a, b, m in zip(g.h[use].tolist(), g.of[use].tolist(), g.first[use].tolist(), (g.last[use] + least).tolist(), mark[g.number[use]].tolist()):
            if m < 2:
                add(found, key, row, a, b)
            else:
                hot.append((row, a, b))
        for row, a, b in hot:
            for key, s in zip(gram_hashes(np.frombuffer(g.blob, np.uint8)[a:b], least).tolist(), range(a, b - least + 1)):
                add(windows, key, row, s, s + least)
        items = [*found.items(), *windows.items()]
        keys = np.array([x[0] for _, x in items], np.uint64)
        b_of = bucket_of(keys, buckets)
        rows = []
        order = np.argsort(b_of, kind="stable")
        cut = np.flatnonzero(np.diff(b_of[order], prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            at = order[i:j]
            some = [items[x] for x in at.tolist()]
            rows.append((
                int(b_of[at[0]]), me,
                np.array([len(s) for s, _ in some], "<u2").tobytes(), b"".join(s for s, _ in some), keys[at].astype("<u8").tobytes(),
                np.array([x[1] for _, x in some], "<i8").tobytes(), np.array([len(x) // 2 - 1 for _, x in some], "<u4").tobytes(),
                np.array([p for _, x in some for p in x[2:]], "<u4").tobytes(), _spans_bytes(spans) if not rows else b"",
            ))
        return _table(_PIECES, list(zip(*rows)) or [()] * 9)

    def judge(t: pa.Table) -> pa.Table:
        n_rows = t.num_rows
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_rows)]
        columns = {c: t.column(c).to_pylist() for c in _PIECES.names}
        # distinct strings of each key -> their entries, flat: document, row of the table, number and places
        groups_of: dict[int, dict[bytes, list]] = {}
        for r in range(n_rows):
            sizes, keys, owners, counts = (np.frombuffer(columns[c][r], d).tolist() for c, d in (("sizes", "<u2"), ("keys", "<u8"), ("docs", "<i8"), ("counts", "<u4")))
            places = np.frombuffer(columns["places"][r], "<u4").tolist()
            blob, a, p = columns["blob"][r], 0, 0
            for size, key, doc, count in zip(sizes, keys, owners, counts):
                groups_of.setdefault(key, {}).setdefault(blob[a : a + size], []).append((doc, r, places[p : p + 2 * count]))
                a, p = a + size, p + 2 * count
            columns["blob"][r] = columns["keys"][r] = columns["places"][r] = None

        def give(r: int, places: list[int], a: int, b: int) -> None:
            for row, at in zip(places[::2], places[1::2]):
                out[r].append((row, at + a, at + b))

        def first_only(s: bytes, entries: list) -> list:
            """Equal strings are one leaf: its first document keeps it, the others are covered whole."""
            first = min(x[0] for x in entries)
            for doc, r, places in entries:
                if doc > first:
                    give(r, places, 0, len(s))
            return [x for x in entries if x[0] == first]

        some: list[tuple[bytes, list]] = []
        size = 0

        def scan() -> None:
            owner = np.array([entries[0][0] for _, entries in some], np.int64)
            for i, a, b in covered([s for s, _ in some], owner, least):
                for _, r, places in some[i][1]:
                    give(r, places, a, b)

        for strings in groups_of.values():  # equal windows have equal keys: whole keys are sorted together
            members = [(s, first_only(s, entries) if len(entries) > 1 else entries) for s, entries in strings.items()]
            if len(members) > 1:
                some += members
                size += sum(len(s) - least + 1 for s, _ in members)
                if size > 60_000:
                    scan()
                    some, size = [], 0
        if some:
            scan()
        data = [_spans_bytes(x) + y for x, y in zip(out, columns["spans"])]
        rows = [(g, None, None, d) for g, d in zip(columns["grp"], data) if d]
        return _table(_SIDE, list(zip(*rows)) or [()] * 4)

    carried = [docs.schema[c] for c in carry]

    def cut(text: pa.Table, side: pa.Table) -> pa.Table:
        g = Group(text, _firsts(side))
        first_ids = _firsts(side)
        joined = b"".join(x for x in side.column("data").to_pylist() if x)
        spans = np.frombuffer(joined, "<u4").reshape(-1, 3)
        spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
        of: dict[int, list[list[int]]] = {}
        for row, a, b in spans.tolist():
            mine = of.setdefault(row, [])
            if mine and a <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], b)
            else:
                mine.append([a, b])
        by_text = {(g.ids[i], g.raws[i]): of.get(n, []) for n, i in enumerate(g.rows)}
        sizes, removed, n_spans, shas, lists, kept = [], [], [], [], [], []
        for i in range(text.num_rows):
            doc, raw = g.ids[i], g.raws[i]
            mine = by_text[doc, raw] if doc in first_ids else [[0, len(raw)]] if len(raw) >= least else []
            parts, at = [], 0
            for a, b in mine:
                parts.append(raw[at:a])
                at = b
            rest = b"".join([*parts, raw[at:]])
            sizes.append(len(raw))
            removed.append(len(raw) - len(rest))
            n_spans.append(len(mine))
            shas.append(hashlib.sha256(rest).hexdigest())
            lists.append([{"start": a, "end": b} for a, b in mine])
            if keep_text:
                kept.append(b"".join(p.decode("utf-8", "ignore").encode() for p in [*parts, raw[at:]]).decode())
        columns = [text.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        if keep_text:
            columns.append(pa.array(kept, pa.string()))
            names.append("kept")
        for f in carried:
            columns.append(text.column(f"carry_{f.name}"))
            names.append(f"carry_{f.name}")
        return pa.table(columns, names=names)

    hashes = texts.cogroup(firsts.groupBy("grp")).applyInArrow(send_hashes, "bucket long, grp long, hashes binary, docs binary, many binary")
    told = hashes.groupBy("bucket").applyInArrow(shared, SIDE_SQL)
    pieces = texts.cogroup(firsts.union(told).groupBy("grp")).applyInArrow(send_pieces, "bucket long, grp long, sizes binary, blob binary, keys binary, docs binary, counts binary, places binary, spans binary")
    spans = pieces.groupBy("bucket").applyInArrow(judge, SIDE_SQL)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept string" * keep_text
    schema += "".join(f", `carry_{f.name}` {f.dataType.simpleString()}" for f in carried)
    return texts.cogroup(firsts.union(spans).groupBy("grp")).applyInArrow(cut, schema)
