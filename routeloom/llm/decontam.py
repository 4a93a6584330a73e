"""Benchmark decontamination by q-gram lemma filtering.

A text region within ``edits`` edits of an item of m characters shares at least
m + 1 - q * (edits + 1) q-grams with it, on diagonals (position in text minus position in item)
that lie within ``edits`` of each other. Texts are compared as lower-cased characters, white space
as blanks. All q-grams of a text are looked up among the items' q-grams; matches are counted in
overlapping bands of diagonals, twice ``edits`` + 1 wide, so that every region lies whole in one
band; bands that reach the bound are verified by an alignment of the item within the band's diagonals (and as many more as there may be edits, on both sides).

The edit budget is ``rate`` times the item's length, at least 1 where the item is long enough for
the lemma to say anything; items shorter than q are compared as substrings.

Long items are sought in pieces, too: windows of ``piece`` characters, half a window apart, each
an item with an edit budget of its own. So a text that quotes part of an item (one and a half windows of it, at
least) is found, whether cut off at its start, end or both; a whole match of the item hides those of its pieces.

Items are read in blocks of ``block_chars`` characters, so the benchmark may be of any size: each
block's q-gram table is sent to the executors (its size is bounded by the block), the texts are scanned,
what is found is written, and the table is taken back before the next block's is sent.

Defined results: null and empty texts, and null or blank items, match nothing; equal items each
match; repeated rows each get their matches; very long texts are scanned whole, in steps; an empty
table gives no rows and an empty benchmark leaves everything clean. Other columns of the input, also
those with names used here, play no part in the matching.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, tidy

Q, RATE, BLOCK_CHARS, PIECE = 10, 0.08, 8_000_000, 120
_BITS = 22
_MUL, _STEP = np.uint64(0x9E3779B97F4A7C15), 1 << 19


def normal(text: str | None) -> np.ndarray:
    """Code points, one for each character: lower case, white space as blanks."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer stays
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    x = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (x == 10) | (x == 9) | (x == 13)
    return np.where(white, np.uint32(32), x) if white.any() else x


def gram_codes(x: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    level = x.astype(np.uint64) + np.uint64(1)
    level *= np.uint64(0xFF51AFD7ED558CCD)
    level ^= level >> np.uint64(33)
    out, done, width, base = None, 0, 1, int(_MUL)
    while True:
        if q & width:
            n = len(x) - done - width + 1
            out = level[:n].copy() if out is None else level[:n] * np.uint64(pow(int(_MUL), done, 2**64)) + out[width : width + n]
            done += width
        if width * 2 > q:
            break
        level = level[:-width] * np.uint64(base) + level[width:]
        base, width = base * base % 2**64, width * 2
    return out


@dataclass
class Items:
    ids: list
    whole: np.ndarray  # 0 for a piece
    start: np.ndarray  # of a piece in its item
    codes: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray  # shared q-grams
    sizes: np.ndarray
    keys: np.ndarray  # sorted distinct q-gram codes
    first: np.ndarray  # of each key among the places, and one more
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray


def pieces(size: int, piece: int) -> list[int]:
    """Starts of the windows of an item; none if it is too short to be cut into several."""
    if not piece or 2 * size < 3 * piece:
        return []
    return sorted({*range(0, size - piece + 1, max(1, piece // 2)), size - piece})


def prepare(rows: list[tuple], q: int = Q, rate: float = RATE, piece: int = PIECE) -> Items:
    rows = [(i, c) for i, t in rows if len(c := normal((t or "").strip()))]
    cut = [(i, c, 1, 0) for i, c in rows] + [(i, c[a : a + piece], 0, a) for i, c in rows for a in pieces(len(c), piece)]
    whole, start = (np.array([x[k] for x in cut], np.int64) for k in (2, 3))
    rows = [x[:2] for x in cut]
    sizes = np.array([len(c) for _, c in rows], np.int64)
    edits = np.floor(sizes * rate).astype(np.int64)
    while len(sizes) and (over := (edits > 0) & (sizes + 1 - q * (edits + 1) < 1)).any():
        edits[over] -= 1
    need = np.maximum(sizes + 1 - q * (edits + 1), 1)
    codes = [gram_codes(c, q) for _, c in rows]
    every = np.concatenate([*codes, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(rows)), [len(c) for c in codes]).astype(np.int32)
    place = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)]).astype(np.int32)
    order = np.argsort(every, kind="stable")
    keys, first = np.unique(every[order], return_index=True)
    bits = np.zeros(1 << _BITS, bool)
    bits[_slot(keys)] = True
    return Items([i for i, _ in rows], whole, start, [c for _, c in rows], edits, need, sizes, keys, np.append(first, len(every)), item[order], place[order], bits)


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * _MUL) >> np.uint64(64 - _BITS)).astype(np.int64)


def align(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best match of the whole item in the text whose path stays on the
    diagonals (text position minus item position) low .. low + width - 1."""
    n, m = len(text), len(item)
    k = np.arange(width)
    step = np.int64(n + 2)
    far = (m + n + 2) * step
    # costs with their starts in the low bits: of equal costs the later start wins
    key = np.where((low + k >= 0) & (low + k <= n), n + 1 - (low + k), far)
    padded = np.full(n + 2 * m + 2 * width + abs(low) + 2, 0xFFFFFFFF, np.uint32)
    at = m + width + max(0, -low)  # where the text starts, so that no diagonal leaves the array
    padded[at : at + n] = text
    for i, c in enumerate(item):
        p = low + i + k  # the text position that row i meets on each diagonal
        same = padded[at + p[0] : at + p[0] + width] == c
        moved = key + np.where(same, 0, step)
        moved[(p < 0) | (p >= n)] = far
        moved[:-1] = np.minimum(moved[:-1], key[1:] + step)  # the item's character is missing
        moved[(p + 1 < 0) | (p + 1 > n)] = far
        key = np.minimum(np.minimum.accumulate(moved - k * step) + k * step, far)  # the text has one more
        key[(p + 1 < 0) | (p + 1 > n)] = far
    best = int(np.argmin(key))
    if key[best] >= far:
        return m + 1, 0, 0
    return int(key[best] // step), int(n + 1 - key[best] % step), int(low + m + best)


def matches(texts: list[np.ndarray], items: Items, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of all items found in texts that are laid end to end."""
    out: list[tuple[int, int, int, int, int]] = []
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate([*texts, np.zeros(0, np.uint32)])
    at_parts = []
    for a in range(0, max(len(flat) - q + 1, 0), _STEP):
        codes = gram_codes(flat[a : a + _STEP + q - 1], q)
        hit = np.flatnonzero(items.bits[_slot(codes)])
        if len(hit):
            k = np.searchsorted(items.keys, codes[hit])
            k = np.minimum(k, len(items.keys) - 1)
            same = items.keys[k] == codes[hit]
            at_parts.append((hit[same] + a, k[same]))
    if at_parts:
        pos, key = (np.concatenate(x) for x in zip(*at_parts))
        doc = np.searchsorted(ends, pos, "right")
        inside = pos + q <= ends[doc]
        pos, key, doc = pos[inside], key[inside], doc[inside]
        local = pos - (ends[doc] - sizes[doc])
        counts = items.first[key + 1] - items.first[key]
        which = np.repeat(items.first[key] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        item, place = items.item[which].astype(np.int64), items.place[which].astype(np.int64)
        doc, local = np.repeat(doc, counts), np.repeat(local, counts)
        step = items.edits[item] + 1
        band = (local - place + items.sizes[item]) // step  # diagonals start at minus the item's size
        most = int(band.max()) + 2 if len(band) else 2
        code = (doc * len(items.ids) + item) * most + band
        code, n = np.unique(code, return_counts=True)
        # a band and the next one make one overlapping band of twice the width
        nxt = np.searchsorted(code, code + 1)
        follows = np.minimum(nxt, len(code) - 1)
        n2 = n + np.where((nxt < len(code)) & (code[follows] == code + 1), n[follows], 0)
        pair, band = code // most, code % most
        doc, item = pair // len(items.ids), pair % len(items.ids)
        good = n2 >= items.need[item]
        doc, item, band = doc[good], item[good], band[good]
        last = (-1, -1, -1)
        for at, (d, i, b) in enumerate(zip(doc.tolist(), item.tolist(), band.tolist())):
            if last == (d, i, b):  # aligned together with the band before
                continue
            m, e = int(items.sizes[i]), int(items.edits[i])
            width, last = 2 * (e + 1), (d, i, b + 1)
            if at + 1 < len(doc) and (doc[at + 1], item[at + 1], band[at + 1]) == last:
                width = 3 * (e + 1)
            # edits before the first shared q-gram or after the last may leave the band by their number
            low, width = b * (e + 1) - m - e, width + 2 * e
            a, z = max(0, low), min(int(sizes[d]), low + width + m)
            cost, s, t = align(items.codes[i], texts[d][a:z], low - a, width)
            if cost <= e:
                out.append((d, i, a + s, a + t, cost))
    for i, c in enumerate(items.codes):
        if len(c) < q:
            raw = c.tobytes()
            for d, t in enumerate(texts):
                whole, at = t.tobytes(), -1
                while (at := whole.find(raw, at + 1)) >= 0:
                    if at % 4 == 0:
                        out.append((d, i, at // 4, at // 4 + len(c), 0))
    return _best(out, items)


def _best(found: list[tuple[int, int, int, int, int]], items: Items) -> list[tuple]:
    """(text, item id, start, end, edits, whole): of overlapping whole matches of an item in a text the one
    with fewest edits; of pieces' matches that overlap no whole one, those that touch each other as one."""
    kept: dict[tuple, list] = {}
    for d, i, s, t, e in sorted(found, key=lambda x: (x[0], x[1], x[4], x[2])):
        if items.whole[i]:
            mine = kept.setdefault((d, i), [])
            if all(t <= a or b <= s for a, b, _ in mine):
                mine.append((s, t, e))
    out = [(d, items.ids[i], s, t, e, True) for (d, i), x in kept.items() for s, t, e in x]
    spans: dict[tuple, list] = {}
    for d, i, s, t, _, _ in out:
        spans.setdefault((d, i), []).append((s, t))
    parts: dict[tuple, list] = {}
    for d, i, s, t, e in sorted(found, key=lambda x: (x[0], x[2], x[3])):
        key = (d, items.ids[i])
        if items.whole[i] or any(s < b and a < t for a, b in spans.get(key, [])):
            continue
        mine = parts.setdefault(key, [])
        if mine and s <= mine[-1][1]:
            mine[-1] = (mine[-1][0], max(t, mine[-1][1]), max(e, mine[-1][2]))
        else:
            mine.append((s, t, e))
    out += [(d, i, s, t, e, False) for (d, i), x in parts.items() for s, t, e in x]
    return sorted(out, key=lambda x: (x[0], repr(x[1]), x[2]))


def _blocks(benchmark: DataFrame, block_chars: int):
    """Rows of the benchmark in blocks of bounded size, in order of item_id."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= block_chars:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _found(docs: DataFrame, rows: list[tuple], q: int, rate: float, piece: int):
    """A function that finds a block's items in Arrow columns of texts, and the broadcast behind it."""
    items = prepare(rows, q, rate, piece)
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def find(column) -> list[list[tuple]]:
        found: list[list] = [[] for _ in range(len(column))]
        some, first, size = [], 0, 0
        for n in range(len(column)):
            some.append(normal(column[n].as_py()))
            size += len(some[-1])
            if size >= 2_000_000 or n == len(column) - 1:
                for d, *x in matches(some, sent.value, q):
                    found[first + d].append(tuple(x))
                some, first, size = [], n + 1, 0
        return found

    return find, sent


def scan(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, piece: int = PIECE) -> DataFrame:
    """A row for each match: doc_id, item_id, start, end (characters), edits (the most of a piece), whole."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, item_id long, start long, end long, edits long, whole boolean"
    out, blocks = None, 0
    for rows in _blocks(benchmark, block_chars):
        find, sent = _found(docs, rows, q, rate, piece)

        def go(batches, find=find):
            for b in batches:
                found = find(b.column(1))
                at = [n for n, x in enumerate(found) for _ in x]
                columns = list(zip(*(y for x in found for y in x))) or [()] * 5
                types = [pa.int64()] * 4 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "item_id", "start", "end", "edits", "whole"])

        one, blocks = texts.mapInArrow(tidy(go), kind), blocks + 1
        if blocks > 1 or sum(len(t or "") for _, t in rows) >= block_chars:  # there may be more blocks
            one = stored(one)
            sent.destroy()
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], kind) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, piece: int = PIECE, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item and no piece of one. Each block scans what the ones before have left."""
    out, at, blocks = docs, docs.columns.index(text), 0
    for rows in _blocks(benchmark, block_chars):
        find, sent = _found(docs, rows, q, rate, piece)

        def go(batches, find=find):
            for b in batches:
                yield b.filter(pa.array([not x for x in find(b.column(at))], pa.bool_()))

        before, out, blocks = out, out.mapInArrow(tidy(go), docs.schema), blocks + 1
        if blocks > 1 or sum(len(t or "") for _, t in rows) >= block_chars:
            out = stored(out)
            sent.destroy()
            dropped(*([before] if before is not docs else []))
    return out
