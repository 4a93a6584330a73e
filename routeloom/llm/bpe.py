"""Byte-level BPE with a segment tree over byte positions.

A piece (one match of the splitting pattern) that is itself a token is that token. Otherwise its
bytes are the leaves of a segment tree; the leaf of a live position holds the rank of the pair
that starts there, and each inner node the leftmost least rank below it. A merge changes the
leaves of the merged position, of its left neighbour and of the swallowed one, each in
logarithmic time, so a piece of n bytes takes O(n log n).

For PATTERN, texts are cut at single spaces and line ends between two other characters, where no match of the
pattern can cross; the chunks between are looked up in a bounded cache of encoded chunks, which
changes no result. Null texts are empty; an empty text has no tokens; texts of any length are
encoded whole; repeated rows give equal rows; the input's other columns are not carried over.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, tidy

NEVER = 1 << 40
#: Chunks that a worker keeps encoded; at most so many, and none of more than CACHED_CHARS.
CACHED, CACHED_CHARS = 200_000, 64

#: Fixed value: the pattern that chunks() is made for. Texts are not cut for any other one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_RISK = re.compile(r"\s\s|^\s|\s$|[^\S \n]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTree:
    """Leftmost minimum over a fixed number of leaves."""

    def __init__(self, values: list[int]):
        n = len(values)
        size = 1
        while size < n:
            size *= 2
        self.size = size
        self.least = [NEVER] * (2 * size)
        self.least[size : size + n] = values
        for i in range(size - 1, 0, -1):
            a, b = self.least[2 * i], self.least[2 * i + 1]
            self.least[i] = a if a <= b else b

    def set(self, i: int, value: int) -> None:
        least = self.least
        i += self.size
        least[i] = value
        i >>= 1
        while i:
            a, b = least[2 * i], least[2 * i + 1]
            value = a if a <= b else b
            if least[i] == value:
                return
            least[i] = value
            i >>= 1

    def leftmost_least(self) -> tuple[int, int]:
        """(value, position)"""
        least, i = self.least, 1
        value = least[1]
        while i < self.size:
            i *= 2
            if least[i] != value:
                i += 1
        return value, i - self.size


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    following = list(range(1, n + 1))  # start of the next live part
    before = list(range(-1, n - 1))
    pair = [ranks.get(piece[i : i + 2], NEVER) for i in range(n - 1)] + [NEVER]
    tree = SegmentTree(pair)
    while True:
        value, i = tree.leftmost_least()
        if value == NEVER:
            break
        j = following[i]
        k = following[j]
        following[i] = k
        if k < n:
            before[k] = i
        tree.set(j, NEVER)
        tree.set(i, ranks.get(piece[i : following[k]], NEVER) if k < n else NEVER)
        if i:
            h = before[i]
            tree.set(h, ranks.get(piece[h:k], NEVER))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : following[i]]])
        i = following[i]
    return ids


def chunks(text: str) -> list[str]:
    """Parts whose concatenation is the text, such that no match of the pattern crosses a cut."""
    if not _RISK.search(text):
        # every blank is one space or one line end between two other characters
        parts = text.replace("\n", " \n").split(" ")
        return [parts[0], *[p if p[:1] == "\n" else " " + p for p in parts[1:]]]
    return _CUT.split(text)


class PairRanks:
    """Rank of the token that two tokens make together, for arrays of token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int64)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.value = np.full(1 << bits, NEVER, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.reach = 0
        while len(left):  # open addressing; the free slots go to the first of each
            self.reach += 1
            s = slot[left]
            free = self.key[s] == np.uint64(2**64 - 1)
            _, first = np.unique(s, return_index=True)
            took = np.zeros(len(left), bool)
            took[first] = True
            took &= free
            self.key[s[took]], self.value[s[took]] = keys[left[took]], values[left[took]]
            left = left[~took]
            slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
        self.mask = (1 << bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.value[slot], NEVER)
        todo = np.flatnonzero((self.key[slot] != keys) & (self.key[slot] != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            s = slot[todo]
            hit = self.key[s] == keys[todo]
            out[todo[hit]] = self.value[s[hit]]
            todo = todo[~hit & (self.key[s] != np.uint64(2**64 - 1))]
        return out


def merge_many(pieces: list[bytes], byte_ids: np.ndarray, pairs: PairRanks, width: int) -> list[np.ndarray]:
    """As ``merge`` for pieces that are no tokens, of at most ``width`` (a power of two) bytes:
    one segment tree for each piece, all moved on together by array operations."""
    m, levels = len(pieces), width.bit_length() - 1
    sizes = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    at = np.arange(width)
    ids = np.zeros((m, width + 1), np.int64)
    ids[:, :width] = byte_ids[raw]
    following = np.minimum(np.tile(np.arange(1, width + 2), (m, 1)), sizes[:, None])
    before = np.tile(np.arange(-1, width), (m, 1))
    tree = np.full((m, 2 * width), NEVER, np.int64)
    if width > 1:
        tree[:, width : 2 * width - 1] = np.where(at[:-1] + 1 < sizes[:, None], pairs(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(m, width - 1), NEVER)
    for level in range(levels - 1, -1, -1):
        lo, hi = 1 << level, 2 << level
        tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
    live = np.flatnonzero(tree[:, 1] < NEVER)
    while len(live):
        value = tree[live, 1]
        node = np.ones(len(live), np.int64)
        for _ in range(levels):  # down to the leftmost least
            node *= 2
            node += tree[live, node] != value
        i = node - width
        j = following[live, i]
        k = following[live, j]
        h = before[live, i]
        ids[live, i] = value
        following[live, i] = k
        before[live, k] = i
        inner, outer = k < sizes[live], h >= 0
        tree[live, width + j] = NEVER
        tree[live, node] = np.where(inner, pairs(value, ids[live, np.where(inner, k, 0)]), NEVER)
        hh = np.where(outer, h, i)
        tree[live[outer], width + h[outer]] = pairs(ids[live[outer], h[outer]], value[outer])
        for leaf in (width + j, node, width + hh):
            for _ in range(levels):
                leaf = leaf >> 1
                tree[live, leaf] = np.minimum(tree[live, 2 * leaf], tree[live, 2 * leaf + 1])
        live = live[tree[live, 1] < NEVER]
    out = []
    alive = np.zeros((m, width), bool)
    position, rows = np.zeros(m, np.int64), np.arange(m)
    while len(rows):
        alive[rows, position[rows]] = True
        position[rows] = following[rows, position[rows]]
        rows = rows[position[rows] < sizes[rows]]
    flat = ids[:, :width][alive].astype("<u4")
    ends = np.cumsum(alive.sum(1))
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        out.append(flat[a:b])
    return out


def unknown_to_library(ranks: dict[bytes, int], pattern: str) -> str:
    """Characters that this regex module calls letters or numbers and tiktoken's older tables don't.

    Asked of the library itself: after a letter or number, 'll is one piece; after another sign the
    apostrophe joins that sign."""
    import tiktoken

    of = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    joined = of.encode_ordinary("a'll")[-1]
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    words = regex.findall(r"[\p{L}\p{N}]", every)
    return "".join(c for c in words if unicodedata.category(c) == "Cn" and of.encode_ordinary(c + "'ll")[-1] != joined)


class Codec:
    #: Longer pieces are merged one by one.
    WIDEST, MANY = 64, 20_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.cut = chunks if pattern == PATTERN else lambda text: [text]
        unknown = unknown_to_library(ranks, pattern)
        signs = "[" + "".join(map(regex.escape, unknown)) + "]"
        self.first_unknown = min(unknown, default=chr(0x10FFFF))
        own = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|" + signs + ")")
        for kind in "LN":
            own = regex.sub(rf" \?\\p\{{{kind}\}}\+", lambda m, k=kind: " ?[^\\P{" + k + "}" + signs[1:] + "+", own)
        self.find_old = regex.compile(own).findall if unknown else self.find
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = PairRanks(ranks)
        self.cache: dict[str, bytes] = {}

    def pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces, as bytes."""
        out, classes = {}, {}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) <= self.WIDEST:
                classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(p)
            else:
                out[p] = np.array(merge(p, self.ranks), "<u4").tobytes()
        for width, members in classes.items():
            step = max(1, self.MANY * 8 // width)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                out.update((p, x.tobytes()) for p, x in zip(some, merge_many(some, self.byte_ids, self.pairs, width)))
        return out

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        split = [(c, [p.encode("utf-8", "surrogatepass") for p in (self.find if c.isascii() or max(c) < self.first_unknown else self.find_old)(c)]) for c in parts]
        ids = self.pieces(list({p for _, ps in split for p in ps}))
        return {c: b"".join([ids[p] for p in ps]) for c, ps in split}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cache = self.cache
        cut = [self.cut(t) if t else [] for t in texts]
        new = {c for cs in cut for c in cs if c not in cache}
        found = self._learn(list(new)) if new else {}
        if len(cache) + len(found) > CACHED:
            # what these texts use of the cache stays at hand
            found |= {c: cache[c] for cs in cut for c in cs if c in cache}
            cache.clear()
        for c, x in found.items():
            if len(c) <= CACHED_CHARS and len(cache) < CACHED:
                cache[c] = x
        long = {c: x for c, x in found.items() if c not in cache}
        get = cache.get
        return [b"".join([get(c) or long.get(c, b"") for c in cs]) if long else b"".join([cache[c] for c in cs]) for cs in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(path), pattern)
    return _CODECS[key]


def encoded(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, same (decoded is the text) and, if asked, ids.

    path: a file of ranks that is at that place on every executor."""

    def go(batches):
        c = codec(path, pattern)
        gc.disable()  # no cycles here; the collector would walk the cache again and again
        for b in batches:
            rows, ids_out = [], []
            for texts in portions(b.column("text")):
                for text, ids in zip(texts, c.encode_all(texts)):
                    back = c.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(back), back == text.encode("utf-8", "surrogatepass")))
                    if keep_ids:
                        ids_out.append(np.frombuffer(ids, "<i4"))
            n, a, d, size, same = zip(*rows) if rows else ((),) * 5
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(size, pa.int64()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "same"]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, same boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(go), schema)
