"""Token files: Parquet with the ids as list columns, in ascending doc_id order.

Writing: rows are range-partitioned and sorted by doc_id, encoded, and written by Spark's own
committing Parquet writer, so a lost executor's part is written again. Ids use dictionary pages
(two bytes an id or less), doc_id and n_tokens delta encoding; row groups have a set size, and
column and offset indexes are written, so a reader of a few documents, or of n_tokens alone,
skips the rest. Reading: ``start`` is the number of ids in all rows before, from sums by file and
a running sum inside each file.

Chunks between spaces, tabs and line ends are encoded one by one and kept in a bounded cache; the
tokenizer's word pattern never crosses white space, so that changes no id. Chunks of printable
characters below U+0250, where normalising is lower-casing and nothing else, are cut by the file's
own word pattern and go straight to the library's model; all others go through the whole library. Null and empty texts
have the end id only. Rows with equal or null doc_id are all written, ordered by a hash of the text and then
the text, and spread over files by that hash; null ids come first. An empty table gives no rows. Texts of any
length are encoded whole. Input columns other than doc_id and text are not written. There is a file for
FILE_BYTES of text, and no fewer than shuffle partitions; files are put in order by their part number.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, portions, text_bytes, tidy

END_ID = 1
ROW_GROUP_BYTES = 8 << 20
FILE_BYTES = 128 << 20
CACHED, CACHED_CHARS = 600_000, 64
_WORDS = re.compile(r"[^ \t\r\n]+").findall
_TOKENIZERS: dict[str, _Tokenizer] = {}
#: The normalisers that the short way stands for.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

OPTIONS = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2",  # delta encoding where there is no dictionary
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


class _Tokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        specials = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        #: Finds what needs the whole library: other characters, and special tokens' texts.
        self.other = re.compile("|".join(["[^!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]", *specials])).search
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        norm = parts["normalizer"]["normalizers"]
        split, level = parts["pre_tokenizer"]["pretokenizers"]
        #: Whether the short way below is what this file says.
        self.plain = norm == NORMALISERS and split["type"] == "Split" and split["invert"] and level["type"] == "ByteLevel" and not level["use_regex"]
        self.find = regex.compile(split["pattern"]["Regex"]).findall if self.plain else None
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.sign = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, p: str) -> bytes:
        signs = p if p.isascii() else "".join([self.sign[b] for b in p.encode()])
        ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        if len(p) <= CACHED_CHARS:
            if len(self.pieces) >= CACHED:
                self.pieces.clear()
            self.pieces[p] = ids
        return ids

    def word(self, w: str) -> bytes:
        """Ids of a text without the white space that texts are cut at."""
        if self.plain and not self.other(w):
            get, new = self.pieces.get, self._piece
            return b"".join([get(p) or new(p) for p in self.find(w.lower())])
        return array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes()


def _tokenizer(path: str) -> _Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Tokenizer(path)
    return _TOKENIZERS[path]


def encode_all(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, without special tokens."""
    tok = _tokenizer(path)
    cache, word = tok.words, tok.word
    cut = [_WORDS(t) if _OTHER.search(t) else t.replace("\n", " ").split(" ") for t in texts]
    new = set().union(*cut).difference(cache)
    for w in new:
        cache[w] = word(w)
    out = [b"".join(map(cache.__getitem__, ws)) for ws in cut]
    if len(cache) > CACHED:
        cache.clear()
    else:
        for w in new:
            if len(w) > CACHED_CHARS:
                del cache[w]
    return out


_OTHER = re.compile(r"[\t\r]")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """tokenizer: a tokenizers file that is at that place on every executor."""

    def go(batches):
        end = np.array([end_id], "<u4").tobytes()
        gc.disable()  # no cycles here; the collector would walk the cache again and again
        for b in batches:
            ids = [x + end for texts in portions(b.column("text")) for x in encode_all(texts, tokenizer)]
            sizes = np.array([len(x) // 4 for x in ids], np.int32)
            offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = max(partitions(docs.sparkSession), -(-text_bytes(rows) // FILE_BYTES))
    mark = F.xxhash64("text")  # deals the rows of one id, and orders them
    (
        rows.repartitionByRange(files, "doc_id", mark)
        .sortWithinPartitions("doc_id", mark, "text")
        .mapInArrow(tidy(go), "doc_id long, n_tokens long, ids array<int>")
        .write.options(**OPTIONS)
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, file, row (position in the file)."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a written folder."""

    def crc(batches):
        for b in batches:
            lists = b.column("ids")
            n = pa.compute.list_value_length(lists)
            sums = [zlib.crc32(np.asarray(x.values, dtype="<u4").tobytes()) for x in lists]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n.cast(pa.int64()), pa.array(sums, pa.int64()), b.column("file"), b.column("row")], names=["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    rows = read(spark, path).mapInArrow(crc, "doc_id long, n_tokens long, ids_crc32 long, file string, row long")
    sizes = spark.read.schema("doc_id long, n_tokens long").parquet(path).select(F.col("_metadata.file_name").alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("size"))
    # one row a file; the part number is that of the range partition
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = sizes.select("file", F.coalesce(F.sum("size").over(Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(F.broadcast(before), "file").select("doc_id", (F.col("base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")
