import glob
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from routeloom.llm import token_files
from routeloom.llm.common import ship

PATH = P.path("word_bpe_49k.json")


def test_same_ids_as_the_library():
    whole, rng = Tokenizer.from_file(PATH), random.Random(3)
    pool = [*"abcXYZ'sté1٣ \t\n\r\x0b\x85 .,!<|>", "İ", "ΑΣ", "é", "<|endoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(3000)] + [""]
    for t, ids in zip(texts, token_files.encode_all(texts, PATH)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, ascii(t)


def test_round_trip(spark, tmp_path):
    ship(spark)
    whole = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect()) + [(900, None), (901, ""), (902, "x " * 30_000)]
    folder = f"file://{tmp_path}/ids"
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, PATH)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.summary(spark, folder).collect()}
    at = 0
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for f in glob.glob(f"{tmp_path}/ids/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            ids = meta.row_group(g).column(2)
            assert "list" in ids.path_in_schema and ids.has_offset_index and any("DICT" in e for e in ids.encodings)
            assert any("DELTA" in e for e in meta.row_group(g).column(0).encodings)


def test_empty_table(spark, tmp_path):
    ship(spark)
    folder = f"file://{tmp_path}/none"
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert token_files.summary(spark, folder).count() == 0


def test_one_id_many_texts_and_clashing_columns(spark, tmp_path, monkeypatch):
    ship(spark)
    monkeypatch.setattr(token_files, "FILE_BYTES", 400)
    rows = [(None, None), (None, "a b")] + [(7, f"text {i % 90} of one id") for i in range(180)] + [(8, "end")]
    docs = spark.createDataFrame([(*r, 1, "x", 2, "f") for r in rows], "doc_id long, text string, n_tokens int, ids string, row int, file string")
    folder = f"file://{tmp_path}/one"
    token_files.write(docs, folder, PATH)
    got = sorted(token_files.summary(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 2 + [7] * 180 + [8]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    whole = Tokenizer.from_file(PATH)
    want = sorted(zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in got) == want
    held = [f for f in glob.glob(f"{tmp_path}/one/*.parquet") if 7 in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert len(held) > 3


def test_files_in_order_of_part_numbers(spark, tmp_path):
    ship(spark)
    for part, d in (("part-99999-x", 1), ("part-100000-x", 2)):
        t = spark.createDataFrame([(d, d + 2, [5] * (d + 2))], "doc_id long, n_tokens long, ids array<int>").toArrow()
        pq.write_table(t, f"{tmp_path}/{part}.parquet")
    assert {r.doc_id: r.start for r in token_files.summary(spark, f"file://{tmp_path}").collect()} == {1: 0, 2: 3}


def test_other_normalisers_go_through_the_library(tmp_path):
    text = open(PATH, encoding="utf-8").read()
    changed = text.replace('"content":" "', '"content":"z"', 1) if '"content":" "' in text else text.replace('"content": " "', '"content": "z"', 1)
    assert changed != text
    other = tmp_path / "other.json"
    other.write_text(changed, encoding="utf-8")
    assert token_files._Tokenizer(PATH).plain and not token_files._Tokenizer(str(other)).plain
