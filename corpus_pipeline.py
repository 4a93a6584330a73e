"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; all but
the last return the columns of documents. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import bpe, decontam, jaccard, quality, repeats
from routeloom.llm.common import dropped, ship, stored, table
from routeloom.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    return quality.kept(docs, quality.learned_from(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least doc_id stays; of its texts and repeated rows one."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    first = jaccard.firsts(docs).withColumnsRenamed({"id": "_id", "mark": "_mark"}).hint("shuffle_hash")
    mine = (F.coalesce("doc_id", F.lit(jaccard.LAST_ID)) == F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    return docs.join(first, mine, "left_semi").dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that a document with a smaller doc_id holds are cut out of the text."""
    ship(spark)
    cut = repeats.dedup(docs, keep_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), F.col("carry_lang").alias("lang"), F.col("carry_source").alias("source"), F.char_length("kept").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digests of ids and decoded text."""
    import public_tokenizers

    ship(spark)
    return bpe.encoded(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("byte_level_bpe", tokens),
]

#: Learned rules, MinHash classes and BPE are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
