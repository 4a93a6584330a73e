"""Thin queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, jaccard, licenses, quality, repeats, token_files, toxicity, url_rules
from .common import shared_dir, ship, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_byte_level_bpe(spark, sf_dir):
    import public_tokenizers

    df = bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op3_token_files(spark, sf_dir):
    path = shared_dir(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_files.summary(spark, path)


@query
def op4_url_filters(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op4_url_filters"] = url_rules.brute_sql()


@query
def op5_license_scan(spark, sf_dir):
    df = licenses.scan(table(spark, sf_dir, "documents"))
    sequence = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    return df.select("doc_id", "n_sentences", sequence.alias("sentence_sequence"), F.array_join("licenses", ",").alias("licenses"), "n_rules")


ORACLE["op5_license_scan"] = licenses.brute_sql()


@query
def op8_chat_formatting(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.formatted(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLE["op8_chat_formatting"] = chat.digest_sql()


@query
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = quality.learned_from(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept")


@query
def op1_suffix_array_dedup(spark, sf_dir):
    return repeats.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


@query
def op6_benchmark_decontamination(spark, sf_dir):
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "edits", "whole")


@query
def op7_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.learned_from(docs, labels.where(~held_out))
    return toxicity.scored(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
