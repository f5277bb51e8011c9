"""Problems 7 and 8: token ids of all documents, and containers filled with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm.bpe import encode_corpus, token_count, vocabulary_path
from measura.llm.packing import pack
from measura.session import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_multi_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) by the byte-level vocabulary for many languages."""
    return encode_corpus(table(spark, sf_dir, "documents"), path=vocabulary_path(name="byte_bpe_multi_50k.tiktoken"))


def p7_word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) by the vocabulary of lower-case words."""
    return encode_corpus(table(spark, sf_dir, "documents"), path=vocabulary_path(name="word_bpe_49k.json"))


def p7_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) by the vocabulary of pieces with byte fallback."""
    return encode_corpus(table(spark, sf_dir, "documents"), path=vocabulary_path(name="piece_bpe_32k.model"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_name, container_id, doc_id, piece_ix, from_token, to_token) for each capacity of pack_limits."""
    limits = table(spark, sf_dir, "pack_limits").orderBy("pack_name").collect()  # a fixed table of a few rows
    sized = table(spark, sf_dir, "documents").select("doc_id", token_count("text").alias("n_tokens"))
    out = pack(sized, "doc_id", "n_tokens", [(r["pack_name"], r["capacity_tokens"]) for r in limits])
    return out.withColumnsRenamed({"from_unit": "from_token", "to_unit": "to_token"})


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each pack are."""
    used = p8_packed(spark, sf_dir).groupBy("pack_name", "container_id").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n"))
    limits = table(spark, sf_dir, "pack_limits").select("pack_name", "capacity_tokens")
    report = used.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return report.join(limits, "pack_name").select("pack_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill"))


QUERIES = {"p7_ids": p7_ids, "p7_multi_ids": p7_multi_ids, "p7_word_ids": p7_word_ids, "p7_piece_ids": p7_piece_ids, "p8_packed": p8_packed, "p8_fill": p8_fill}
ORACLES: dict[str, str] = {}
