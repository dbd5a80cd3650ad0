"""The queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, common, imatch, jaccard, media, mixing, quality, substring, suffix, warc


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a public vocabulary file; another path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.pairs_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(common.documents(spark, sf_dir), vocabulary(), others=["doc_id"], with_ids=False)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve_revisits(warc.records_of(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(common.documents(spark, sf_dir), 13, with_text=False)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_report(common.documents(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "lang", "source", mixing.tokens(F.col("text")).alias("n_tokens"))
    taken = mixing.mix(docs, 0.6, mixing.WEIGHTS, mixing.domain_of(F.col("source")), epochs=2, n_tokens=F.col("n_tokens"))
    return taken.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", "n_tokens", F.col("mix_copies").alias("copies"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.documents(spark, sf_dir), 4, 85, 100)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(common.documents(spark, sf_dir), 200, with_text=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(common.documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_chat_preferences, op2_bpe, op3_warc_revisits, op4_substring_dedup, op5_imatch, op6_source_mix, op7_jaccard_join, op8_suffix_array, op9_quality, op10_media)}
ORACLES = {"op1_chat_preferences": chat.ORACLE, "op3_warc_revisits": warc.ORACLE, "op5_imatch": imatch.ORACLE, "op6_source_mix": mixing.ORACLE}
