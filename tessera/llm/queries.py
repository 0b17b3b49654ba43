"""The thin queries op1 to op10: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity_join import classes

    found = classes(read_table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    counted = token_counts(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprints

    return fingerprints(read_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")


#: Verdict, host, start of the path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op5_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .host_trust import judge_urls

    judged = judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_surrogates import configured_key, replace_pii

    done = replace_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark))
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_entities", "kinds")


def op7_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_reuse import encode_decode

    return encode_decode(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_pairs import predictions

    return predictions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_ann_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_scan import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reply_trees import conversation_digests

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversation_digests(rows.unionByName(extra))


def queries() -> dict[str, Query]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return SQL
