"""Raw documents to encoded training documents, in five stages; each works on what its predecessor kept.

All stages but the last return the columns of their input, extra ones and such with the stages' own names among them.
Null texts count as empty (quality scores them as such, near duplicates keeps them all, personal data keeps null,
mixing gives them size 0, encoding no ids); null ids, sources and languages are values like others. Repeated rows are
one document to near duplicates. Very long texts are single rows throughout. Without labels of both kinds nothing is
rejected. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe_reuse import encode_decode
from tessera.llm.common import materialize
from tessera.llm.mixing import emit
from tessera.llm.parity_join import one_of_each
from tessera.llm.pii_surrogates import configured_key, replace_pii
from tessera.llm.quality_pairs import accepted
from tessera.sources import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, learned from preference pairs, accepts."""
    return accepted(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of five-word-shingle similarity 0.8 or more."""
    return one_of_each(docs, words=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by surrogates; n_chars follows."""
    return replace_pii(docs, configured_key(spark), report=False).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources meet their target weights."""
    return emit(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' count and digests of every document of the mix."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]

#: Learned scores and tokenizer results are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what one returns is written as Parquet and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
