"""Saving and loading of what operators build: vocabularies, vector stores, attention caches, memo tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.bpe import Vocabulary


def save_vocabulary(spark: SparkSession, vocabulary: Vocabulary, path: str) -> None:
    """One JSON document, written through Spark so that any file system it knows works."""
    spark.createDataFrame([(vocabulary.to_json().replace("\n", " "),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    return Vocabulary.from_json(spark.read.text(path, wholetext=True).first()["value"])


def save_store(store: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vectors, ids and metadata in one table; mode "append" adds rows."""
    store.write.mode(mode).parquet(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_kv(spark: SparkSession, layers: list[tuple[np.ndarray, np.ndarray]], path: str) -> None:
    """Keys and values of each layer, flat, with their shapes."""
    rows = [(i, part, list(map(int, x.shape)), np.asarray(x, float).ravel().tolist()) for i, kv in enumerate(layers) for part, x in zip("kv", kv, strict=True)]
    spark.createDataFrame(rows, "layer int, part string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load_kv(spark: SparkSession, path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    rows = spark.read.parquet(path).orderBy("layer", "part").collect()
    parts = [np.array(r["data"]).reshape(r["shape"]) for r in rows]
    return list(zip(parts[::2], parts[1::2], strict=True))


def open_memo(spark: SparkSession, path: str) -> DataFrame:
    """The memo table at ``path``, made empty if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], "key string, value string, created double, ttl double").write.parquet(path)
    return spark.read.parquet(path).select("key", "value", F.col("created").cast("double"), F.col("ttl").cast("double"))
