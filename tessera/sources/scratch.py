"""Tables that operators write on their way, in the folder that the driver and all executors share.

They cut the lineage as a checkpoint does, survive the loss of any executor, let later plans prune columns,
and give the optimizer true sizes. All tables of an application lie in one folder, which goes when the
application's Python process ends; those of a ``scratch`` block go when the block ends.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local master, as in tests, may do without: a temporary folder is made and used. A cluster that
    names none is refused, since executors would write where nobody else looks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="tessera-")
    return _own_dir[app]


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def application_dir(spark: SparkSession) -> str:
    """The application's folder inside the shared one; it is deleted when the Python process ends."""
    folder = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def clean() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)

        atexit.register(clean)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the application's folder and returns it read back."""
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with, which else stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """A ``materialize`` into a folder of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.number = spark, f"{application_dir(spark)}/scratch-{uuid.uuid4().hex}", itertools.count()
        self.paths: dict[int, str] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{next(self.number)}-{name}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again, and shuffle files of what made them."""
        for df in tables:
            delete(self.spark, self.paths.pop(id(df)))
        release(self.spark)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that go when the block ends; what leaves the block must be written elsewhere first."""
    kept = Scratch(spark)
    try:
        yield kept
    finally:
        delete(spark, kept.folder)
