"""Server-sent-event frames of texts, one per character, for batch tables and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DONE = "[DONE]"  # fixed value: the last frame's data


def frames(texts: DataFrame) -> DataFrame:
    """(stream_id, seq, frame) from (stream_id, text). Line feeds are data and are not escaped. Stateless."""
    characters = F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "")
    cut = texts.select("stream_id", F.posexplode(F.concat(characters, F.array(F.lit(DONE)))).alias("seq", "data"))
    return cut.select("stream_id", "seq", F.concat(F.lit("data: "), "data", F.lit("\n\n")).alias("frame"))


def stream_frames(texts: DataFrame, target: str, checkpoint: str | None = None, sink: str = "memory") -> StreamingQuery:
    """Writes the frames of a streaming (stream_id, text), all that is available.

    ``sink`` "memory" makes the table ``target``, for looking at; a file format ("parquet", "json") writes to the folder
    ``target`` exactly once, "kafka" to the topic ``target`` (with value and key; brokers come from the session's setting
    ``spark.tessera.kafka.servers``). Sinks other than memory need a ``checkpoint`` folder.
    """
    if sink != "memory" and checkpoint is None:
        raise ValueError("a checkpoint folder is needed, else a restart would write frames twice")
    out = frames(texts)
    if sink == "kafka":
        out = out.select(F.col("stream_id").cast("string").alias("key"), F.col("frame").alias("value"))
    writer = out.writeStream.format(sink).outputMode("append").trigger(availableNow=True)
    if sink == "memory":
        writer = writer.queryName(target)
    elif sink == "kafka":
        writer = writer.option("topic", target).option("kafka.bootstrap.servers", texts.sparkSession.conf.get("spark.tessera.kafka.servers"))
    else:
        writer = writer.option("path", target)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
