"""The same transforms on streams, and tables that streams keep."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import FeatureSession, Transform


def stream_table(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the schema of a table."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """datum_id (a hash of file and line) and value of text files that arrive in a folder."""
    return spark.readStream.text(path).select(F.xxhash64(F.col("_metadata.file_path"), "value").alias("datum_id"), "value")


def stream_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """datum_id (a hash) and value of "dim label id:value ..." lines of a socket, without dim; for sources.parse_libsvm."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.xxhash64("value").alias("datum_id"), F.regexp_replace("value", r"^\s*\S+\s+", "").alias("value"))


def transform_stream(stream: DataFrame, like: DataFrame, transforms: Sequence[Transform], output: str = "sparse", sizes: dict[str, int] | None = None) -> DataFrame:
    """The session's projection on a stream. Dictionaries come from the table like; every transform is local to a row,
    so the plan is the same and keeps no state."""
    planned = FeatureSession(like, transforms, output, sizes)
    return planned.on(stream)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that has arrived to Parquet, once each, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def dictionary_merge(spark: SparkSession, root: str, column: str) -> Callable[[DataFrame, int], None]:
    """For each_batch: keeps value, id of all values of a column seen so far under root; new values get the next ids, in
    their order. Each version is a folder of its own, so that a batch that is run again starts from the one before."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        from ..operators.stats import numbered

        values = batch.select(F.col(column).alias("value")).where("value is not null").distinct()
        if batch_id > 0:
            known = spark.read.parquet(f"{root}/version={batch_id - 1}")
            n = known.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
            new = numbered(values.join(known, "value", "left_anti"), "value", name="id").select("value", (F.col("id") + F.lit(n)).cast("long").alias("id"))
            out = known.select("value", "id").unionByName(new)
        else:
            out = numbered(values, "value", name="id").select("value", F.col("id").cast("long").alias("id"))
        out.write.mode("overwrite").parquet(f"{root}/version={batch_id}")

    return merge


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, key and n of tumbling windows, or of ones that begin every slide; rows later than the watermark are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
