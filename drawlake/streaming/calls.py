"""The stream of reader calls: running rollups, windows over time, events for a viewer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drawlake.operators.stats import rollup_columns


def read_calls(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Calls as they are appended to a folder of Parquet files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def running_layer_stats(calls: DataFrame) -> DataFrame:
    """The same figures per layer as the batch rollup; state is one row per layer."""
    return calls.groupBy(F.coalesce("layer", F.lit("?")).alias("layer")).agg(*rollup_columns())


def windowed_stats(calls: DataFrame, length: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Figures per window and layer. Rows later than the watermark are dropped, and state behind it is released."""
    window = F.window("at", length, slide) if slide else F.window("at", length)
    return calls.withWatermark("at", late).groupBy(window, "layer").agg(*rollup_columns())


def sessions(calls: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return calls.withWatermark("at", late).groupBy(F.session_window("at", gap), "layer").agg(F.count(F.lit(1)).alias("calls"))


def without_repeats(calls: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return calls.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def start(stats: DataFrame, to: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "complete", every: str | None = "1 second") -> StreamingQuery:
    """Hand each update to a function of a batch and its number; with every=None the query stops when it has read what is there."""
    writer = stats.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(to)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def events(stages: DataFrame) -> DataFrame:
    """Events for a viewer, in order: event, data (JSON without a closing tag inside)."""
    body = F.replace(F.to_json(F.struct(*[c for c in stages.columns if c not in ("seq", "event")])), F.lit("</"), F.lit("<\\/"))
    return stages.select("seq", "event", body.alias("data")).orderBy("seq")
