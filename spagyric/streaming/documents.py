"""Extraction as a stream: documents are self-contained, so the batch plan holds for every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from spagyric.operators.extract import records
from spagyric.operators.tokens import paragraphs, sentences
from spagyric.spec.models import Model


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", files_per_trigger: int = 16) -> DataFrame:
    """Documents as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_records(docs: DataFrame, models: list[Model], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Records of every sentence, stateless: in append mode without watermark."""
    found = sentences(paragraphs(docs, key, text), [key, "el_idx"], "text")
    return records(found, [key, "el_idx", "sent_idx"], models)


def counts_by_window(events: DataFrame, time: str, keys: list[str], window: str, late: str, slide: str | None = None) -> DataFrame:
    """(window, keys, n) in event time; rows later than ``late`` behind the newest are dropped by the watermark."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"))


def resolved_sink(stream: DataFrame, models: list[Model], path: str, checkpoint: str) -> DataStreamWriter:
    """Resolves each micro-batch by document and appends it; a batch that is written again replaces itself."""
    from spagyric.operators.resolve import resolve

    def write(batch: DataFrame, number: int) -> None:
        resolve(batch, models).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
