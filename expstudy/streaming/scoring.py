"""Model scoring on a streaming DataFrame (section 2.11 of the survey).

Scoring is a stateless projection (MOD-12), so the same generated expression
runs on a file-source stream; new files are scored as they arrive and written
through the exactly-once file sink with its own checkpoint folder.  No state,
no watermark: nothing is aggregated across batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from expstudy.operators.score import GlmModel


def score_stream(spark: SparkSession, model: GlmModel, source_dir: str, schema, name: str = "MODEL_PRED",
                 use_offset: bool = True, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of the Parquet files in ``source_dir`` with predictions appended.

    Rows with a level unseen in training get a NULL prediction (a stream cannot
    be checked up front).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    return src.withColumn(name, model.predict(src, use_offset=use_offset))


def run_scoring_stream(scored: DataFrame, out_dir: str, checkpoint_dir: str, available_now: bool = True):
    """Write a scored stream to Parquet; ``availableNow`` processes what is there and stops."""
    w = scored.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
