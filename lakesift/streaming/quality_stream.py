"""A manifest of features that arrives as files: the quality gate as a stream. The gate is stateless, so it needs no watermark; rows of a batch are written once (the checkpoint says which)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakesift.operators.quality import Thresholds, reason_codes


def read_features(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def gated(features: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """features with fail_reasons (codes) and passes; works on streams and tables alike."""
    codes = reason_codes(F.col("duration_sec"), F.col("snr_db"), F.col("silence_ratio"), F.col("is_clipped"), F.col("rms_db"), t)
    return features.withColumn("fail_reasons", codes).withColumn("passes", F.size("fail_reasons") == 0)


def start(features: DataFrame, out: str, checkpoint: str, t: Thresholds = Thresholds(), once: bool = True) -> StreamingQuery:
    """Writes the clips that pass to Parquet: what is there now, or on and on."""
    writer = gated(features, t).filter("passes").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
