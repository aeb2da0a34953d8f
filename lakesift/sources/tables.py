"""Manifests and results in files."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.operators.mix import numbered, sample


def read_manifest(spark: SparkSession, path: str, source: str | None = "real") -> DataFrame:
    """A manifest in Parquet; id and path are required, source is added where it is absent."""
    df = spark.read.parquet(path)
    if missing := {"id", "path"} - set(df.columns):
        raise ValueError(f"the manifest has no {', '.join(sorted(missing))}")
    return df.withColumn("source", F.lit(source)) if source and "source" not in df.columns else df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x


def write_json(report: dict, path: str) -> None:
    """A report as strict JSON; what isn't a number is null."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(_plain(report), f, indent=2, default=str)


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def corpus_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "id", locale: str = "en", split: str = "train") -> DataFrame:
    """n rows of a corpus table in its order, with new ids that count them (cv_LOCALE_SPLIT_000000), locale and source_split."""
    rows = numbered(sample(df, n, seed, id_col), "_n", id_col).orderBy("_n")
    new = F.format_string(f"cv_{locale}_{split}_%06d", "_n")
    return rows.withColumns({id_col: new, "locale": F.lit(locale), "source_split": F.lit(split)}).drop("_n")
