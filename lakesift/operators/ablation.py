"""Ablations over mixes: acoustic overlap with a test set, diversity and counts of each ratio, in one job keyed by ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.functions.signals import dot
from lakesift.operators import diversity, mix, wer

N_SAMPLE = 200


def overlap(train: DataFrame, test: DataFrame, vector: str = "embedding", n_sample: int = N_SAMPLE, seed: int = 42, id_col: str = "id") -> DataFrame:
    """One row: the mean, over sampled test rows, of the greatest similarity to a sampled train row; null if a side is empty. Both samples are small whatever the corpus."""
    draw = lambda df: mix.sample(df.filter(F.col(vector).isNotNull()), n_sample, seed, id_col)
    a = draw(test).select(F.col(id_col).alias("t"), F.col(vector).alias("u"))
    b = draw(train).select(F.col(vector).alias("v"))
    best = a.crossJoin(F.broadcast(b)).groupBy("t").agg(F.max(dot(F.col("u"), F.col("v"))).alias("s"))
    return best.agg(F.bround(F.avg("s"), 4).alias("acoustic_overlap"))


def run(splits: DataFrame, test: DataFrame | None = None, vector: str = "embedding", wer_eval: float | None = None, seed: int = 42, n_sample: int = N_SAMPLE, id_col: str = "id") -> DataFrame:
    """A row for each ratio: counts by source, diversity_ columns, acoustic_overlap (null without a test set), and wer_eval, which is the same for all since the model and its test set are fixed."""
    count = lambda kind: F.count_if(F.col("source") == kind)
    out = splits.groupBy("mix_synthetic_ratio").agg(F.count(F.lit(1)).alias("n_total"), count("real").alias("n_real"), count("synthetic").alias("n_synthetic"))
    names = list(diversity.axes_of(splits).values())
    if names:
        found = diversity.scores(splits, ["mix_synthetic_ratio"])
        rounded = [F.bround(F.coalesce(n, F.lit(0.0)), 4).alias(f"diversity_{n}") for n in names]
        out = out.join(found, "mix_synthetic_ratio", "left").select(*out.columns, *rounded)
        out = out.withColumn("diversity_overall", F.bround(sum((F.col(f"diversity_{n}") for n in names[1:]), F.col(f"diversity_{names[0]}")) / len(names), 4))
    if test is not None and vector in splits.columns:
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
        ranked = mix.ranked(splits.filter(F.col(vector).isNotNull()).withColumn("_o", key), ["mix_synthetic_ratio"], id_col=id_col)
        train = ranked.filter(F.col("_r") <= n_sample).select("mix_synthetic_ratio", F.col(vector).alias("v"))
        few = mix.sample(test.filter(F.col(vector).isNotNull()), n_sample, seed, id_col).select(F.col(id_col).alias("t"), F.col(vector).alias("u"))
        best = train.crossJoin(F.broadcast(few)).groupBy("mix_synthetic_ratio", "t").agg(F.max(dot(F.col("u"), F.col("v"))).alias("s"))
        mean = best.groupBy("mix_synthetic_ratio").agg(F.bround(F.avg("s"), 4).alias("acoustic_overlap"))
        out = out.join(mean, "mix_synthetic_ratio", "left")
    else:
        out = out.withColumn("acoustic_overlap", F.lit(None).cast("double"))
    out = out.withColumn("wer_eval", F.lit(wer_eval).cast("double")).withColumnRenamed("mix_synthetic_ratio", "synthetic_ratio")
    return out.orderBy("synthetic_ratio")


def best(results: DataFrame) -> DataFrame:
    """One row: the ratio of the greatest overlap and that of the least error rate; of ties, the lowest ratio."""
    top = F.max_by("synthetic_ratio", F.struct("acoustic_overlap", -F.col("synthetic_ratio")))
    low = F.min_by("synthetic_ratio", F.struct("wer_eval", "synthetic_ratio"))
    has = lambda c, v: F.when(F.count(c) > 0, v)
    return results.agg(has("acoustic_overlap", top).alias("best_overlap_ratio"), has("wer_eval", low).alias("best_wer_ratio"))


def save(results: DataFrame, folder: str) -> None:
    """Parquet and CSV."""
    results.write.mode("overwrite").parquet(f"{folder}/ablation_results.parquet")
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/ablation_results.csv")


def transcribe(manifest: DataFrame, backend, path: str = "path") -> DataFrame:
    """manifest with hypothesis. backend() is made once in each worker and gives a function from a path to text; what fails is empty."""
    run_backend = F.pandas_udf(_iterator(backend), "string")
    return manifest.withColumn("hypothesis", run_backend(F.col(path)))


def _iterator(backend):
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = backend()

        def one(p):
            try:
                return model(p)
            except Exception:  # a clip that can't be transcribed has no words
                return ""

        for paths in batches:
            yield paths.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def evaluate(manifest: DataFrame, backend=None, ref: str = "sentence", by: str | None = None) -> dict:
    return wer.evaluate_split(manifest if backend is None else transcribe(manifest, backend), ref, "hypothesis", by)
