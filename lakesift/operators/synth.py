"""Synthetic speech from a plan. The speech service is a backend; the one here makes tones, so that everything else can be tested without a network."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.operators.gaps import VOICES
from lakesift.operators.mix import numbered
from lakesift.operators.quality import Thresholds, inspect_clip
from lakesift.session import written
from lakesift.sources.audio import write_wav

SR = 16000
GATE = Thresholds(0.5, 25.0, 20.0, 0.5)


def tone_backend(voice: str, text: str) -> np.ndarray:
    """A burst for each word over a quiet floor, at a pitch of the voice."""
    pitch = 120 + zlib.crc32(voice.encode()) % 180
    parts = []
    for word in text.split():
        n = SR // 20 * (2 + len(word) // 2)
        t = np.arange(n) / SR
        parts += [0.4 * np.sin(2 * np.pi * pitch * t) * np.hanning(n), np.zeros(SR // 20)]
    x = np.concatenate(parts) if parts else np.zeros(0)
    return (x + 0.002 * np.sin(2 * np.pi * 50 * np.arange(len(x)) / SR)).astype(np.float32)


def voices(spark, catalog: dict | None = None) -> DataFrame:
    """(gender, accent, pos, voice_id)."""
    rows = [(g, a, k, v) for (g, a), names in (catalog or VOICES).items() for k, v in enumerate(names)]
    return spark.createDataFrame(rows, "gender string, accent string, pos int, voice_id string")


def utterances(plan: DataFrame) -> DataFrame:
    """(plan_pos, text_pos, voice_id, sentence): the first n_samples texts of each target."""
    return plan.select("plan_pos", "voice_id", F.posexplode(F.slice("texts", F.lit(1), F.col("n_samples").cast("int"))).alias("text_pos", "sentence"))


def generate(plan: DataFrame, folder: str | None = None, backend: Callable[[str, str], np.ndarray] = tone_backend, catalog: dict | None = None, gate: Thresholds | None = GATE, repeatable: bool | None = None) -> DataFrame:
    """The manifest of what could be made: failures and clips that don't pass the gate are left out; ids count successes, in the plan's order. With a folder, clips are written to it as WAV.

    repeatable: a voice makes the same sound of the same text each time, as tone_backend does. Then each pair of the two is spoken once, unless each utterance is a file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, seconds = [], []
            for row in batch.itertuples(index=False):
                try:
                    x = backend(row.voice_id, row.sentence)
                    ok = len(x) > 0 and (gate is None or inspect_clip(x, SR, gate)["passes"])
                    if ok and folder:
                        write_wav(os.path.join(folder, f"{row.plan_pos}_{row.text_pos}.wav"), x, SR)
                except Exception:  # a failed utterance is left out
                    ok, x = False, ()
                keep.append(ok)
                seconds.append(len(x) / SR)
            yield batch.assign(duration_sec=seconds)[keep]

    wanted = utterances(plan)
    if (backend is tone_backend if repeatable is None else repeatable) and not folder:
        pairs = wanted.select("voice_id", "sentence").distinct().repartition(plan.sparkSession.sparkContext.defaultParallelism)  # few rows, but much work each
        spoken = pairs.mapInPandas(run, "voice_id string, sentence string, duration_sec double")
        made = wanted.join(spoken, ["voice_id", "sentence"]).select("plan_pos", "voice_id", "text_pos", "sentence", "duration_sec")
    else:
        made = wanted.repartition("plan_pos", "text_pos").mapInPandas(run, "plan_pos long, voice_id string, text_pos int, sentence string, duration_sec double")
    made = written(made)  # numbering reads it twice
    known = voices(plan.sparkSession, catalog).groupBy("voice_id").agg(F.min("gender").alias("gender"), F.min("accent").alias("accent"))
    made = numbered(made, "_n", "plan_pos", "text_pos").join(F.broadcast(known), "voice_id", "left")
    unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    path = F.concat(F.lit(f"{folder}/"), F.col("plan_pos"), F.lit("_"), F.col("text_pos"), F.lit(".wav")) if folder else F.lit(None).cast("string")
    return made.select(
        F.concat(F.lit("syn_"), "voice_id", F.lit("_"), F.lpad(F.col("_n").cast("string"), 6, "0")).alias("id"), path.alias("path"), F.concat(F.lit("tts_"), "voice_id").alias("speaker_id"), "sentence",
        F.lit("unknown").alias("age"), unknown("gender"), unknown("accent"), F.lit("synthetic").alias("locale"), "duration_sec", F.lit("synthetic").alias("source"), F.col("voice_id").alias("tts_voice"),
    )
