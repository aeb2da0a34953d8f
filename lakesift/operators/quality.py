"""Quality of clips: measured features, the gate with its reasons, summaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.functions import dsp
from lakesift.schemas import QUALITY
from lakesift.sources import audio


@dataclass(frozen=True)
class Thresholds:
    """A clip that lies on a threshold passes."""

    min_duration_sec: float = 0.5  # shorter: too_short
    max_duration_sec: float = 30.0  # longer: too_long
    min_snr_db: float = 15.0  # less: low_snr
    max_silence_ratio: float = 0.4  # more: too_silent
    clipping: float = 0.99  # of full scale
    min_rms_db: float = -40.0


#: What the command line uses: clips of 20 s at most.
CLI_THRESHOLDS = Thresholds(max_duration_sec=20.0)
REASONS = ("too_short", "too_long", "low_snr", "too_silent", "clipped", "too_quiet")


def reason_codes(duration: Column, snr: Column, silence: Column, clipped: Column, rms: Column, t: Thresholds) -> Column:
    """Codes of what a clip fails, in a fixed order."""
    tests = (duration < t.min_duration_sec, duration > t.max_duration_sec, snr < t.min_snr_db, silence > t.max_silence_ratio, clipped, rms < t.min_rms_db)
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for test, code in zip(tests, REASONS))))


def inspect_clip(x: np.ndarray, sr: int, t: Thresholds = Thresholds()) -> dict:
    """All measures of a clip, with reasons that name the measured values. What can't be measured fails, with the error as the reason."""
    try:
        if not len(x):
            raise ValueError("the clip is empty")
        duration, snr, silence = len(x) / sr, dsp.snr_db(x, sr), dsp.silence_ratio(x, sr)
        clipped, rms = dsp.is_clipped(x, t.clipping), dsp.rms_db(x)
    except Exception as error:  # one bad clip doesn't stop a corpus
        return {"duration_sec": 0.0, "snr_db": 0.0, "silence_ratio": 1.0, "is_clipped": False, "rms_db": -120.0, "passes": False, "fail_reasons": [f"exception: {error}"]}
    tests = [
        (duration < t.min_duration_sec, f"too_short ({duration:.2f}s)"), (duration > t.max_duration_sec, f"too_long ({duration:.2f}s)"),
        (snr < t.min_snr_db, f"low_snr ({snr:.1f}dB)"), (silence > t.max_silence_ratio, f"too_silent ({silence:.1%})"),
        (clipped, "clipped"), (rms < t.min_rms_db, f"too_quiet ({rms:.1f}dB)"),
    ]
    reasons = [text for failed, text in tests if failed]
    return {"duration_sec": duration, "snr_db": snr, "silence_ratio": silence, "rms_db": rms, "is_clipped": clipped, "passes": not reasons, "fail_reasons": reasons}


_KINDS = {"duration_sec": pa.float64(), "snr_db": pa.float64(), "silence_ratio": pa.float64(), "rms_db": pa.float64(), "is_clipped": pa.bool_(), "passes": pa.bool_(), "fail_reasons": pa.list_(pa.string())}
TABLE = f"{QUALITY}, md5 string, embedding array<float>"


def measuring(t: Thresholds = Thresholds(), embed: bool = True, id_col: str = "id", more: tuple[str, ...] = ()) -> audio.Step:
    """The step of measure, over batches (id, samples, sr); columns named in more are passed on."""
    names = [id_col, *_KINDS, "md5", "embedding", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in audio.few(batches):
            column, rates = batch.column("samples"), batch.column("sr").to_pylist()
            off, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            clip = [flat[a - off[0] : b - off[0]] for a, b in zip(off[:-1], off[1:])]
            rates = [int(r or 16000) for r in rates]
            found = [inspect_clip(x, sr, t) for x, sr in zip(clip, rates)]
            vectors = audio.lists([dsp.mfcc_embedding(x, sr) for x, sr in zip(clip, rates)]) if embed else pa.nulls(len(clip), pa.list_(pa.float32()))
            values = [pa.array([f[k] for f in found], kind) for k, kind in _KINDS.items()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *values, pa.array([dsp.pcm_md5(x) for x in clip]), vectors, *(batch.column(c) for c in more)], names)

    return run


def measure(clips: DataFrame, t: Thresholds = Thresholds(), embed: bool = True, id_col: str = "id") -> DataFrame:
    """One Arrow pass over clips (id, samples, sr): the feature table, without the samples, with load_error if clips have it. Everything after it is relational."""
    more = tuple(c for c in ("load_error",) if c in clips.columns)
    samples = F.coalesce("samples", F.array().cast("array<float>")).alias("samples")
    errors = "".join(f", {c} string" for c in more)
    return clips.select(id_col, samples, "sr", *more).mapInArrow(measuring(t, embed, id_col, more), f"{id_col} {clips.schema[id_col].dataType.simpleString()}, {TABLE}{errors}")


def measure_files(files: DataFrame, target_sr: int = audio.TARGET_SR, t: Thresholds = Thresholds(), embed: bool = True, id_col: str = "id", decoder=audio.decode_wav) -> DataFrame:
    """measure(decode(files)) of (id, content) in one Python worker: samples don't pass through the JVM."""
    step = audio.chain(audio.decoding(target_sr, decoder, id_col), measuring(t, embed, id_col, ("load_error",)))
    return files.select(id_col, "content").mapInArrow(step, f"{id_col} {files.schema[id_col].dataType.simpleString()}, {TABLE}, load_error string")


def attach(manifest: DataFrame, features: DataFrame, id_col: str = "id") -> DataFrame:
    """The manifest with qf_ columns."""
    renamed = features.select(id_col, *(F.col(c).alias(f"qf_{c}") for c in ("snr_db", "duration_sec", "silence_ratio", "rms_db", "is_clipped", "passes", "fail_reasons")))
    return manifest.join(renamed, id_col)


def summary(features: DataFrame) -> DataFrame:
    """One row: counts, pass rate, means, clipping rate. The denominator is 1 at least."""
    n, passed = F.count(F.lit(1)), F.count_if("passes")
    rate = lambda c: c / F.greatest(n, F.lit(1))
    return features.agg(
        n.alias("total"), passed.alias("passed"), (n - passed).alias("failed"), rate(passed).alias("pass_rate"),
        F.avg("snr_db").alias("mean_snr_db"), F.avg("duration_sec").alias("mean_duration_sec"), F.avg("silence_ratio").alias("mean_silence_ratio"), rate(F.count_if("is_clipped")).alias("clipping_rate"),
    )


def reason_counts(features: DataFrame, by_category: bool = True) -> DataFrame:
    """(reason, n): by category, or by the whole text with its value."""
    reason = F.explode("fail_reasons").alias("reason")
    code = F.regexp_extract("reason", "^[a-z_]+", 0) if by_category else F.col("reason")
    return features.select(reason).groupBy(code.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def thresholds_row(t: Thresholds) -> dict:
    return asdict(t)
