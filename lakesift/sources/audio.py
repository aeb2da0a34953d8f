"""Audio files: decoding in Arrow batches, and WAV writing. PCM WAV of 8, 16, 24 and 32 bits is read here; other codecs by a decoder that is passed in."""

from __future__ import annotations

import io
import os
import re
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.functions.dsp import resample

TARGET_SR = 16000
#: Clips of an Arrow batch at most; bytes of ids and paths to broadcast at most.
CLIPS, MAX_BROADCAST = 16, 64 << 20
#: From Arrow batches to Arrow batches.
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of CLIPS rows, so that a step holds the sound of so many clips and not of the 10,000 rows that Spark puts into a batch."""
    for whole in batches:
        for k in range(0, whole.num_rows, CLIPS):
            yield whole.slice(k, CLIPS)


def chain(*steps: Step) -> Step:
    """Steps as one, in one Python worker: sound passes from each to the next a few clips at a time, and not through the JVM, which would gather it into large batches again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(mono samples in [-1, 1], rate)."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, sr, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32), sr


def write_wav(path: str, x: np.ndarray, sr: int) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with wave.open(path, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(sr)
        f.writeframes((np.clip(np.asarray(x, np.float64), -1, 1) * 32767).astype("<i2").tobytes())


def encode_wav(pcm: np.ndarray, sr: int, width: int = 2, channels: int = 1) -> bytes:
    """A WAV file of 16-bit samples, written in width bytes (2, 3 or 4), the same in each channel."""
    wide = (np.asarray(pcm, np.int64) << 8 * (width - 2)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width]
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(sr)
        f.writeframes(np.repeat(wide[:, None], channels, axis=1).tobytes())
    return out.getvalue()


def lists(arrays: list[np.ndarray], kind: pa.DataType = pa.float32()) -> pa.ListArray:
    """Arrays as one Arrow column, without a Python object for each value."""
    ends = np.cumsum([len(x) for x in arrays], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def decoding(target_sr: int = TARGET_SR, decoder: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav, id_col: str = "id", more: tuple[str, ...] = ()) -> Step:
    """The step of decode; columns named in more are passed on."""

    def one(content) -> tuple[np.ndarray, str | None]:
        try:
            x, sr = decoder(content.as_buffer().to_pybytes() if content.is_valid else b"")
            return resample(x, sr, target_sr), None
        except Exception as error:  # any broken file
            return np.zeros(target_sr, np.float32), f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = [one(x) for x in batch.column("content")]
            sr = pa.array(np.full(len(found), target_sr, np.int32))
            own = [batch.column(id_col), lists([x for x, _ in found]), sr, pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(c) for c in more)], [id_col, "samples", "sr", "load_error", *more])

    return run


def decode(files: DataFrame, target_sr: int = TARGET_SR, decoder: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav, id_col: str = "id") -> DataFrame:
    """(id, samples, sr, load_error) of (id, content). A file that can't be read is a second of zeros, with the error: it fails quality but is counted."""
    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, "content").mapInArrow(decoding(target_sr, decoder, id_col), f"{id_col} {kind}, samples array<float>, sr int, load_error string")


def _plain(path: Column) -> Column:
    """A path without its scheme for local files, and without repeated or relative slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "/+(\\./+)*", "/")


def load_files(manifest: DataFrame, folder: str, path: str = "path", id_col: str = "id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, content) of the manifest's files, null where there is none. A path is absolute or under folder, and names one file: equal names in different folders are different clips. A path without a file is a load error too.

    ids and paths are broadcast to the files up to a size, so that sound isn't shuffled; beyond it they are joined.
    """
    files = manifest.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(folder)
    root = folder if ":" in folder or folder.startswith("/") else os.path.abspath(folder)
    under = F.concat(F.lit(root.rstrip("/") + "/"), F.coalesce(F.col(path), F.lit("")))
    wanted = manifest.select(id_col, _plain(F.when(F.col(path).rlike("^([a-z0-9]+:)?/"), F.col(path)).otherwise(under)).alias("_f"))
    small = (wanted.agg(F.sum(F.length("_f") + 64)).first()[0] or 0) <= max_broadcast
    there = files.select(_plain(F.col("path")).alias("_f"))
    found = files.select(_plain(F.col("path")).alias("_f"), "content").join(F.broadcast(wanted) if small else wanted, "_f").select(id_col, "content")
    lost = wanted.join(there, "_f", "left_anti").select(id_col, F.lit(None).cast("binary").alias("content"))
    return found.unionByName(lost)


def load_clips(manifest: DataFrame, folder: str, target_sr: int = TARGET_SR, path: str = "path", id_col: str = "id", decoder=decode_wav, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The manifest's clips, decoded; see load_files."""
    return decode(load_files(manifest, folder, path, id_col, max_broadcast), target_sr, decoder, id_col)


def writing(folder: str, id_col: str = "id") -> Step:
    """The step of write_clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            paths = [os.path.join(folder, f"{i}.wav") for i in batch.column(id_col).to_pylist()]
            for p, x, sr in zip(paths, batch.column("samples"), batch.column("sr").to_pylist()):
                write_wav(re.sub("^file:/*", "/", p), x.values.to_numpy(zero_copy_only=False), int(sr))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(paths, pa.string())], [id_col, "path"])

    return run


def write_clips(clips: DataFrame, folder: str, id_col: str = "id") -> DataFrame:
    """Writes clips as WAV from the tasks that hold them; (id, path) of what was written."""
    return clips.select(id_col, "samples", "sr").mapInArrow(writing(folder, id_col), f"{id_col} {clips.schema[id_col].dataType.simpleString()}, path string")
