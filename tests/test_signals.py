import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesift.functions import dsp, signals
from lakesift.operators import quality
from lakesift.sources import audio

SR = 16000


def tone(freq=440.0, seconds=2.0, amplitude=0.5):
    n = int(seconds * SR)
    t = np.arange(n) * (1 / SR)
    return np.float32(np.sin(t * freq * 2 * np.pi) * amplitude)


def speech(seconds=3.0):
    """Bursts over a floor 40 dB lower."""
    t = np.arange(int(seconds * SR)) / SR
    return (0.5 * np.sin(2 * np.pi * 300 * t) * np.where(np.sin(2 * np.pi * 2 * t) > -0.5, 1, 0.005)).astype(np.float32)


def test_snr_follows_the_formula():
    assert dsp.snr_db(np.zeros(2 * SR), SR) == 0.0  # T1
    assert dsp.snr_db(tone(amplitude=0.8), SR) < 0.1  # T2: a steady tone has no quiet frames
    assert 30 < dsp.snr_db(speech(), SR) <= 80


def test_silence():
    assert dsp.silence_ratio(np.zeros(2 * SR), SR) == 1.0  # T3
    assert dsp.silence_ratio(tone(), SR) < 0.01
    assert dsp.silence_ratio(np.r_[np.zeros(SR), tone(seconds=1)], SR) == pytest.approx(0.5, abs=0.02)


def test_level_and_clipping():
    assert dsp.rms_db(np.zeros(SR)) == -120 and dsp.rms_db(np.ones(SR)) == pytest.approx(0)
    assert dsp.is_clipped(np.ones(SR)) and not dsp.is_clipped(tone())


def test_gate():
    assert quality.inspect_clip(speech(), SR)["passes"]
    reasons = lambda x, **k: [r.split(" ")[0] for r in quality.inspect_clip(x, SR, quality.Thresholds(**k))["fail_reasons"]]
    assert "too_short" in reasons(tone(seconds=0.1)) and "clipped" in reasons(np.ones(2 * SR)) and "too_quiet" in reasons(speech() * 1e-3)
    assert "too_silent" in reasons(np.r_[np.zeros(int(1.9 * SR)), tone(seconds=0.05)]) and "too_long" in reasons(speech(), max_duration_sec=2)
    assert quality.inspect_clip(np.zeros(0), SR)["fail_reasons"][0].startswith("exception")
    assert "too_short" not in reasons(speech(3.0), min_duration_sec=3.0)  # on the threshold


def test_defaults_differ_by_caller():
    assert quality.Thresholds().max_duration_sec == 30 and quality.CLI_THRESHOLDS.max_duration_sec == 20  # T4


def test_embedding():
    e = dsp.mfcc_embedding(speech(), SR)
    assert e.shape == (40,) and abs(np.linalg.norm(e) - 1) < 1e-5
    assert not dsp.mfcc_embedding(np.zeros(0), SR).any()
    assert e @ dsp.mfcc_embedding(speech() * 0.98, SR) > 0.97


def test_md5_and_resampling():
    assert dsp.pcm_md5(tone()) == dsp.pcm_md5(tone().copy()) != dsp.pcm_md5(tone(880))
    down = dsp.resample(tone(440), SR, 8000)
    assert len(down) == SR and np.abs(down[200:-200] - tone(440)[::2][200:-200]).max() < 0.01


def test_expressions_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.normal(0, 0.2, 200) * (1 if k % 2 else np.linspace(0, 1, 200))]) for k in range(6)] + [(6, [0.0] * 200)]
    df = spark.createDataFrame(rows, "id int, x array<double>").withColumn("levels", signals.frame_levels(F.col("x"), 16))
    found = df.select("id", signals.snr_db(F.col("levels")).alias("snr"), signals.silence_ratio(F.col("levels"), F.size("x"), 8, 12.0).alias("silence"), signals.rms_db(F.col("x")).alias("rms")).collect()
    for r in found:
        x = np.array(rows[r.id][1])
        assert r.snr == pytest.approx(dsp.snr_db(x, 640), abs=1e-9)
        assert r.silence == pytest.approx(dsp.silence_ratio(x, 640, 12.0), abs=1e-9)
        assert r.rms == pytest.approx(dsp.rms_db(x), abs=1e-9)


def test_wav_and_load_errors(spark, tmp_path):
    audio.write_wav(str(tmp_path / "a.wav"), tone(), SR)
    (tmp_path / "b.wav").write_bytes(b"not audio")
    m = spark.createDataFrame([("a", f"{tmp_path}/a.wav"), ("b", f"{tmp_path}/b.wav"), ("c", f"{tmp_path}/gone.wav")], "id string, path string")
    got = {r.id: r for r in audio.load_clips(m, str(tmp_path)).collect()}
    assert got["a"].load_error is None and np.abs(np.array(got["a"].samples) - tone()).max() < 1e-3
    assert got["b"].load_error and got["c"].load_error and len(got["b"].samples) == SR and not any(got["b"].samples)


def test_resampling_in_blocks():
    x = np.random.default_rng(0).normal(size=5000).astype(np.float32)
    assert np.array_equal(dsp.resample(x, 44100, 16000), dsp.resample(x, 44100, 16000, block=97))


def test_equal_names_in_different_folders(spark, tmp_path):
    """A path names one file; a missing one is a load error, and nothing is multiplied."""
    from lakesift.sources import audio

    for k, folder in enumerate(("a", "b")):
        audio.write_wav(str(tmp_path / folder / "1.wav"), np.full(100 * (k + 1), 0.5), 16000)
    rows = [("x", "a/1.wav"), ("y", "b/1.wav"), ("z", str(tmp_path / "b" / "1.wav")), ("lost", "1.wav"), ("none", None)]
    manifest = spark.createDataFrame(rows, "id string, path string")
    for limit in (64 << 20, -1):
        got = {r.id: (len(r.samples), r.load_error is None) for r in audio.load_clips(manifest, str(tmp_path), max_broadcast=limit).collect()}
        assert got == {"x": (100, True), "y": (200, True), "z": (200, True), "lost": (16000, False), "none": (16000, False)}
