"""Signal functions on one clip, in numpy: frames, level, signal-to-noise, silence, clipping, loudness, resampling, cepstral embedding."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

Signal = np.ndarray


def frame_rms(x: Signal, sr: int, ms: float = 25.0) -> tuple[np.ndarray, int]:
    """(level of each half-overlapping frame, hop). Frames are centred: the signal is padded with zeros by half a frame at both ends."""
    length = int(ms / 1000 * sr)
    hop = length // 2
    padded = np.pad(np.asarray(x, np.float64), length // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, length)[::hop]
    return np.sqrt(np.mean(frames * frames, axis=1)), hop


def snr_db(x: Signal, sr: int, ms: float = 25.0) -> float:
    """Loud against quiet frames (90th and 10th percentile) in dB, between 0 and 80. Frames of digital silence don't count; without others it is 0."""
    level, _ = frame_rms(x, sr, ms)
    level = level[level > 0]
    if not len(level):
        return 0.0
    quiet, loud = np.percentile(level, (10, 90))
    if quiet < 1e-10:
        return 60.0
    if loud < 1e-10:
        return 0.0
    return float(np.clip(20 * np.log10(loud / (quiet + 1e-10)), 0, 80))


def silence_ratio(x: Signal, sr: int, top_db: float = 30.0, ms: float = 25.0) -> float:
    """Share of samples in frames that lie top_db or more under the loudest frame; 1 for a clip of zeros."""
    level, hop = frame_rms(x, sr, ms)
    peak = level.max(initial=0.0)
    if peak <= 0:
        return 1.0
    speech = 20 * np.log10(np.maximum(level, 1e-5)) - 20 * np.log10(max(peak, 1e-5)) > -top_db
    at = np.arange(len(level)) * hop
    length = np.minimum(at + hop, len(x)) - np.minimum(at, len(x))
    return float(np.clip(1 - length[speech].sum() / len(x), 0, 1))


def is_clipped(x: Signal, threshold: float = 0.99) -> bool:
    return bool(np.mean(np.abs(x) >= threshold) > 0.001)


def rms_db(x: Signal) -> float:
    level = float(np.sqrt(np.mean(np.asarray(x, np.float64) ** 2)))
    return -120.0 if level < 1e-10 else 20 * float(np.log10(level))


def pcm_md5(x: Signal) -> str:
    """MD5 of the clip as 16-bit samples, rounded toward zero; values beyond full scale wrap."""
    return hashlib.md5((np.asarray(x, np.float64) * 32767).astype(np.int64).astype(np.int16).tobytes()).hexdigest()


def resample(x: Signal, sr: int, target: int, taps: int = 32, block: int = 1 << 15) -> np.ndarray:
    """Windowed-sinc resampling, in blocks of output samples: what it holds besides the clip doesn't grow with it."""
    if sr == target or not len(x):
        return np.asarray(x, np.float32)
    n, x = int(np.ceil(len(x) * target / sr)), np.asarray(x, np.float64)
    cutoff = min(1.0, target / sr)
    reach = int(np.ceil(taps / cutoff))
    out, offsets = np.empty(n, np.float32), np.arange(-reach + 1, reach + 1)
    for lo in range(0, n, block):
        at = np.arange(lo, min(lo + block, n)) * (sr / target)
        near = np.floor(at).astype(np.int64)[:, None] + offsets
        away = at[:, None] - near
        weight = cutoff * np.sinc(cutoff * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / reach, -1, 1)))
        inside = (near >= 0) & (near < len(x))
        out[lo : lo + block] = (np.where(inside, x[np.clip(near, 0, len(x) - 1)], 0) * weight).sum(1)
    return out


def _mel(hz: np.ndarray) -> np.ndarray:
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1000) / 1000) / np.log(6.4))


def _hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp(np.log(6.4) * (mel - 15) / 27))


@lru_cache(8)
def _matrices(sr: int, n_fft: int, bands: int, n_mfcc: int) -> tuple[np.ndarray, np.ndarray]:
    """Triangular mel filters of equal area, and the orthonormal cosine transform."""
    edges = _hz(np.linspace(0, _mel(np.array(sr / 2.0)), bands + 2))
    bins = np.arange(n_fft // 2 + 1) * sr / n_fft
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    filters = np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]
    k, m = np.arange(n_mfcc)[:, None], np.arange(bands)
    cosines = np.sqrt(2 / bands) * np.cos(np.pi * k * (2 * m + 1) / (2 * bands))
    cosines[0] /= np.sqrt(2)
    return filters, cosines


def mfcc_embedding(x: Signal, sr: int, bands: int = 128, n_fft: int = 512, hop: int = 160, n_mfcc: int = 20) -> np.ndarray:
    """Mean and deviation over time of n_mfcc cepstral coefficients, of length 1; zeros for an empty clip."""
    if not len(x):
        return np.zeros(2 * n_mfcc, np.float32)
    filters, cosines = _matrices(sr, n_fft, bands, n_mfcc)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(x, np.float64), n_fft // 2), n_fft)[::hop]
    power = np.abs(np.fft.rfft(frames * window)) ** 2
    db = 10 * np.log10(np.maximum(power @ filters.T, 1e-10))
    mfcc = np.maximum(db, db.max() - 80) @ cosines.T
    out = np.concatenate([mfcc.mean(0), mfcc.std(0)])
    return (out / (np.linalg.norm(out) + 1e-8)).astype(np.float32)


def planes(n_bits: int, dim: int, seed: int = 42) -> np.ndarray:
    """Normals of n_bits random planes."""
    return np.float32(np.random.default_rng(seed).standard_normal(size=(n_bits, dim)))
