"""The queries of the sound path that have no SQL, against plain loops."""

import numpy as np
import pytest

from lakesift.functions import dsp
from lakesift.operators import quality
from lakesift.plans import audio_queries


def test_cepstra_by_definition(spark, sf_dir):
    """Each coefficient by sums over samples, bands and time, without a Fourier routine or matrices."""
    sr, n, hop, bands = audio_queries.SR, 512, 160, 128
    sounds = {r.id: np.array(r.samples, np.float64) for r in audio_queries.clips(spark, sf_dir).filter("id in (1, 2)").collect()}
    got = {r.id: np.array(r.embedding) for r in audio_queries.QUERIES["f11_mfcc"](spark, sf_dir).filter("id in (1, 2)").collect()}
    mel = lambda f: 3 * f / 200 if f < 1000 else 15 + 27 * np.log(f / 1000) / np.log(6.4)
    hz = lambda m: 200 * m / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    edges = [hz(mel(sr / 2) * k / (bands + 1)) for k in range(bands + 2)]
    angle = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    for k, x in sounds.items():
        y, rows = np.concatenate([np.zeros(n // 2), x, np.zeros(n // 2)]), []
        for at in range(0, len(y) - n + 1, hop):
            power = [abs(z) ** 2 for z in angle @ (y[at : at + n] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)))]
            energy = [sum(p * max(0, min((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a) for p, f in zip(power, np.arange(n // 2 + 1) * sr / n) if a < f < c) for a, b, c in zip(edges, edges[1:], edges[2:])]
            rows.append([10 * np.log10(max(e, 1e-10)) for e in energy])
        top = max(map(max, rows)) - 80
        cepstra = [[sum(max(v, top) * np.cos(np.pi * q * (2 * b + 1) / (2 * bands)) for b, v in enumerate(row)) * np.sqrt((1 if q == 0 else 2) / bands) for q in range(20)] for row in rows]
        want = np.concatenate([np.mean(cepstra, 0), np.std(cepstra, 0)])
        assert got[k] == pytest.approx(want / np.linalg.norm(want), abs=2e-4)


def test_curation_report_by_loops(spark, sf_dir):
    found = {(r.part, r.metric): r.value for r in audio_queries.QUERIES["a19_curation_report"](spark, sf_dir).collect()}
    passed, exact, near, categories, durations = [], {}, {}, {}, []
    known = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    clips = sorted((r for r in audio_queries.clips(spark, sf_dir).collect() if r.id in known), key=lambda r: r.id)
    for r in clips:
        x = np.array(r.samples, np.float32)
        one = quality.inspect_clip(x, r.sr)
        durations.append(one["duration_sec"])
        for reason in one["fail_reasons"]:
            categories[reason.split(" ")[0]] = categories.get(reason.split(" ")[0], 0) + 1
        if one["passes"]:
            passed.append((r.id, x))
    first, rest = {}, []
    for k, x in passed:
        name = dsp.pcm_md5(x)
        if name in first:
            exact[k] = first[name]
        else:
            first[name] = k
            rest.append((k, dsp.mfcc_embedding(x, audio_queries.SR).astype(np.float64)))
    planes, buckets = dsp.planes(18, 40).astype(np.float64), {}
    for k, v in rest:
        kept = buckets.setdefault(tuple(planes @ v > 0), [])
        hit = next((j for j, u in kept if u @ v >= 0.97), None)
        if hit is None:
            kept.append((k, v))
        else:
            near[k] = hit
    n, out = len(clips), len(passed) - len(exact) - len(near)
    want = {("all", "n_input"): n, ("all", "load_errors"): sum(r.load_error is not None for r in clips), ("all", "n_output"): out, ("all", "overall_retention_rate"): out / n, ("quality", "passed"): len(passed), ("quality", "mean_duration_sec"): np.mean(durations),
            ("deduplication", "exact_duplicates"): len(exact), ("deduplication", "near_duplicates"): len(near), ("deduplication", "n_kept"): out, ("deduplication", "near_groups"): len(set(near.values()))}
    want |= {("fail_categories", k): v for k, v in categories.items()}
    assert {k: found[k] for k in want} == pytest.approx(want, abs=1e-6) and len(passed) > 5 and {k for k in found if k[0] == "fail_categories"} == {("fail_categories", k) for k in categories}


def test_results_text():
    from lakesift.operators import report

    text = report.results_text({"diversity_impact": {"before_synthetic": {"overall": 0.5}, "after_synthetic_added": {"overall": 0.75}}, "wer_ablation": [{"synthetic_ratio": 0.0, "wer_overall": 8.0, "wer_female": 9.0}, {"synthetic_ratio": 0.5, "wer_overall": 7.5}], "key_findings": ["more is not always better"]})
    assert text.split("\n") == ["overall            0.500 -> 0.750 (up 0.250)", "  0%  overall 8.0 %  female 9.0 %", " 50%  overall 7.5 %   *", "- more is not always better"] and report.results_text({}) == ""
