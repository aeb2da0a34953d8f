"""Whole runs: curation, augmentation, ablation."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.operators import ablation, charts, dedup, diversity, gaps, mix, quality, synth
from lakesift.session import written
from lakesift.sources import audio, tables


def curate(manifest: DataFrame, clips: DataFrame, thresholds: quality.Thresholds = quality.Thresholds(), dedup_threshold: float = dedup.THRESHOLD, n_bits: int = dedup.N_BITS, out: str | None = None) -> tuple[DataFrame, dict]:
    """(survivors with qf_ columns, report). clips are (id, samples, sr, load_error), or already their feature table, measured with these thresholds. The feature table, without samples, is made once and feeds everything after it."""
    began = time.time()
    features = (quality.measure(clips, thresholds) if "samples" in clips.columns else clips).persist()
    ordered = manifest if "pos" in manifest.columns else written(manifest.withColumn("pos", F.monotonically_increasing_id()))
    annotated = quality.attach(ordered, features).persist()
    passed = features.filter("passes").join(ordered.select("id", "pos"), "id")
    assignment = dedup.assign(passed, dedup_threshold, n_bits, blocks=True).persist()
    kept = dedup.keep(annotated.filter("qf_passes"), assignment).drop("pos")
    n_input, n_output = annotated.count(), kept.count()
    report = {
        "n_input": n_input,
        "load_errors": features.filter("load_error is not null").count() if "load_error" in features.columns else 0,
        "quality": quality.summary(features).first().asDict() | {
            "fail_reasons": {r.reason: r.n for r in quality.reason_counts(features, False).collect()}, "fail_categories": {r.reason: r.n for r in quality.reason_counts(features).collect()},
        },
        "deduplication": dedup.report(passed, assignment).first().asDict(),
        "diversity_before": diversity.report(annotated),
        "diversity_after": diversity.report(kept),
        "n_output": n_output,
        "overall_retention_rate": n_output / max(1, n_input),
        "elapsed_sec": round(time.time() - began, 1),
    }
    if out:
        tables.write_parquet(kept, f"{out}/filtered_manifest.parquet")
        tables.write_json(report, f"{out}/curation_report.json")
        charts.save_report(manifest.sparkSession, report, f"{out}/charts")
    return kept, report


def curate_files(manifest: DataFrame, folder: str, thresholds: quality.Thresholds = quality.Thresholds(), **options) -> tuple[DataFrame, dict]:
    return curate(manifest, quality.measure_files(audio.load_files(manifest, folder), t=thresholds), thresholds, **options)


def export_view(kept: DataFrame) -> DataFrame:
    """The survivors with the names that later steps read: duration_sec, snr_db, silence_ratio, source."""
    named = kept.withColumnsRenamed({f"qf_{c}": c for c in ("duration_sec", "snr_db", "silence_ratio")}).drop("qf_passes")
    return named if "source" in named.columns else named.withColumn("source", F.lit("real"))


def augment(manifest: DataFrame, folder: str | None = None, dry_run: bool = False, backend=synth.tone_backend, gate: quality.Thresholds | None = synth.GATE, **analysis) -> tuple[list, DataFrame | None, dict]:
    """(targets, augmented manifest, report): the plan, what could be made of it, and the scores before and after with their differences."""
    real = manifest if "source" in manifest.columns else manifest.withColumn("source", F.lit("real"))
    targets = gaps.analyse(real, **analysis)
    before = diversity.scores(diversity.normalise(real)).first().asDict()
    if dry_run:
        return targets, None, {"before": before}
    made = synth.generate(gaps.plan_frame(real.sparkSession, targets), folder, backend, gate=gate)
    both = real.unionByName(made, allowMissingColumns=True)
    after = diversity.scores(diversity.normalise(both)).first().asDict()
    delta = {k: None if before[k] is None or after.get(k) is None else round(after[k] - before[k], 4) for k in before}
    return targets, both, {"n_real": real.count(), "n_synthetic": made.count(), "before": before, "after": after, "delta": delta}


def ablate(real: DataFrame, synthetic: DataFrame, ratios: tuple[float, ...] = mix.RATIOS, seed: int = 42, out: str | None = None, backend=None) -> DataFrame:
    """Results by ratio on a test set held out of the real rows."""
    train, test = mix.holdout(real, seed)
    splits = mix.splits(train.withColumn("source", F.lit("real")), synthetic.withColumn("source", F.lit("synthetic")), ratios, seed)
    wer_eval = ablation.evaluate(test, backend)["wer"] if backend is not None else None
    results = ablation.run(splits, test if "embedding" in test.columns else None, wer_eval=wer_eval, seed=seed)
    if out:
        ablation.save(results, out)
        charts.save_ablation(results, f"{out}/charts")
    return results
