"""python -m lakesift.cli COMMAND: curate, augment, ablate, voices."""

from __future__ import annotations

import argparse

from lakesift.operators import gaps, mix, quality, report, synth
from lakesift.plans import curation
from lakesift.session import session
from lakesift.sources import tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lakesift")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("curate", help="quality filter, dedup and reports of a manifest and its audio files")
    p.add_argument("--manifest", required=True)
    p.add_argument("--audio", required=True, help="folder of the clips")
    p.add_argument("--out", default="outputs")
    t = quality.CLI_THRESHOLDS
    for name, value in (("min-duration", t.min_duration_sec), ("max-duration", t.max_duration_sec), ("min-snr", t.min_snr_db), ("max-silence", t.max_silence_ratio), ("dedup-threshold", 0.97)):
        p.add_argument(f"--{name}", type=float, default=value)
    p = commands.add_parser("augment", help="plan and make synthetic clips for under-represented groups")
    p.add_argument("--manifest", required=True)
    p.add_argument("--out", default="outputs/synthetic")
    p.add_argument("--max-ratio", type=float, default=0.6)
    p.add_argument("--min-gap", type=float, default=0.03)
    p.add_argument("--dry-run", action="store_true", help="only print the plan")
    p.add_argument("--min-snr", type=float, default=synth.GATE.min_snr_db)
    p = commands.add_parser("ablate", help="mixes of real and synthetic rows at several ratios")
    p.add_argument("--real", required=True)
    p.add_argument("--synthetic", required=True)
    p.add_argument("--out", default="results")
    p.add_argument("--ratios", type=float, nargs="+", default=list(mix.RATIOS))
    p.add_argument("--seed", help="of the holdout and the samples", type=int, default=42)
    commands.add_parser("voices", help="the voice catalog")
    a = parser.parse_args(argv)
    if a.command == "voices":
        for (gender, accent), names in gaps.VOICES.items():
            print(f"{gender:8s} {accent:14s} {', '.join(names)}")
        return
    spark = session()
    if a.command == "curate":
        limits = quality.Thresholds(a.min_duration, a.max_duration, a.min_snr, a.max_silence)
        _, found = curation.curate_files(tables.read_manifest(spark, a.manifest), a.audio, thresholds=limits, dedup_threshold=a.dedup_threshold, out=a.out)
        print(report.curation_text(found))
    elif a.command == "augment":
        gate = quality.Thresholds(0.5, 25.0, a.min_snr, 0.5)
        targets, both, found = curation.augment(tables.read_manifest(spark, a.manifest), a.out, a.dry_run, gate=gate, max_ratio=a.max_ratio, min_gap=a.min_gap)
        print(report.plan_text(targets))
        if both is not None:
            tables.write_parquet(both, f"{a.out}/augmented_manifest.parquet")
            tables.write_json(found, f"{a.out}/augmentation_report.json")
    else:
        results = curation.ablate(tables.read_manifest(spark, a.real), tables.read_manifest(spark, a.synthetic, "synthetic"), tuple(a.ratios), a.seed, a.out)
        print(report.ablation_text([r.asDict() for r in results.collect()]))


if __name__ == "__main__":
    main()
