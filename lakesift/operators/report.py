"""Tidy tables for charts, and text summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def funnel(spark: SparkSession, report: dict) -> DataFrame:
    """(step, stage, n) of a curation report."""
    rows = [(0, "input", report["n_input"]), (1, "quality", report["quality"]["passed"]), (2, "dedup", report["n_output"])]
    return spark.createDataFrame(rows, "step int, stage string, n bigint")


def shares_before_after(spark: SparkSession, report: dict, axis: str = "gender") -> DataFrame:
    """(label, before_pct, after_pct) over the labels of both."""
    before, after = (report[f"diversity_{k}"].get(f"{axis}_distribution", {}) for k in ("before", "after"))
    rows = [(x, float(before.get(x, {}).get("pct", 0.0)), float(after.get(x, {}).get("pct", 0.0))) for x in sorted({*before, *after})]
    return spark.createDataFrame(rows, "label string, before_pct double, after_pct double")


def scores_before_after(spark: SparkSession, report: dict) -> DataFrame:
    """(axis, before, after)."""
    before, after = (report[f"diversity_{k}"]["diversity_score"] for k in ("before", "after"))
    return spark.createDataFrame([(k, before[k], after.get(k)) for k in before], "axis string, before double, after double")


def ablation_series(results: DataFrame) -> DataFrame:
    """(synthetic_ratio, metric, value) of ablation results, for charts against the ratio."""
    metrics = [c for c in results.columns if c.startswith("diversity_") or c in ("acoustic_overlap", "wer_eval")]
    wide = results.select("synthetic_ratio", *(results[c].cast("double").alias(c) for c in metrics))
    return wide.unpivot("synthetic_ratio", metrics, "metric", "value").filter("value is not null")


def against_real(results: DataFrame) -> DataFrame:
    """(synthetic_ratio, delta_diversity, delta_overlap, best_overlap, best_wer): each mix against the one without synthetic rows, and whether it is the best (of equal ones, all)."""
    same = results.filter("synthetic_ratio = 0").agg(F.max("diversity_overall").alias("d0"), F.max("acoustic_overlap").alias("o0"))
    top = results.agg(F.max("acoustic_overlap").alias("o1"), F.min("wer_eval").alias("w1"))
    both = results.crossJoin(F.broadcast(same)).crossJoin(F.broadcast(top))
    return both.select(
        "synthetic_ratio", F.bround(F.col("diversity_overall") - F.col("d0"), 4).alias("delta_diversity"), F.bround(F.col("acoustic_overlap") - F.col("o0"), 4).alias("delta_overlap"),
        F.coalesce(F.col("acoustic_overlap") == F.col("o1"), F.lit(False)).alias("best_overlap"), F.coalesce(F.col("wer_eval") == F.col("w1"), F.lit(False)).alias("best_wer"),
    )


def results_text(results: dict) -> str:
    """A results file for the console: scores before and after synthetic rows, error rates by ratio with the best marked, and the findings. Parts that are absent are left out."""
    lines, change = [], results.get("diversity_impact", {})
    before, after = change.get("before_synthetic", {}), change.get("after_synthetic_added", {})
    for axis in (k for k in before if k in after and isinstance(before[k], (int, float))):
        delta = after[axis] - before[axis]
        lines.append(f"{axis:18s} {before[axis]:.3f} -> {after[axis]:.3f} ({'up' if delta > 0 else 'down'} {abs(delta):.3f})")
    rows = results.get("wer_ablation", [])
    least = min((r["wer_overall"] for r in rows), default=None)
    for r in rows:
        rest = "  ".join(f"{k[4:]} {r[k]:.1f} %" for k in ("wer_female", "wer_accented", "wer_underrep") if k in r)
        lines.append(f"{r['synthetic_ratio']:4.0%}  overall {r['wer_overall']:.1f} %  {rest}" + (" *" if r["wer_overall"] == least else ""))
    return "\n".join([*lines, *(f"- {x}" for x in results.get("key_findings", []))])


def curation_text(report: dict) -> str:
    """What a curation run did, for the console."""
    q, d = report["quality"], report["deduplication"]
    hours = report["diversity_after"].get("duration", {}).get("total_hours")
    overall = report["diversity_after"]["diversity_score"].get("overall")
    show = lambda x, f: "N/A" if x is None else format(x, f)
    return "\n".join([
        f"input          {report['n_input']} clips, {report['load_errors']} could not be read",
        f"quality        {q['passed']} pass ({100 * q['pass_rate']:.1f} %)",
        f"duplicates     {d['exact_duplicates']} exact, {d['near_duplicates']} near",
        f"output         {report['n_output']} clips ({100 * report['overall_retention_rate']:.1f} %), {show(hours, '.2f')} h",
        f"diversity      {show(overall, '.3f')}",
    ])


def plan_text(targets: list, top: int = 15) -> str:
    lines = [f"{t.plan_pos + 1:3d}. {t.gender:8s} {t.accent:14s} {t.voice_id:24s} {t.n_samples:5d}  {t.priority:.3f}" for t in targets[:top]]
    return "\n".join([*lines, f"{sum(t.n_samples for t in targets)} utterances for {len(targets)} targets"])


def ablation_text(rows: list[dict]) -> str:
    """A line for each ratio; all ratios of the least error rate are marked."""
    known = [r["wer_eval"] for r in rows if r.get("wer_eval") is not None]
    mark = lambda r: " *" if known and r.get("wer_eval") == min(known) else ""
    show = lambda x: "-" if x is None else f"{x:.4f}"
    return "\n".join(f"{r['synthetic_ratio']:.2f}  {r['n_total']:6d}  {show(r.get('diversity_overall'))}  {show(r.get('acoustic_overlap'))}  {show(r.get('wer_eval'))}{mark(r)}" for r in rows)
