"""Charts of reports and results as SVG files: bars and lines, drawn from the tidy tables of operators.report, which are small."""

from __future__ import annotations

import os
from html import escape

from pyspark.sql import DataFrame

from lakesift.operators import report

COLOURS = ("#3b6ea5", "#d08c3f", "#5a9367", "#9c5a8a", "#7a7a7a", "#b0524f")
_W, _H, _LEFT, _TOP, _BOTTOM = 640, 360, 60, 40, 60


def _frame(title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{_W}" height="{_H}" font-family="sans-serif" font-size="12">'
    return "\n".join([head, f'<rect width="{_W}" height="{_H}" fill="white"/>', f'<text x="{_W / 2}" y="22" text-anchor="middle" font-size="15">{escape(title)}</text>', *body, "</svg>"])


def _text(x: float, y: float, what: str, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(what)}</text>'


def bars(title: str, rows: list[tuple], names: tuple[str, ...]) -> str:
    """Groups of bars: rows are (label, value of each of names)."""
    top = max([v or 0 for r in rows for v in r[1:]], default=0) or 1
    wide, tall = (_W - _LEFT - 20) / max(1, len(rows)), _H - _TOP - _BOTTOM
    out = []
    for i, (label, *values) in enumerate(rows):
        for j, v in enumerate(values):
            h, w = tall * (v or 0) / top, 0.8 * wide / len(values)
            x, y = _LEFT + i * wide + 0.1 * wide + j * w, _H - _BOTTOM - h
            out += [f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{COLOURS[j % len(COLOURS)]}"/>', _text(x + w / 2, y - 4, f"{v or 0:.4g}")]
        out.append(_text(_LEFT + (i + 0.5) * wide, _H - _BOTTOM + 16, str(label)))
    return _frame(title, [*out, *_legend(names)])


def lines(title: str, rows: list[tuple[float, str, float]]) -> str:
    """A line for each metric: rows are (x, metric, value)."""
    names = sorted({r[1] for r in rows})
    xs, ys = [r[0] for r in rows] or [0, 1], [r[2] for r in rows] or [0, 1]
    x0, xw, y0, yw = min(xs), (max(xs) - min(xs)) or 1, min(ys), (max(ys) - min(ys)) or 1
    at = lambda x, y: (_LEFT + (x - x0) / xw * (_W - _LEFT - 40), _H - _BOTTOM - (y - y0) / yw * (_H - _TOP - _BOTTOM))
    out = [_text(*at(x, y0 - 0.07 * yw), f"{x:.2g}") for x in sorted(set(xs))] + [_text(_LEFT - 8, at(x0, y)[1], f"{y:.3g}", "end") for y in (y0, y0 + yw)]
    for k, name in enumerate(names):
        points = [at(x, y) for x, n, y in sorted(rows) if n == name]
        colour = COLOURS[k % len(COLOURS)]
        out.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in points)}"/>')
        out += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="{colour}"/>' for x, y in points]
    return _frame(title, [*out, *_legend(tuple(names))])


def _legend(names: tuple[str, ...]) -> list[str]:
    step = (_W - _LEFT) / max(1, len(names))
    return [x for k, n in enumerate(names) for x in (f'<rect x="{_LEFT + k * step:.1f}" y="{_H - 24}" width="10" height="10" fill="{COLOURS[k % len(COLOURS)]}"/>', _text(_LEFT + k * step + 14, _H - 15, n, "start"))]


def save_report(spark, found: dict, folder: str) -> list[str]:
    """Charts of a curation report: the funnel, failures by kind, labels before and after, scores before and after."""
    pages = {"funnel": bars("Clips by stage", [(r.stage, r.n) for r in report.funnel(spark, found).orderBy("step").collect()], ("clips",))}
    if failed := found["quality"].get("fail_categories"):
        pages["failures"] = bars("Clips by what they fail", sorted(failed.items(), key=lambda x: (-x[1], x[0])), ("clips",))
    for axis in ("gender", "age", "accent"):
        if rows := [tuple(r) for r in report.shares_before_after(spark, found, axis).collect()]:
            pages[axis] = bars(f"{axis} in %", rows, ("before", "after"))
    pages["scores"] = bars("Diversity", [tuple(r) for r in report.scores_before_after(spark, found).collect()], ("before", "after"))
    return _save(pages, folder)


def save_ablation(results: DataFrame, folder: str) -> list[str]:
    """Charts of ablation results against the ratio: diversity, overlap, error rates."""
    rows = [(r.synthetic_ratio, r.metric, r.value) for r in report.ablation_series(results).collect()]
    parts = {"diversity": [r for r in rows if r[1].startswith("diversity_")], "overlap": [r for r in rows if r[1] == "acoustic_overlap"], "wer": [r for r in rows if r[1].startswith("wer")]}
    return _save({f"ablation_{k}": lines(f"{k} by share of synthetic rows", v) for k, v in parts.items() if v}, folder)


def _save(pages: dict[str, str], folder: str) -> list[str]:
    os.makedirs(folder, exist_ok=True)
    paths = [os.path.join(folder, f"{name}.svg") for name in pages]
    for path, page in zip(paths, pages.values()):
        with open(path, "w", encoding="utf-8") as f:
            f.write(page)
    return paths
