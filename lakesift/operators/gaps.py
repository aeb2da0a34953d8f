"""Demographic gaps and the plan of synthetic speech that would close them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.functions.text import accent_column
from lakesift.schemas import PLAN

#: Voices of a speech service: locale, accent, gender, names in the order of preference.
_CATALOG = """
en-US american male Guy Christopher Eric
en-US american female Jenny Aria Michelle
en-GB british male Ryan Thomas
en-GB british female Sonia Libby Maisie
en-AU australian male William
en-AU australian female Natasha
en-IN indian male Prabhat
en-IN indian female Neerja
en-CA canadian male Liam
en-CA canadian female Clara
en-IE irish female Emily
en-NZ new_zealand female Molly
en-ZA south_african male Luke
en-ZA south_african female Leah
"""
#: By gender and accent.
VOICES = {(g, a): [f"{where}-{name}Neural" for name in names] for where, a, g, *names in (line.split() for line in _CATALOG.strip().split("\n"))}
_WHO = ("The gardener", "A young doctor", "My neighbour", "The night train", "Our teacher")
_WHAT = (
    "waited near the old bridge until the rain stopped.", "asked for a quiet room on the second floor.", "brought seven green apples from the market.", "will be ready at half past nine tomorrow.", "has never seen the ocean in winter.",
    "left a short message about the new schedule.", "found the missing key under a stack of papers.", "prefers strong coffee and fresh bread.", "could not explain why the lights went out.", "travelled slowly through the narrow valley.",
)
PROMPTS = [f"{who} {what}" for what in _WHAT for who in _WHO]


@dataclass
class Target:
    gender: str
    accent: str
    voice_id: str
    n_samples: int
    priority: float
    age_group: str = "unknown"
    texts: list[str] = field(default_factory=list)
    plan_pos: int = 0


def shares(df: DataFrame, column: str) -> dict[str, float]:
    """Shares of labels, nulls aside, the most frequent first."""
    rows = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).count().orderBy(F.desc("count"), "k").collect()
    total = sum(r["count"] for r in rows)
    return {r.k: r["count"] / total for r in rows}


def summary(df: DataFrame, columns: tuple[str, ...] = ("gender", "accent", "age")) -> DataFrame:
    """(column, label, share) to three places."""
    parts = []
    for c in (c for c in columns if c in df.columns):
        per = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
        total = per.agg(F.sum("n").alias("total"))
        parts.append(per.crossJoin(total).select(F.lit(c).alias("column"), "label", F.bround(F.col("n") / F.col("total"), 3).alias("share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def analyse(
    df: DataFrame, catalog: dict | None = None, gender_target: dict | None = None, accent_target: dict | None = None, max_ratio: float = 0.6, min_gap: float = 0.03, prompts: list[str] | None = None
) -> list[Target]:
    """The plan, the largest gaps first. Only label counts leave the cluster; half the budget goes to gender, half to accent. Labels are taken as they are written."""
    catalog, prompts, n = catalog or VOICES, prompts or PROMPTS, df.count()
    half = int(n * max_ratio) // 2
    targets: list[Target] = []
    if "gender" in df.columns:
        targets += _by_gender(shares(df, "gender"), n, half, catalog, gender_target, min_gap)
    if accent_column(df):
        targets += _by_accent(shares(df, accent_column(df)), n, half, catalog, accent_target, min_gap)
    for i, t in enumerate(targets):
        t.texts = [prompts[(7 * i + j) % len(prompts)] for j in range(t.n_samples)]
    targets.sort(key=lambda t: -t.priority)  # stable
    for i, t in enumerate(targets):
        t.plan_pos = i
    return targets


def _by_gender(seen: dict, n: int, budget: int, catalog: dict, target: dict | None, min_gap: float) -> list[Target]:
    labels = [g for g in ("male", "female", "other") if g in seen or g in (target or {})]
    out: list[Target] = []
    for g in labels:
        gap = (target.get(g, 0.0) if target else 1 / len(labels)) - seen.get(g, 0.0)
        wanted = min(int(gap * n * 1.1), budget // len(labels))
        keys = [k for k in catalog if k[0] == g][:3]
        if gap < min_gap or wanted < 1 or not keys:
            continue
        if each := wanted // len(keys):
            out += [Target(g, k[1], catalog[k][0], each, gap) for k in keys]
    return out


def _by_accent(seen: dict, n: int, budget: int, catalog: dict, target: dict | None, min_gap: float) -> list[Target]:
    universe = sorted(target) if target else sorted({k[1] for k in catalog} | set(list(seen)[:10]))
    out: list[Target] = []
    for accent in universe:
        gap = (target[accent] if target else 1 / len(universe)) - seen.get(accent, 0.0)
        wanted = min(int(gap * n * 1.1), budget // len(universe))
        if gap < min_gap or wanted < 1:
            continue
        out += [Target(g, accent, catalog[g, accent][0], max(1, wanted // 2), 0.8 * gap) for g in ("female", "male") if (g, accent) in catalog]
    return out


def plan_frame(spark, targets: list[Target]) -> DataFrame:
    rows = [(t.plan_pos, t.gender, t.accent, t.age_group, t.voice_id, t.n_samples, t.texts, float(t.priority)) for t in targets]
    return spark.createDataFrame(rows, PLAN)
