"""Thresholds come from all labelled rows that weren't trained on."""

import random

import numpy as np
import pytest

from lakesift.llm import toxicity


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_thresholds_are_those_of_sorted_rows(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), float(np.float32(rng.choice([rng.gauss(0, 3), rng.randint(-3, 3)]))), rng.random()) for _ in range(600)]
    rows = [(lang, s, int(p < 1 / (1 + np.exp(1 - s)))) for lang, s, p in rows] + [("d", 1.0, 1), ("e", 2.0, 0)]
    got = toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, score float, toxic int"))
    for key in [(True, None), *((False, x) for x in "abcde")]:
        own = [(s, t) for lang, s, t in rows if key[0] or lang == key[1]]
        s, t = np.array([x for x, _ in own]), np.array([x for _, x in own])
        assert got[key][:2] == (len(t), t.sum())
        if 0 < t.sum() < len(t):
            assert got[key][2] == pytest.approx(toxicity.best_threshold(s, t))
    assert set(got) == {(True, None), *((False, x) for x in "abcde")}


def test_a_rare_language_has_all_its_labelled_rows(spark, monkeypatch):
    rng = random.Random(4)
    plain, rows = [f"word{k}" for k in range(200)], []
    for k in range(1500):
        lang, toxic = "rare" if k % 50 == 0 else "en", rng.random() < 0.4
        rows.append((k, " ".join(rng.choices(plain, k=30) + ["scum"] * (2 * toxic)), lang, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen = {}
    real = toxicity.best_thresholds
    monkeypatch.setattr(toxicity, "best_thresholds", lambda scored: seen.setdefault("found", real(scored)))
    model = toxicity.fit(df, df.select("doc_id", "toxic"), max_rows=80)
    assert seen["found"][True, None][0] == 1500 - 60
    assert seen["found"][False, "rare"][0] >= 20 and seen["found"][False, "rare"][1] >= toxicity.MIN_TOXIC
    assert model.thresholds["rare"] == seen["found"][False, "rare"][2]
