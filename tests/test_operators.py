import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesift.operators import ablation, dedup, diversity, gaps, mix, quality, synth, wer
from lakesift.plans import curation
from lakesift.sources import tables
from test_signals import SR, speech, tone


@pytest.fixture(scope="module")
def real(spark):
    rng = np.random.default_rng(42)
    pick = lambda names, p: names[rng.choice(len(names), p=p)]
    rows = [(f"r{k:04d}", f"/x/{k}.wav", f"s{k % 30}", gaps.PROMPTS[k % 50], pick(["male", "female"], [0.7, 0.3]), pick("american british australian indian canadian".split(), [0.55, 0.25, 0.1, 0.06, 0.04]), "twenties", 3.0, "real") for k in range(200)]
    return spark.createDataFrame(rows, "id string, path string, speaker_id string, sentence string, gender string, accent string, age string, duration_sec double, source string")


@pytest.fixture(scope="module")
def synthetic(spark):
    rng = np.random.default_rng(99)
    keys = list(gaps.VOICES)
    rows = [(f"y{k:04d}", f"/y/{k}.wav", f"v{k % 14}", gaps.PROMPTS[k % 50], *keys[rng.integers(len(keys))], "unknown", 4.0, "synthetic") for k in range(80)]
    return spark.createDataFrame(rows, "id string, path string, speaker_id string, sentence string, gender string, accent string, age string, duration_sec double, source string")


def test_mix_sizes(real, synthetic):
    for ratio, want in ((0.0, (160, 0)), (0.25, (120, 40)), (0.5, (80, 80)), (0.75, (40, 80)), (1.0, (0, 80))):
        m = mix.mix(real, synthetic, ratio)
        assert (m.filter("source = 'real'").count(), m.filter("source = 'synthetic'").count()) == want
    with pytest.raises(ValueError):
        mix.sizes(1, 1, 1.5)
    assert mix.sizes(200, 0, 0.0) == (200, 0)
    assert [mix.sizes(415, 203, r) for r in mix.RATIOS] == [(406, 0), (365, 41), (304, 102), (203, 203), (102, 203), (0, 203)]  # T14


def test_splits_and_strata(real, synthetic):
    n = {r.mix_synthetic_ratio: r.n for r in mix.splits(real, synthetic).groupBy("mix_synthetic_ratio").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {0.0: 160, 0.1: 160, 0.25: 160, 0.5: 160, 0.75: 120, 1.0: 80}
    s = mix.stratified(real, 50)
    assert s.count() == 50 == s.select("id").distinct().count()  # T6
    assert s.select("accent").distinct().count() == 5
    assert mix.stratified(real, 0).count() == 0 and mix.stratified(real, 1000).count() == 200


def test_balance(spark, real):
    got = {r.gender: r["count"] for r in mix.balance(real).groupBy("gender").count().collect()}
    assert got["male"] == got["female"]
    rows = [(k, "m" if k < 140 else "f") for k in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "id int, gender string")
    got = {r.gender: r["count"] for r in mix.balance(df, {"m": 0.75, "f": 0.25}).groupBy("gender").count().collect()}
    assert got == {"m": 140, "f": 46}  # T7
    got = {r.gender: r["count"] for r in mix.balance(df, {"m": 0.75, "f": 0.25}, inverse=True).groupBy("gender").count().collect()}
    assert got == {"m": 20, "f": 60}
    assert mix.balance(df.drop("gender")).count() == 201


def test_holdout_is_capped(spark):
    train, test = mix.holdout(spark.range(20))
    assert (train.count(), test.count()) == (0, 20)  # T23


def test_gap_plan(real, spark):
    targets = gaps.analyse(real, max_ratio=0.5, min_gap=0.02)
    assert targets and any(t.gender == "female" for t in targets)
    assert sum(t.n_samples for t in targets) <= 105 and all(len(t.texts) == t.n_samples for t in targets)
    assert [t.priority for t in targets] == sorted((t.priority for t in targets), reverse=True)
    even = spark.createDataFrame([(str(k), "male" if k % 2 else "female", "american") for k in range(100)], "id string, gender string, accent string")
    assert gaps.analyse(even, {k: v for k, v in gaps.VOICES.items() if k[1] == "american"}, min_gap=0.10) == []
    assert gaps.analyse(real) == gaps.analyse(real)  # T9
    made = synth.generate(gaps.plan_frame(spark, targets[:2]), gate=None)
    assert made.count() == sum(t.n_samples for t in targets[:2]) and made.select("id").distinct().count() == made.count()


def test_augment_raises_entropy(real):
    targets, both, report = curation.augment(real, gate=None)
    assert report["after"]["gender_entropy"] > report["before"]["gender_entropy"] and both.count() == 200 + sum(t.n_samples for t in targets)


def test_diversity_corner_cases(spark):
    one = spark.createDataFrame([("a",), ("a",)], "speaker_id string")
    assert diversity.balance(one).first()[0] == pytest.approx(-1.0, abs=1e-6)  # T12
    assert diversity.balance(one.limit(0)).first()[0] == 0.0
    m = spark.createDataFrame([("A", " Male ", ""), ("A", "male", None), ("", None, "x y")], "speaker_id string, gender string, sentence string")
    r = diversity.report(m)
    assert r["n_speakers"] == 2 and r["gender_distribution"]["male"] == {"count": 2, "pct": 66.67} and r["duration"] == {}
    axes = r["diversity_score"]
    assert axes["overall"] == pytest.approx((axes["gender_entropy"] + axes["speaker_balance"]) / 2)  # T13
    assert diversity.sentence_stats(spark.createDataFrame([("a",), ("a b",), ("a " * 10,)], "sentence string")).first().p5 == pytest.approx(1.1)
    assert diversity.scores(spark.createDataFrame([(1,)], "z int")).first().overall is None


def test_near_is_a_fold_not_a_closure(spark):
    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    df = spark.createDataFrame([("a", 0, at(0)), ("b", 1, at(10)), ("c", 2, at(20))], "id string, pos int, embedding array<double>")
    for f in (dedup.near, dedup.near_blocks):
        assert [tuple(r) for r in f(df, 0.98, 0, 2).collect()] == [("b", "a")]  # T20


def test_near_variants_agree(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    v = np.concatenate([base, base + rng.normal(0, 0.3, base.shape)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, k, x.tolist()) for k, x in enumerate(v)], "id int, pos int, embedding array<double>")
    for bits in (0, 2):
        assert {tuple(r) for r in dedup.near(df, 0.8, bits, 8).collect()} == {tuple(r) for r in dedup.near_blocks(df, 0.8, bits, 8).collect()} != set()


@pytest.mark.parametrize("ids", ["number", "text"])
def test_large_buckets_go_by_blocks(spark, monkeypatch, ids):
    """A hot bucket of many blocks has the result of one fold over it."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    v = base[rng.integers(0, 30, 200)] + rng.normal(0, 0.35, (200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k if ids == "number" else f"r{k:03d}", int(k * 7 % 200), x.tolist()) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, f"id {'long' if ids == 'number' else 'string'}, pos int, embedding array<double>")
    want = {tuple(r) for r in dedup.near(df, 0.8, 0, 8).collect()}
    monkeypatch.setattr(dedup, "BLOCK", 32)
    got = [tuple(r) for r in dedup.near_blocks(df, 0.8, 0, 8).collect()]
    assert set(got) == want and len(got) == len(want) > 50


def _distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_wer(spark):
    pairs = [("hello world", "hello world", 0), ("one two three", "four five six", 1), ("the cat sat here", "the cat sat there", 0.25), ("", "hello", 1), ("", "", 0), (None, "x", 1), ("A b", "a B", 0), ("一 二 三", "一 二 四", 1 / 3)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "id int, sentence string, hypothesis string")
    got = {r.id: r.wer for r in wer.score(df).collect()}
    assert got == pytest.approx({k: p[2] for k, p in enumerate(pairs)})
    two = wer.score(spark.createDataFrame([("hello world", "hello world"), ("the cat sat", "the dog sat")], "sentence string, hypothesis string"))
    assert wer.corpus(two).first().wer == 20.0 and wer.corpus(two, macro=True).first().wer == 16.67  # T21


def test_wer_against_dynamic_programming(spark):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(list("abcdef"), rng.integers(0, 30))), " ".join(rng.choice(list("abcdefg"), rng.integers(0, 30)))) for k in range(40)]
    got = {r.id: r.wer_edits for r in wer.score(spark.createDataFrame(rows, "id int, sentence string, hypothesis string")).collect()}
    assert got == {k: _distance(a.split(), b.split()) for k, a, b in rows}


def test_compare(spark):
    df = spark.createDataFrame([("a b c d", "a x y d", "a b y d")], "sentence string, base string, tuned string")
    r = wer.compare(df, "sentence", "base", "tuned").first()
    assert (r.base_wer, r.tuned_wer, r.delta, r.relative_pct, r.direction) == (50.0, 25.0, -25.0, 50.0, "improvement")


def test_curation_end_to_end(spark, tmp_path):
    clips = {"a": speech(), "b": speech(), "c": (speech() * 0.98).astype(np.float32), "d": tone(seconds=0.1), "e": np.ones(SR), "f": np.zeros(SR)}
    rows = [(k, [float(v) for v in x], SR, "broken" if k == "f" else None) for k, x in clips.items()]
    frame = spark.createDataFrame(rows, "id string, samples array<float>, sr int, load_error string")
    manifest = spark.createDataFrame([(k, f"{k}.wav", p, "s", "words here", "male") for p, k in enumerate(clips)], "id string, path string, pos int, speaker_id string, sentence string, gender string")
    kept, report = curation.curate(manifest, frame, out=str(tmp_path))
    assert [r.id for r in kept.select("id").collect()] == ["a"]
    assert report["n_input"] == 6 and report["load_errors"] == 1 and report["quality"]["passed"] == 3
    assert report["deduplication"]["exact_duplicates"] == 1 and report["deduplication"]["near_duplicates"] == 1
    assert {"too_short", "clipped", "low_snr"} <= set(report["quality"]["fail_categories"])  # T17
    assert json.load(open(tmp_path / "curation_report.json"))["n_output"] == 1
    assert {"duration_sec", "snr_db", "source"} <= set(curation.export_view(kept).columns)  # T15


def test_empty_manifest(spark, real, synthetic):
    none = real.limit(0)
    assert diversity.report(none)["n_samples"] == 0
    assert mix.mix(real, synthetic.limit(0), 0.0).count() == 200
    assert ablation.overlap(none.withColumn("embedding", F.array(F.lit(1.0))), none.withColumn("embedding", F.array(F.lit(1.0)))).first()[0] is None
    assert quality.summary(spark.createDataFrame([], "snr_db double, duration_sec double, silence_ratio double, is_clipped boolean, passes boolean")).first().total == 0


def test_transcription_backend(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, sentence string")

    def backend():
        return lambda p: "x" if p == "a" else 1 / 0

    assert [r.hypothesis for r in ablation.transcribe(df, backend).orderBy("path").collect()] == ["x", ""]


def test_tables(spark, tmp_path):
    spark.createDataFrame([("a", "p")], "id string, path string").write.parquet(str(tmp_path / "m"))
    assert tables.read_manifest(spark, str(tmp_path / "m")).first().source == "real"
    spark.range(2).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "bad"))
    tables.write_json({"a": float("nan"), "b": {1: 2}}, str(tmp_path / "r.json"))
    assert tables.read_json(str(tmp_path / "r.json")) == {"a": None, "b": {"1": 2}}


def test_duplicates_compute_their_rows_once(spark):
    """What is expensive to make (sounds' MD5) isn't made again for each step of the assignment."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(3)
    rows = [(k, k, str(k % 50), rng.normal(size=8).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, pos long, md5 string, embedding array<double>").mapInArrow(count, "id long, pos long, md5 string, embedding array<double>")
    found = dedup.assign(df, 0.5, 1, 8).collect()
    assert {r.kind for r in found} == {"exact", "near"} and seen.value == 60
