"""The operators as queries over the given tables, with DuckDB SQL for those that SQL can express. Documents serve as a manifest, embeddings as vectors and as short signals."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.functions import dsp, signals
from lakesift.functions.text import words
from lakesift.operators import ablation, dedup, diversity, gaps, mix, quality, report, wer
from lakesift.session import shared_folder
from lakesift.sources import tables

#: Signals are 64 samples at this rate: frames of 16 samples, half-overlapping.
SR, FRAME = 640, 16
#: Thresholds at which the gate bites on these signals.
GATE = quality.Thresholds(0.05, 30.0, 6.0, 0.4, 0.3, -19.0)
BITS, NEAR = 4, 0.30


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a manifest; labels are written unevenly, as people write them."""
    d, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    age = F.when(F.col("n_chars") < 500, "Twenties").when(F.col("n_chars") < 2000, " thirties ").when(F.col("n_chars") < 8000, "FORTIES").otherwise(" ")
    messy = F.when(F.col("doc_id") % 17 == 0, " ").when(F.col("doc_id") % 3 == 0, F.upper("lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), "lang", F.lit("\t"))).otherwise(F.col("lang"))
    gender = F.when(F.col("quality") == 1, "male").when(F.col("quality") == 0, "Female ")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("speaker_id"), messy.alias("accent"), gender.alias("gender"), age.alias("age"), F.col("text").alias("sentence"), (F.col("n_chars") / 15.0).alias("duration_sec")
    )


_M = """WITH raw AS (SELECT doc_id AS id, source AS speaker_id, text AS sentence, n_chars / 15.0 AS duration_sec,
 CASE WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 3 = 1 THEN '  ' || lang || chr(9) ELSE lang END AS accent,
 CASE quality WHEN 1 THEN 'male' WHEN 0 THEN 'Female ' END AS gender,
 CASE WHEN n_chars < 500 THEN 'Twenties' WHEN n_chars < 2000 THEN ' thirties ' WHEN n_chars < 8000 THEN 'FORTIES' ELSE ' ' END AS age
 FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT id, speaker_id, sentence, duration_sec, nullif(regexp_replace(lower(accent), '^\\s+|\\s+$', '', 'g'), '') AS accent,
 nullif(regexp_replace(lower(gender), '^\\s+|\\s+$', '', 'g'), '') AS gender, nullif(regexp_replace(lower(age), '^\\s+|\\s+$', '', 'g'), '') AS age FROM raw)
"""
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_W, _WL = _WORDS.format("sentence"), _WORDS.format("lower(sentence)")


def _norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.normalise(manifest(spark, sf_dir))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.bround(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _on_manifest(f: Callable[[DataFrame], DataFrame], digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(f(_norm(spark, sf_dir)), digits)


def _dist_sql(c: str) -> str:
    return _M + f"SELECT {c} AS label, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM m GROUP BY {c}"


def _entropy_sql(c: str, name: str = "value", m: str = "m") -> str:
    return f"(SELECT CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p)) / ln(count(*)) END AS {name} FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {m} WHERE {c} IS NOT NULL GROUP BY {c}))"


_BALANCE = "(SELECT coalesce(sum(-p * ln(p + 1e-12)) / ln(count(*) + 1e-12), 0) AS speaker_balance FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM m WHERE speaker_id IS NOT NULL GROUP BY speaker_id))"
_MOMENTS = "round_even(avg({0}), 6) AS mean, round_even(median({0}), 6) AS median, round_even(quantile_cont({0}, 0.05), 6) AS p5, round_even(quantile_cont({0}, 0.95), 6) AS p95, round_even(stddev_samp({0}), 6) AS std"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of each embedding as a signal, by expressions alone."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    df = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x")).withColumn("levels", signals.frame_levels(F.col("x"), FRAME))
    n = F.size("x")
    return df.select(
        "id", (n / SR).alias("duration_sec"), F.bround(signals.snr_db(F.col("levels")), 6).alias("snr_db"), F.bround(signals.silence_ratio(F.col("levels"), n, FRAME // 2, 12.0), 6).alias("silence_ratio"),
        signals.is_clipped(F.col("x"), GATE.clipping).alias("is_clipped"), F.bround(signals.rms_db(F.col("x")), 6).alias("rms_db"),
    )


_F = f"""WITH s AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
z AS (SELECT id, x, list_concat(list_concat(list_resize([]::DOUBLE[], {FRAME // 2}, 0.0), x), list_resize([]::DOUBLE[], {FRAME // 2}, 0.0)) AS y FROM s),
l AS (SELECT id, x, list_transform(range(0, (len(y) - {FRAME}) // {FRAME // 2} + 1), lambda k: sqrt(list_sum(list_transform(y[k * {FRAME // 2} + 1 : k * {FRAME // 2} + {FRAME}], lambda v: v * v)) / {FRAME})) AS levels FROM z),
h AS (SELECT *, list_filter(levels, lambda v: v > 0) AS heard, list_max(levels) AS peak, len(x) AS n FROM l),
q AS (SELECT *, list_aggregate(heard, 'quantile_cont', 0.1) AS quiet, list_aggregate(heard, 'quantile_cont', 0.9) AS loud FROM h),
f AS (SELECT id, n / {SR} AS duration_sec,
 round_even(CASE WHEN len(heard) = 0 THEN 0 WHEN quiet < 1e-10 THEN 60 WHEN loud < 1e-10 THEN 0 ELSE least(greatest(20 * log10(loud / (quiet + 1e-10)), 0), 80) END, 6)::DOUBLE AS snr_db,
 round_even(CASE WHEN peak <= 0 THEN 1 ELSE least(greatest(1 - list_sum(list_transform(range(0, len(levels)), lambda k:
   CASE WHEN 20 * log10(greatest(levels[k + 1], 1e-5)) - 20 * log10(greatest(peak, 1e-5)) > -12.0 THEN least((k + 1) * {FRAME // 2}, n) - least(k * {FRAME // 2}, n) ELSE 0 END)) / n, 0), 1) END, 6)::DOUBLE AS silence_ratio,
 len(list_filter(x, lambda v: abs(v) >= {GATE.clipping})) / len(x) > 0.001 AS is_clipped,
 round_even(CASE WHEN sqrt(list_sum(list_transform(x, lambda v: v * v)) / n) < 1e-10 THEN -120 ELSE 20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / n)) END, 6)::DOUBLE AS rms_db FROM q),
g AS (SELECT *, list_filter([CASE WHEN duration_sec < {GATE.min_duration_sec} THEN 'too_short' END, CASE WHEN duration_sec > {GATE.max_duration_sec} THEN 'too_long' END, CASE WHEN snr_db < {GATE.min_snr_db} THEN 'low_snr' END,
 CASE WHEN silence_ratio > {GATE.max_silence_ratio} THEN 'too_silent' END, CASE WHEN is_clipped THEN 'clipped' END, CASE WHEN rms_db < {GATE.min_rms_db} THEN 'too_quiet' END], lambda r: r IS NOT NULL) AS fail_reasons FROM f)
"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = quality.reason_codes(F.col("duration_sec"), F.col("snr_db"), F.col("silence_ratio"), F.col("is_clipped"), F.col("rms_db"), GATE)
    return _features(spark, sf_dir).withColumn("fail_reasons", codes).withColumn("passes", F.size("fail_reasons") == 0)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "embedding")


def _planes_sql(n_bits: int, source: str = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings") -> str:
    rows = ", ".join(f"({i}, {[float(v) for v in p]})" for i, p in enumerate(dsp.planes(n_bits, 64)))
    return f"""planes(i, plane) AS (VALUES {rows}), v AS MATERIALIZED ({source}),
b AS MATERIALIZED (SELECT id, any_value(e) AS e, sum(CASE WHEN list_dot_product(e, list_transform(plane, lambda x: x::DOUBLE)) > 0 THEN 1 << i ELSE 0 END)::BIGINT AS bucket FROM v, planes GROUP BY id)"""


def near_sql(n_bits: int, threshold: float, *source: str) -> str:
    """Near duplicates in SQL, as CTEs after WITH RECURSIVE; the last is near (id, canonical_id). source gives (id, e)."""
    return (
        _planes_sql(n_bits, *source)
        + f""", r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) AS rn FROM b),
s AS MATERIALIZED (SELECT x.bucket, x.id AS a, y.id AS b, x.rn AS ra, y.rn AS rb FROM r x JOIN r y ON x.bucket = y.bucket AND x.rn < y.rn WHERE list_dot_product(x.e, y.e) >= {threshold}),
fold AS (SELECT bucket, 1::BIGINT AS rn, [id] AS kept, []::STRUCT(id BIGINT, canonical_id BIGINT)[] AS gone FROM r WHERE rn = 1
 UNION ALL SELECT f.bucket, f.rn + 1, CASE WHEN c IS NULL THEN list_append(kept, r.id) ELSE kept END, CASE WHEN c IS NULL THEN gone ELSE list_append(gone, {{'id': r.id, 'canonical_id': c}}) END
 FROM (SELECT f.*, r.id AS nid, (SELECT min(a) FROM s WHERE s.b = r.id AND list_contains(f.kept, s.a)) AS c FROM fold f JOIN r ON r.bucket = f.bucket AND r.rn = f.rn + 1) f JOIN r ON r.id = f.nid),
last AS (SELECT bucket, gone FROM fold f WHERE rn = (SELECT max(rn) FROM r WHERE r.bucket = f.bucket)),
near AS (SELECT unnest(gone, recursive := true) FROM last)"""
    )


_NEAR_SQL = f"WITH RECURSIVE {near_sql(BITS, NEAR)} SELECT id, canonical_id FROM near"


def _by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.md5("text").alias("md5"))


_EXACT_SQL = "SELECT doc_id AS id, first FROM (SELECT doc_id, row_number() OVER w AS rn, first_value(doc_id) OVER w AS first FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)) WHERE rn > 1"


def _exact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _by_text(spark, sf_dir)
    return _rounded(dedup.report(df, dedup.exact(df).withColumn("kind", F.lit("exact"))))


def _pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = _norm(spark, sf_dir).select("id", "speaker_id", "accent", "gender", "age")
    return m.filter("gender = 'male'").withColumn("source", F.lit("real")), m.filter("gender = 'female'").withColumn("source", F.lit("synthetic"))


_POOLS = _M + ", re AS (SELECT id, accent, 'real' AS source FROM m WHERE gender = 'male'), sy AS (SELECT id, accent, 'synthetic' AS source FROM m WHERE gender = 'female'), z AS (SELECT (SELECT count(*) FROM re) AS nr, (SELECT count(*) FROM sy) AS ns)"
_SIZES = "least(tot - w, nr) AS n_real, least(w, ns) AS n_syn FROM (SELECT *, round_even(tot * ratio, 0)::BIGINT AS w FROM (SELECT *, CASE WHEN ns = 0 THEN nr ELSE 2 * least(nr, ns) END AS tot FROM z, ratios))"
_RATIOS = "ratios AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS ratio)"


def _mix_sql(ratio: float) -> str:
    return _POOLS + f""", ratios AS (SELECT {ratio}::DOUBLE AS ratio), n AS (SELECT {_SIZES}),
a AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn FROM re), b AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn FROM sy)
SELECT id, source, {ratio}::DOUBLE AS mix_synthetic_ratio FROM a, n WHERE rn <= n_real UNION ALL SELECT id, source, {ratio}::DOUBLE FROM b, n WHERE rn <= n_syn"""


_SPLITS_SQL = _POOLS + f""", {_RATIOS}, n AS (SELECT ratio, {_SIZES}),
e AS (SELECT p.*, n.*, row_number() OVER (PARTITION BY ratio, source ORDER BY md5('42:' || CASE ratio WHEN 0.0 THEN '0.0' WHEN 1.0 THEN '1.0' ELSE ratio::VARCHAR END || ':' || id), id) AS rn FROM (SELECT * FROM re UNION ALL SELECT * FROM sy) p, n),
k AS (SELECT id, source, accent, ratio FROM e WHERE rn <= CASE source WHEN 'real' THEN n_real ELSE n_syn END)
"""


def _mix(ratio: float) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: mix.mix(*_pools(spark, sf_dir), ratio).select("id", "source", "mix_synthetic_ratio")


def _stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _norm(spark, sf_dir)
    return mix.stratified(m, m.count() // 4).select("id", "accent")


_STRATIFIED_SQL = _M + """, r AS (SELECT id, accent, md5('42:' || id) AS o, row_number() OVER (PARTITION BY accent ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY accent) AS c, count(*) OVER () AS total FROM m),
q AS (SELECT *, least(c, greatest(1, round_even((total // 4)::DOUBLE * c / total, 0))) AS quota FROM r)
SELECT id, accent FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN rn > quota THEN 1 ELSE 0 END, o, id) AS place FROM q) WHERE place <= total // 4"""


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.balance(_norm(spark, sf_dir)).select("id", "gender")


_BALANCED_SQL = _M + ", c AS (SELECT gender, count(*) AS n FROM m WHERE gender IS NOT NULL GROUP BY gender) SELECT id, gender FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY md5('42:' || id), id) AS rn FROM m WHERE gender IS NOT NULL) WHERE rn <= (SELECT min(n) FROM c)"


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for the manifest; accents are mapped to the catalog's by language."""
    return gaps.plan_frame(spark, gaps.analyse(_plan_manifest(spark, sf_dir))).select("plan_pos", "gender", "accent", "voice_id", "n_samples", F.bround("priority", 6).alias("priority"))


def _plan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"en": "american", "fr": "british", "de": "indian"}
    accent = F.col("accent")
    for k, v in names.items():
        accent = F.when(F.col("accent") == k, v).otherwise(accent)
    return _norm(spark, sf_dir).withColumn("accent", accent)


def _plan_ctes() -> str:
    """The plan as CTEs; the last is plan, with gen, the place in the order in which targets are made."""
    catalog = ", ".join(f"({k}, '{g}', '{a}', '{v[0]}')" for k, ((g, a), v) in enumerate(gaps.VOICES.items()))
    return _M + f""", p AS (SELECT gender, CASE accent WHEN 'en' THEN 'american' WHEN 'fr' THEN 'british' WHEN 'de' THEN 'indian' ELSE accent END AS accent FROM m),
catalog(k, gender, accent, voice_id) AS (VALUES {catalog}), n AS (SELECT count(*) AS n, floor(count(*) * 0.6)::BIGINT // 2 AS half FROM p),
gs AS (SELECT gender, count(*) / sum(count(*)) OVER () AS share FROM p WHERE gender IS NOT NULL GROUP BY gender),
gl AS (SELECT gender, share, count(*) OVER () AS labels FROM gs WHERE gender IN ('male', 'female', 'other')),
gk AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY k) AS pos FROM catalog),
gw AS (SELECT gl.gender, 1.0 / labels - share AS gap, least(floor((1.0 / labels - share) * n * 1.1)::BIGINT, half // labels) AS wanted FROM gl, n),
gt AS (SELECT 0 AS part, CASE gw.gender WHEN 'male' THEN 0 WHEN 'female' THEN 1 ELSE 2 END AS o1, '' AS o2, pos AS o3, gk.gender, gk.accent, voice_id, wanted // 3 AS n_samples, gap AS priority FROM gw JOIN gk ON gw.gender = gk.gender AND pos <= 3 WHERE gap >= 0.03 AND wanted >= 1 AND wanted // 3 > 0),
sh AS (SELECT accent, count(*) AS c, count(*) / sum(count(*)) OVER () AS share FROM p WHERE accent IS NOT NULL GROUP BY accent),
un AS (SELECT accent FROM catalog UNION SELECT accent FROM (SELECT accent FROM sh ORDER BY c DESC, accent LIMIT 10)),
ua AS (SELECT un.accent, 1.0 / count(*) OVER () - coalesce(share, 0) AS gap, count(*) OVER () AS a FROM un LEFT JOIN sh ON un.accent = sh.accent),
aw AS (SELECT accent, gap, least(floor(gap * n * 1.1)::BIGINT, half // a) AS wanted FROM ua, n),
ats AS (SELECT 1 AS part, 0 AS o1, aw.accent AS o2, CASE gender WHEN 'female' THEN 0 ELSE 1 END AS o3, gender, aw.accent, voice_id, greatest(1, wanted // 2) AS n_samples, 0.8 * gap AS priority FROM aw JOIN catalog ON aw.accent = catalog.accent WHERE gap >= 0.03 AND wanted >= 1),
tg AS (SELECT *, row_number() OVER (ORDER BY part, o1, o2, o3) - 1 AS gen FROM (SELECT * FROM gt UNION ALL SELECT * FROM ats)),
plan AS (SELECT (row_number() OVER (ORDER BY round(priority, 12) DESC, gen) - 1)::BIGINT AS plan_pos, gen, gender, accent, voice_id, n_samples::BIGINT AS n_samples, round_even(priority, 6)::DOUBLE AS priority FROM tg)"""


_PLANNED = _plan_ctes()
_PLAN_SQL = _PLANNED + " SELECT plan_pos, gender, accent, voice_id, n_samples, priority FROM plan"
_PROMPTS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in gaps.PROMPTS) + "]"
_TEXTS = _PLANNED + f", texts AS (SELECT *, {_PROMPTS}[((7 * gen + j) % {len(gaps.PROMPTS)})::INT + 1] AS sentence FROM (SELECT *, unnest(range(0, n_samples)) AS j FROM plan))"
_GENERATED_SQL = _TEXTS + """ SELECT 'syn_' || voice_id || '_' || lpad((row_number() OVER (ORDER BY plan_pos, j) - 1)::VARCHAR, 6, '0') AS id, NULL::VARCHAR AS path, 'tts_' || voice_id AS speaker_id, sentence, 'unknown' AS age, gender, accent, 'synthetic' AS locale,
 list_sum(list_transform(string_split(sentence, ' '), lambda w: 800 * (2 + len(w) // 2) + 800)) / 16000.0 AS duration_sec, 'synthetic' AS source, voice_id AS tts_voice FROM texts"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_pos, j, sentence) of each utterance in the plan."""
    plan = gaps.plan_frame(spark, gaps.analyse(_plan_manifest(spark, sf_dir)))
    return plan.select("plan_pos", F.posexplode("texts").alias("j", "sentence"))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakesift.operators import synth

    return synth.generate(gaps.plan_frame(spark, gaps.analyse(_plan_manifest(spark, sf_dir)))).withColumn("duration_sec", F.bround("duration_sec", 6))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn against the next turn."""
    c = _table(spark, sf_dir, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("sentence"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"), F.col("text").alias("hypothesis"))
    return a.join(b, ["conv_id", "turn"])


_EDITS = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i]), lambda last, i: list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j]), lambda now, j: list_append(now, least(now[-1] + 1, last[j[1] + 1] + 1, last[j[1]] + ({a}[i[1]] <> {b}[j[1]])::BIGINT)), [i[1]]), range(0, len({b}) + 1))[-1]"
_WER = f"""WITH t AS (SELECT a.conv_id, a.turn, b.role AS next_role, {_WORDS.format('lower(a.text)')} AS r, coalesce({_WORDS.format('lower(b.text)')}, []) AS h, {_WORDS.format('a.text')} AS raw FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'),
d AS MATERIALIZED (SELECT *, {_EDITS.format(a='r', b='h')} AS wer_edits, len(r) AS wer_words, CASE WHEN len(r) > 0 THEN {_EDITS.format(a='r', b='h')} / len(r) WHEN len(h) > 0 THEN 1 ELSE 0 END AS wer FROM t)"""
_MICRO = "round_even(100 * CASE WHEN sum(wer_words) > 0 THEN sum(wer_edits) / sum(wer_words) ELSE avg(wer) END, 2)::DOUBLE"


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wer.evaluate_split(_pairs(spark, sf_dir), by="next_role")
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


def _tuned(df: DataFrame) -> DataFrame:
    """The reference without every fifth word as a second hypothesis."""
    return df.withColumn("tuned", F.array_join(F.filter(words("sentence"), lambda x, i: i % 5 != 4), " "))


def _full_pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(real, synthetic, test) with all labels and an embedding."""
    m = _norm(spark, sf_dir).select("id", "speaker_id", "accent", "gender", "age").join(_vectors(spark, sf_dir).select("id", "embedding"), "id")
    return m.filter("gender = 'male'").withColumn("source", F.lit("real")), m.filter("gender = 'female'").withColumn("source", F.lit("synthetic")), m.filter("gender is null")


def _overlap_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synthetic, test = _full_pools(spark, sf_dir)
    return ablation.run(mix.splits(real, synthetic), test, wer_eval=12.5)


_OVERLAP_CTES = _M + f""", fe AS (SELECT m.*, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM m JOIN embeddings ON vec_id = id),
re AS (SELECT *, 'real' AS source FROM fe WHERE gender = 'male'), sy AS (SELECT *, 'synthetic' AS source FROM fe WHERE gender = 'female'), z AS (SELECT (SELECT count(*) FROM re) AS nr, (SELECT count(*) FROM sy) AS ns),
{_RATIOS}, n AS (SELECT ratio, {_SIZES}),
ek AS (SELECT p.*, n.*, row_number() OVER (PARTITION BY ratio, source ORDER BY md5('42:' || CASE ratio WHEN 0.0 THEN '0.0' WHEN 1.0 THEN '1.0' ELSE ratio::VARCHAR END || ':' || id), id) AS rn FROM (SELECT * FROM re UNION ALL SELECT * FROM sy) p, n),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY md5('42:' || id), id) AS place FROM ek WHERE rn <= CASE source WHEN 'real' THEN n_real ELSE n_syn END),
ta AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS place FROM fe WHERE gender IS NULL) WHERE place <= 200),
ov AS (SELECT ratio, round_even(avg(s), 4) AS acoustic_overlap FROM (SELECT ratio, ta.id, max(list_dot_product(ta.e, k.e)) AS s FROM ta, k WHERE k.place <= 200 GROUP BY ratio, ta.id) GROUP BY ratio),
""" + ", ".join(
    f"h_{c} AS (SELECT ratio, CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p)) / ln(count(*)) END AS v FROM (SELECT ratio, count(*) / sum(count(*)) OVER (PARTITION BY ratio) AS p FROM k WHERE {c} IS NOT NULL GROUP BY ratio, {c}) GROUP BY ratio)" for c in ("gender", "age", "accent")
) + """, h_speaker AS (SELECT ratio, sum(-p * ln(p + 1e-12)) / ln(count(*) + 1e-12) AS v FROM (SELECT ratio, count(*) / sum(count(*)) OVER (PARTITION BY ratio) AS p FROM k GROUP BY ratio, speaker_id) GROUP BY ratio),
n2 AS (SELECT ratio, count(*) AS n_total, count(*) FILTER (source = 'real') AS n_real, count(*) FILTER (source = 'synthetic') AS n_synthetic FROM k GROUP BY ratio),
res AS (SELECT n2.ratio AS synthetic_ratio, n_total, n_real, n_synthetic, dg AS diversity_gender_entropy, da AS diversity_age_entropy, dc AS diversity_accent_entropy, ds AS diversity_speaker_balance, round_even((dg + da + dc + ds) / 4, 4)::DOUBLE AS diversity_overall, acoustic_overlap::DOUBLE AS acoustic_overlap, 12.5::DOUBLE AS wer_eval
 FROM n2 LEFT JOIN ov USING (ratio) LEFT JOIN (SELECT ratio, round_even(coalesce(g.v, 0), 4)::DOUBLE AS dg, round_even(coalesce(a.v, 0), 4)::DOUBLE AS da, round_even(coalesce(c.v, 0), 4)::DOUBLE AS dc, round_even(coalesce(s.v, 0), 4)::DOUBLE AS ds
  FROM n2 LEFT JOIN h_gender g USING (ratio) LEFT JOIN h_age a USING (ratio) LEFT JOIN h_accent c USING (ratio) LEFT JOIN h_speaker s USING (ratio)) USING (ratio))"""


def _strata(pool: str, n: str) -> str:
    """Rows of pool, n of them, strata of accents in proportion."""
    return f"""SELECT id, source FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN rn > quota THEN 1 ELSE 0 END, o, id) AS place FROM (SELECT *, least(c, greatest(1, round_even({n}::DOUBLE * c / total, 0))) AS quota
 FROM (SELECT id, source, accent, md5('42:' || id) AS o, row_number() OVER (PARTITION BY accent ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY accent) AS c, count(*) OVER () AS total FROM {pool}))) WHERE place <= {n}"""


_MIX_STRATA_SQL = _POOLS + f", ratios AS (SELECT 0.25::DOUBLE AS ratio), n AS (SELECT {_SIZES}) SELECT *, 0.25::DOUBLE AS mix_synthetic_ratio FROM ({_strata('re', '(SELECT n_real FROM n)')} UNION ALL {_strata('sy', '(SELECT n_syn FROM n)')})"
_FREE_SIZES = _SIZES.replace("CASE WHEN ns = 0 THEN nr ELSE 2 * least(nr, ns) END", "nr + ns")


def _tables_round_trip(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        where = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
        if kind == "parquet":
            rows = _norm(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.format_string("clips/%d.wav", "id").alias("path"), "gender", "accent")
            tables.write_parquet(rows, where)
            return tables.read_manifest(spark, where)
        if kind == "csv":
            tables.write_csv(diversity.counts(_norm(spark, sf_dir), "age"), where)
            return tables.read_csv(spark, where)
        where = re.sub("^file:/*", "/", where)
        tables.write_json({"scores": diversity.scores(_norm(spark, sf_dir)).first().asDict(), "none": float("nan")}, where)
        back = tables.read_json(where)
        return _rounded(spark.createDataFrame([*((k, float(v)) for k, v in back["scores"].items()), ("none", back["none"])], "metric string, value double"))

    return run


def _real_and_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return v.filter("label < 5"), v.filter("label >= 5")


_OVERLAP_SQL = """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
a AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn FROM v WHERE label >= 5) WHERE rn <= 200), b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn FROM v WHERE label < 5) WHERE rn <= 200)
SELECT round_even(avg(s), 4) AS acoustic_overlap FROM (SELECT a.id, max(list_dot_product(a.e, b.e)) AS s FROM a, b GROUP BY a.id)"""


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.run(mix.splits(*_pools(spark, sf_dir)).select("id", "source", "accent", "mix_synthetic_ratio")).drop("acoustic_overlap", "wer_eval")


_ABLATION_SQL = _SPLITS_SQL + """, n2 AS (SELECT ratio, count(*) AS n_total, count(*) FILTER (source = 'real') AS n_real, count(*) FILTER (source = 'synthetic') AS n_synthetic FROM k GROUP BY ratio),
h AS (SELECT ratio, CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p)) / ln(count(*)) END AS v FROM (SELECT ratio, count(*) / sum(count(*)) OVER (PARTITION BY ratio) AS p FROM k WHERE accent IS NOT NULL GROUP BY ratio, accent) GROUP BY ratio)
SELECT ratio AS synthetic_ratio, n_total, n_real, n_synthetic, round_even(coalesce(v, 0), 4)::DOUBLE AS diversity_accent_entropy, round_even(coalesce(v, 0), 4)::DOUBLE AS diversity_overall FROM n2 LEFT JOIN h USING (ratio)"""


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = mix.holdout(_norm(spark, sf_dir).select("id"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synthetic = _pools(spark, sf_dir)
    before, after = (diversity.scores(x.select("accent", "speaker_id")) for x in (real, real.unionByName(synthetic)))
    both = before.crossJoin(after.select(*(F.col(c).alias(f"{c}_after") for c in after.columns)))
    return both.select(*(F.bround(F.col(f"{c}_after") - F.col(c), 4).alias(f"delta_{c}") for c in before.columns))


def _scores_sql(m: str) -> str:
    return f"SELECT accent_entropy, speaker_balance, (accent_entropy + speaker_balance) / 2 AS overall FROM {_entropy_sql('accent', 'accent_entropy', m)}, {_BALANCE.replace('FROM m', f'FROM {m}')}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s1_manifest": lambda s, d: _rounded(manifest(s, d).drop("sentence")),
    "p8_labels": lambda s, d: _norm(s, d).select("id", "gender", "age", "accent"),
    "a1_samples_speakers": _on_manifest(lambda m: m.agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("speaker_id").alias("n_speakers"))),
    "a3_speaker_counts": _on_manifest(diversity.speaker_counts),
    "a4_gender_distribution": _on_manifest(lambda m: diversity.counts(m, "gender")),
    "a5_age_distribution": _on_manifest(lambda m: diversity.counts(m, "age")),
    "a6_accent_distribution": _on_manifest(lambda m: diversity.accent_distribution(m)),
    "a7_entropy": _on_manifest(lambda m: diversity.entropy(m, "accent", normalised=False)),
    "a8_normalised_entropy": _on_manifest(lambda m: diversity.entropy(m, "accent")),
    "a9_imbalance": _on_manifest(diversity.imbalance),
    "a10_balance": _on_manifest(diversity.balance),
    "a11_scores": _on_manifest(diversity.scores),
    "a12_sentence_stats": _on_manifest(diversity.sentence_stats),
    "a13_vocabulary": _on_manifest(diversity.vocabulary_size),
    "a14_domains": _on_manifest(diversity.domains),
    "a15_duration_stats": _on_manifest(diversity.duration_stats),
    "f1_signal_features": _features,
    "f12_cosine_bucket": lambda s, d: _vectors(s, d).select("id", F.bround(signals.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"), signals.sign_bucket(F.col("embedding"), 18, 64).alias("bucket")),
    "p4_quality_gate": lambda s, d: _gated(s, d),
    "a16_quality_summary": lambda s, d: _rounded(quality.summary(_gated(s, d))),
    "a17_reason_counts": lambda s, d: quality.reason_counts(_gated(s, d)),
    "d1_exact": lambda s, d: dedup.exact(_by_text(s, d)),
    "d3_near": lambda s, d: dedup.near(_vectors(s, d), NEAR, BITS, 64),
    "d3_near_blocks": lambda s, d: dedup.near_blocks(_vectors(s, d), NEAR, BITS, 64),
    "d3_near_default": lambda s, d: dedup.near_blocks(_vectors(s, d), dim=64),
    "d4_keep": lambda s, d: dedup.keep(_by_text(s, d), dedup.exact(_by_text(s, d))).select("id"),
    "a18_dedup_report": _exact_report,
    "a20_summary": lambda s, d: gaps.summary(_norm(s, d)),
    "m1_mix_25": _mix(0.25),
    "m1_mix_75": _mix(0.75),
    "m2_sample": lambda s, d: mix.sample(_norm(s, d), 100).select("id"),
    "m3_stratified": _stratified,
    "m4_splits": lambda s, d: mix.splits(*_pools(s, d)).select("id", "source", F.col("mix_synthetic_ratio")),
    "m5_balance": _balanced,
    "g1_plan": _plan,
    "g4_texts": _texts,
    "g6_generated": _generated,
    "g7_delta": _augmented,
    "p7_holdout": _holdout,
    "e1_wer": lambda s, d: wer.score(_pairs(s, d)).select("conv_id", "turn", "wer_edits", "wer_words", F.bround("wer", 6).alias("wer")),
    "e2_wer_corpus": lambda s, d: wer.corpus(wer.score(_pairs(s, d)), "next_role"),
    "e5_overlap": lambda s, d: ablation.overlap(*_real_and_test(s, d)),
    "e6_ablation": _ablation,
    "e4_evaluate": _evaluated,
    "e7_compare": lambda s, d: wer.compare(_tuned(_pairs(s, d)), "sentence", "hypothesis", "tuned"),
    "e6_overlap": _overlap_ablation,
    "e8_against_real": lambda s, d: report.against_real(_overlap_ablation(s, d)),
    "a23_best_overlap": lambda s, d: ablation.best(_overlap_ablation(s, d)),
    "m1_mix_strata": lambda s, d: mix.mix(*_pools(s, d), 0.25, "stratified").select("id", "source", "mix_synthetic_ratio"),
    "m1_mix_free": lambda s, d: mix.mix(*_pools(s, d), 0.25, fixed=False).select("id", "source", "mix_synthetic_ratio"),
    "s2_corpus_sample": lambda s, d: tables.corpus_sample(_table(s, d, "documents").withColumn("row", F.col("doc_id")), 200, id_col="doc_id").select("doc_id", "row", "source", "locale", "source_split"),
    "s6_parquet": _tables_round_trip("parquet"),
    "s7_csv": _tables_round_trip("csv"),
    "s8_json": _tables_round_trip("json"),
    "s10_chart_series": lambda s, d: report.ablation_series(_ablation(s, d)),
    "a23_best": lambda s, d: ablation.best(_ablation(s, d).withColumn("acoustic_overlap", F.col("diversity_overall")).withColumn("wer_eval", F.col("n_total").cast("double"))),
}

_SCORES_SQL = _M + f"""SELECT round_even(gender_entropy, 6)::DOUBLE AS gender_entropy, round_even(age_entropy, 6)::DOUBLE AS age_entropy, round_even(accent_entropy, 6)::DOUBLE AS accent_entropy, round_even(speaker_balance, 6)::DOUBLE AS speaker_balance,
 round_even((gender_entropy + age_entropy + accent_entropy + speaker_balance) / 4, 6)::DOUBLE AS overall FROM {_entropy_sql('gender', 'gender_entropy')}, {_entropy_sql('age', 'age_entropy')}, {_entropy_sql('accent', 'accent_entropy')}, {_BALANCE}"""
_PASS = "len(fail_reasons) = 0"
ORACLES: dict[str, str] = {
    "s1_manifest": _M + "SELECT id, speaker_id, accent, gender, age, round_even(duration_sec, 6)::DOUBLE AS duration_sec FROM raw",
    "p8_labels": _M + "SELECT id, gender, age, accent FROM m",
    "a1_samples_speakers": _M + "SELECT count(*) AS n_samples, count(DISTINCT speaker_id) AS n_speakers FROM m",
    "a3_speaker_counts": _M + "SELECT speaker_id, count(*) AS n FROM m WHERE speaker_id IS NOT NULL GROUP BY speaker_id",
    "a4_gender_distribution": _dist_sql("gender"),
    "a5_age_distribution": _dist_sql("age"),
    "a6_accent_distribution": _dist_sql("accent"),
    "a7_entropy": _M + "SELECT round_even(coalesce(sum(-p * ln(p)), 0), 6)::DOUBLE AS value FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM m WHERE accent IS NOT NULL GROUP BY accent)",
    "a8_normalised_entropy": _M + f"SELECT round_even(value, 6)::DOUBLE AS value FROM {_entropy_sql('accent')}",
    "a9_imbalance": _M + "SELECT round_even(max(n) / (median(n) + 1e-6), 6)::DOUBLE AS value FROM (SELECT count(*) AS n FROM m WHERE speaker_id IS NOT NULL GROUP BY speaker_id)",
    "a10_balance": _M + f"SELECT round_even(speaker_balance, 6)::DOUBLE AS value FROM {_BALANCE}",
    "a11_scores": _SCORES_SQL,
    "a12_sentence_stats": _M + f"SELECT {_MOMENTS.format('n')} FROM (SELECT len({_W})::DOUBLE AS n FROM m WHERE sentence IS NOT NULL)",
    "a13_vocabulary": _M + f"SELECT count(DISTINCT w) AS vocabulary_size FROM (SELECT unnest({_WL}) AS w FROM m)",
    "a14_domains": _M + f"SELECT round_even(100 * avg((n <= 5)::INT), 6)::DOUBLE AS short_pct, round_even(100 * avg((n BETWEEN 6 AND 15)::INT), 6)::DOUBLE AS medium_pct, round_even(100 * avg((n > 15)::INT), 6)::DOUBLE AS long_pct FROM (SELECT len({_W}) AS n FROM m WHERE sentence IS NOT NULL)",
    "a15_duration_stats": _M + f"SELECT round_even(sum(d) / 3600, 6) AS total_hours, {_MOMENTS.format('d')} FROM (SELECT duration_sec::DOUBLE AS d FROM m)",
    "f1_signal_features": _F + "SELECT * FROM f",
    "f12_cosine_bucket": "WITH " + _planes_sql(18) + " SELECT id, round_even(list_dot_product(e, e), 6)::DOUBLE AS norm2, bucket FROM b",
    "p4_quality_gate": _F + f"SELECT *, {_PASS} AS passes FROM g",
    "a16_quality_summary": _F + f"""SELECT count(*) AS total, count(*) FILTER ({_PASS}) AS passed, count(*) FILTER (NOT {_PASS}) AS failed, round_even(count(*) FILTER ({_PASS}) / greatest(count(*), 1), 6)::DOUBLE AS pass_rate, round_even(avg(snr_db), 6)::DOUBLE AS mean_snr_db,
 round_even(avg(duration_sec), 6)::DOUBLE AS mean_duration_sec, round_even(avg(silence_ratio), 6)::DOUBLE AS mean_silence_ratio, round_even(count(*) FILTER (is_clipped) / greatest(count(*), 1), 6)::DOUBLE AS clipping_rate FROM g""",
    "a17_reason_counts": _F + "SELECT reason, count(*) AS n FROM (SELECT unnest(fail_reasons) AS reason FROM g) GROUP BY reason",
    "d1_exact": f"SELECT id, first AS canonical_id FROM ({_EXACT_SQL})",
    "d3_near": _NEAR_SQL,
    "d3_near_blocks": _NEAR_SQL,
    "d3_near_default": f"WITH RECURSIVE {near_sql(dedup.N_BITS, dedup.THRESHOLD)} SELECT id, canonical_id FROM near",
    "d4_keep": f"SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM ({_EXACT_SQL}))",
    "a18_dedup_report": f"""SELECT n AS n_input, r AS exact_duplicates, 0::BIGINT AS near_duplicates, g AS exact_groups, 0::BIGINT AS near_groups, r AS n_removed, n - r AS n_kept, round_even((n - r) / greatest(n, 1), 6)::DOUBLE AS retention_rate
 FROM (SELECT count(*) AS n FROM documents), (SELECT count(*) AS r, count(DISTINCT first) AS g FROM ({_EXACT_SQL}))""",
    "a20_summary": _M + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS label, round_even(count(*) / sum(count(*)) OVER (), 3)::DOUBLE AS share FROM m WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("gender", "accent", "age")),
    "m1_mix_25": _mix_sql(0.25),
    "m1_mix_75": _mix_sql(0.75),
    "m2_sample": _M + "SELECT id FROM m ORDER BY md5('42:' || id), id LIMIT 100",
    "m3_stratified": _STRATIFIED_SQL,
    "m4_splits": _SPLITS_SQL + "SELECT id, source, ratio AS mix_synthetic_ratio FROM k",
    "m5_balance": _BALANCED_SQL,
    "g1_plan": _PLAN_SQL,
    "g4_texts": _TEXTS + " SELECT plan_pos, j::INT AS j, sentence FROM texts",
    "g6_generated": _GENERATED_SQL,
    "g7_delta": _POOLS.replace("SELECT id, accent, 'real'", "SELECT id, accent, speaker_id, 'real'").replace("SELECT id, accent, 'synthetic'", "SELECT id, accent, speaker_id, 'synthetic'")
    + f", al AS (SELECT * FROM re UNION ALL SELECT * FROM sy) SELECT round_even(y.accent_entropy - x.accent_entropy, 4)::DOUBLE AS delta_accent_entropy, round_even(y.speaker_balance - x.speaker_balance, 4)::DOUBLE AS delta_speaker_balance, round_even(y.overall - x.overall, 4)::DOUBLE AS delta_overall FROM ({_scores_sql('re')}) x, ({_scores_sql('al')}) y",
    "p7_holdout": _M + "SELECT id, CASE WHEN rn <= least(n, greatest(50, n // 10)) THEN 'test' ELSE 'train' END AS part FROM (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn, count(*) OVER () AS n FROM m)",
    "e5_overlap": _OVERLAP_SQL,
    "e1_wer": _WER + " SELECT conv_id, turn, wer_edits::BIGINT AS wer_edits, wer_words::BIGINT AS wer_words, round_even(wer, 6)::DOUBLE AS wer FROM d",
    "e2_wer_corpus": _WER + f' SELECT next_role AS "group", count(*) AS n_samples, {_MICRO} AS wer FROM d GROUP BY next_role',
    "e4_evaluate": _WER + f" SELECT 'n_samples' AS metric, count(*)::DOUBLE AS value FROM d UNION ALL SELECT 'wer', {_MICRO} FROM d UNION ALL SELECT 'wer_' || next_role, {_MICRO} FROM d GROUP BY next_role",
    "e7_compare": _WER + f""", s AS (SELECT round_even(100 * sum(wer_edits) / sum(wer_words), 2)::DOUBLE AS base_wer, round_even(100 * sum({_EDITS.format(a='r', b='y')}) / sum(wer_words), 2)::DOUBLE AS tuned_wer FROM (SELECT *, list_transform(list_filter(raw, lambda x, i: (i - 1) % 5 <> 4), lambda x: lower(x)) AS y FROM d))
SELECT base_wer, tuned_wer, round_even(tuned_wer - base_wer, 2)::DOUBLE AS delta, CASE WHEN base_wer > 0 THEN round_even(100 * (base_wer - tuned_wer) / base_wer, 1)::DOUBLE END AS relative_pct, CASE WHEN tuned_wer < base_wer THEN 'improvement' ELSE 'regression' END AS direction FROM s""",
    "e6_overlap": _OVERLAP_CTES + " SELECT * FROM res",
    "e8_against_real": _OVERLAP_CTES + """ SELECT synthetic_ratio, round_even(diversity_overall - (SELECT diversity_overall FROM res WHERE synthetic_ratio = 0), 4)::DOUBLE AS delta_diversity, round_even(acoustic_overlap - (SELECT acoustic_overlap FROM res WHERE synthetic_ratio = 0), 4)::DOUBLE AS delta_overlap,
 acoustic_overlap = (SELECT max(acoustic_overlap) FROM res) AS best_overlap, wer_eval = (SELECT min(wer_eval) FROM res) AS best_wer FROM res""",
    "a23_best_overlap": _OVERLAP_CTES + " SELECT arg_max(synthetic_ratio, (acoustic_overlap, -synthetic_ratio)) AS best_overlap_ratio, arg_min(synthetic_ratio, (wer_eval, synthetic_ratio)) AS best_wer_ratio FROM res",
    "m1_mix_strata": _MIX_STRATA_SQL,
    "m1_mix_free": _mix_sql(0.25).replace(_SIZES, _FREE_SIZES),
    "s2_corpus_sample": "SELECT printf('cv_en_train_%06d', row_number() OVER (ORDER BY doc_id) - 1) AS doc_id, doc_id AS row, source, 'en' AS locale, 'train' AS source_split FROM (SELECT * FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 200)",
    "s6_parquet": _M + "SELECT id::VARCHAR AS id, printf('clips/%d.wav', id) AS path, gender, accent, 'real' AS source FROM m",
    "s7_csv": _dist_sql("age"),
    "s8_json": "SELECT * FROM (UNPIVOT (" + _SCORES_SQL + ") ON gender_entropy, age_entropy, accent_entropy, speaker_balance, overall INTO NAME metric VALUE value) UNION ALL SELECT 'none', NULL",
    "e6_ablation": _ABLATION_SQL,
    "s10_chart_series": f"SELECT synthetic_ratio, metric, value FROM (UNPIVOT ({_ABLATION_SQL}) ON diversity_accent_entropy, diversity_overall INTO NAME metric VALUE value)",
    "a23_best": f"SELECT arg_max(synthetic_ratio, (diversity_overall, -synthetic_ratio)) AS best_overlap_ratio, arg_min(synthetic_ratio, (n_total, synthetic_ratio)) AS best_wer_ratio FROM ({_ABLATION_SQL})",
}


from lakesift.plans import audio_queries  # noqa: E402

QUERIES |= audio_queries.QUERIES
ORACLES |= audio_queries.oracles()
