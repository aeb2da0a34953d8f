"""The sound path as queries: embeddings become WAV files of several formats, are decoded, measured, deduplicated and curated. DuckDB makes the same samples from the embeddings on its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.functions import dsp
from lakesift.operators import dedup, quality
from lakesift.plans import curation
from lakesift.session import shared_folder, written
from lakesift.sources import audio

#: Rate and samples of a clip; samples between two changes of its loudness; a clip in BROKEN can't be read, one in COPIES sounds like the one before it.
SR, LENGTH, HOLD, BROKEN, COPIES = 8000, 4800, 75, 50, 20
FRAME = 200
GATE = quality.Thresholds()
BITS, NEAR = 4, 0.30
_SAMPLES = "samples array<float>, sr int, load_error string"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding): what each clip sounds like."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    own = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % COPIES == 3, F.col("vec_id") - 1).otherwise(F.col("vec_id")).alias("base"))
    return own.join(e.select(F.col("vec_id").alias("base"), "embedding"), "base").select("id", "embedding")


def _make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, content, embedding) of (id, embedding), a few clips at a time."""
    i = np.arange(LENGTH)
    for batch in audio.few(batches):
        content = []
        for k, vector in zip(batch.column("id").to_pylist(), batch.column("embedding")):
            e = vector.values.to_numpy().astype(np.float64)
            x = 40.0 * e[i % 64] * np.abs(e[i // HOLD % 64]) * np.abs(e[i // HOLD % 64])
            pcm = np.trunc(np.clip(x, -1, 1) * 32767).astype(np.int64)
            content.append(b"RIFF, but no more" if k % BROKEN == 7 else audio.encode_wav(pcm, SR, (2, 2, 3, 4)[k % 4], (1, 2, 1, 1)[k % 4]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(content, pa.binary()), batch.column("embedding")], ["id", "content", "embedding"])


def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content, embedding): WAV in 16 bits, 16 bits stereo, 24 and 32 bits by turns."""
    return _vectors(spark, sf_dir).mapInArrow(_make, "id long, content binary, embedding array<float>")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of wav_files, decoded where they are made."""
    return _vectors(spark, sf_dir).mapInArrow(audio.chain(_make, audio.decoding(SR)), f"id long, {_SAMPLES}")


def _measured(vectors: DataFrame, embed: bool = False) -> DataFrame:
    """The feature table of the files of these (id, embedding), made, decoded and measured in one Python worker."""
    step = audio.chain(_make, audio.decoding(SR), quality.measuring(GATE, embed, "id", ("load_error",)))
    return vectors.mapInArrow(step, f"id long, {quality.TABLE}, load_error string")


def features(spark: SparkSession, sf_dir: str, embed: bool = False) -> DataFrame:
    return _measured(_vectors(spark, sf_dir), embed)


def _told(found: DataFrame) -> DataFrame:
    x = F.transform("samples", lambda v: v.cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return found.select("id", F.size("samples").cast("bigint").alias("n"), "sr", F.col("load_error").isNotNull().alias("failed"), total.alias("total"), F.array_max(F.transform(x, lambda v: F.abs(v))).alias("peak"), F.element_at(x, 1000).alias("one"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.bround(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clips that could be decoded."""
    return (batch.filter(batch.column("load_error").is_null()) for batch in batches)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that are written as files and found again by their manifest's paths; every tenth path names no file."""
    folder = f"{shared_folder(spark)}/clips-{uuid.uuid4().hex}"
    there = _vectors(spark, sf_dir).mapInArrow(audio.chain(_make, audio.decoding(SR), _sound, audio.writing(folder)), "id long, path string")
    manifest = there.withColumn("path", F.when(F.col("id") % 10 == 5, F.concat("path", F.lit(".lost"))).otherwise(F.col("path")))
    return audio.load_clips(written(manifest), folder, SR)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakesift.plans.queries import manifest

    rows = manifest(spark, sf_dir).drop("duration_sec")
    return rows.join(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id")), "id", "left_semi").withColumn("pos", F.col("id"))


def _dedup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, md5, embedding): the sounds' MD5 and the vectors they were made from, made once."""
    step = audio.chain(_make, audio.decoding(SR, more=("embedding",)), _told_apart)
    return written(_vectors(spark, sf_dir).mapInArrow(step, "id long, md5 string, embedding array<float>").select("id", F.col("id").alias("pos"), "md5", "embedding"))


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        md5 = [dsp.pcm_md5(x.values.to_numpy()) for x in batch.column("samples")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(md5, pa.string()), batch.column("embedding")], ["id", "md5", "embedding"])


def _assigned(table: DataFrame) -> DataFrame:
    return dedup.assign(table, NEAR, BITS, 64)


def _with_assigned(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the table and what goes of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = _dedup_table(spark, sf_dir)
        return f(table, _assigned(table))

    return run


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, metric, value) of a whole curation run with its default thresholds."""
    manifest = _manifest(spark, sf_dir)
    _, found = curation.curate(manifest, _measured(_vectors(spark, sf_dir).join(manifest.select("id"), "id", "left_semi"), True))
    rows = [("all", k, float(found[k])) for k in ("n_input", "load_errors", "n_output", "overall_retention_rate")]
    for part in ("quality", "deduplication"):
        rows += [(part, k, float(v)) for k, v in found[part].items() if isinstance(v, (int, float))]
    rows += [("fail_categories", k, float(v)) for k, v in found["quality"]["fail_categories"].items()]
    rows += [(when, k, float(v)) for when in ("diversity_before", "diversity_after") for k, v in found[when]["diversity_score"].items() if v is not None]
    return _rounded(spark.createDataFrame(rows, "part string, metric string, value double"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s4_decode": lambda s, d: _told(clips(s, d)),
    "s9_wav_files": lambda s, d: _told(_files(s, d)),
    "f8_inspect": lambda s, d: _rounded(features(s, d).drop("md5", "embedding", "load_error")),
    "f9_batch_summary": lambda s, d: _rounded(quality.summary(features(s, d))),
    "f10_pcm_md5": lambda s, d: features(s, d).select("id", "md5"),
    "f11_mfcc": lambda s, d: features(s, d, True).select("id", F.transform("embedding", lambda x: F.bround(x.cast("double"), 4)).alias("embedding")),
    "p1_attach": lambda s, d: _rounded(quality.attach(_manifest(s, d).select("id", "speaker_id"), features(s, d))),
    "p2_passing": lambda s, d: features(s, d).filter("passes").select("id"),
    "d1_sounds": lambda s, d: dedup.exact(features(s, d).withColumn("pos", F.col("id"))),
    "d4_assign": _with_assigned(lambda table, gone: gone),
    "d4_keep_both": _with_assigned(lambda table, gone: dedup.keep(table, gone).select("id")),
    "a18_dedup_report_both": _with_assigned(lambda table, gone: _rounded(dedup.report(table, gone))),
    "a19_curation_report": _report,
}

_C = f"""WITH RECURSIVE e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
w AS (SELECT a.id, b.e FROM e a JOIN e b ON b.id = CASE WHEN a.id % {COPIES} = 3 THEN a.id - 1 ELSE a.id END),
c AS MATERIALIZED (SELECT id, e, id % {BROKEN} = 7 AS failed, CASE WHEN id % {BROKEN} = 7 THEN list_resize([]::DOUBLE[], {SR}, 0.0) ELSE list_transform(range(0, {LENGTH}), lambda i: trunc(greatest(least(40.0 * e[i % 64 + 1] * abs(e[(i // {HOLD}) % 64 + 1]) * abs(e[(i // {HOLD}) % 64 + 1]), 1.0), -1.0) * 32767) / 32768.0) END AS x FROM w)"""
_T = "id, len(x)::BIGINT AS n, {sr} AS sr, failed, list_sum(x) AS total, list_max(list_transform(x, lambda v: abs(v))) AS peak, x[1000] AS one"
_F = _C + f""",
l AS (SELECT id, x, list_transform(range(0, len(x) // {FRAME // 2} + 1), lambda k: sqrt(list_sum(list_transform(x[greatest(1, (k - 1) * {FRAME // 2} + 1) : (k + 1) * {FRAME // 2}], lambda v: v * v)) / {FRAME})) AS levels FROM c),
h AS (SELECT id, x, levels, list_filter(levels, lambda v: v > 0) AS heard, list_max(levels) AS peak, len(x) AS n, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms FROM l),
q AS (SELECT *, list_aggregate(heard, 'quantile_cont', 0.1) AS quiet, list_aggregate(heard, 'quantile_cont', 0.9) AS loud FROM h),
f AS (SELECT id, n / {SR}.0 AS duration_sec,
 CASE WHEN len(heard) = 0 THEN 0 WHEN quiet < 1e-10 THEN 60 WHEN loud < 1e-10 THEN 0 ELSE least(greatest(20 * log10(loud / (quiet + 1e-10)), 0), 80) END::DOUBLE AS snr_db,
 CASE WHEN peak <= 0 THEN 1 ELSE least(greatest(1 - list_sum(list_transform(range(0, len(levels)), lambda k:
   CASE WHEN 20 * log10(greatest(levels[k + 1], 1e-5)) - 20 * log10(greatest(peak, 1e-5)) > -30.0 THEN least((k + 1) * {FRAME // 2}, n) - least(k * {FRAME // 2}, n) ELSE 0 END)) / n, 0), 1) END::DOUBLE AS silence_ratio,
 CASE WHEN rms < 1e-10 THEN -120 ELSE 20 * log10(rms) END::DOUBLE AS rms_db,
 len(list_filter(x, lambda v: abs(v) >= {GATE.clipping})) / len(x) > 0.001 AS is_clipped FROM q),
g AS MATERIALIZED (SELECT *, list_filter([CASE WHEN duration_sec < {GATE.min_duration_sec} THEN printf('too_short (%.2fs)', duration_sec) END, CASE WHEN duration_sec > {GATE.max_duration_sec} THEN printf('too_long (%.2fs)', duration_sec) END,
 CASE WHEN snr_db < {GATE.min_snr_db} THEN printf('low_snr (%.1fdB)', snr_db) END, CASE WHEN silence_ratio > {GATE.max_silence_ratio} THEN printf('too_silent (%.1f%%)', 100 * silence_ratio) END,
 CASE WHEN is_clipped THEN 'clipped' END, CASE WHEN rms_db < {GATE.min_rms_db} THEN printf('too_quiet (%.1fdB)', rms_db) END], lambda r: r IS NOT NULL) AS fail_reasons FROM f)
"""
_R = ", ".join(f"round_even({c}, 6)::DOUBLE AS {{p}}{c}" for c in ("duration_sec", "snr_db", "silence_ratio", "rms_db")) + ", is_clipped AS {p}is_clipped, len(fail_reasons) = 0 AS {p}passes, fail_reasons AS {p}fail_reasons"
_PASS = "len(fail_reasons) = 0"
_MD5 = _C + """, m AS MATERIALIZED (SELECT id, e, md5(unhex(array_to_string(list_transform(x, lambda v: printf('%02x%02x', trunc(v * 32767)::INT & 255, (trunc(v * 32767)::INT >> 8) & 255)), ''))) AS md5 FROM c),
x AS MATERIALIZED (SELECT id, first AS canonical_id FROM (SELECT id, row_number() OVER w AS rn, first_value(id) OVER w AS first FROM m WINDOW w AS (PARTITION BY md5 ORDER BY id)) WHERE rn > 1)"""


def _both_sql() -> str:
    from lakesift.plans.queries import near_sql

    return _MD5 + ", " + near_sql(BITS, NEAR, "SELECT id, e FROM m WHERE id NOT IN (SELECT id FROM x)") + ", z AS (SELECT id, canonical_id, 'exact' AS kind FROM x UNION ALL SELECT id, canonical_id, 'near' FROM near)"


def oracles() -> dict[str, str]:
    both = _both_sql()
    return {
        "s4_decode": f"{_C} SELECT {_T.format(sr=SR)} FROM c",
        "s9_wav_files": f"{_C}, y AS (SELECT id, id % 10 = 5 AS failed, CASE WHEN id % 10 = 5 THEN list_resize([]::DOUBLE[], {SR}, 0.0) ELSE list_transform(x, lambda v: trunc(v * 32767) / 32768.0) END AS x FROM c WHERE NOT failed) SELECT {_T.format(sr=SR)} FROM y",
        "f8_inspect": f"{_F} SELECT id, {_R.format(p='')} FROM g",
        "f9_batch_summary": f"""{_F} SELECT count(*) AS total, count(*) FILTER ({_PASS}) AS passed, count(*) FILTER (NOT {_PASS}) AS failed, round_even(count(*) FILTER ({_PASS}) / greatest(count(*), 1), 6)::DOUBLE AS pass_rate, round_even(avg(snr_db), 6)::DOUBLE AS mean_snr_db,
 round_even(avg(duration_sec), 6)::DOUBLE AS mean_duration_sec, round_even(avg(silence_ratio), 6)::DOUBLE AS mean_silence_ratio, round_even(count(*) FILTER (is_clipped) / greatest(count(*), 1), 6)::DOUBLE AS clipping_rate FROM g""",
        "f10_pcm_md5": f"{_MD5} SELECT id, md5 FROM m",
        "p1_attach": f"{_F} SELECT d.doc_id AS id, d.source AS speaker_id, {_R.format(p='qf_')} FROM g JOIN documents d ON d.doc_id = g.id",
        "p2_passing": f"{_F} SELECT id FROM g WHERE {_PASS}",
        "d1_sounds": f"{_MD5} SELECT id, canonical_id FROM x",
        "d4_assign": f"{both} SELECT id, canonical_id, kind FROM z",
        "d4_keep_both": f"{both} SELECT id FROM m WHERE id NOT IN (SELECT id FROM z)",
        "a18_dedup_report_both": f"""{both} SELECT n AS n_input, xd AS exact_duplicates, nd AS near_duplicates, xg AS exact_groups, ng AS near_groups, xd + nd AS n_removed, n - xd - nd AS n_kept, round_even((n - xd - nd) / greatest(n, 1), 6)::DOUBLE AS retention_rate
 FROM (SELECT count(*) AS n FROM m), (SELECT count(*) FILTER (kind = 'exact') AS xd, count(*) FILTER (kind = 'near') AS nd, count(DISTINCT canonical_id) FILTER (kind = 'exact') AS xg, count(DISTINCT canonical_id) FILTER (kind = 'near') AS ng FROM z)""",
    }
