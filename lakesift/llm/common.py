"""Shared helpers: the shared folder for cut lineage, and the tokenizer that every text operator here uses.

A token is a maximal run of ASCII letters, digits and non-ASCII characters (general punctuation, CJK punctuation and the
Latin-1 symbols U+00A0-U+00BF separate tokens), lower-cased character by character. ``TOKEN_RE`` states the same
rule for RE2, so that DuckDB's ``regexp_extract_all(lower(text), TOKEN_RE)`` gives the same tokens.

Tokens are found and hashed for a whole Arrow batch at once with numpy; no Python object is made per token.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_RE = "[a-z0-9\\x{C0}-\\x{1FFF}\\x{2070}-\\x{2FFF}\\x{3040}-\\x{10FFFF}]+"
SEPARATORS_RE = "[\\x{80}-\\x{BF}\\x{2000}-\\x{206F}\\x{3000}-\\x{303F}]"
#: Bytes of text that are worked on at once; bounds a worker's memory whatever the batch. A longer document is a piece of its own.
PIECE_BYTES = 2 << 20

_WORD = np.zeros(256, np.bool_)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_POWERS: list[np.ndarray] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where the session names none and runs in one JVM is a local one used."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lakesift-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder, under the application's id, and reads it back: it is computed once, and what is lost with an executor is read again."""
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lakesift-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that cut wrote in this application: to be called when none of its results is read any more."""
    _delete(spark, _own_dir(spark))


def forget(df: DataFrame, folder: str) -> None:
    """Deletes the table that cut wrote, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.rpartition("/")[2].startswith(f"{folder}-"):
            _delete(df.sparkSession, path)


def stable(df: DataFrame) -> DataFrame:
    """df such that it has the same rows whenever it is computed: as it is, if it is a scan and projections; else written first, since
    shuffles and samples may choose or order rows anew. Their numbers (monotonically_increasing_id) may still differ from job to job: see numbered."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return cut(df, "stable") if any(x in plan for x in ("Exchange", "Sample", "InMemoryTableScan", "Adaptive", "Window", "Join")) else df


def numbered(df: DataFrame, name: str, folder: str) -> DataFrame:
    """df with numbers of its rows under this name, written with them once: numbers of a scan depend on the cores alive, so none may be computed again in another job."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()), folder)


def keyed(df: DataFrame, id_col: str, name: str, folder: str) -> DataFrame:
    """df with a key of each row under this name that is the same in all jobs: the id, if ids are whole numbers, unique and not null; else a number, see numbered."""
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return numbered(df, name, folder)
    twice = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    return numbered(df, name, folder) if twice.head(1) else df.withColumn(name, F.col(id_col).cast("bigint"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def lowered(text: pa.Array) -> pa.Array:
    """Lower case with the separators outside ASCII made spaces; null becomes empty."""
    text = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    if np.isin(raw, np.array([0xC2, 0xE2, 0xE3], np.uint8)).any():
        text = pc.replace_substring_regex(text, SEPARATORS_RE, " ")
    return text


def _buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a large_string array without nulls."""
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def token_spans(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, firsts): token k is bytes[starts[k]:ends[k]]; document i has tokens firsts[i]:firsts[i+1]. text is lowered."""
    raw, off = _buffers(text)
    if not len(raw):
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = _WORD[raw]
    edge = np.zeros(len(raw), np.bool_)
    edge[1:] = word[:-1]
    edge[off[:-1][off[:-1] < len(raw)]] = False
    starts = np.flatnonzero(word & ~edge)
    edge[:-1] = word[1:]
    edge[-1] = False
    edge[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~edge) + 1
    return raw, starts, ends, np.searchsorted(starts, off)


def token_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, firsts) of lowered texts."""
    raw, starts, ends, firsts = token_spans(text)
    return span_hashes(raw, [(starts, ends)])[0], firsts


def span_hashes(raw: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Hashes of the bytes at [starts, ends), for each pair of arrays."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return [mix((total[ends] - total[starts]) * down[starts]) for starts, ends in spans]


def gram_hashes(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, firsts) of word n-grams. A document of fewer than n tokens, but one at least, has all of them as its only gram."""
    count = np.diff(firsts)
    acc = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        m = max(0, len(hashes) - k)
        acc[:m] = acc[:m] * np.uint64(0x2545F4914F6CDD1D) + hashes[k:]
    acc = mix(acc + np.uint64(n))
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    for i in np.flatnonzero((count > 0) & (count < n)):
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in hashes[firsts[i] : firsts[i + 1]]:
                value = value * np.uint64(0x2545F4914F6CDD1D) + h
            acc[firsts[i]] = mix(np.array([value + np.uint64(count[i])]))[0]
    out = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(grams, out=out[1:])
    index = np.arange(out[-1]) + np.repeat(firsts[:-1] - out[:-1], grams)
    return acc[index], out


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about PIECE_BYTES together."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    ends, k = np.cumsum(sizes), 0
    while k < batch.num_rows:
        least = ends[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, least + PIECE_BYTES, "right")))
        stop = min(stop, k + 4096, batch.num_rows)
        yield batch.slice(k, stop - k)
        k = stop


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each node's component, of edges (a, b), by alternating large and small stars; nodes without an edge are not in it.

    Each round is written to the shared folder, so lineage stays short; long chains need rounds in the logarithm of their length.
    """
    tidy = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    sign = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = cut(tidy(edges), "components")
    before = sign(now)
    for _ in range(rounds):
        if not before[0]:
            break
        last = now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = tidy(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(tidy(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))), "components")
        after = sign(now)
        forget(last, "components")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components are not complete after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
