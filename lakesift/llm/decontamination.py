"""Benchmark decontamination (1): a broadcast hash set of normalised test n-grams; the token windows of every training document are
scanned against it, hits are verified, and spans or documents are removed.

A test item of fewer than n tokens counts as one window of its own length (MIN_TOKENS at least). A document's windows are hashed for a whole Arrow batch at once; only the documents
with a hit are then looked at token by token: the normalised words of each window that hit are compared with the test's own, so no
hash collision removes anything. Windows that hit are merged to spans, and a span's characters, from its first word to its
last, are cut out of the text. A document of which more than MAX_SHARE of its tokens lies in spans goes as a whole.

What is broadcast is the benchmark's windows, whose size is checked: beyond MAX_BROADCAST bytes the windows of both sides meet in a shuffle join
on their hashes instead, and verification goes on from the matching positions. Of a document's windows only those move whose bit is set in a table of the benchmark's hashes (MAX_BITS at most).

Defined cases: a null text stays null and is kept; an empty one likewise. Null items, and items of fewer than MIN_TOKENS tokens, are not looked for.
Copies of a document are each treated; repeated items count once. Of an empty table comes an empty one; an empty benchmark leaves all
as it is. Extra columns stay; columns named n_spans or n_tokens_cut, or _dc_hits, are overwritten.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.llm.common import TOKEN_RE, cut, gram_hashes, lowered, pieces, token_hashes

#: Tokens in a window; least tokens of an item that is looked for; largest share of a document's tokens in spans; bytes of windows to broadcast at most.
N, MIN_TOKENS, MAX_SHARE, MAX_BROADCAST = 8, 5, 0.5, 64 << 20
#: Bits of the table of hashes for the way beyond a broadcast: 16 a window up to this.
MAX_BITS, _SLICES = 1 << 29, 16

_WORDS = re.compile(r"[a-zA-Z0-9À-῿⁰-⿿぀-\U0010ffff]+")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised tokens and their places in the text as it is. Lower-casing goes character by character, so that places hold."""
    spans = [m.span() for m in _WORDS.finditer(text)]
    return pc.utf8_lower(pa.array([text[a:b] for a, b in spans], pa.large_string())).to_pylist(), spans


def windows_of(tokens: list[str], n: int = N, least: int = MIN_TOKENS) -> set[str]:
    if len(tokens) < n:
        return {" ".join(tokens)} if len(tokens) >= least else set()
    return {" ".join(tokens[k : k + n]) for k in range(len(tokens) - n + 1)}


def _hash_windows(texts: list[str]) -> np.ndarray:
    """Hashes of windows, each of which is one gram; token_hashes and gram_hashes salt a gram with its length."""
    hashes, firsts = token_hashes(lowered(pa.array(texts, pa.large_string())))
    out = [gram_hashes(hashes[firsts[i] : firsts[i + 1]], np.array([0, firsts[i + 1] - firsts[i]]), int(firsts[i + 1] - firsts[i]))[0] for i in range(len(texts))]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def find_spans(tokens: list[str], grams: set[str], lengths: list[int]) -> list[tuple[int, int]]:
    """Merged [start, end) token spans of the windows that are in grams."""
    spans: list[tuple[int, int]] = []
    hits = sorted((k, k + n) for n in lengths for k in range(len(tokens) - n + 1) if " ".join(tokens[k : k + n]) in grams)
    for a, b in hits:
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def cut_text(text: str, grams: set[str], lengths: list[int], max_share: float) -> tuple[str | None, int, int]:
    """(text without the spans, spans, tokens cut); None as the text: the document goes."""
    tokens, places = words(text)
    spans = find_spans(tokens, grams, lengths)
    lost = sum(b - a for a, b in spans)
    if lost > max_share * len(tokens):
        return None, len(spans), lost
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return "".join([*out, text[last:]]), len(spans), lost


def _probe(table: np.ndarray, shift: int, sorted_grams: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that are in the set: a bit table lets few through to the exact search."""
    maybe = np.flatnonzero(table[(hashes >> np.uint64(shift)).astype(np.int64)])
    at = np.searchsorted(sorted_grams, hashes[maybe])
    at[at == len(sorted_grams)] = 0
    return maybe[sorted_grams[at] == hashes[maybe]] if len(sorted_grams) else maybe[:0]


def _scanner(text: str, by_length: dict[int, np.ndarray]) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Which rows of a batch have a window whose hash is in the set."""
    bits = {n: max(16, int(len(g)).bit_length() + 4) for n, g in by_length.items()}
    tables = {}
    for n, g in by_length.items():
        tables[n] = np.zeros(1 << bits[n], np.bool_)
        tables[n][(g >> np.uint64(64 - bits[n])).astype(np.int64)] = True

    def scan(batch: pa.RecordBatch) -> np.ndarray:
        hit = np.zeros(batch.num_rows, np.bool_)
        hashes, firsts = token_hashes(lowered(batch.column(text)))
        for n, grams in by_length.items():
            mine, at = gram_hashes(hashes, firsts, n)
            found = _probe(tables[n], 64 - bits[n], grams, mine)
            hit[np.searchsorted(at, found, "right") - 1] = True
        return hit

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "text", n: int = N, min_tokens: int = MIN_TOKENS, max_share: float = MAX_SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs without the benchmark's passages; n_spans and n_tokens_cut added."""
    docs = docs.drop("n_spans", "n_tokens_cut", "_dc_hits")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_spans", T.LongType()), T.StructField("n_tokens_cut", T.LongType())])
    schema[text].nullable = True
    benchmark = benchmark.select(F.col(item).cast("string").alias("item")).filter(F.col("item").isNotNull())
    if (benchmark.agg(F.sum(F.length("item"))).first()[0] or 0) * n > max_broadcast:
        return _by_join(docs, benchmark, text, n, min_tokens, max_share, schema)
    grams: set[str] = set()
    for row in benchmark.toLocalIterator():
        grams |= windows_of(words(row.item)[0], n, min_tokens)
    kept = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.value
        ordered = sorted(own)
        length = np.array([x.count(" ") + 1 for x in ordered], np.int64)
        hashes = _hash_windows(ordered)
        scan = _scanner(text, {int(k): np.sort(hashes[length == k]) for k in np.unique(length)})
        for whole in batches:
            for batch in pieces(whole, text):
                yield _apply(batch, scan(batch) if own else np.zeros(batch.num_rows, np.bool_), text, lambda _: own, max_share)

    return docs.mapInArrow(run, schema)


def _apply(batch: pa.RecordBatch, hit: np.ndarray, text: str, grams_of: Callable[[int], set[str]], max_share: float) -> pa.RecordBatch:
    spans, lost, keep, changed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, np.bool_), {}
    column = batch.column(text)
    for i in map(int, np.flatnonzero(hit)):
        grams = grams_of(i)
        new, spans[i], lost[i] = cut_text(column[i].as_py(), grams, sorted({x.count(" ") + 1 for x in grams}) if len(grams) < 10000 else _lengths(grams), max_share)
        if new is None:
            keep[i] = False
        elif spans[i]:
            changed[i] = new
    if changed:
        mask = np.zeros(batch.num_rows, np.bool_)
        mask[list(changed)] = True
        column = pc.replace_with_mask(column, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], column.type))
    names = batch.schema.names
    columns = [column if c == text else batch.column(c) for c in names]
    out = pa.RecordBatch.from_arrays([*columns, pa.array(spans), pa.array(lost)], [*names, "n_spans", "n_tokens_cut"])
    return out if keep.all() else out.filter(pa.array(keep))


_CACHE: dict[int, tuple[set[str], list[int]]] = {}


def _lengths(grams: set[str]) -> list[int]:
    """The window lengths in a large set, which is looked through once."""
    if (found := _CACHE.get(id(grams))) is None or found[0] is not grams:
        _CACHE.clear()
        _CACHE[id(grams)] = found = (grams, sorted({x.count(" ") + 1 for x in grams}))
    return found[1]


def _bit_table(tests: DataFrame) -> np.ndarray:
    """A table, of a power of two of places, that is true at the leading bits of each hash in tests (h)."""
    bits = int(np.clip(16 * tests.count(), 1 << 16, MAX_BITS) - 1).bit_length()
    part = (1 << bits) // _SLICES // 8

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, np.bool_)
        for batch in batches:
            found[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(found)
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([packed[k * part : (k + 1) * part].tobytes() for k in range(_SLICES)], pa.binary())], ["slice", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                total[k] = total[k] | x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "bits"])

    schema = "slice int, bits binary"
    out = np.zeros(_SLICES * part, np.uint8)
    for r in tests.select("h").mapInArrow(gather, schema).repartition(_SLICES, "slice").mapInArrow(merge, schema).toLocalIterator():
        out[r.slice * part : (r.slice + 1) * part] = np.frombuffer(r.bits, np.uint8)
    return out


def _by_join(docs: DataFrame, benchmark: DataFrame, text: str, n: int, min_tokens: int, max_share: float, schema: T.StructType) -> DataFrame:
    """The way beyond a broadcast: the hashes of the documents' windows meet the benchmark's in a shuffle; each document gets the windows it may hold and verifies those."""
    key = "_dc_row"
    docs = docs.withColumn(key, F.xxhash64(F.col(text)))  # copies share their hits

    def test_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = sorted({g for x in batch.column(0).to_pylist() for g in windows_of(words(x)[0], n, min_tokens)})
            yield pa.RecordBatch.from_arrays([pa.array(_hash_windows(grams).view(np.int64)), pa.array(grams, pa.string())], ["h", "gram"])

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(np.bool_)
        shift = np.uint64(64 - len(known).bit_length() + 1)
        for whole in batches:
            for batch in pieces(whole, text):
                hashes, firsts = token_hashes(lowered(batch.column(text)))
                rows = batch.column(key).to_numpy(zero_copy_only=False)
                for size in range(min(min_tokens, n), n + 1):
                    mine, at = gram_hashes(hashes, firsts, size)
                    maybe = known[(mine >> shift).astype(np.int64)]
                    pair = np.unique(np.rec.fromarrays([np.repeat(rows, np.diff(at))[maybe], mine.view(np.int64)[maybe]]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair["f0"])), pa.array(np.ascontiguousarray(pair["f1"]))], [key, "h"])

    tests = cut(benchmark.mapInArrow(test_windows, "h long, gram string").distinct(), "benchmark-windows")
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(tests))
    found = docs.select(key, text).mapInArrow(doc_windows, f"{key} long, h long").join(tests, "h").groupBy(key).agg(F.collect_set("gram").alias("_dc_hits"))
    joined = docs.join(found, key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("_dc_hits").to_pylist()
            yield _apply(batch.drop_columns(["_dc_hits"]), np.array([bool(h) for h in hits], np.bool_), text, lambda i: set(hits[i]), max_share)

    return joined.mapInArrow(run, schema)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "lang", "source", "n_spans", "n_tokens_cut", "text")


#: Words and what stands between them: word k has part k before it, and one part more at the end. Over a table with doc_id (unique), lang, source and text, and over benchmark (text).
_LETTERS = TOKEN_RE.replace("a-z", "a-zA-Z")
CLEAN_SQL = f"""
WITH b AS (SELECT list_transform(regexp_extract_all(text, '{_LETTERS}'), lambda x: lower(x)) AS t FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT unnest(CASE WHEN len(t) >= {N} THEN list_transform(range(1, len(t) - {N - 2}), lambda k: array_to_string(t[k:k + {N - 1}], ' '))
        WHEN len(t) >= {MIN_TOKENS} THEN [array_to_string(t, ' ')] ELSE [] END) AS gram FROM b),
s AS (SELECT DISTINCT len(string_split(gram, ' '))::BIGINT AS n FROM g),
d AS MATERIALIZED (SELECT *, list_transform(words, lambda x: lower(x)) AS t FROM (SELECT doc_id, lang, source, text, regexp_extract_all(text, '{_LETTERS}') AS words FROM {{docs}})),
p AS (SELECT doc_id, n, k, array_to_string(t[k:k + n - 1], ' ') AS gram FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS k FROM d, s WHERE len(t) >= n)),
h AS (SELECT doc_id, unnest(range(k, k + n)) AS k FROM p JOIN g USING (gram)),
c AS (SELECT doc_id, list(DISTINCT k) AS cuts, count(DISTINCT k) AS n_tokens_cut FROM h GROUP BY doc_id)
SELECT doc_id, lang, source, coalesce(len(list_filter(cuts, lambda k: NOT list_contains(cuts, k - 1))), 0)::BIGINT AS n_spans, coalesce(n_tokens_cut, 0)::BIGINT AS n_tokens_cut,
 CASE WHEN cuts IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(words) + 2), lambda k:
   CASE WHEN list_contains(cuts, k) AND list_contains(cuts, k - 1) THEN '' ELSE parts[k] END || CASE WHEN k > len(words) OR list_contains(cuts, k) THEN '' ELSE words[k] END), '') END AS text
FROM (SELECT d.*, cuts, n_tokens_cut, CASE WHEN cuts IS NOT NULL THEN regexp_split_to_array(text, '{_LETTERS}') END AS parts FROM d LEFT JOIN c USING (doc_id))
WHERE coalesce(n_tokens_cut, 0) <= {MAX_SHARE} * coalesce(len(t), 0)
"""
ORACLE = CLEAN_SQL.replace("{docs}", "documents")
