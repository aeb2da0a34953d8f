"""Toxicity (2): a convolutional text classifier. Words are hashed to embeddings (a word's is the sum of its own and those of its first bytes, PREFIXES); filters of several widths slide over them; each filter's greatest
value in the text goes through a linear layer to a score. It is trained with numpy on the driver, and thresholds are calibrated by language on all labelled rows that it wasn't trained on.

Since a filter is linear in the embeddings, its value at a place is a sum of table look-ups, one for each word under it: for scoring, embeddings
and filters are folded into one table (bucket, offset, filter), and a batch of documents costs a few gathers and one maximum by document. Scoring is one Arrow pass
without a shuffle; the table is of constant size.

Training reads a bounded sample of labelled rows, chosen by hash (MAX_TRAINING rows with both classes in their proportions; a documented parameter) and leaves every fourth of
them out; everything else reads all rows, and texts are read whole in either case. A language's threshold is the one with the best F1 on all labelled rows of this language whose text
wasn't trained on, drawn towards the common one where it has few toxic rows (MIN_TOXIC); null and unseen languages have the common threshold. For that, documents are scored
in a pass without a shuffle; ids and scores meet the labels, exact counts by language, score and label are summed, and F1 at each score comes from running sums in two steps
(ranges of scores, then inside each), so that a large language isn't one task. The driver gets a row for each language.

Defined cases: a null or empty text has score null and isn't toxic. Labels that are null are left out. Without a toxic and a clean labelled row nothing can be learnt: all scores are null.
Rows that repeat get equal scores; ties with the threshold are toxic. Empty tables give empty ones. Extra columns stay; toxic_score, threshold and is_toxic are overwritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.llm.common import cut, lowered, pieces, span_hashes, token_spans

#: Labelled rows to take for training at most; bits of a word's hash bucket; width of an embedding; filter widths and filters of each.
MAX_TRAINING, BITS, DIM, WIDTHS, FILTERS = 6000, 22, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE, DECAY, SEED = 10, 64, 0.02, 1e-3, 5
#: Lengths in bytes of the beginnings that have embeddings too; share of a text's words that a training step leaves out.
PREFIXES, DROPOUT = (4, 6), 0.3
#: Training texts that a bucket must be in to have an embedding; all others share one of zeros, so that rare words can't be learnt by heart.
MIN_TEXTS = 6
#: Toxic rows of a language, among those not trained on, from which it has a threshold of its own.
MIN_TOXIC = 5
#: Ranges of scores to 1 of a logit, for the running sums.
RANGES = 256


class Model:
    """known (buckets, ascending), emb (row 0 for all others, dim), kernels {width: (width, dim, filters)}, out (filters of all widths), bias, thresholds {language: logit}, common."""

    def __init__(self, known: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.known = known
        self.emb = rng.normal(0, 0.1, (len(known) + 1, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.kernels = {w: rng.normal(0, 0.5 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.shift = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-2.0)
        self.thresholds: dict[str, float] = {}
        self.common = 0.0

    def rows(self) -> np.ndarray:
        """The embedding's row for each bucket."""
        table = np.zeros((1 << BITS) + 1, np.int32)  # the last is for -1
        table[self.known] = np.arange(1, len(self.known) + 1)
        return table

    def tables(self) -> dict[int, np.ndarray]:
        """(width, rows, filters): embeddings times kernels."""
        return {w: np.einsum("bd,wdf->wbf", self.emb, k) for w, k in self.kernels.items()}


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets (words, 1 + beginnings), firsts). A word no longer than a beginning has -1 there."""
    raw, starts, ends, firsts = token_spans(lowered(text))
    hashes = span_hashes(raw, [(starts, ends)] + [(starts, np.minimum(starts + n, ends)) for n in PREFIXES])
    out = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in hashes], 1)
    for k, n in enumerate(PREFIXES):
        out[:, k + 1] = np.where(ends - starts > n, out[:, k + 1] ^ (k + 1), -1)
    return out, firsts


def _sum(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    out = table[tokens[:, 0]]
    for k in range(1, tokens.shape[1]):
        out += table[tokens[:, k]]
    return out


def pooled(tables: dict[int, np.ndarray], shift: dict[int, np.ndarray], tokens: np.ndarray, firsts: np.ndarray, places: bool = False):
    """(documents, filters) of greatest values, above 0, over all places; documents have a token or more. With places, also where they are."""
    count, out, at = np.diff(firsts), [], []
    for w, table in tables.items():
        value = _sum(table[0], tokens)
        for o in range(1, w):
            value[:-o] += _sum(table[o], tokens[o:])
        # a window that runs over a document's end is none, but in a document shorter than the filter, whose only window has what there is
        for o in range(1, w):
            last = (firsts[1:] - o)[count >= w]
            value[last] = -np.inf
        for i in np.flatnonzero(count < w):
            a, b = firsts[i], firsts[i + 1]
            value[a:b] = -np.inf
            value[a] = sum(table[o][tokens[a + o]].sum(0) for o in range(b - a))
        best = np.maximum.reduceat(value, firsts[:-1], axis=0)
        if places:
            spot = np.empty(best.shape, np.int64)
            for i in range(len(count)):
                spot[i] = firsts[i] + value[firsts[i] : firsts[i + 1]].argmax(0)
            at.append(spot)
        out.append(np.maximum(best + shift[w], 0))
    return (np.concatenate(out, 1), at) if places else np.concatenate(out, 1)


def logits(model: Model, tables: dict[int, np.ndarray], tokens: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The score of each document; those without a token have nan."""
    score, has = np.full(len(firsts) - 1, np.nan, np.float32), np.diff(firsts) > 0
    if has.any():
        score[has] = pooled(tables, model.shift, tokens, np.r_[firsts[:-1][has], firsts[-1]]) @ model.out + model.bias
    return score


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the logistic loss; the classes weigh the same. Gradients go through each filter's best place."""
    rng = np.random.default_rng(seed)
    docs = [words(pa.array([text]))[0] for text in texts]
    seen, often = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True)
    model = Model(seen[(often >= MIN_TEXTS) & (seen >= 0)], seed)
    rows = model.rows()
    docs = [rows[d] for d in docs]
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    params = {"emb": model.emb, "out": model.out, **{f"k{w}": model.kernels[w] for w in WIDTHS}, **{f"s{w}": model.shift[w] for w in WIDTHS}}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    bias_m = np.zeros(2)
    usable = np.flatnonzero([len(d) > 0 for d in docs])
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in range(0, len(usable), BATCH):
            if k == 0:
                order = rng.permutation(usable)
            some = order[k : k + BATCH]
            step += 1
            tokens = np.concatenate([docs[i] for i in some])
            firsts = np.r_[0, np.cumsum([len(docs[i]) for i in some])]
            # only the words of the batch are looked up
            tokens = np.where(rng.random(len(tokens))[:, None] < DROPOUT, 0, tokens)
            used, tokens = np.unique(tokens, return_inverse=True)
            tokens = tokens.reshape(-1, 1 + len(PREFIXES))
            small = {w: np.einsum("bd,wdf->wbf", model.emb[used], kern) for w, kern in model.kernels.items()}
            hidden, at = pooled(small, model.shift, tokens, firsts, True)
            p = 1 / (1 + np.exp(-(hidden @ model.out + model.bias)))
            err = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
            grads = {"out": hidden.T @ err + 1e-4 * model.out, "emb": np.zeros((len(used), DIM), np.float32)}
            back = err[:, None] * model.out[None] * (hidden > 0)
            for j, w in enumerate(WIDTHS):
                g = back[:, j * FILTERS : (j + 1) * FILTERS]
                grads[f"s{w}"] = g.sum(0)
                kern = np.zeros_like(model.kernels[w])
                for o in range(w):
                    inside = at[j] + o < firsts[1:, None]
                    word = tokens[np.minimum(at[j] + o, len(tokens) - 1)]
                    gi = g * inside
                    kern[o] = np.einsum("bf,bfd->df", gi, model.emb[used[word]].sum(2))
                    step_back = gi[:, :, None] * model.kernels[w][o].T[None]
                    for c in range(word.shape[2]):
                        np.add.at(grads["emb"], word[:, :, c], step_back)
                grads[f"k{w}"] = kern
            grads["emb"] += DECAY * model.emb[used]
            grads["emb"][used == 0] = 0
            for name, g in grads.items():
                m, v = moments[name]
                rows = used if name == "emb" else slice(None)
                m[rows] = 0.9 * m[rows] + 0.1 * g
                v[rows] = 0.999 * v[rows] + 0.001 * g * g
                params[name][rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.999**step)) + 1e-7)
            b = err.sum()
            bias_m[:] = 0.9 * bias_m[0] + 0.1 * b, 0.999 * bias_m[1] + 0.001 * b * b
            model.bias = np.float32(model.bias - rate * (bias_m[0] / (1 - 0.9**step)) / (np.sqrt(bias_m[1] / (1 - 0.999**step)) + 1e-7))
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap below the scores of the best F1; of equal ones, that with the fewest rows above."""
    by = np.argsort(-scores, kind="stable")
    s, y = scores[by], labels[by]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    f1[:-1][s[:-1] == s[1:]] = -1  # ties aren't parted
    k = int(f1.argmax())
    return float(s[k] if k + 1 == len(s) else (s[k] + s[k + 1]) / 2)


def raw_scores(docs: DataFrame, model: Model, trained: list[str]) -> DataFrame:
    """(doc_id, lang, score, fresh) of the rows with a token: the logit, and whether the text isn't one of trained."""
    shared = docs.sparkSession.sparkContext.broadcast((model, {_digest(x) for x in trained}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        tables, table = own.tables(), own.rows()
        for whole in batches:
            for batch in pieces(whole, "text"):
                found, firsts = words(batch.column("text"))
                value = logits(own, tables, table[found], firsts)
                fresh = [x is not None and _digest(x) not in known for x in batch.column("text").to_pylist()]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(value), pa.array(fresh, pa.bool_())], ["doc_id", "lang", "score", "fresh"])
                yield out.filter(pa.array(~np.isnan(value)))

    kinds = [docs.schema["doc_id"], docs.schema["lang"], T.StructField("score", T.FloatType()), T.StructField("fresh", T.BooleanType())]
    return docs.select("doc_id", "lang", "text").mapInArrow(run, T.StructType(kinds))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def best_thresholds(scored: DataFrame) -> dict[tuple[bool, str | None], tuple[int, int, float]]:
    """best_threshold of scored (lang, score, toxic) for each language, at (False, language), and for all rows, at (True, None): (rows, toxic rows, threshold)."""
    counts = scored.groupBy("lang", F.col("score").cast("double").alias("score"), F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("c"))
    both = F.inline(F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("all"), F.col("lang").cast("string").alias("lang"))))
    counts = counts.select("score", "toxic", "c", both).filter("all or lang is not null").groupBy("all", "lang", "score").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("toxic")).alias("hits"))
    # a range of scores is short where scores are dense
    counts = cut(counts.withColumn("part", F.floor(F.col("score") * RANGES)), "toxic-counts")
    key = ["all", "lang"]
    same = lambda a, b: (F.col(f"{a}.all") == F.col(f"{b}.all")) & F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang"))
    parts = counts.groupBy(*key, "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    above = Window.partitionBy(*key).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "hits")))
    totals = counts.groupBy(*key).agg(F.sum("n").alias("rows"), F.sum("hits").alias("positive"))
    inside = Window.partitionBy(*key, "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(*key, "part", "score", F.sum("n").over(inside).alias("n"), F.sum("hits").over(inside).alias("hits")).alias("a")
    sums = sums.join(parts.alias("b"), same("a", "b") & (F.col("a.part") == F.col("b.part"))).select("a.all", "a.lang", "score", (F.col("n") + F.col("n_above")).alias("n"), (F.col("hits") + F.col("hits_above")).alias("hits")).alias("a")
    sums = sums.join(totals.alias("b"), same("a", "b"))
    f1 = 2 * F.col("hits") / (F.col("n") + F.greatest(F.lit(1), F.col("positive")))
    best = sums.groupBy("a.all", "a.lang", "rows", "positive").agg(F.max(F.struct(f1.alias("f1"), F.col("score"))).alias("best"))
    best = best.select("all", "lang", "rows", "positive", F.col("best.score").alias("top")).alias("a")
    below = counts.alias("b").join(F.broadcast(best), same("a", "b")).groupBy("a.all", "a.lang", "rows", "positive", "top").agg(F.max(F.when(F.col("b.score") < F.col("top"), F.col("b.score"))).alias("next"))
    return {(r["all"], r.lang): (r.rows, r.positive, r.top if r.next is None else (r.top + r.next) / 2) for r in below.collect()}


def calibrate(model: Model, scored: DataFrame) -> None:
    """Thresholds from scored (lang, score, toxic: 0 or 1). Without a toxic and a clean row the common one is 0 and languages have none."""
    found = best_thresholds(scored)
    n, positive, model.common = found.get((True, None), (0, 0, 0.0))
    if not 0 < positive < n:
        model.common = 0.0
        return
    for (whole, lang), (n, positive, own) in sorted(found.items(), key=str):
        if not whole and 0 < positive < n:
            share = min(1.0, positive / MIN_TOXIC)
            model.thresholds[lang] = share * own + (1 - share) * model.common


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> list:
    """At most max_rows labelled rows (text, lang, toxic), chosen by the hash of their id."""
    some = known_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select("doc_id", "text", "lang").filter("text is not null").join(F.broadcast(some), "doc_id")
    return own.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_rows).collect()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> Model | None:
    rows = sample(docs, labels, max_rows)
    seen: set[str] = set()
    rows = [r for r in rows if not (r.text in seen or seen.add(r.text))]  # no copy of a training text is held out
    if len({int(r.toxic > 0) for r in rows}) < 2:
        return None
    rest = [r for k, r in enumerate(rows) if k % 4 != 3] if len(rows) >= 40 else rows
    model = train([r.text for r in rest], [int(r.toxic > 0) for r in rest])
    scored = raw_scores(docs, model, [r.text for r in rest] if len(rows) >= 40 else [])
    calibrate(model, scored.filter("fresh").join(known_labels(labels), "doc_id").select("lang", "score", (F.col("toxic") > 0).cast("int").alias("toxic")))
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with toxic_score (0 to 1), threshold and is_toxic."""
    added = [T.StructField("toxic_score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("is_toxic", T.BooleanType())]
    docs = docs.drop(*(f.name for f in added))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables, table = (own.tables(), own.rows()) if own is not None else ({}, None)
        squash = lambda x: 1 / (1 + np.exp(-x))
        for whole in batches:
            for batch in pieces(whole, text):
                n = batch.num_rows
                value, limit = np.full(n, np.nan), np.full(n, np.nan)
                if own is not None:
                    found, firsts = words(batch.column(text))
                    value = logits(own, tables, table[found], firsts).astype(np.float64)
                    limit = np.array([own.thresholds.get(x, own.common) for x in batch.column(lang).to_pylist()], np.float64)
                with np.errstate(invalid="ignore", over="ignore"):
                    columns = [pa.array(squash(value), from_pandas=True), pa.array(squash(limit), from_pandas=True), pa.array(value >= limit)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "toxic_score", "threshold", "is_toxic"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents with their scores; toxic ones have is_toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "lang", "text"), model).drop("text")
