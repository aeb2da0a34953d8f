"""Word error rate without Python workers: each pair's distinct words become single characters, and the built-in edit distance counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.functions.text import words

#: The character before the first that stands for a word, and the distinct words of a pair that there are characters for beyond it (of a million words each, a table of distances would have 10^12 cells); more are an error.
_BASE, MAX_WORDS = 0xFFFF, 0x10FFFF - 0xFFFF


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row, which the optimizer doesn't see through: else these costly arrays are made again at each of their uses."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def with_edits(df: DataFrame, ref: str, hyp: str, edits: str, n_ref: str, n_hyp: str, lower: bool = True) -> DataFrame:
    """df with the edits and both sides' numbers of words under these names."""
    clean = lambda c: words(F.lower(F.coalesce(c, F.lit(""))) if lower else F.coalesce(c, F.lit("")))
    spell = lambda x: F.decode(F.unhex(F.array_join(F.transform(x, lambda w: F.lpad(F.hex(F.array_position("_names", w) + _BASE), 8, "0")), "")), "UTF-32")
    both = _once(_once(df, _a=clean(F.col(ref)), _b=clean(F.col(hyp))), _names=F.array_union("_a", "_b"))
    distance = F.when(F.size("_names") <= MAX_WORDS, F.levenshtein(spell("_a"), spell("_b"))).otherwise(F.raise_error(F.lit(f"a pair has more than {MAX_WORDS} distinct words")).cast("int"))
    done = _once(both, **{edits: distance.cast("bigint"), n_ref: F.size("_a").cast("bigint"), n_hyp: F.size("_b").cast("bigint")})
    return done.drop("_a", "_b", "_names")


def rate(distance: Column, n_ref: Column, n_hyp: Column) -> Column:
    """Against an empty reference: 0 if the hypothesis is empty too, else 1."""
    return F.when(n_ref == 0, F.when(n_hyp == 0, 0.0).otherwise(1.0)).otherwise(distance / n_ref)


def score(df: DataFrame, ref: str = "sentence", hyp: str = "hypothesis") -> DataFrame:
    """df with wer_edits, wer_words and wer."""
    done = with_edits(df.drop("wer_edits", "wer_words", "wer"), ref, hyp, "wer_edits", "wer_words", "_m")
    return done.withColumn("wer", rate(F.col("wer_edits"), F.col("wer_words"), F.col("_m"))).drop("_m")


def corpus(scored: DataFrame, by: str | None = None, macro: bool = False) -> DataFrame:
    """(group,) n_samples, wer in %, to two places. micro: all edits over all words; macro: the mean of the rates. A null group counts."""
    micro = F.when(F.sum("wer_words") > 0, F.sum("wer_edits") / F.sum("wer_words")).otherwise(F.avg("wer"))
    value = F.bround(100 * (F.avg("wer") if macro else micro), 2).alias("wer")
    grouped = scored.groupBy(F.col(by).alias("group")) if by else scored
    return grouped.agg(F.count(F.lit(1)).alias("n_samples"), value)


def evaluate_split(df: DataFrame, ref: str = "sentence", hyp: str = "hypothesis", by: str | None = None) -> dict:
    scored = score(df, ref, hyp)
    row = corpus(scored).first()
    by = by or ("gender" if "gender" in df.columns else None)
    groups = {str(r.group): r.wer for r in corpus(scored, by).collect()} if by else {}
    return {"n_samples": row.n_samples, "wer": row.wer, **{f"wer_{k}": v for k, v in groups.items()}}


def compare(df: DataFrame, ref: str, base: str, tuned: str) -> DataFrame:
    """One row: both models' rates in %, the difference, the relative one (null if the base rate is 0) and its direction."""
    both = with_edits(with_edits(df.select(ref, base, tuned), ref, base, "d0", "n", "_m0"), ref, tuned, "d1", "_n1", "_m1")
    sums = both.agg(*(F.sum(c).cast("double").alias(c) for c in ("d0", "d1", "n")))
    rates = sums.select(F.bround(100 * F.col("d0") / F.col("n"), 2).alias("base_wer"), F.bround(100 * F.col("d1") / F.col("n"), 2).alias("tuned_wer"))
    delta = F.bround(F.col("tuned_wer") - F.col("base_wer"), 2)
    return rates.select(
        "base_wer", "tuned_wer", delta.alias("delta"), F.when(F.col("base_wer") > 0, F.bround(100 * (F.col("base_wer") - F.col("tuned_wer")) / F.col("base_wer"), 1)).alias("relative_pct"),
        F.when(delta < 0, "improvement").otherwise("regression").alias("direction"),
    )
