"""Demographic and linguistic diversity of a manifest. A metric whose column is absent is skipped; blank labels are null (but an empty speaker_id is a speaker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.functions.text import accent_column, label, words


def normalise(df: DataFrame) -> DataFrame:
    return df.withColumns({c: label(F.col(c)) for c in ("gender", "age", "accent", "locale") if c in df.columns})


def counts(df: DataFrame, column: str) -> DataFrame:
    """(label, n, pct): the null label counts, most frequent first; shares are of all rows, rounded half to even."""
    per = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    share = F.bround(100 * F.col("n") / F.col("_total"), 2).alias("pct")
    return per.crossJoin(F.broadcast(total)).select("label", "n", share).orderBy(F.desc("n"), F.col("label").asc_nulls_last())


def speaker_counts(df: DataFrame) -> DataFrame:
    return df.filter("speaker_id is not null").groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "speaker_id")


def accent_distribution(df: DataFrame, top: int | None = None) -> DataFrame | None:
    column = accent_column(df)
    if column is None:
        return None
    found = counts(df, column)
    return found if top is None else found.limit(top)


def _axes(df: DataFrame, columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """(by, axis, h, shifted, k): entropy in nats, the same with a logarithm shifted by 1e-12, and labels, of each column (by its axis' name) in one pass over df. Totals are sums of counts, not windows over labels."""
    by = by or []
    each = F.inline(F.array(*(F.struct(F.lit(name).alias("axis"), F.col(c).cast("string").alias("label")) for c, name in columns.items())))
    per = df.select(*by, each).filter("label is not null").groupBy(*by, "axis", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = per.groupBy(*by, "axis").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return per.join(F.broadcast(total), [*by, "axis"]).groupBy(*by, "axis").agg(F.sum(-p * F.ln(p)).alias("h"), F.sum(-p * F.ln(p + 1e-12)).alias("shifted"), F.count(F.lit(1)).alias("k"))


def _value(name: str, normalised: bool = True) -> Column:
    """An axis' value of rows of _axes: entropy over its greatest value, 0 for one label or none; of speaker_balance with both logarithms shifted."""
    if name == "speaker_balance":
        own = F.col("shifted") / F.ln(F.col("k") + 1e-12)
    else:
        own = F.when(F.col("k") <= 1, 0.0).otherwise(F.col("h") / F.ln("k")) if normalised else F.col("h")
    return F.coalesce(F.max(F.when(F.col("axis") == name, own)), F.lit(0.0))


def entropy(df: DataFrame, column: str, normalised: bool = True) -> DataFrame:
    """One row, value: Shannon entropy of the labels in nats, or divided by its greatest value; 0 for one label or none."""
    return _axes(df, {column: column}).agg(_value(column, normalised).alias("value"))


def balance(df: DataFrame, column: str = "speaker_id") -> DataFrame:
    """One row, value: entropy of speakers with both logarithms shifted by 1e-12; -1 for one speaker, 0 for none."""
    return _axes(df, {column: "speaker_balance"}).agg(_value("speaker_balance").alias("value"))


def imbalance(df: DataFrame) -> DataFrame:
    """One row, value: the largest speaker against the median one."""
    per = df.filter("speaker_id is not null").groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.max("n") / (F.median("n") + 1e-6)).alias("value"))


def _moments(c: Column) -> dict[str, Column]:
    return {"mean": F.avg(c), "median": F.median(c), "p5": F.percentile(c, F.lit(0.05)), "p95": F.percentile(c, F.lit(0.95)), "std": F.stddev_samp(c)}


def sentence_stats(df: DataFrame, column: str = "sentence") -> DataFrame:
    n = df.filter(F.col(column).isNotNull()).select(F.size(words(F.col(column))).cast("double").alias("n"))
    return n.agg(*(v.alias(k) for k, v in _moments(F.col("n")).items()))


def vocabulary_size(df: DataFrame, column: str = "sentence") -> DataFrame:
    return df.select(F.explode(words(F.lower(column))).alias("w")).agg(F.count_distinct("w").alias("vocabulary_size"))


def domains(df: DataFrame, column: str = "sentence") -> DataFrame:
    """Shares of sentences in %: to 5 words, to 15, longer."""
    n = df.filter(F.col(column).isNotNull()).select(F.size(words(F.col(column))).alias("n"))
    share = lambda test: 100 * F.avg(test.cast("double"))
    return n.agg(share(F.col("n") <= 5).alias("short_pct"), share(F.col("n").between(6, 15)).alias("medium_pct"), share(F.col("n") > 15).alias("long_pct"))


def duration_stats(df: DataFrame, column: str = "duration_sec") -> DataFrame:
    c = F.col(column)
    return df.agg((F.sum(c) / 3600).alias("total_hours"), *(v.alias(k) for k, v in _moments(c).items()))


def axes_of(df: DataFrame) -> dict[str, str]:
    """The columns that scores read, with the names of their axes."""
    wanted = [("gender", "gender_entropy"), ("age", "age_entropy"), (accent_column(df) or "", "accent_entropy"), ("speaker_id", "speaker_balance")]
    return {c: name for c, name in wanted if c in df.columns}


def scores(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one for each value of by): an entropy for each axis that is there, speaker_balance, and overall, the mean of them all. All axes come from one pass."""
    columns = axes_of(df)
    if not columns:
        return df.sparkSession.createDataFrame([(None,)], "overall double")
    names = list(columns.values())
    found = _axes(df, columns, by)
    row = (found.groupBy(*by) if by else found).agg(*(_value(n).alias(n) for n in names))
    return row.withColumn("overall", sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names))


def report(df: DataFrame) -> dict:
    """All metrics, as plain values."""
    df = normalise(df)
    one = lambda frame: frame.first().asDict()
    rows = lambda frame: {str(r.label): {"count": r.n, "pct": r.pct} for r in frame.collect()}
    out: dict = {"n_samples": df.count(), "n_speakers": None}
    if "speaker_id" in df.columns:
        out |= {"n_speakers": df.agg(F.count_distinct("speaker_id")).first()[0], "speaker_imbalance_ratio": one(imbalance(df))["value"]}
    out |= {f"{c}_distribution": rows(counts(df, c)) for c in ("gender", "age") if c in df.columns}
    if accent_column(df):
        out |= {"accent_distribution": rows(accent_distribution(df, 20)), "accent_entropy": one(entropy(df, accent_column(df)))["value"]}
    if "sentence" in df.columns:
        out |= {"sentence_length": one(sentence_stats(df)), "domain_coverage": one(domains(df)), **one(vocabulary_size(df))}
    out["duration"] = one(duration_stats(df)) if "duration_sec" in df.columns else {}
    return out | {"diversity_score": one(scores(df))}
