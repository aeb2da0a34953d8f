"""Samples of exact size, mixes of real and synthetic rows, gender balance. A random order is the order of md5(seed:id), so that any engine draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.functions.text import shuffle_key
from lakesift.session import written

RATIOS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
#: Rows that are drawn by a plain sort; digits of a key's beginning, of which there are 16^DIGITS.
FEW, DIGITS = 10_000, 3


def sizes(n_real: int, n_synthetic: int, ratio: float, fixed: bool = True) -> tuple[int, int]:
    """(real, synthetic) rows of a mix; each is at most what there is, so a mix may be smaller than asked for."""
    if not 0 <= ratio <= 1:
        raise ValueError(f"the ratio lies between 0 and 1, not at {ratio}")
    total = (n_real if n_synthetic == 0 else 2 * min(n_real, n_synthetic)) if fixed else n_real + n_synthetic
    wanted = round(total * ratio)  # half to even
    return min(total - wanted, n_real), min(wanted, n_synthetic)


def lowest(df: DataFrame, n: int, key: str = "_o", id_col: str = "id") -> DataFrame:
    """The n rows of the least keys (hexadecimal). A few are sorted; of many, counts by the key's beginning (16^DIGITS at most) say up to where all are taken, so that no task gets all n."""
    if n <= FEW:
        return df.orderBy(key, id_col).limit(max(0, n))
    begins = F.substring(key, 1, DIGITS)
    before = 0
    for begin, count in sorted(df.groupBy(begins.alias("b")).count().collect()):
        if before + count >= n:
            return df.filter(begins < begin).unionByName(df.filter(begins == begin).orderBy(key, id_col).limit(n - before))
        before += count
    return df


def ranked(df: DataFrame, by: list[str], key: str = "_o", id_col: str = "id") -> DataFrame:
    """df with _r, the place in its group by (key, id), from 1: places among equal beginnings of the key, and counts of those before. A large group is many tasks."""
    part = df.withColumn("_b", F.substring(key, 1, DIGITS))
    sums = part.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by)), F.col("_b").alias("_gb"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key, id_col))
    same = F.col("_b") == F.col("_gb")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return part.withColumn("_i", inside).join(sums, same).withColumn("_r", F.col("_i") + F.col("_before")).drop("_b", "_i", "_gb", "_before", *(f"_g{k}" for k in range(len(by))))


def numbered(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df with its rows' numbers in this order, from 0: numbers in ranges of rows, and counts of the ranges before."""
    part = written(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    sums = part.groupBy(F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_c"))  # a row for each range
    sums = sums.select("_q", F.coalesce(F.sum("_c").over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1 + F.col("_before")
    return part.join(F.broadcast(sums), F.col("_p") == F.col("_q")).withColumn(name, place.cast("bigint")).drop("_p", "_q", "_before")


def sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """min(n, rows) rows."""
    return lowest(df.withColumn("_o", shuffle_key(seed, F.col(id_col))), n, id_col=id_col).drop("_o")


def stratum(df: DataFrame) -> str | None:
    return next((c for c in ("accent", "locale", "gender") if c in df.columns), None)


def stratified(df: DataFrame, n: int, seed: int = 42, id_col: str = "id", by: str | None = None) -> DataFrame:
    """n rows, strata in proportion (one row at least each; null is a stratum): trimmed, or filled up with rows not yet drawn, to exactly n."""
    by = by or stratum(df)
    if by is None:
        return sample(df, n, seed, id_col)
    key = shuffle_key(seed, F.col(id_col))
    strata = df.groupBy(F.col(by).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    total = strata.agg(F.sum("_c")).first()[0] or 0
    strata = strata.withColumn("_q", F.least(F.col("_c"), F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_c") / F.lit(total), 0)).cast("bigint")))
    drawn = strata.agg(F.sum("_q")).first()[0] or 0
    both = ranked(df.withColumn("_o", key), [by], id_col=id_col).join(strata, F.col(by).eqNullSafe(F.col("_s")))
    first, late = both.filter(F.col("_r") <= F.col("_q")), both.filter(F.col("_r") > F.col("_q"))
    out = lowest(first, n, id_col=id_col) if drawn >= n else first.unionByName(lowest(late, n - drawn, id_col=id_col))
    return out.select(*df.columns)


def mix(real: DataFrame, synthetic: DataFrame, ratio: float, strategy: str = "random", seed: int = 42, fixed: bool = True, id_col: str = "id") -> DataFrame:
    """One shuffled mix with mix_synthetic_ratio."""
    n_real, n_synthetic = sizes(real.count(), synthetic.count(), ratio, fixed)
    draw = stratified if strategy == "stratified" else sample
    both = draw(real, n_real, seed, id_col).unionByName(draw(synthetic, n_synthetic, seed, id_col), allowMissingColumns=True)
    return both.withColumn("mix_synthetic_ratio", F.lit(float(ratio))).orderBy(shuffle_key(seed, F.col(id_col), F.lit("mix")), id_col)


def splits(real: DataFrame, synthetic: DataFrame, ratios: tuple[float, ...] = RATIOS, seed: int = 42, fixed: bool = True, id_col: str = "id") -> DataFrame:
    """The mixes of all ratios in one job: pools are ranked once for each ratio, then cut at the ratio's sizes."""
    n_real, n_synthetic = real.count(), synthetic.count()
    plan = [(float(r), *map(int, sizes(n_real, n_synthetic, r, fixed))) for r in sorted(ratios)]
    table = F.broadcast(real.sparkSession.createDataFrame(plan, "mix_synthetic_ratio double, _real bigint, _syn bigint"))
    pool = real.withColumn("_is_syn", F.lit(False)).unionByName(synthetic.withColumn("_is_syn", F.lit(True)), allowMissingColumns=True)
    each = pool.crossJoin(table).withColumn("_o", shuffle_key(seed, F.col(id_col), F.col("mix_synthetic_ratio")))
    cut = F.when(F.col("_is_syn"), F.col("_syn")).otherwise(F.col("_real"))
    return ranked(each, ["mix_synthetic_ratio", "_is_syn"], id_col=id_col).filter(F.col("_r") <= cut).drop("_r", "_o", "_real", "_syn", "_is_syn")


def balance(df: DataFrame, target: dict[str, float] | None = None, seed: int = 42, id_col: str = "id", column: str = "gender", inverse: bool = False) -> DataFrame:
    """Rows whose labels come near the target shares by leaving rows out. Null labels go; labels that aren't in the target stay whole.

    inverse: divide by the shares, as an older rule does; for uniform targets it is the same.
    """
    if column not in df.columns:
        return df
    counts = {r[0]: r[1] for r in df.filter(F.col(column).isNotNull()).groupBy(column).count().collect()}
    target = target or {k: 1 / len(counts) for k in counts}
    present = {k: v for k, v in target.items() if counts.get(k) and v > 0}
    if not present:
        return df.filter(F.col(column).isNotNull())
    if inverse:
        least = min(counts[k] for k in present)
        quota = {k: int(least / v * min(present.values())) for k, v in present.items()}
    else:
        scale = min(counts[k] / v for k, v in present.items())
        quota = {k: int(scale * v + 1e-9) for k, v in present.items()}
    limit: Column = F.lit(None).cast("bigint")
    for k, q in quota.items():
        limit = F.when(F.col(column) == k, F.lit(q)).otherwise(limit)
    known = df.filter(F.col(column).isNotNull()).withColumn("_o", shuffle_key(seed, F.col(id_col)))
    return ranked(known, [column], id_col=id_col).filter(F.col("_r") <= F.coalesce(limit, F.col("_r"))).drop("_r", "_o")


def holdout(df: DataFrame, seed: int = 42, id_col: str = "id", least: int = 50, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(train, test): the test has a tenth of the rows, 50 at least, all of them at most."""
    n = df.count()
    test = sample(df, min(n, max(least, int(n * share))), seed, id_col)
    return df.join(test.select(id_col), id_col, "left_anti"), test
