"""Mixing sources to target weights (6): a time-varying curriculum. Each source has a weight schedule over training time u in [0, 1], given at knots and
linear between them. Its integral W(u) times the total is the source's cumulative token demand; the demand is inverted at
each document's cumulative tokens, which gives the document's training position; documents are range-sorted by position.

Cumulative tokens come in two steps, so that a hot source isn't one task: sums by source and hash bucket, then a running sum inside each
bucket. Only (key, source, tokens, hash) moves for that; the text moves once, in the final sort, where the positions can be broadcast
(MAX_BROADCAST bytes of them at most; beyond it they are joined). A row's key is its id if ids are unique; if not, a number that is written with the table.

The weights at a knot are scaled to sum 1. The total is the least at which each source's whole supply is used, unless it is given:
no document is left out then, and sources that the schedule wants more of are read again, in further epochs.

Defined cases: null is a source of its own. A null or empty text counts as one token; other texts count blanks and line breaks, plus one. Documents of a source without
weight have no position and go; schedule rows with a null weight are left out. Rows that repeat each have a position; ties in the order (equal ids) go by place in the
table. Of an empty table comes an empty one. Extra columns stay; n_tokens, epoch and position are overwritten, and names beginning with _mx_ are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import cut, keyed, stable

#: At the end of training a source's weight is its share of tokens to this power, scaled to sum 1; at the start it is the share itself.
TEMPER, SEED, MAX_BROADCAST = 0.7, 17, 64 << 20
#: What a row of positions takes in a broadcast, as measured.
ROW_BYTES = 112


def tokens(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    blanks = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (blanks(" ") + blanks("\n") + 1).cast("bigint")


def tempered(supply: DataFrame, power: float = TEMPER) -> DataFrame:
    """The default schedule (source, u, weight) for supply (source, n_tokens): from the shares of tokens to tempered shares."""
    supply = supply.withColumn("a", F.col("n_tokens").cast("double"))
    total = supply.agg(F.sum("a").alias("ta"))
    shares = supply.crossJoin(total).withColumn("a", F.col("a") / F.col("ta"))
    return shares.select("source", F.inline(F.array(F.struct(F.lit(0.0).alias("u"), F.col("a").alias("weight")), F.struct(F.lit(1.0).alias("u"), F.pow("a", F.lit(power)).alias("weight")))))


def demands(schedule: DataFrame) -> DataFrame:
    """(source, segs, share): the integrated schedule. A segment has its start, width, weight, slope, and the integral at both ends."""
    known = schedule.filter("u is not null and weight is not null and u between 0 and 1 and weight >= 0").groupBy("source", "u").agg(F.max("weight").alias("weight"))
    whole = known.groupBy("u").agg(F.sum("weight").alias("s")).filter("s > 0")
    known = known.join(whole, "u").withColumn("w", F.col("weight") / F.col("s"))
    by = Window.partitionBy("source").orderBy("u")
    seg = known.withColumn("u1", F.lead("u").over(by)).withColumn("w1", F.lead("w").over(by)).filter("u1 is not null")
    seg = seg.withColumn("area", (F.col("u1") - F.col("u")) * (F.col("w") + F.col("w1")) / 2)
    seg = seg.withColumn("hi", F.sum("area").over(by)).withColumn("lo", F.col("hi") - F.col("area"))
    parts = F.struct("u", "w", ((F.col("w1") - F.col("w")) / (F.col("u1") - F.col("u"))).alias("slope"), "lo", "hi")
    return seg.groupBy("source").agg(F.array_sort(F.collect_list(parts)).alias("segs"), F.sum("area").alias("share"))


def mix(docs: DataFrame, schedule: DataFrame | None = None, total: int | None = None, text: str = "text", source: str = "source", id_col: str = "doc_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs in the order of their position, with n_tokens, epoch (from 0) and position (in [0, 1]); see above. Every source needs knots at 0 and 1."""
    docs = keyed(stable(docs).drop("n_tokens", "epoch", "position"), id_col, "_mx_row", "mix-numbered")
    order = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    narrow = docs.select("_mx_row", F.col(source).alias("source"), F.col(id_col).alias("_mx_id"), order.alias("h"), tokens(F.col(text)).alias("n_tokens"))
    narrow = cut(narrow.withColumn("bucket", F.substring("h", 1, 3)), "mix-tokens")
    sums = narrow.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    supply = sums.groupBy("source").agg(F.sum("n").alias("n_tokens"))
    wanted = demands(tempered(supply) if schedule is None else schedule)
    plan = supply.join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").filter("share > 0")
    plan = cut(plan.withColumnRenamed("n_tokens", "supply"), "mix-plan")
    size = float(total) if total is not None else plan.agg(F.max(F.col("supply") / F.col("share"))).first()[0] or 0.0
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "_mx_id", "_mx_row").rowsBetween(Window.unboundedPreceding, -1))
    at = narrow.withColumn("inside", F.coalesce(inside, F.lit(0)))
    at = at.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.coalesce("before", F.lit(0)) + F.col("inside")).drop("s", "b")
    at = at.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rounds = F.ceil((F.col("share") * size - 0.5 - F.col("start")) / F.col("supply")).cast("int")
    at = at.filter(rounds > 0).select("_mx_row", "n_tokens", "start", "supply", "segs", F.explode(F.sequence(F.lit(0), rounds - 1)).alias("epoch"))
    q = (F.col("start") + F.col("epoch") * F.col("supply")) / F.lit(size)
    at = at.withColumn("q", q).withColumn("seg", F.coalesce(F.get(F.filter("segs", lambda x: x.hi > F.col("q")), F.lit(0)), F.element_at("segs", -1)))
    rest = F.greatest(F.lit(0.0), F.col("q") - F.col("seg.lo"))
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("seg.w") * F.col("seg.w") + 2 * F.col("seg.slope") * rest))
    position = F.when(rest == 0, F.col("seg.u")).otherwise(F.least(F.lit(1.0), F.col("seg.u") + 2 * rest / (F.col("seg.w") + root)))
    places = cut(at.select("_mx_row", "n_tokens", F.col("epoch").cast("bigint").alias("epoch"), position.alias("position")), "mix-places")
    if places.count() * ROW_BYTES <= max_broadcast:
        places = F.broadcast(places)
    return docs.join(places, "_mx_row").orderBy("position", id_col, "_mx_row").drop("_mx_row")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "n_tokens", "epoch", F.round("position", 9).alias("position"), "text")


#: Over a table with doc_id (unique), source and text; {columns} are taken of it besides.
MIXED_SQL = f"""
WITH t AS (SELECT *, (length(x) - length(replace(x, ' ', '')) + length(x) - length(replace(x, chr(10), '')) + 1)::BIGINT AS n_tokens, md5('{SEED}:' || doc_id) AS h
           FROM (SELECT doc_id, source, coalesce(text, '') AS x FROM {{docs}})),
c AS (SELECT doc_id, source, n_tokens, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start FROM t),
s AS (SELECT source, sum(n_tokens)::DOUBLE AS supply FROM t GROUP BY source),
p AS (SELECT source, supply, supply / sum(supply) OVER () AS w0, pow(supply / sum(supply) OVER (), {TEMPER}) AS raw FROM s),
w AS (SELECT source, supply, w0, raw / sum(raw) OVER () AS w1 FROM p),
a AS (SELECT *, (w0 + w1) / 2 AS share, max(supply / ((w0 + w1) / 2)) OVER () AS total FROM w),
e AS (SELECT doc_id, c.source, n_tokens, w0, w1, total, (start + epoch * supply) / total AS q, epoch
      FROM (SELECT *, unnest(range(0, greatest(0, ceil((share * total - 0.5 - start) / supply))::BIGINT)) AS epoch FROM c JOIN a ON c.source IS NOT DISTINCT FROM a.source) c)
SELECT d.doc_id, d.source, n_tokens, epoch, CASE WHEN q = 0 THEN 0 ELSE least(1.0, 2 * q / (w0 + sqrt(greatest(0, w0 * w0 + 2 * (w1 - w0) * q)))) END AS position, d.text{{columns}}
FROM e JOIN {{docs}} d USING (doc_id)
"""
ORACLE = f"SELECT doc_id, source, n_tokens, epoch, round(position, 9) AS position, text FROM ({MIXED_SQL.replace('{docs}', 'documents').replace('{columns}', '')})"
