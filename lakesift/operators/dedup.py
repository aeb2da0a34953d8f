"""Duplicates: equal content first, then near ones by sign hashes and cosine. Of near duplicates in a bucket each row is held against the rows kept before it: it goes if one of
these is similar enough, and belongs to the first such. That isn't transitive closure, and depends on the order (pos)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.functions.signals import dot, sign_bucket
from lakesift.operators.mix import numbered
from lakesift.session import written

THRESHOLD, N_BITS = 0.97, 18
#: Rows of a bucket that one task holds at most; larger buckets are worked off in blocks of so many.
BLOCK = 4096
#: Rows that are held against leaders at once.
ROWS = 256


def exact(df: DataFrame, key: str = "md5", id_col: str = "id", pos: str = "pos") -> DataFrame:
    """(id, canonical_id): rows whose key came before, and the first row that has it."""
    w = Window.partitionBy(key).orderBy(pos, id_col)
    ranked = df.filter(F.col(key).isNotNull()).select(id_col, F.row_number().over(w).alias("rn"), F.first(id_col).over(w).alias("canonical_id"))
    return ranked.filter("rn > 1").drop("rn")


def near(df: DataFrame, threshold: float = THRESHOLD, n_bits: int = N_BITS, dim: int = 40, vector: str = "embedding", id_col: str = "id", pos: str = "pos") -> DataFrame:
    """(id, canonical_id) by one expression over each bucket's rows in order."""
    hashed = df.select(id_col, pos, F.col(vector).alias("v"), sign_bucket(F.col(vector), n_bits, dim).alias("bucket"))
    many = hashed.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct(pos, id_col, "v"))).alias("rows")).filter(F.size("rows") > 1)
    kind = df.schema[id_col].dataType.simpleString()
    element = many.schema["rows"].dataType.elementType.simpleString()
    start = F.from_json(F.lit('{"kept": [], "gone": []}'), f"kept array<{element}>, gone array<struct<id:{kind},canonical_id:{kind}>>")

    def fold(state, x):
        hit = F.filter(state["kept"], lambda k: dot(k["v"], x["v"]) >= threshold)
        gone = F.array_append(state["gone"], F.struct(x[id_col].alias("id"), F.element_at(hit, 1)[id_col].alias("canonical_id")))
        return F.when(F.size(hit) > 0, F.struct(state["kept"].alias("kept"), gone.alias("gone"))).otherwise(F.struct(F.array_append(state["kept"], x).alias("kept"), state["gone"].alias("gone")))

    return many.select(F.inline(F.aggregate("rows", start, fold)["gone"])).withColumnRenamed("id", id_col)


def _leaders(ids: list, v: np.ndarray, threshold: float) -> tuple[list[int], list[tuple]]:
    """(places of the rows that stay, (id, canonical id) of the others), in order."""
    kept, near, n, gone = np.zeros(len(ids), np.int64), np.empty_like(v), 0, []
    for k in range(len(ids)):
        hit = np.flatnonzero(near[:n] @ v[k] >= threshold) if n else ()
        if len(hit):
            gone.append((ids[k], ids[kept[hit[0]]]))
        else:
            kept[n], near[n], n = k, v[k], n + 1
    return kept[:n].tolist(), gone


def near_blocks(df: DataFrame, threshold: float = THRESHOLD, n_bits: int = N_BITS, dim: int = 40, vector: str = "embedding", id_col: str = "id", pos: str = "pos") -> DataFrame:
    """The same by matrix products in Arrow groups, one for each bucket of up to BLOCK rows; larger buckets go by blocks, see _large_buckets."""
    kind = df.schema[id_col].dataType.simpleString()
    hashed = written(df.select(F.col(id_col).alias("i"), F.col(pos).alias("p"), F.col(vector).alias("v"), sign_bucket(F.col(vector), n_bits, dim).alias("bucket")))  # read several times
    sizes = hashed.groupBy("bucket").count().filter("count > 1")
    large = sizes.filter(F.col("count") > BLOCK).select("bucket")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["p", "i"], kind="stable")
        return pd.DataFrame(_leaders(rows.i.tolist(), np.stack(rows.v.to_numpy()).astype(np.float64), threshold)[1], columns=[id_col, "canonical_id"])

    schema = f"{id_col} {kind}, canonical_id {kind}"
    small = hashed.join(sizes.filter(F.col("count") <= BLOCK).select("bucket"), "bucket", "left_semi").groupBy("bucket").applyInPandas(run, schema)
    return small.unionByName(_large_buckets(hashed.join(large, "bucket", "left_semi"), threshold, id_col, kind)) if large.head(1) else small


def _large_buckets(rows: DataFrame, threshold: float, id_col: str, kind: str) -> DataFrame:
    """(id, canonical_id) of (i, p, v, bucket), block by block in order: a block's rows that stay are its leaders; all later rows of the bucket, in parts, are held against them and go
    if they are similar, to the first such. A row that outlives all blocks before its own has met every row kept before it, so the result is that of one task with the whole bucket."""
    rest = numbered(rows, "_n", "bucket", "p", "i")
    first = rest.groupBy("bucket").agg(F.min("_n").alias("_first"))
    rest = written(rest.join(F.broadcast(first), "bucket").withColumn("block", F.floor((F.col("_n") - F.col("_first")) / BLOCK)).drop("_first"))
    empty = "i " + kind + ", c " + kind
    gone, last = [], rest.agg(F.max("block")).first()[0]

    def lead(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("_n", kind="stable")
        kept, out = _leaders(table.i.tolist(), np.stack(table.v.to_numpy()).astype(np.float64), threshold)
        stay = table.iloc[kept]
        return pd.DataFrame({"i": [*stay.i, *(x for x, _ in out)], "c": [*[None] * len(stay), *(c for _, c in out)], "n": [*stay._n, *[-1] * len(out)], "v": [*stay.v, *[None] * len(out)], "bucket": table.bucket.iloc[0]})

    def meet(members: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(leaders):
            return pd.DataFrame([], columns=["i", "c"])
        leaders = leaders.sort_values("n", kind="stable")
        heads, found = np.stack(leaders.v.to_numpy()).astype(np.float64).T, []
        for k in range(0, len(members), ROWS):
            part = members.iloc[k : k + ROWS]
            near = np.stack(part.v.to_numpy()).astype(np.float64) @ heads >= threshold
            hit = near.any(1)
            found.append(pd.DataFrame({"i": part.i[hit], "c": leaders.i.to_numpy()[near[hit].argmax(1)]}))
        return pd.concat(found)

    for block in range(int(last) + 1):
        mine = rest.filter(F.col("block") == block)
        led = written(mine.groupBy("bucket").applyInPandas(lead, f"i {kind}, c {kind}, n long, v {rest.schema['v'].dataType.simpleString()}, bucket long"))
        gone.append(led.filter("n < 0").select("i", "c"))
        later = rest.filter(F.col("block") > block)
        parts = later.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        members = later.join(F.broadcast(parts), "bucket").withColumn("part", F.pmod(F.xxhash64("_n"), F.col("parts")).cast("int")).groupBy("bucket", "part")
        leaders = led.filter("n >= 0").join(F.broadcast(parts), "bucket").select(F.col("bucket").alias("b2"), "i", "n", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p2")).groupBy("b2", "p2")
        hits = written(members.cogroup(leaders).applyInPandas(meet, empty))
        gone.append(hits)
        rest = written(later.join(hits, "i", "left_anti"))
        if not rest.head(1):
            break
    out = gone[0]
    for x in gone[1:]:
        out = out.unionByName(x)
    return out.select(F.col("i").alias(id_col), F.col("c").alias("canonical_id"))


def assign(df: DataFrame, threshold: float = THRESHOLD, n_bits: int = N_BITS, dim: int = 40, key: str = "md5", vector: str = "embedding", id_col: str = "id", pos: str = "pos", blocks: bool = True) -> DataFrame:
    """(id, canonical_id, kind) of all rows that go: exact ones, then near ones among the others. ids are unique."""
    df = written(df.select(*dict.fromkeys((id_col, pos, key, vector))))  # read several times
    first = exact(df, key, id_col, pos)
    rest = df.join(first.select(id_col), id_col, "left_anti")
    second = (near_blocks if blocks else near)(rest, threshold, n_bits, dim, vector, id_col, pos)
    return first.withColumn("kind", F.lit("exact")).unionByName(second.withColumn("kind", F.lit("near")))


def keep(df: DataFrame, assignment: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(assignment.select(id_col), id_col, "left_anti")


def report(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row of counts: input, kept, groups and copies of either kind, retention."""
    total = df.agg(F.count(F.lit(1)).alias("n_input"))
    kinds = [(k, F.col("kind") == k) for k in ("exact", "near")]
    counts = assignment.agg(
        *(F.count_if(c).alias(f"{k}_duplicates") for k, c in kinds),
        *(F.count_distinct(F.when(c, F.col("canonical_id"))).alias(f"{k}_groups") for k, c in kinds),
        F.count(F.lit(1)).alias("n_removed"),
    )
    both = total.crossJoin(counts).withColumn("n_kept", F.col("n_input") - F.col("n_removed"))
    return both.withColumn("retention_rate", F.col("n_kept") / F.greatest(F.col("n_input"), F.lit(1)))


def groups(assignment: DataFrame, id_col: str = "id") -> DataFrame:
    """(canonical_id, duplicates)."""
    return assignment.groupBy("canonical_id").agg(F.array_sort(F.collect_list(id_col)).alias("duplicates"))


def contamination(train: DataFrame, test: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", id_col: str = "id", n_bits: int = N_BITS, dim: int = 40) -> DataFrame:
    """(train_id, test_id) of similar pairs over two manifests, among those with the same sign bucket."""
    side = lambda df, name, v: df.select(F.col(id_col).alias(name), F.col(vector).alias(v), sign_bucket(F.col(vector), n_bits, dim).alias("bucket"))
    return side(train, "train_id", "u").join(side(test, "test_id", "v"), "bucket").filter(dot(F.col("u"), F.col("v")) >= threshold).select("train_id", "test_id")
