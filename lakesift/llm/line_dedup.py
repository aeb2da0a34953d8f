"""Line dedup (10): site-relative frequency. Pages are grouped by host; the pages of a host that contain a line, divided
by the host's pages, is the line's ratio; lines above the boilerplate ratio are dropped from that host's pages.

Lines are counted by two 64-bit hashes (two seeds: 128 bits), so that text isn't shuffled for the count; partial sums are made before the
shuffle and a page counts a line once. A host can have no more than (lines a page) / ratio lines above the ratio whatever its size, so what is
joined back to the pages by host is small for each host. It is written once and its size is checked: broadcast, the text doesn't move; beyond MAX_BROADCAST it is a shuffle join.

Defined cases: a null text stays null, an empty one empty; neither has lines, but the page counts in its host's total. Null is a host of its own.
Blank lines are never counted nor dropped. A line that repeats in a page counts once and each of its copies is dropped. A page whose lines are
all dropped stays, with an empty text. Hosts of fewer than min_pages pages keep all lines. Rows that repeat are pages of their own.
An empty table gives an empty one. Extra columns stay; columns named n_lines_dropped or beginning with _ld_ are overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import cut

#: A line on more than this share of a host's pages is boilerplate; hosts with fewer pages than MIN_PAGES are left alone, as are lines on fewer than MIN_ON pages.
MAX_RATIO, MIN_PAGES, MIN_ON = 0.05, 10, 3
#: Bytes of the lines' keys to broadcast at most; beyond it the pages meet them in a join by host.
MAX_BROADCAST = 64 << 20


def _key(line: Column) -> Column:
    """128 bits of the line without outer spaces."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, min_on: int = MIN_ON) -> DataFrame:
    """(_ld_host, _ld_drop): for each host with any, the keys of its lines above the ratio."""
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _key))
    totals = docs.groupBy(F.col(host).alias("_ld_host")).agg(F.count(F.lit(1)).alias("pages"))
    on = docs.select(F.col(host).alias("_ld_host"), F.explode(keys).alias("k")).groupBy("_ld_host", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_on)
    totals = totals.filter(F.col("pages") >= min_pages).withColumnRenamed("_ld_host", "h")
    over = on.join(totals, F.col("_ld_host").eqNullSafe(F.col("h"))).filter(F.col("n") > max_ratio * F.col("pages"))
    return over.groupBy("_ld_host").agg(F.collect_list("k").alias("_ld_drop"))


def drop_lines(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """docs with boilerplate lines dropped from the text, and n_lines_dropped added."""
    found = cut(boilerplate(docs, text, host, **limits), "boilerplate")
    if 64 * (found.agg(F.sum(F.size("_ld_drop") + 1)).first()[0] or 0) <= MAX_BROADCAST:
        found = F.broadcast(found)
    joined = docs.join(found, F.col(host).eqNullSafe(F.col("_ld_host")), "left").withColumn("_ld_lines", _lines(F.col(text)))
    kept = F.when(F.col("_ld_drop").isNull(), F.col("_ld_lines")).otherwise(F.filter("_ld_lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_ld_drop"), _key(x))))
    return (
        joined.withColumn("_ld_kept", kept)
        .withColumn("n_lines_dropped", F.coalesce((F.size("_ld_lines") - F.size("_ld_kept")).cast("bigint"), F.lit(0).cast("bigint")))
        .withColumn(text, F.when(F.col("_ld_kept").isNotNull(), F.array_join("_ld_kept", "\n")))
        .drop("_ld_host", "_ld_drop", "_ld_lines", "_ld_kept")
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_lines(docs).select("doc_id", "lang", "source", "n_lines_dropped", "text")


#: Over a table with doc_id, text, lang, source; doc_id unique.
DROPPED_SQL = f"""
SELECT doc_id, lang, source, (len(lines) - len(kept))::BIGINT AS n_lines_dropped, array_to_string(kept, chr(10)) AS text
FROM (SELECT d.*, CASE WHEN b.drops IS NULL THEN d.lines ELSE list_filter(d.lines, lambda x: NOT list_contains(b.drops, trim(x))) END AS kept
      FROM (SELECT *, string_split(text, chr(10)) AS lines FROM {{docs}}) d
      LEFT JOIN (SELECT l.source, list(l.line) AS drops
                 FROM (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT doc_id, source, trim(unnest(string_split(text, chr(10)))) AS line FROM {{docs}}) GROUP BY ALL) l
                 JOIN (SELECT source, count(*) AS pages FROM {{docs}} GROUP BY ALL) t ON l.source IS NOT DISTINCT FROM t.source
                 WHERE l.line <> '' AND t.pages >= {MIN_PAGES} AND l.n >= {MIN_ON} AND l.n > {MAX_RATIO} * t.pages GROUP BY ALL) b
      ON d.source IS NOT DISTINCT FROM b.source)
"""
ORACLE = DROPPED_SQL.replace("{docs}", "documents")
