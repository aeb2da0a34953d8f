"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, mixing to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm import decontamination, line_dedup, mixing, ngram_join, quality_rules
from lakesift.llm.common import cut


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with columns that aren't of documents under names that no operator uses."""
    return docs.withColumnsRenamed({c: f"_doc_{c}" for c in docs.columns if c not in OWN})


def _documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df with the columns of docs, and n_chars counted anew."""
    back = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c if c in OWN else f"_doc_{c}").alias(c) for c in docs.columns]
    return df.select(*back)


#: Each stage takes any documents: nulls, empty texts, repeated rows and extra columns have the results that its operator states; of an empty table comes an empty one.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: failing lines go, and documents that lose too much."""
    return _documents(quality_rules.clean_lines(_aside(docs)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines go that are on too many of their source's documents."""
    return _documents(line_dedup.drop_lines(_aside(docs)), docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near duplicates the document of least id stays."""
    return _documents(ngram_join.drop_copies(_aside(docs)), docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: benchmark passages are cut out; documents that consist of them go."""
    return _documents(decontamination.decontaminate(_aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents in training order, with n_tokens, epoch and position. Each is there once at least."""
    added = ("n_tokens", "epoch", "position")
    out = mixing.mix(_aside(docs))
    return out.select(*(F.col(c if c in OWN else f"_doc_{c}").alias(c) for c in docs.columns if c not in added), "n_tokens", "epoch", F.round("position", 9).alias("position"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", copies), ("benchmark decontamination", leaks), ("mixing to target weights", mixed)]
_of = lambda sql, docs: sql.replace("{docs}", docs)
#: The operators' own SQL, each over the rows of the one before. doc_id is unique.
ORACLE_SQL = f"""
WITH stage1 AS MATERIALIZED ({_of(quality_rules.CLEANED_SQL, "documents")}),
stage2 AS MATERIALIZED ({_of(line_dedup.DROPPED_SQL, "stage1")}),
copies AS MATERIALIZED ({_of(ngram_join.GROUPS_SQL, "stage2")}),
stage3 AS MATERIALIZED (SELECT * FROM stage2 WHERE doc_id NOT IN (SELECT doc_id FROM copies WHERE doc_id <> group_id)),
stage4 AS MATERIALIZED ({_of(decontamination.CLEAN_SQL, "stage3")})
SELECT doc_id, text, lang, source, length(text)::BIGINT AS n_chars, n_tokens, epoch, round(position, 9) AS position FROM ({_of(mixing.MIXED_SQL, "stage4").replace("{columns}", ", d.lang")})
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
