"""Session settings that the operators are written for; a cluster's own settings win."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lakesift", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC. Partition counts are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master without it gets a folder of its own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="lakesift-"))
    return (where or sc.getCheckpointDir()).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that row numbers and the like are the same in all jobs and outlive executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
