"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the reader of that copy.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where neither that setting nor a
    folder set on the context exists (local tests) is a temporary one chosen.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="webloom-checkpoint-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session, for tables that are written and read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else tempfile.mkdtemp(prefix="webloom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
