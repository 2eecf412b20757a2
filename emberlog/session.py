"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: HotSpot leaves larger methods to its interpreter.
JIT_METHOD_BYTES = 8000


def configure(spark: SparkSession) -> SparkSession:
    """Let the last of equal JSON keys win, as JSON readers commonly do, and keep generated methods to what the JVM compiles.

    Projections fused to a method beyond that size run in the JVM's interpreter for good; beyond the limit Spark runs them one by one.
    The settings stay for the whole session.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_METHOD_BYTES)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; on a cluster a machine's own folder would be lost with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="emberlog-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that all who read it share one evaluation.

    ``by`` names a column whose values get a folder each: a filter on it reads only the files of its values.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
