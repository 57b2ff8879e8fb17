"""Working tables in the shared folder, for loops whose lineage would grow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this process only where that is unset in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="webquarry-"))
    return base.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: survives lost executors, cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/webquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._wq_settled = True
    return got


def once(df: DataFrame, name: str) -> DataFrame:
    """``settled``, unless df comes from it as it is: for what several branches of a plan read."""
    return df if getattr(df, "_wq_settled", False) else settled(df, name)
