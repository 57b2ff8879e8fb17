"""Helpers shared by the training-data operators: working tables in the shared
folder, and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder for working tables: the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent in local mode (unit tests) a folder of this process is used; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN_DIR.setdefault("dir", tempfile.mkdtemp(prefix="webquarry-"))
    return f"{base.rstrip('/')}/webquarry"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) for what is run inside; they are put back afterwards."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to a new working table and read it back (cuts the lineage, survives lost executors)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete working tables that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def by_slices(column: pa.Array, make: Callable[[list], pa.Array], rows: int = 1000) -> pa.Array:
    """``make`` over a batch some rows at a time, so that a worker holds few rows as Python objects; spare Arrow memory goes back."""
    parts = [make(column.slice(at, rows).to_pylist()) for at in range(0, len(column), rows)] or [make([])]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (columns ``a``, ``b``, any order, repeats allowed).

    Alternates the large-star and small-star contractions until nothing changes; every
    round is two aggregations with map-side combine and two equi-joins, and is written to
    the shared folder, so neither links nor components ever reach the driver.
    Returns (``node``, ``root``) for every node that has a link; root is the smallest node.
    Empty edges give an empty result; self links are ignored.
    """
    spark = edges.sparkSession

    def down(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        return tuple(row)

    now, path = written(down(edges.selectExpr("a AS u", "b AS v")), "edges")
    seen = state(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after, path2 = written(down(small), "edges")
        said = state(after)
        remove(spark, path)
        now, path = after, path2
        if said == seen and said[0] == said[2]:
            break
        seen = said
    else:
        raise RuntimeError("connected_components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
