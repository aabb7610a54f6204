"""Smallest reachable vertex over links, by star contraction on DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; where it is unset, a local session has a folder of its own and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or "file:///tmp/pixelloom-shared").rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """A table in the cluster's shared folder, so that lineage ends and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/contraction-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(df: DataFrame) -> None:
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(u, v): for each vertex u that is not the smallest of its component, the smallest v."""
    e = _cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    before = mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = wide.join(wide.groupBy("u").agg(F.min("v").alias("m")), "u")
        last, e = e, _cut(near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        _drop(last)
        after = mark(e)
        if after == before:
            break
        before = after
    return e
