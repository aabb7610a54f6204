"""Places and tables that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, spark.checkpoint.dir.  Where that is unset, a local session has a folder of its own; a cluster is refused."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/pixelloom-shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def passing(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted with the session if nothing discards it before."""
    name, store = _path(spark, path)
    store.deleteOnExit(name)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(passing(spark, path))


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            name, store = _path(spark, folder)
            store.delete(name, True)


#: Share of an even partition beyond which a key counts as hot, and the least rows for that.
HOT_SHARE, HOT_ROWS = 0.25, 256


def hot_keys(counts: DataFrame, keys, total: int, n_col="n") -> DataFrame | None:
    """(keys.., salts) of the keys that hold more than a quarter of an even partition's rows, or None.

    At most ``partitions / HOT_SHARE`` keys can do that, whatever the data, so the list is
    bounded and may be broadcast.
    """
    spark = counts.sparkSession
    limit = max(HOT_ROWS, int(total * HOT_SHARE) // partitions(spark))
    rows = counts.where(F.col(n_col) > limit).select(*keys, F.ceil(F.col(n_col) / limit).cast("int").alias("salts"))
    held = rows.collect()
    return spark.createDataFrame(held, rows.schema) if held else None


def split_join(left: DataFrame, right: DataFrame, keys, hot: DataFrame | None, how="inner") -> DataFrame:
    """``left`` joined with ``right``, which has each key once; the rows of hot keys are dealt to several partitions."""
    if hot is None:
        return left.join(right, keys, how)
    salt = F.pmod(F.xxhash64(*[c for c in left.columns]), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("salt", salt).drop("salts")
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def apart(docs: DataFrame, own=("doc_id", "text")):
    """(docs with all columns but ``own`` under names of no meaning, {name: column that was}), so that nothing clashes."""
    names = {c: f"kept_{k}" for k, c in enumerate(c for c in docs.columns if c not in own)}
    return docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]), {c: F.col(names.get(c, c)) for c in docs.columns}
