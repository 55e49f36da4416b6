"""What the training-data operators share: folds, shared storage, connected components, token files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes not to be a column of df (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests); on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(made)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has no more than `most` rows (narrow ones: keys and sizes); else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Keys that hold more than one in so many rows are joined apart; there are at most as many of them.
HOT = 1000


def join_back(rows: DataFrame, found: DataFrame, keys: list[str], copies: str, spread: str) -> DataFrame:
    """rows left-joined with found, which has one row per key; copies: rows that have the key.

    Keys of more than one in HOT rows of all those found are broadcast: HOT at most, whatever the corpus. Rows that have got
    theirs, and those without a key, go on by a hash of the column `spread`, so no task gets all rows of a key.
    """
    total = found.agg(F.sum(copies)).first()[0] or 0
    told = F.struct(*(c for c in found.columns if c not in keys))
    hot = F.broadcast(found.where(F.col(copies) * HOT > total).select(*keys, told.alias("__hot")))
    rest = found.where(F.col(copies) * HOT <= total).select(*keys, told.alias("__rest"), F.pmod(F.col(copies), F.lit(1)).cast("long").alias("__spread"))
    some = rows.join(hot, keys, "left")
    through = F.col("__hot").isNotNull()
    for k in keys:
        through |= F.col(k).isNull()
    some = some.withColumn("__spread", F.when(through, F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    return some.join(rest, [*keys, "__spread"], "left").select(*rows.columns, F.coalesce("__hot", "__rest").alias("__told")).select(*rows.columns, "__told.*")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star steps, all of it distributed.

    edges: pairs of long ids (order, repeats and self-loops don't matter). Returns (node, component), component
    being the smallest id reachable; only nodes that occur in an edge. Each step is a partial aggregation and an
    equi-join, and is written to the shared folder. No edges give no rows.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
