"""Session helpers shared by the operators."""

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BROADCAST_ROWS = 50_000


def local_session(cores: str = "8", shuffle: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("jobloom")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder.

    Only where the session names none and runs on one machine, as in tests, is
    a local one set; a cluster without a shared folder is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get()
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    where = shared_folder(spark, name)
    df.write.mode("overwrite").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def plain_unions(spark: SparkSession) -> None:
    """Plan unions without a claimed output partitioning.

    Spark 4.1 may take a union of equally partitioned inputs as partitioned
    and skip the shuffle of an aggregate above it; over nested unions this
    was seen to leave equal keys in different tasks, that is, wrong rows.
    """
    if spark.conf.get("spark.sql.unionOutputPartitioning", "false") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def union_all(frames, missing: bool = False) -> DataFrame:
    """Rows of all frames, matched by column name."""
    first, *rest = frames
    plain_unions(first.sparkSession)
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=missing)
    return first


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use the whole cluster for a scan that yields too few partitions.

    A table of many files already gives every core its share and is returned
    as it is; only a small or single-file table is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast only after checking that the side is small.

    The check reads at most ``rows + 1`` rows.  Beyond the bound the frame is
    returned as it is, so the join shuffles and AQE may split its hot keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def earliest(df: DataFrame, keys, order, keep) -> DataFrame:
    """One row per key: the least by ``order``.

    An aggregate of structs combines on the map side, so a key that holds a
    third of all rows still reaches its reducer as one row per task.
    """
    placed = [c.alias(f"_order{i}") for i, c in enumerate(order)]
    ranked = F.struct(*placed, *[F.col(c) for c in keep if c not in keys])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in keep if c not in keys])


def top_per_key(df: DataFrame, keys, order, n: int, position: str = "position") -> DataFrame:
    """The first ``n`` rows per key.

    Spark turns the ``row_number() <= n`` filter into a group limit on both
    sides of the shuffle, so at most ``n`` rows per key and task move.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= n)


def hot_join(big: DataFrame, small: DataFrame, key: str, spread: Column, ways: int = 16) -> DataFrame:
    """Equi-join in which one key may hold a large share of ``big``.

    ``big`` rows are spread over ``ways`` salts per key and ``small`` rows are
    repeated once per salt, so every key is worked on by ``ways`` tasks.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(ways)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return salted.join(repeated, [key, "_salt"]).drop("_salt")
