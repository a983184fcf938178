"""Stored tables: the shared folder, exact ranks over all partitions, and updates that rewrite only what changed."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RANK = "rank"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only where all tasks run on this machine and none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tamarack-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint, so that later passes see the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path as its object."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names_below(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if it is not there."""
    fs, p = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def ranked(rows: DataFrame, *order: str | Column, name: str = RANK) -> DataFrame:
    """``rows`` with their place from 0 in the order over all of them.

    Rows are sorted by ranges and kept; a partition's first place follows from the counts of those before it, one small
    row for each, so no single task sees all rows.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = materialize(kept.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    first, begin = [], 0
    for part, k in counts:
        first.append((part, begin))
        begin += k
    starts = spark.createDataFrame(first, "_p int, _first long")
    # as many rows as there are partitions
    out = kept.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return out.select(*rows.columns, (F.col("_first") + F.col("_at")).alias(name))


def write_parted(rows: DataFrame, path: str, key: str, parts: int) -> None:
    """A table in ``parts`` folders by the key's hash, for ``update_derived``."""
    rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition("part").write.partitionBy("part").parquet(path)


def update_derived(spark: SparkSession, path: str, key: str, new: DataFrame, parts: int) -> int:
    """Put the columns of ``new`` (key and derived ones) into a table of ``write_parted``; gives the number of rows that changed.

    Only folders with a changed row are rewritten, each replaced as a whole when all are written, so a run that changes
    nothing writes nothing, and one that breaks leaves the table as it was.  Rows that ``new`` lacks stay as they are.
    """
    table = spark.read.parquet(path)
    derived = [c for c in new.columns if c != key]
    given = new.select(F.col(key).alias("_key"), F.struct(*derived).alias("_new")).withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int"))
    same = F.lit(True)
    for c in derived:
        same = same & F.col(c).eqNullSafe(F.col(f"_new.{c}"))
    changed = materialize(table.select(key, "part", *derived).join(given, F.col(key) == F.col("_key")).where(~same).select("_key", "_new", "_part"))
    touched = [(r["_part"], r["n"]) for r in changed.groupBy("_part").agg(F.count("*").alias("n")).collect()]  # at most ``parts``
    if not touched:
        return 0
    rows = table.where(F.col("part").isin([p for p, _ in touched])).join(changed, F.col(key) == F.col("_key"), "left")
    columns = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in derived else F.col(c) for c in table.columns]
    rows.select(*columns).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return sum(n for _, n in touched)
