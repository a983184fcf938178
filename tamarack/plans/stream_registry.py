"""Queries that run as streams: lots of events come one after the other, and each run goes on where the last one stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.plans.registry import ORACLES, SQL_K, query, right, table
from tamarack.plans.store_registry import CAP, LIMIT, WINDOW_S, _folder
from tamarack.streaming import limits, replay

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(f"""WITH e AS (SELECT user_id, event_type AS question_id, event_id AS n, coalesce({SQL_K} < 50, false) AS wrong FROM events)
SELECT user_id, question_id, count(*) FILTER (wrong) AS wrong_count, max(n) FILTER (wrong) AS last_wrong, NOT arg_max(wrong, n) AS resolved FROM e GROUP BY 1, 2 HAVING count(*) FILTER (wrong) > 0""")
def wrongbook_stream(spark, sf_dir):
    """Events in three lots, whose times are mixed; the stored wrongbook is brought up to date after each."""
    folder = _folder(spark, "wrongbook")
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("question_id"), F.col("event_id").alias("at"), (~right()).alias("wrong"))
    for k in range(3):
        e.where(F.pmod("at", F.lit(3)) == 2 - k).write.mode("append").parquet(f"{folder}/answers")
        replay.keep_wrongbook(spark.readStream.schema(e.schema).parquet(f"{folder}/answers"), folder)
    return replay.read_wrongbook(spark, folder)


@query(ORACLES["capped_limits"])
def capped_limits_stream(spark, sf_dir):
    """The limits of ``capped_limits`` as a stream with timers, over the events of an earlier and of a later time."""
    folder = _folder(spark, "limits")
    s: SparkSession = spark.newSession()  # the state store's kind is a setting of this stream alone
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    time = F.date_trunc("second", F.col("ts").cast("timestamp"))
    e: DataFrame = table(s, sf_dir, "events").select(F.col("event_type").alias("bucket"), F.col("event_id").alias("id"), F.col("user_id").alias("key"), time.alias("time"), right().alias("ok"))
    middle = F.lit(e.agg(F.timestamp_seconds(F.floor(F.avg(F.unix_seconds("time"))))).first()[0]).cast("timestamp")
    for lot in (F.col("time") < middle, F.col("time") >= middle):
        e.where(lot).write.mode("append").parquet(f"{folder}/attempts")
        found = limits.capped_limits_stream(s.readStream.schema(e.schema).parquet(f"{folder}/attempts"), LIMIT, WINDOW_S, CAP)
        run = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(limits.OUTPUT).parquet(f"{folder}/out")
