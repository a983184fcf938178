"""Streaming forms: incremental ingest, the wrong-answer state and the anchored rate limit.

The reference behaviours are batch or online ones; these run them over streams or logs of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tamarack.operators import study
from tamarack.operators.study import ordered_fold
from tamarack.operators.tables import names_below

BOOK = "user_id long, question_id string, wrong_count long, last_wrong long, resolved boolean"


def ingest_available(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> None:
    """Append what is new in a folder of Parquet files and stop; files that were read are not read again."""
    rows = spark.readStream.schema(schema).parquet(source)
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def wrongbook_updates(answers: DataFrame) -> DataFrame:
    """Changes of the wrong-answer table from a stream of (user_id, question_id, at, kind).

    ``kind`` is wrong (count one up, open again), right (an existing entry is resolved), blank (nothing), resolve and delete.
    As a deletion makes the order matter, a question's answers must not come in a later micro-batch than newer ones;
    within one they are put in order.  The state is a row for each user and question and has no end, as the book has none.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, resolved = state.get if state.exists else (0, False)
        before = (count, resolved)
        for kind in pd.concat(frames).sort_values("at")["kind"]:
            if kind == "wrong":
                count, resolved = count + 1, False
            elif kind in ("right", "resolve") and count:
                resolved = True
            elif kind == "delete":
                count, resolved = 0, False
        state.update((count, resolved))
        if (count, resolved) != before:
            yield pd.DataFrame({"user_id": [key[0]], "question_id": [key[1]], "wrong_count": [count], "resolved": [resolved]})

    return answers.groupBy("user_id", "question_id").applyInPandasWithState(fold, "user_id long, question_id long, wrong_count long, resolved boolean", "wrong_count long, resolved boolean", "update", GroupStateTimeout.NoTimeout)


def keep_wrongbook(answers: DataFrame, folder: str) -> None:
    """Bring the wrongbook stored in ``folder`` up to date with a stream of (user_id, question_id, at, wrong), and stop.

    An entry is three values that merge in any order (a count, the time of the last wrong answer, the outcome at the
    newest time), so lots may come late or mixed and no watermark is needed; the state is one row for each user and
    question, as the book itself.  A micro-batch writes the entries that it changed under its number and replaces what a
    broken attempt of the same batch had left; the checkpoint says where the next run goes on.  Answers of one time and
    question need distinct ``at`` values for a defined outcome; rows without a user or question are left out.
    """
    rows = answers.where("user_id IS NOT NULL AND question_id IS NOT NULL").withColumn("question_id", F.col("question_id").cast("string"))
    entries = study.wrongbook(rows, "user_id", "question_id", "at", F.coalesce("wrong", F.lit(False)))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    entries.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_wrongbook(spark: SparkSession, folder: str) -> DataFrame:
    """The stored wrongbook: of each user and question the entry of the newest micro-batch; empty before the first one."""
    if not names_below(spark, f"{folder}/changes"):
        return spark.createDataFrame([], BOOK)
    changes = spark.read.schema(f"{BOOK}, batch long").parquet(f"{folder}/changes")
    return study.latest(changes, ["user_id", "question_id"], "batch").drop("batch")


def rate_limited(attempts: DataFrame, limit: int, window_s: int) -> DataFrame:
    """Attempts (key, at in seconds, ok) with ``blocked``: a window begins at the first failure, not at a round time.

    A blocked attempt changes nothing; a success clears the key.  An ordered fold over each key's attempts.
    """
    def step(state: tuple, at: int | None, ok: bool | None) -> tuple:
        since, n = state
        fresh = n == 0 or (None if at is None or since is None else at >= since + window_s)
        if n >= limit and not fresh:
            if fresh is not None:
                return state, True
            blocked = None
        else:
            blocked = False
        return ((0, 0) if ok else (at, 1) if fresh else (since, n + 1)), blocked

    rows = attempts.select("key", F.col("at").cast("long").alias("at"), "ok")
    return ordered_fold(rows, ["key"], ["at", "ok"], ["at", "ok"], ["key", "at", "ok"], "blocked", (0, 0), step)
