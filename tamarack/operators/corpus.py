"""Corpus tables: idempotent writes, merging by fingerprint, conflicts, counts and the contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


class ContractError(ValueError):
    """Content changed at a key that is already there."""


def first_writer_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_writer_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by a total order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def new_rows(stored: DataFrame, incoming: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet.  A stored key with another payload is an error."""
    a, b = stored.alias("a"), incoming.alias("b")
    same_key = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    differs = reduce(lambda x, y: x | y, (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in payload))
    if not a.join(b, same_key).where(differs).isEmpty():
        raise ContractError(f"content changed at an existing key ({', '.join(keys)})")
    return incoming.join(stored, keys, "left_anti")


def reference_counts(references: DataFrame, url: str, flags: list[str]) -> DataFrame:
    """How often each url is referred to and where: the count and the or of the flags."""
    return references.groupBy(url).agg(F.count("*").alias("ref_count"), *(F.max(f).alias(f) for f in flags))


def conditional_distinct(rows: DataFrame, by: str, key: str, **conditions: Column) -> DataFrame:
    """Rows, distinct keys, and distinct keys under each condition, by group."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(key).alias("distinct_keys"), *(F.countDistinct(F.when(c, F.col(key))).alias(name) for name, c in conditions.items()))


def breakdown(rows: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Counts by value, the most frequent first, ties by value."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)
    return counts.limit(top) if top else counts


def key_conflicts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Values of each key that stand with several values of the other, both ways."""
    one = rows.groupBy(F.col(a).cast("string").alias("key")).agg(F.countDistinct(b).alias("n")).where("n > 1").withColumn("direction", F.lit(f"{a}->{b}"))
    other = rows.groupBy(F.col(b).cast("string").alias("key")).agg(F.countDistinct(a).alias("n")).where("n > 1").withColumn("direction", F.lit(f"{b}->{a}"))
    return one.unionAll(other).select("direction", "key", "n")


def conflict_list(rows: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys with several values and those values, sorted and joined."""
    g = rows.groupBy(key).agg(F.countDistinct(value).alias("n_values"), F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias("all_values"))
    return g.where(F.col("n_values") >= least)


def top_duplicates(rows: DataFrame, key: str, limit: int) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return counts.where("n > 1").orderBy(F.desc("n"), "first_id").limit(limit)


def expectations(measures: DataFrame, expected: dict[str, int | None]) -> DataFrame:
    """(metric, actual, expected, ok) from a frame of one row; a measure without an expectation is only reported."""
    items = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("actual"), F.lit(v).cast("long").alias("expected")) for k, v in expected.items()))
    rows = measures.select(F.explode(items).alias("m")).select("m.*")
    return rows.withColumn("ok", F.when(F.col("expected").isNull(), True).otherwise(F.col("actual") == F.col("expected")))


def contract(occurrences: DataFrame, questions: DataFrame, warnings: DataFrame, expected: dict[str, int | None]) -> DataFrame:
    """(metric, actual, expected, ok) of the seven measures of a merged corpus; of those not in ``expected`` only the value.

    ``occurrences`` has question_id and raw_qid, ``questions`` id and answer_type, ``warnings`` kind.  A source id that
    several questions hold was split, a question of several source ids was merged; empty source ids split nothing.
    """
    several = lambda key, value, rows: rows.groupBy(key).agg(F.countDistinct(value).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    named = occurrences.where(F.coalesce("raw_qid", F.lit("")) != "")
    parts = [
        occurrences.agg(F.count("*").alias("occurrences")),
        questions.agg(F.count("*").alias("entities"), F.count_if(F.col("answer_type") == "judge").alias("judge_questions")),
        warnings.agg(F.count_if(F.col("kind") == "correct_mark_mismatch").alias("mark_mismatch"), F.count_if(F.col("kind") == "answer_missing").alias("answer_missing")),
        several("raw_qid", "question_id", named).withColumnRenamed("n", "qid_split"),
        several("question_id", "raw_qid", occurrences).withColumnRenamed("n", "qid_merged"),
    ]
    measures = parts[0]
    for p in parts[1:]:
        measures = measures.join(p)  # one row each
    names = ("occurrences", "entities", "mark_mismatch", "judge_questions", "answer_missing", "qid_split", "qid_merged")
    return expectations(measures, {n: expected.get(n) for n in names})
