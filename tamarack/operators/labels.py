"""Labelling: samples, buckets, plans, resumable runs, validation and quality measures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tamarack.functions.answers import answer_matches, tertiary_verdict
from tamarack.functions.dates import percent_or_zero
from tamarack.functions.text import trim_all


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows in turns from each stratum, in a seeded order within it."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("round", F.row_number().over(w)).where(F.col("round") <= n).orderBy("round", stratum).limit(n)


def buckets(rows: DataFrame, module: str, tag: Column) -> DataFrame:
    """Buckets by module and tag, the largest first."""
    name = F.concat_ws("/", F.col(module), F.coalesce(F.when(tag != "", tag), F.lit("(无标签)")))
    return rows.groupBy(name.alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket")


def work_plan(plan: DataFrame, owners: DataFrame, engines: list[str]) -> DataFrame:
    """Buckets keep an owner that still runs; others go to the shared queue, and those that lost one are marked."""
    known = owners.select(F.col("bucket").alias("_b"), "engine")
    p = plan.join(known, F.col("bucket") == F.col("_b"), "left").drop("_b")
    alive = F.col("engine").isin(engines)
    return p.select("bucket", "n", F.when(alive, F.col("engine")).alias("owner"), (F.col("engine").isNotNull() & ~F.coalesce(alive, F.lit(False))).alias("reassigned"))


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do."""
    return rows.join(done, key, "left_anti")


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, percent) of values that are neither null nor empty."""
    aggs = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "[]") == F.lit(False)).alias(c) for c in columns]
    g = rows.agg(F.count("*").alias("_n"), *aggs)
    items = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.round(percent_or_zero(c, "_n"), 6).alias("percent")) for c in columns))
    return g.select(F.explode(items).alias("x")).select("x.*")


def convergence(rows: DataFrame, group: str, detail: str) -> DataFrame:
    """Rows and distinct details by group; a group in which they are equal has not converged at all."""
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(detail).alias("d"))
    return g.withColumn("rate", F.round(F.col("d").cast("double") / F.col("n"), 6)).withColumn("one_to_one", (F.col("n") > 1) & (F.col("n") == F.col("d")))


def type_share(rows: DataFrame, group: str, kind: str, high: float = 0.8) -> DataFrame:
    """The most frequent kind of each group, its share, and whether that is suspiciously high."""
    c = rows.groupBy(group, kind).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    c = c.withColumn("total", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), kind))).where("_r = 1").drop("_r")
    return c.withColumn("share", F.round(F.col("n").cast("double") / F.col("total"), 6)).withColumn("dominant", F.col("n") >= high * F.col("total"))


def run_totals(calls: DataFrame) -> DataFrame:
    """Runs from their ledger: calls by outcome, tokens, cost (null if any is unknown) and state."""
    g = calls.groupBy("run_id").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.sum("cost_usd").alias("_cost"), F.count_if(F.col("cost_usd").isNull()).alias("_unknown"), F.min(F.col("usage_known")).alias("usage_known"))
    state = F.when(F.col("failed") == 0, "done").when(F.col("ok") == 0, "failed").otherwise("partial")
    return g.withColumn("cost_usd", F.when(F.col("_unknown") == 0, F.col("_cost"))).withColumn("state", state).drop("_cost", "_unknown")


def validated(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels with the verdict on their tertiary against the closed vocabulary (small, checked by Spark before a broadcast)."""
    names = taxonomy.select(F.col("subject").alias("_s"), F.col("tertiary").alias("_t")).distinct()
    l = labels.join(names, (F.col("subject") == F.col("_s")) & (F.col("tertiary") == F.col("_t")), "left")
    return l.withColumn("verdict", tertiary_verdict("secondary", "tertiary", F.col("_t").isNotNull())).drop("_s", "_t")


def label_problems(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels (with the ``module`` and ``answer`` of their question) with ``problems``, an array of (field, problem, fatal),
    and ``novel``: the tertiary if it is unknown and acceptable.  Null fields count as empty ones.

    The vocabulary is joined on its three levels; Spark broadcasts a level only if it is small.
    """
    levels = [("subject",), ("subject", "secondary"), ("subject", "secondary", "tertiary")]
    l = labels.withColumn("tertiary", trim_all(F.coalesce("tertiary", F.lit(""))))
    for n, names in enumerate(levels):
        known = taxonomy.select(*(F.col(c).alias(f"_{c}") for c in names)).distinct().withColumn(f"_known{n}", F.lit(True))
        on = F.lit(True)
        for c in names:
            on = on & (F.col(c) == F.col(f"_{c}"))
        l = l.join(known, on, "left").drop(*(f"_{c}" for c in names)).withColumn(f"_known{n}", F.coalesce(f"_known{n}", F.lit(False)))

    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    blank = lambda c: trim_all(F.coalesce(c, F.lit(""))) == ""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    problem = lambda field, name, fatal: F.struct(F.lit(field).alias("field"), name.alias("problem"), F.lit(fatal).alias("fatal"))
    found = lambda field, when, name, fatal: F.when(when, problem(field, F.lit(name), fatal))
    verdict = tertiary_verdict("secondary", "tertiary", F.col("_known2"))
    subject = F.when(none("subject"), "empty").when(~F.col("_known0"), "unknown").when(~none("module") & (F.col("subject") != F.col("module")), "other_module")
    secondary = F.when(none("secondary"), "empty").when(~F.col("_known1"), "unknown")
    judged = ~none("secondary") & F.col("_known0")
    steps = F.transform(F.coalesce("reasoning_chain", F.array().cast("array<string>")), lambda x, i: F.when(blank(x), problem("reasoning_chain", F.concat(F.lit("blank_step_"), (i + 1).cast("string")), True)))
    one = F.array(
        F.when(subject.isNotNull(), problem("subject", subject, True)),
        F.when(secondary.isNotNull(), problem("secondary", secondary, True)),
        F.when(judged & ~verdict.isin("ok", "novel"), problem("tertiary", verdict, True)),
        *(found(c, blank(F.col(c)), "empty", c != "boundary") for c in ("detail", "question_model", "fastest_solution", "template", "boundary")),
        found("reasoning_chain", size("reasoning_chain") == 0, "empty", True),
        found("reasoning_chain", size("reasoning_chain").between(1, 2), "short", False),
    )
    more = F.array(
        *(found(c, size(c) == 0, "empty", c == "key_features") for c in ("key_features", "pitfalls", "typical_ask")),
        found("conclusion", ~none("conclusion") & ~none("answer") & ~answer_matches("conclusion", "answer"), "other_answer", False),
    )
    l = l.withColumn("problems", F.filter(F.concat(one, steps, more), lambda x: x.isNotNull()))
    return l.withColumn("novel", F.when(judged & (verdict == "novel"), F.col("tertiary"))).drop("_known0", "_known1", "_known2")


def balanced_owners(plan: DataFrame, engines: list[str]) -> DataFrame:
    """``bucket, n, engine``: whole buckets dealt to engines by size, forwards and backwards in turn.

    Two engines' loads differ by no more than the largest bucket: in each turn the sizes between them only fall, and
    the next turn goes the other way.  The plan has a row for each bucket of the closed vocabulary, not for each question.
    """
    k = len(engines)
    at = F.row_number().over(Window.orderBy(F.desc("n"), "bucket")) - 1
    turn = F.pmod(F.col("_at"), F.lit(2 * k))
    place = F.when(turn < k, turn).otherwise(2 * k - 1 - turn)
    return plan.withColumn("_at", at).select("bucket", "n", F.element_at(F.array(*map(F.lit, engines)), (place + 1).cast("int")).alias("engine"))


#: Row digests are numbers of 60 bits; the hash of a sequence is a polynomial in each point, modulo this prime.
PRIME = (1 << 61) - 1
POINTS = (1_152_921_504_606_846_883, 864_691_128_455_135_207)


def input_hash(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One hash of all inputs in the order of their keys, those of one key in the order of their digests.

    The hash of a sequence follows from those of its parts and their lengths, so each range of keys is hashed where it
    lies, and one row for each range is put together, whatever the ranges are.
    """
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = rows.select(F.col(key).alias("k"), F.conv(F.substring(F.sha2(F.concat(*map(cell, [key, *fields])), 256), 1, 15), 16, 10).cast("long").alias("h"))
    h = h.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h").select(F.spark_partition_id().alias("part"), "h")
    names = ["part", "n", "a", "b", "pa", "pb"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, a, b = None, 0, 0, 0
        for batch in batches:
            for part, x in zip(batch.column("part").to_pylist(), batch.column("h").to_pylist()):
                n, a, b = n + 1, (a * POINTS[0] + x) % PRIME, (b * POINTS[1] + x) % PRIME
        if n:
            row = [part, n, a, b, *(pow(p, n, PRIME) for p in POINTS)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=names)

    parts = h.mapInArrow(hashed, ", ".join(f"{c} long" for c in names)).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("parts"))
    wide = lambda c: f"CAST({c} AS decimal(19, 0))"
    joined = lambda v, p: f"CAST(aggregate(parts, {wide(0)}, (s, x) -> CAST((s * {wide('x.' + p)} + {wide('x.' + v)}) % {wide(PRIME)} AS decimal(19, 0))) AS string)"
    total = "CAST(aggregate(parts, 0L, (s, x) -> s + x.n) AS string)"
    return parts.select(F.expr(f"sha2(concat_ws(':', {total}, {joined('a', 'pa')}, {joined('b', 'pb')}), 256)").alias("input_hash"))
