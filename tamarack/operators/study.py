"""Practice analytics: filters, pages, latest rows, daily activity, streaks, mastery, review and state tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tamarack.functions.dates import local_day, percent_or_null

PAGE, MOST_ON_PAGE, MOST_PAGES = 20, 100, 100_000


def matching(rows: DataFrame, **equals: object) -> DataFrame:
    """Rows that equal every parameter that is given; an absent or empty one asks nothing."""
    asked = [F.col(k) == F.lit(v) for k, v in equals.items() if v not in (None, "")]
    return rows.where(reduce(lambda a, b: a & b, asked)) if asked else rows


def bounds(page: int, size: int) -> tuple[int, int]:
    page = min(max(page, 1), MOST_PAGES)
    size = PAGE if size < 1 else min(size, MOST_ON_PAGE)
    return (page - 1) * size, size


def paged(rows: DataFrame, order: list[Column | str], page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """One page by a total order, and a row that says how many there are in all; neither runs before it is asked for."""
    skip, take = bounds(page, size)
    return rows.orderBy(*order).offset(skip).limit(take), rows.agg(F.count("*").alias("total"))


def user_pages(rows: DataFrame, user: str, order: list[Column], size: int) -> DataFrame:
    """All pages of every user's list: ``rows`` with the user's ``total``, the ``page`` from 1 and the ``place`` on it.

    ``order`` is to be a total one.  A page is picked by user and number where it is asked for.
    """
    w = Window.partitionBy(user)
    r = rows.withColumn("total", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy(*order)) - 1)
    return r.withColumn("page", F.expr(f"_n div {size} + 1")).withColumn("place", F.expr(f"CAST(_n % {size} + 1 AS long)")).drop("_n")


def wrongbook_list(book: DataFrame, status: str = "open") -> DataFrame:
    """Entries of a wrongbook by status: resolved, all, or anything else for those that are open."""
    return book if status == "all" else book.where(F.col("resolved") == (status == "resolved"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value) of all values that are neither null nor empty, in one pass."""
    items = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(items).alias("f")).select("f.*").where("value IS NOT NULL AND value != ''").distinct()


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest order of each key, kept whole in one aggregation without a sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")


def session_days(sessions: DataFrame, answers: DataFrame) -> DataFrame:
    """Each user's local days: answers that are not blank, right ones, time and number of submitted sessions.

    Answers are brought to one row a session before they meet it, so that a session's time counts once; sessions without
    answers count too.  ``sessions`` has session_id, user_id, submitted_at and duration_ms, ``answers`` session_id,
    user_answer and is_correct.
    """
    given = F.coalesce(F.trim("user_answer"), F.lit("")) != ""
    counts = answers.groupBy("session_id").agg(F.count_if(given).alias("answered"), F.count_if(given & F.col("is_correct")).alias("correct"))
    s = sessions.where("submitted_at IS NOT NULL").join(counts, "session_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return s.groupBy("user_id", local_day("submitted_at").alias("day")).agg(total("answered"), total("correct"), total("duration_ms"), F.count("*").alias("sessions"))


def having(rows: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows that have a match, each once."""
    return rows.join(other.select(F.col(other_key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def flag_of(rows: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """A column that says whether a row has a match."""
    keys = other.select(F.col(other_key).alias("_k")).distinct()
    return rows.join(keys, F.col(key) == F.col("_k"), "left").withColumn(name, F.col("_k").isNotNull()).drop("_k")


def chosen_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def daily_activity(answers: DataFrame, user: str, ts: str, correct: Column, duration: str) -> DataFrame:
    """Answers, right ones, time and active users by local day."""
    return answers.groupBy(local_day(ts).alias("day")).agg(F.count("*").alias("answered"), F.sum(correct.cast("int")).alias("correct"), F.round(F.sum(duration), 4).alias("duration"), F.countDistinct(user).alias("users"))


def sessions_by_day(sessions: DataFrame, answers: DataFrame) -> DataFrame:
    """Submitted sessions by user and local day, with answers counted by session first so that no duration counts twice.

    An answer counts if it is not blank; a session of blanks counts as a session but not as activity.
    """
    per = answers.where(F.trim(F.coalesce("user_answer", F.lit(""))) != "").groupBy("session_id").agg(F.count("*").alias("answered"), F.sum("is_correct").alias("correct"))
    s = sessions.where("submitted_at IS NOT NULL").join(per, F.col("id") == F.col("session_id"), "left")
    return s.groupBy("user_id", local_day("submitted_at").alias("day")).agg(F.coalesce(F.sum("answered"), F.lit(0)).alias("answered"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("sessions"))


def period_totals(days: DataFrame, previous: date, start: date, end: date) -> DataFrame:
    """Totals of the window, of the one before, of its last day and of all days, by user."""
    spans = {"period": F.col("day").between(start, end), "previous": (F.col("day") >= previous) & (F.col("day") < start), "today": F.col("day") == F.lit(end), "lifetime": F.lit(True)}
    sums = [F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(f"{name}_{c}") for name, inside in spans.items() for c in ("answered", "correct", "duration_ms", "sessions")]
    out = days.groupBy("user_id").agg(*sums)
    return out.withColumns({f"{n}_accuracy": percent_or_null(f"{n}_correct", f"{n}_answered") for n in spans})


def day_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))


def streaks(active: DataFrame, user: str, today: Column) -> DataFrame:
    """Longest and current run of active days; the current one lives on if its last day is yesterday."""
    w = Window.partitionBy(user).orderBy("day")
    runs = active.select(user, "day").distinct().withColumn("run", F.date_sub("day", F.row_number().over(w)))
    runs = runs.groupBy(user, "run").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    current = F.max(F.when(F.col("last") >= F.date_sub(today, 1), F.col("n")))
    return runs.groupBy(user).agg(F.max("n").alias("longest"), F.coalesce(current, F.lit(0)).alias("current"), F.max(F.col("last") == today).alias("practiced_today"))


def mastery(answers: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    """Answered, right and their ratio for each key, as ``user × concept``."""
    g = answers.groupBy(*keys).agg(F.count("*").alias("answered"), F.sum(correct.cast("int")).alias("correct"))
    return g.withColumn("mastery", F.col("correct").cast("double") / F.col("answered"))


def with_all(groups: DataFrame, dimension: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """Groups joined to a full dimension, zeros where nothing happened."""
    return dimension.join(groups, key, "left").fillna(0, fill)


def weakest(groups: DataFrame, part: str, whole: str, least: int, k: int, tie: str) -> DataFrame:
    """The k groups with the lowest ratio of those with enough rows."""
    return groups.where(F.col(whole) >= least).withColumn("ratio", F.round(F.col(part).cast("double") / F.col(whole), 6)).orderBy("ratio", tie).limit(k)


def wrongbook(answers: DataFrame, user: str, question: str, ts: str, wrong: Column, blank: Column | None = None) -> DataFrame:
    """Questions once answered wrongly: how often, when last, and whether the last answer was right.  Blanks change nothing."""
    rows = answers.where(~blank) if blank is not None else answers
    g = rows.groupBy(user, question).agg(F.count_if(wrong).alias("wrong_count"), F.max(F.when(wrong, F.col(ts))).alias("last_wrong"), (~F.max_by(wrong, ts)).alias("resolved"))
    return g.where("wrong_count > 0")


def quota(requests: DataFrame, user: str, ts: str, amount: Column, limit: float, tie: str) -> DataFrame:
    """Running use by user and local day; ``over`` marks requests at which it exceeds the limit."""
    w = Window.partitionBy(user, "day").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return requests.withColumn("day", local_day(ts)).withColumn("used", F.sum(amount).over(w)).withColumn("over", F.col("used") > limit)


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], values: list[str], out: list[str], name: str, start: tuple, step: Callable) -> DataFrame:
    """``out`` and a flag ``name`` of each row: ``step(state, *values)`` gives the next state and the flag, in order within a key.

    A key's rows are sorted in one partition and pass in batches, with only the last state kept between them.
    """
    rows = rows.select(*dict.fromkeys([*keys, *order, *values, *out])).repartition(*keys).sortWithinPartitions(*keys, *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for batch in batches:
            flags = []
            for key, given in zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*(batch.column(c).to_pylist() for c in values))):
                if key != last:
                    last, state = key, start
                state, flag = step(state, *given)
                flags.append(flag)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(flags, pa.bool_())], names=[*out, name])

    return rows.mapInArrow(fold, StructType([*(StructField(c, rows.schema[c].dataType) for c in out), StructField(name, BooleanType())]))


def accepted_requests(requests: DataFrame, user: str, ts: str, amount: str, limit: int, tie: str) -> DataFrame:
    """As ``quota``, but a refused request uses nothing: an ordered fold over a user's day."""
    def step(state: tuple, n: int | None) -> tuple:
        if n is None:
            return state, None
        used = state[0] + n
        return ((used,), True) if used <= limit else (state, False)

    rows = requests.withColumn("day", local_day(ts)).withColumn(amount, F.col(amount).cast("long"))
    return ordered_fold(rows, [user, "day"], [ts, tie, amount], [amount], [user, "day", tie], "accepted", (0,), step)


def accepted_revisions(events: DataFrame, key: str, order: str, revision: str) -> DataFrame:
    """Drafts saved with the revision that was current at the time; others are refused."""
    def step(state: tuple, rev: int | None) -> tuple:
        if rev is None:
            return state, None
        return ((rev + 1,), True) if rev == state[0] else (state, False)

    rows = events.withColumn(revision, F.col(revision).cast("long"))
    return ordered_fold(rows, [key], [order, revision], [revision], [key, order], "accepted", (0,), step)


def refresh_concepts(labels: DataFrame, stored: DataFrame) -> DataFrame:
    """Concepts (module, name) with the newest secondary and their count; stored ids stay, new ones follow."""
    fresh = labels.groupBy(F.col("subject").alias("module"), F.col("tertiary").alias("name")).agg(F.max_by("secondary", "id").alias("secondary"), F.count("*").alias("n_labels"))
    merged = fresh.join(stored.select("module", "name", F.col("id").alias("old")), ["module", "name"], "full")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    w = Window.partitionBy("known").orderBy("module", "name")  # as many rows as there are concepts
    merged = merged.withColumn("known", F.col("old").isNotNull()).withColumn("n", F.row_number().over(w)).crossJoin(top)
    return merged.select(F.when(F.col("known"), F.col("old")).otherwise(F.col("top") + F.col("n")).alias("id"), "module", "name", "secondary", F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


def milestones(totals: DataFrame) -> DataFrame:
    """(user_id, name, progress, goal, reached) from answered, longest and modules_with_five by user."""
    goals = (("first_answer", "answered", 1), ("hundred_answers", "answered", 100), ("thousand_answers", "answered", 1000), ("week_streak", "longest", 7), ("month_streak", "longest", 30), ("all_modules", "modules_with_five", 6))
    items = F.array(*(F.struct(F.lit(n).alias("name"), F.least(F.col(c).cast("long"), F.lit(g).cast("long")).alias("progress"), F.lit(g).cast("long").alias("goal"), (F.col(c) >= g).alias("reached")) for n, c, g in goals))
    return totals.select("user_id", F.explode(items).alias("m")).select("user_id", "m.*")
