"""Practice sessions: selecting questions, checking and submitting answers, progress on papers, profiles, OCR rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tamarack.functions.answers import WEEK_MS, answered_in_draft, grade, json_long
from tamarack.operators.study import mastery, wrongbook

MOST_QUESTIONS, MOST_PAPERS, MOST_SOURCES, CONCEPT_SAMPLES = 200, 3000, 100, 5
GRADED_KINDS = ("single", "multi", "judge")


def select_questions(questions: DataFrame, n: int, seed: str, only: DataFrame | None = None, paper: DataFrame | None = None) -> DataFrame:
    """Gradable questions for a session: in the paper's order, or in a seeded one; at most ``MOST_QUESTIONS``.

    ``only`` (id) restricts to a wrongbook, favourites or a concept; ``paper`` (id, number) gives a paper's questions.
    """
    q = questions.where(F.col("answer_type").isin(*GRADED_KINDS))
    if only is not None:
        q = q.join(only.select("id"), "id", "left_semi")
    if paper is not None:
        return q.join(paper.select("id", "number"), "id").orderBy("number", "id").limit(min(n, MOST_QUESTIONS))
    return q.withColumn("_key", F.md5(F.concat(F.lit(seed), F.col("id").cast("string")))).orderBy("_key", "id").limit(min(n, MOST_QUESTIONS)).drop("_key")


def answer_faults(answers: DataFrame, session: DataFrame, options: DataFrame) -> DataFrame:
    """What is wrong with submitted answers (question_id, answer, duration_ms): one row for each fault.

    ``session`` has question_id and answer_type, ``options`` question_id and label.
    """
    known = session.select("question_id", "answer_type")
    a = answers.join(known, "question_id", "left")
    repeated = answers.groupBy("question_id").count().where("count > 1").select("question_id", F.lit("repeated").alias("fault"))
    rules = (("not_in_session", F.col("answer_type").isNull()), ("duration", ~F.col("duration_ms").between(0, WEEK_MS)), ("several_letters", (F.col("answer_type") != "multi") & (F.length("answer") > 1)))
    simple = reduce(DataFrame.union, (a.where(rule).select("question_id", F.lit(name).alias("fault")) for name, rule in rules))
    letters = a.where("answer_type IN ('single', 'multi')").select("question_id", F.explode(F.filter(F.split("answer", ""), lambda c: c != "")).alias("label"))
    foreign = letters.join(options.select("question_id", "label"), ["question_id", "label"], "left_anti").select("question_id", F.lit("not_an_option").alias("fault")).distinct()
    return simple.union(repeated).union(foreign)


def submit(answers: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replay of submitted answers (user_id, question_id, answer, at): graded rows, the wrongbook and mastery by concept.

    Blank answers are graded as wrong, but neither enter the wrongbook nor count as answered.
    """
    g = answers.join(questions.select("question_id", "answer_type", F.col("answer").alias("official"), "concept"), "question_id")
    g = g.withColumn("is_correct", grade("answer_type", "official", "answer"))
    blank = F.coalesce(F.col("answer"), F.lit("")) == ""
    return g, wrongbook(g, "user_id", "question_id", "at", ~F.col("is_correct"), blank), mastery(g.where(~blank), ["user_id", "concept"], F.col("is_correct"))


def paper_progress(sessions: DataFrame) -> DataFrame:
    """The session that counts for each user and paper: an unfinished one first, then the latest; with answers saved.

    ``sessions`` has user_id, id, spec (JSON with paper_id), question_ids, draft (JSON) and submitted_at.
    """
    s = sessions.withColumn("paper_id", json_long("spec", "$.paper_id")).where("paper_id IS NOT NULL")
    w = Window.partitionBy("user_id", "paper_id").orderBy(F.col("submitted_at").isNull().desc(), F.desc_nulls_last("submitted_at"), F.desc("id"))
    s = s.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return s.select("user_id", "paper_id", "id", answered_in_draft("draft", F.col("question_ids")).alias("saved"), F.size("question_ids").alias("total"), F.when(F.col("submitted_at").isNull(), "resume").otherwise("review").alias("action"))


def paper_action(saved: Column, total: Column, submitted: Column) -> Column:
    """What a paper's button says."""
    return F.when(submitted, "review").when((total > 0) & (saved >= 0), "resume").otherwise("start")


def latest_unfinished(sessions: DataFrame, k: int = 3) -> DataFrame:
    """Each user's k latest sessions that are not submitted, with the number of answers saved."""
    w = Window.partitionBy("user_id").orderBy(F.desc("started_at"), F.desc("id"))
    s = sessions.where("submitted_at IS NULL").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    return s.withColumn("saved", answered_in_draft("draft", F.col("question_ids")))


def profiles(users: DataFrame, stored: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """All users with their profile, defaults where none is stored."""
    p = users.join(stored, "user_id", "left")
    return p.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def anchored(rows: DataFrame, keys: list[str], order: list[str], at: str, reach: str, name: str = "group") -> DataFrame:
    """``rows`` with the number of their segment within a key: one begins where ``at`` is further than ``reach`` of the
    segment's first row away from it.  The rows of a key pass in their order, with one anchor held."""
    sorted_rows, names = rows.repartition(*keys).sortWithinPartitions(*keys, *order), [*rows.columns, name]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, far, number = None, 0.0, 0.0, 0
        for batch in batches:
            out = []
            for key, x, r in zip(zip(*(batch.column(c).to_pylist() for c in keys)), batch.column(at).to_pylist(), batch.column(reach).to_pylist()):
                if key != last:
                    last, anchor, far, number = key, x, r, 0
                elif abs(x - anchor) > far:
                    anchor, far, number = x, r, number + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=names)

    return sorted_rows.mapInArrow(fold, StructType([*rows.schema.fields, StructField(name, LongType())]))


def rebuild_rows(boxes: DataFrame) -> DataFrame:
    """Text of tables from recognised boxes (sha256, x, y, height, text): rows from top to bottom, cells joined by bars.

    A box belongs to the row whose first box's centre is at most 0.6 of that box's height, 1 at least, away.  Boxes
    without text or place are left out.
    """
    place = boxes.where(F.coalesce("text", F.lit("")) != "").dropna(subset=["x", "y", "height"])
    place = place.select("sha256", F.col("x").cast("double").alias("x"), (F.col("y") + F.col("height") / 2).cast("double").alias("centre"), (0.6 * F.greatest(F.col("height").cast("double"), F.lit(1.0))).alias("reach"), "text")
    rows = anchored(place, ["sha256"], ["centre", "x", "text"], "centre", "reach", "row")
    joined = lambda xs, sep: F.array_join(F.transform(F.array_sort(xs), lambda x: x["text"]), sep)
    lines = rows.groupBy("sha256", "row").agg(joined(F.collect_list(F.struct("x", "centre", "text")), " | ").alias("text"))
    return lines.groupBy("sha256").agg(joined(F.collect_list(F.struct("row", "text")), "\n").alias("text"))


def one_model_per_bucket(rows: DataFrame, bucket: str, engine: str, model: str, label: object, schema: str) -> DataFrame:
    """Labels rows by a pluggable function of (model, frame); a bucket lies in one partition and has one model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for m, part in f.groupby(engine, sort=False, dropna=False):
                yield label(model if pd.isna(m) else m, part)

    return rows.repartition(bucket).mapInPandas(run, schema)


def user_stats(answers: DataFrame, wrong: DataFrame, favorites: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row for each user: answered and right ones, questions to review, favourites and submitted sessions.

    ``answers`` has user_id, user_answer and is_correct, ``wrong`` user_id and resolved, ``favorites`` user_id and
    ``sessions`` user_id and submitted_at.  An answer counts unless it is empty; one of blanks counts here.
    """
    counts = (
        answers.where("user_answer != ''").groupBy("user_id").agg(F.count("*").alias("answered"), F.sum(F.col("is_correct").cast("int")).alias("correct")),
        wrong.where("NOT resolved").groupBy("user_id").agg(F.count("*").alias("wrong")),
        favorites.groupBy("user_id").agg(F.count("*").alias("favorites")),
        sessions.where("submitted_at IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("sessions")),
    )
    return reduce(lambda a, b: a.join(b, "user_id", "full"), counts).fillna(0)


def labelled_answers(answers: DataFrame, sessions: DataFrame, labels: DataFrame, concepts: DataFrame) -> DataFrame:
    """Answers of submitted sessions with the concept of their question's newest label; blanks and unknown concepts go."""
    s = sessions.where("submitted_at IS NOT NULL").select(F.col("id").alias("session_id"), "user_id")
    newest = labels.groupBy("question_id").agg(F.max_by(F.struct("subject", "tertiary"), "id").alias("l")).select("question_id", "l.*")
    c = concepts.select(F.col("id").alias("concept_id"), F.col("module").alias("subject"), F.col("name").alias("tertiary"))
    a = answers.where("user_answer != ''").select("session_id", "question_id", "is_correct")
    return a.join(s, "session_id").join(newest, "question_id").join(c, ["subject", "tertiary"])


def weak_in_order(groups: DataFrame, user: str, place: str, least: int = 5, k: int = 3) -> DataFrame:
    """Each user's k weakest groups of those with enough answers; of equal ones those that come first in the given order."""
    ratio = F.col("correct").cast("double") / F.col("answered")
    w = Window.partitionBy(user).orderBy(ratio, place)
    return groups.where(F.col("answered") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hidden_view(questions: DataFrame) -> DataFrame:
    """What a question shows before it is answered: no answer, explanation or marks; a judgement has its two fixed options."""
    fixed = F.array(*(F.struct(F.lit(k).alias("label"), F.lit(v).alias("content")) for k, v in (("A", "正确"), ("B", "错误"))))
    shown = F.transform("options", lambda o: F.struct(o["label"].alias("label"), o["content"].alias("content")))
    return questions.select("id", "module", "stem", "answer_type", F.when(F.col("answer_type") == "judge", fixed).otherwise(shown).alias("options"))


def revealed(questions: DataFrame, answers: DataFrame, user: str = "user_id") -> DataFrame:
    """Answer and explanation of the questions that a user has answered in a submitted session."""
    seen = answers.where("user_answer != '' AND submitted_at IS NOT NULL").select(user, F.col("question_id").alias("id")).distinct()
    return seen.join(questions.select("id", "answer", "explanation"), "id")


def alive(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def engine_totals(calls: DataFrame) -> DataFrame:
    """Each model's share of a run: questions by outcome, tokens, cost, time and the buckets that it worked on."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "cost_usd", "duration_sec"))
    return calls.groupBy("model").agg(F.count("*").alias("questions"), is_("ok"), is_("failed"), is_("skipped"), *sums, F.array_sort(F.collect_set("bucket")).alias("buckets"))


PAPER_TEXTS, PAPER_NUMBERS = ("exam_type", "region", "module", "paper_variant"), ("year", "question_count")


def _shown_papers(papers: DataFrame) -> DataFrame:
    """A paper's columns as a list shows them: what is not known is empty or 0."""
    texts = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in PAPER_TEXTS)
    numbers = (F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in PAPER_NUMBERS)
    return papers.select("id", "name", *texts, *numbers)


def paper_list(papers: DataFrame, limit: int = MOST_PAPERS, year: int = 0, **equal: str) -> DataFrame:
    """Papers by the given columns' values (an empty one and year 0 ask for nothing), the newest years first, then by id.

    The list ends after ``limit`` papers, as the feature asks; Spark keeps that many of each partition, no more.
    """
    if unknown := equal.keys() - set(PAPER_TEXTS):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    for c, v in equal.items():
        papers = papers.where(F.col(c) == v) if v else papers
    papers = papers.where(F.col("year") == year) if year > 0 else papers
    return _shown_papers(papers).orderBy(F.desc("year"), "id").limit(limit)


def question_sources(occurrences: DataFrame, papers: DataFrame, limit: int = MOST_SOURCES) -> DataFrame:
    """For each question (question_id, paper_id) the papers that it occurs in, each once, ``rank`` 1 the newest; at most
    ``limit`` of them.  Only ids and years are ranked; what a paper shows meets the ranked ones afterwards."""
    years = papers.select(F.col("id").alias("paper_id"), F.coalesce(F.col("year").cast("long"), F.lit(0)).alias("_y"))
    pairs = occurrences.select("question_id", "paper_id").distinct().join(years, "paper_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("_y"), "paper_id"))).where(F.col("rank") <= limit)
    return ranked.drop("_y").join(_shown_papers(papers).withColumnRenamed("id", "paper_id"), "paper_id")


def concept_list(concepts: DataFrame, stats: DataFrame, user: int, module: str = "", secondary: str = "") -> DataFrame:
    """Concepts that have questions, with what a user has answered of them; zeros where there is nothing."""
    c = concepts.where("question_count > 0")
    c = c.where(F.col("module") == module) if module else c
    c = c.where(F.col("secondary") == secondary) if secondary else c
    mine = stats.where(F.col("user_id") == user).select(F.col("concept_id").alias("id"), "answered", "correct", "mastery")
    return c.join(mine, "id", "left").fillna(0, ["answered", "correct", "mastery"]).orderBy("module", "secondary", "name")


def concept_cards(concepts: DataFrame, labels: DataFrame) -> DataFrame:
    """Each concept's card from the newest label of its name: texts empty and lists without items where there is none or
    where what is stored is no list; and its first ``CONCEPT_SAMPLES`` questions by id among the questions' newest labels.

    ``labels`` has id, question_id, subject, tertiary, template, boundary and key_features (JSON).
    """
    keys = ["subject", "tertiary"]
    newest = labels.groupBy("question_id").agg(F.max_by(F.struct("id", "subject", "tertiary", "template", "boundary", "key_features"), "id").alias("l")).select("question_id", "l.*")
    cards = newest.groupBy(*keys).agg(F.max_by(F.struct("template", "boundary", "key_features"), "id").alias("card"))
    few = newest.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("question_id"))).where(F.col("_n") <= CONCEPT_SAMPLES)
    samples = few.groupBy(*keys).agg(F.array_sort(F.collect_list("question_id")).alias("samples"))
    text = lambda c: F.coalesce(F.col(f"card.{c}"), F.lit("")).alias(c)
    features = F.coalesce(F.from_json("card.key_features", "array<string>"), F.array().cast("array<string>")).alias("key_features")
    c = concepts.withColumns({"subject": F.col("module"), "tertiary": F.col("name")}).join(cards, keys, "left").join(samples, keys, "left")
    return c.select(*concepts.columns, text("template"), text("boundary"), features, F.coalesce("samples", F.array().cast("array<bigint>")).alias("samples"))


def related_concepts(cards: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts that a card's list of confusable ones names, in its module; 0 where none has the name."""
    items = F.coalesce(F.from_json("confusable", "array<struct<`考点`: string, `区分信号`: string>>"), F.array())
    c = cards.select("id", "module", F.posexplode(items).alias("at", "x")).select("id", "module", "at", F.coalesce("x.考点", F.lit("")).alias("name"), F.coalesce("x.区分信号", F.lit("")).alias("signal"))
    known = concepts.groupBy(F.col("name").alias("_n"), F.col("module").alias("_m")).agg(F.min("id").alias("concept_id"))
    return c.join(known, (F.col("name") == F.col("_n")) & (F.col("module") == F.col("_m")), "left").select("id", "at", "name", "signal", F.coalesce("concept_id", F.lit(0)).alias("concept_id"))


#: The ranges of a profile's numbers and the choices it has, and the longest texts.
PROFILE_RANGES = {"avatar_id": (0, 7), "daily_questions": (5, 200), "daily_minutes": (5, 180)}
PROFILE_CHOICES = {"default_limit": (10, 20, 50), "reading_size": (16, 18, 20)}
PROFILE_LENGTHS = {"nickname": 40, "bio": 200, "exam_name": 40}


def profile_faults(today: Column) -> Column:
    """What is wrong with a profile's columns, in order; ``stored_exam_date`` is the date that it has already."""
    day = F.col("exam_date").try_cast("date")
    kept = day.isNotNull() & (F.col("exam_date") == F.col("stored_exam_date")) & (day <= today)
    fits = day.isNotNull() & (F.date_format(day, "yyyy-MM-dd") == F.col("exam_date")) & (day > today) & (day <= F.add_months(today, 60))
    rules = {c: ~F.col(c).between(a, b) for c, (a, b) in PROFILE_RANGES.items()}
    rules |= {c: ~F.col(c).isin(*v) for c, v in PROFILE_CHOICES.items()} | {c: F.length(c) > n for c, n in PROFILE_LENGTHS.items()}
    rules["exam_date"] = (F.col("exam_date") != "") & ~F.coalesce(kept | fits, F.lit(False))
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())


def overall_convergence(groups: DataFrame) -> DataFrame:
    """One row for all groups of ``labels.convergence``: totals of all and of those with several rows, and the names that never converge."""
    several = F.col("n") > 1
    name = groups.columns[0]
    totals = [F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias(f"{label}_{c}") for label, cond in (("all", F.lit(True)), ("several", several)) for c in ("n", "d")]
    return groups.agg(*totals, F.count_if(several).alias("several_groups"), F.array_join(F.array_sort(F.collect_list(F.when(several & (F.col("n") == F.col("d")), F.col(name)))), ",").alias("never"))
