"""Placeholders and image texts: references, replacement, work lists and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tamarack.functions.dates import percent_or_full
from tamarack.functions.text import display_tex, tex_class
from tamarack.operators.tables import ranked

PLACEHOLDER = r"⟦IMG:([^⟧]+)⟧"
STATES = ("ok", "empty", "error")
SAMPLE_CLASSES = ("math_wrap", "cjk_text", "has_delim", "empty")


def placeholder_references(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each url in any of the columns: how often, and in which."""
    each = [F.expr(f"transform(regexp_extract_all(coalesce(`{c}`, ''), '{PLACEHOLDER}', 1), u -> struct(u AS url, '{c}' AS place))") for c in columns]
    items = F.flatten(F.array(*each))
    refs = rows.select(F.explode(items).alias("r")).select("r.*")
    return refs.groupBy("url").agg(F.count("*").alias("ref_count"), *(F.max(F.col("place") == c).alias(f"in_{c}") for c in columns))


def resolve_placeholders(rows: DataFrame, key: str, text: str, images: DataFrame) -> DataFrame:
    """``key, text`` with placeholders replaced by the images' texts, and counts of what was and was not replaced.

    ``images`` has url, engine (formula or text) and tex; an image that was read but holds no text counts as ``no_text``.
    What an image shows is worked out once for each image.  Texts are cut at the placeholders, the pieces meet their
    images by a join and are put together in order; rows without a placeholder pass by, and rows of equal keys stay apart.
    """
    counts = ("formula", "figure", "no_text", "formula_missing", "figure_missing")
    body = F.coalesce(text, F.lit(""))
    plain = rows.where(~body.contains("⟦IMG:")).select(key, body.alias("resolved"), *(F.lit(0).cast("long").alias(c) for c in counts))
    pieces = rows.where(body.contains("⟦IMG:")).select(key, F.monotonically_increasing_id().alias("_row"), body.alias("_t"))
    pieces = pieces.select(key, "_row", F.posexplode(F.split("_t", r"(?=⟦IMG:)|(?<=⟧)")).alias("at", "piece"))
    url = F.regexp_extract("piece", "^" + PLACEHOLDER + "$", 1)
    pieces = pieces.withColumn("url", F.when(url != "", url))
    shown = F.when(F.col("engine") == "formula", display_tex("tex")).otherwise(F.col("tex"))
    known = images.select(F.col("url").alias("known"), "engine", "tex", F.when(F.coalesce(shown, F.lit("")) != "", shown).alias("shown"))
    p = pieces.join(known, F.col("url") == F.col("known"), "left").withColumn("shown", F.coalesce("shown", "piece"))
    hit = F.col("url").isNotNull() & F.col("known").isNotNull()
    some = F.coalesce(F.col("tex"), F.lit("")) != ""
    figure = F.col("url").startswith("题目图/")
    g = p.groupBy("_row").agg(
        F.any_value(key).alias(key),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]), "").alias("resolved"),
        F.count_if(hit & some & (F.col("engine") == "formula")).alias("formula"),
        F.count_if(hit & some & (F.col("engine") != "formula")).alias("figure"),
        F.count_if(hit & ~some).alias("no_text"),
        F.count_if(F.col("url").isNotNull() & F.col("known").isNull() & ~figure).alias("formula_missing"),
        F.count_if(F.col("url").isNotNull() & F.col("known").isNull() & figure).alias("figure_missing"),
    )
    return g.drop("_row").unionByName(plain)


def ocr_worklist(images: DataFrame, retry_errors: bool = False) -> DataFrame:
    """One image for each content that has no text yet, the smallest url; failed ones again on demand."""
    status = F.coalesce("ocr_status", F.lit("pending"))
    todo = images.where(status.isin("pending", "error") if retry_errors else status == "pending").where("sha256 IS NOT NULL")
    return todo.groupBy("sha256").agg(F.min("url").alias("url"))


def apply_results(images: DataFrame, results: DataFrame) -> DataFrame:
    """Results reach every image with the same content."""
    r = results.select("sha256", F.col("status").alias("ocr_status"), F.col("tex").alias("ocr_tex"))
    return images.drop("ocr_status", "ocr_tex").join(r, "sha256", "left")


def shard_faults(shard: DataFrame, results: DataFrame) -> DataFrame:
    """What speaks against a shard's results: unknown or repeated contents and unknown states; missing ones are counted too."""
    unknown = results.join(shard, "sha256", "left_anti").select("sha256", F.lit("unknown").alias("fault"))
    repeated = results.groupBy("sha256").count().where("count > 1").select("sha256", F.lit("repeated").alias("fault"))
    state = results.where(~F.col("status").isin("ok", "empty", "error")).select("sha256", F.lit("bad_status").alias("fault"))
    missing = shard.join(results, "sha256", "left_anti").select("sha256", F.lit("missing").alias("fault"))
    return unknown.union(repeated).union(state).union(missing)


def shards(work: DataFrame, size: int) -> DataFrame:
    """A work list (sha256, ...) with its ``shard``: equal ones but for the last, in the order of the contents' hashes."""
    return ranked(work, "sha256").withColumn("shard", F.expr(f"rank div {size}")).drop("rank")


def accepted_results(work: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (shard, sha256, status, tex) of shards without a fault, and ``shard, fault, n`` of the others, which go as a whole.

    A fault is a content that the shard does not hold, one that comes twice, or a state that is none; contents that
    a shard lacks are no fault and stay to be done.
    """
    mine = work.select(F.col("shard").alias("_s"), F.col("sha256").alias("_h"))
    r = results.join(mine, (F.col("shard") == F.col("_s")) & (F.col("sha256") == F.col("_h")), "left")
    each = r.groupBy("shard", "sha256").agg(F.count("*").alias("k"), F.max(F.col("_h").isNull()).alias("unknown"), F.count_if(~F.coalesce(F.col("status").isin(*STATES), F.lit(False))).alias("bad"))
    found = F.array(F.when(F.col("unknown"), "unknown"), F.when(F.col("k") > 1, "repeated"), F.when(F.col("bad") > 0, "bad_status"))
    faults = each.select("shard", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("fault")).groupBy("shard", "fault").agg(F.count("*").alias("n"))
    return results.join(faults.select("shard").distinct(), "shard", "left_anti"), faults


def coverage(rows: DataFrame, text: str, replaced: str) -> DataFrame:
    """Rows, rows with placeholders, rows without any left, and the coverage in percent (100 if there is nothing to do)."""
    has = F.coalesce(F.col(text), F.lit("")).contains("⟦IMG:")
    left = F.coalesce(F.col(replaced), F.lit("")).contains("⟦IMG:")
    g = rows.agg(F.count("*").alias("n_rows"), F.count_if(has).alias("with_images"), F.count_if(has & ~left).alias("fully_replaced"))
    return g.withColumn("coverage", percent_or_full("fully_replaced", "with_images"))


def report(images: DataFrame, questions: DataFrame, materials: DataFrame) -> DataFrame:
    """(measure, value): the counts over images, questions and materials, and the share in percent of materials resolved.

    Each table is read once; its row of counts is turned into lines, so that the tables need not be joined.
    """
    formula, figure = F.col("kind") == "公式图", F.col("kind") == "题目图"
    ok = F.col("ocr_status") == "ok"
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    image = lambda c: text(c).contains("⟦IMG:")
    formula_in = lambda c: text(c).contains("⟦IMG:公式图")
    by_kind = lambda name, kind: {
        f"{name}_total": kind, f"{name}_indexed": kind & F.col("sha256").isNotNull(), f"{name}_read": kind & ok, f"{name}_error": kind & (F.col("ocr_status") == "error"),
    }
    of_images = by_kind("formula", formula) | by_kind("figure", figure) | {
        "formula_pending": formula & F.col("ocr_status").isNull(), "formula_empty": formula & ok & (F.trim(text("ocr_tex")) == ""), "formula_year": formula & ok & text("ocr_tex").contains("年"),
    }
    of_questions = {
        "question_total": F.lit(True), "question_with_formula": text("explanation_with_formula") != "", "question_formula_missing": F.col("formula_missing"), "question_without_explanation": text("explanation") == "",
        "placeholders_total": formula_in("explanation"), "placeholders_left": formula_in("explanation_with_formula"), "stems_with_image": image("stem"), "stems_resolved": F.col("stem_with_text").isNotNull(),
    }
    of_materials = {"materials_with_image": image("body"), "materials_resolved": F.col("body_with_text").isNotNull()}

    def lines(rows: DataFrame, counts: dict[str, Column], share: Column | None = None) -> DataFrame:
        g = rows.agg(*(F.count_if(c).cast("double").alias(n) for n, c in counts.items()))
        g = g if share is None else g.withColumn("materials_percent", share)
        return g.unpivot([], g.columns, "measure", "value")

    share = percent_or_full("materials_resolved", "materials_with_image")
    return lines(images, of_images).union(lines(questions, of_questions)).union(lines(materials, of_materials, share))


def class_samples(images: DataFrame, n: int, seed: str) -> DataFrame:
    """About n recognised texts, taken in turns from the four classes, in a seeded order within each."""
    c = images.withColumn("class", tex_class("ocr_tex")).withColumn("key", F.md5(F.concat(F.lit(seed), "url")))
    c = c.withColumn("round", F.row_number().over(Window.partitionBy("class").orderBy("key", "url"))).where(F.col("round") <= n)
    place = F.array_position(F.array(*map(F.lit, SAMPLE_CLASSES)), F.col("class"))
    return c.orderBy("round", place).limit(n).drop("key")
