"""Answers, labels and validation as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tamarack.functions.text import col, json_object_in, repair_escapes, trim_all

WEEK_MS = 7 * 24 * 3600 * 1000


def normalized_answer(x: Column | str) -> Column:
    """Distinct letters A to Z in order; null if anything but letters, blanks and separators is there."""
    s = F.regexp_replace(F.upper(col(x)), r"[ ,，、;；]", "")
    letters = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))), "")
    return F.when(s.rlike("^[A-Z]*$"), letters)


def grade(kind: Column | str, official: Column | str, answer: Column | str) -> Column:
    """Equal letter sets, not empty, one letter unless the question takes several."""
    a, o = normalized_answer(answer), normalized_answer(official)
    return F.coalesce((a == o) & (a != "") & ((F.length(a) == 1) | (col(kind) == "multi")), F.lit(False))


def answer_type(answer: Column | str, options: Column) -> Column:
    a = trim_all(answer)
    return F.when(F.coalesce(a, F.lit("")).isin("", "（缺）"), "other").when(F.size(options) == 0, "judge").when(a.rlike("^[A-Z]+$"), F.when(F.length(a) > 1, "multi").otherwise("single")).otherwise("other")


def question_warnings(answer: Column | str, options: Column, placeholder: Column) -> Column:
    """Kinds of warnings in order; without an answer or options the later rules are not asked."""
    a = F.coalesce(trim_all(answer), F.lit(""))
    labels = F.transform(options, lambda o: o["label"])
    marked = F.array_join(F.transform(F.filter(options, lambda o: o["is_correct"]), lambda o: o["label"]), "")
    outside = F.exists(F.filter(F.split(a, ""), lambda c: c != ""), lambda c: ~F.array_contains(labels, c))
    rules = F.filter(F.array(F.when(marked != a, "mark_mismatch"), F.when(outside, "answer_not_in_options"), F.when(F.size(options) != 4, "unusual_option_count")), lambda w: w.isNotNull())
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(col(answer), F.lit("")) == "", F.array(F.lit("no_answer_line"))).when(a == "（缺）", F.array(F.lit("answer_missing"))).when(F.size(options) == 0, F.when(placeholder, none).otherwise(F.array(F.lit("no_options")))).otherwise(rules)


def answer_matches(conclusion: Column | str, answer: Column | str) -> Column:
    """Exact, or by the letters A to H: the same multiset if the answer has several, else contained."""
    letters = lambda x: F.array_sort(F.filter(F.split(F.regexp_replace(F.upper(x), "[^A-H]", ""), ""), lambda c: c != ""))
    c, a = letters(col(conclusion)), letters(col(answer))
    by_letters = F.when(F.size(a) > 1, c == a).when(F.size(a) == 1, F.array_contains(c, F.get(a, F.lit(0)))).otherwise(False)
    return (trim_all(conclusion) == trim_all(answer)) | by_letters


def json_long(spec: Column | str, path: str) -> Column:
    """A number in a JSON text; null if the text, the path or the number is not there."""
    return F.get_json_object(col(spec), path).try_cast("bigint")


def answered_in_draft(draft: Column | str, allowed: Column) -> Column:
    """Distinct allowed questions of a draft (JSON array) with an answer that is not blank."""
    items = F.from_json(col(draft), "array<struct<question_id: bigint, answer: string>>")
    ids = F.transform(F.filter(items, lambda i: F.trim(F.coalesce(i["answer"], F.lit(""))) != ""), lambda i: i["question_id"])
    return F.coalesce(F.size(F.array_intersect(F.array_distinct(ids), allowed)), F.lit(0))


LABEL = "struct<subject: string, secondary: string, tertiary: string, detail: string, question_model: string, reasoning_chain: array<string>, fastest_solution: string, pitfalls: array<string>, template: string, key_features: array<string>, boundary: string, confusable: array<struct<`考点`: string, `区分信号`: string>>, typical_ask: array<string>, conclusion: string, doubt: string>"


def parse_label(raw: Column | str) -> Column:
    """A model's output as a label; null if no JSON object is in it.  Escapes that were eaten are put back."""
    label = F.from_json(json_object_in(raw), LABEL)
    strings = [f for f in ("detail", "fastest_solution", "template", "boundary", "conclusion")]
    for f in strings:
        label = label.withField(f, repair_escapes(label[f]))
    return F.when(json_object_in(raw) != "", label)


def tertiary_verdict(secondary: Column | str, tertiary: Column | str, known: Column) -> Column:
    """``ok``, ``novel`` (unknown but under its secondary) or what is wrong."""
    prefix = F.substring_index(col(tertiary), "-", 1)
    return F.when(F.coalesce(col(tertiary), F.lit("")) == "", "empty").when(F.instr(col(tertiary), "-") < 2, "no_prefix").when(prefix != col(secondary), "wrong_prefix").when(known, "ok").otherwise("novel")


def cost_usd(tokens_in: Column | str, tokens_out: Column | str, price_in: Column | str, price_out: Column | str) -> Column:
    """Per thousand tokens; null, never 0, without a price."""
    return (col(tokens_in) * col(price_in) + col(tokens_out) * col(price_out)) / 1000.0


def parse_pricing(text: Column | str) -> Column:
    """``input,output`` in dollars per thousand tokens; null unless both are decimal numbers.

    The words for infinity and hexadecimal numbers are not prices and give null.
    """
    parts = F.transform(F.split(col(text), ",", -1), lambda x: F.when(trim_all(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), trim_all(x)).try_cast("double"))
    whole = (F.size(parts) == 2) & F.get(parts, F.lit(0)).isNotNull() & F.get(parts, F.lit(1)).isNotNull()
    return F.when(whole, F.struct(F.get(parts, F.lit(0)).alias("input"), F.get(parts, F.lit(1)).alias("output")))


def retry_class(status: Column | str) -> Column:
    s = col(status)
    return F.when(s == 429, "rate_limited").when(s.isin(408, 409) | (s >= 500), "retryable").when(s >= 400, "fatal").otherwise("ok")


def backoff_seconds(kind: Column | str, attempt: Column | str, retry_after: Column | None = None) -> Column:
    """As the server says, else by steps of 20 s up to a minute for rate limits and doubling up to 30 s for others."""
    n = col(attempt)
    own = F.when(col(kind) == "rate_limited", F.least(20 * n, F.lit(60))).otherwise(F.least(F.pow(F.lit(2), n), F.lit(30)))
    return F.coalesce(retry_after, own).cast("double") if retry_after is not None else own.cast("double")


def strict_greatest(*columns: Column | str) -> Column:
    """The greatest of the values; null if any of them is, which the built-in function skips."""
    return F.when(F.array_position(F.array(*(col(c).isNull() for c in columns)), F.lit(True)) == 0, F.greatest(*map(col, columns)))
