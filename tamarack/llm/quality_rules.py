"""Quality rules: surface statistics and divergence from language references, in native column expressions.

A document is compared with references of the languages in the corpus: a histogram of character classes and one of each
language's most frequent words, both counted over all documents.  The Jensen-Shannon distance to the nearest reference
decides, and only for texts that are long enough for their histogram to mean something.

Defined cases: a null or empty text has no words and fails the base rules; a null or rare language counts under the
pooled reference; repeated rows are judged alike; an empty table gives an empty result; other columns are left alone,
and what the operator adds is one struct under a name that the table does not have yet.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tamarack.llm.common import WORD, documents, free_name, text_of

#: Character classes, no two of which share a character; what no class takes counts as "other", symbols among it.
CLASSES = (r"\p{Ll}+", r"\s+", r"\p{Lu}+", r"[.,;:!?'\"()-]+", r"\p{Nd}+")
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Words of a window, a power of two.
WINDOW = 8
#: Guards and limits of the divergence rules (distance: square root of the divergence in bits, 0 to 1).
MIN_CHARS_FOR_CLASSES, MIN_WORDS_FOR_WORDS = 100, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.23, 0.37
TOP_WORDS = 40
#: A language has a reference of its own from this share of the documents, so there are at most 200.
MIN_LANGUAGE_SHARE = 0.005


def _blanks(text: Column) -> Column:
    """The text with blanks for other white space."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(blanks: Column) -> Column:
    """The words of a text whose white space is blanks."""
    return F.array_remove(F.split(blanks, " "), "")


def _classes(d: DataFrame, text: str, blanks: str) -> tuple[DataFrame, list[Column], str]:
    """``d`` with what each class in turn leaves of the text; the numbers of characters by class and of all; what no class takes.

    White space goes first, as matches of the others are then long and few.
    """
    d = d.withColumn(left := free_name(d, "_rest"), F.replace(F.col(blanks), F.lit(" "), F.lit("")))
    counts = {r"\s+": F.length(text) - F.length(left)}
    for p in (p for p in CLASSES if p != r"\s+"):
        d = d.withColumn(rest := free_name(d, "_rest"), F.regexp_replace(left, p, ""))
        counts[p] = F.length(left) - F.length(rest)
        left = rest
    return d, [*(counts[p] for p in CLASSES), F.length(text)], left


def _plain(text: Column) -> Column:
    """Letters and white space, in lower case: of a word its letters."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", ""))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[dict]:
    """One reference for each frequent language and one for the rest, counted over all documents.

    What comes back to the driver is bounded: 201 references of 6 class shares and TOP_WORDS words each.
    """
    d = docs.select(F.col(lang).cast("string").alias("l"), text_of(text).alias("t"))
    least = MIN_LANGUAGE_SHARE * docs.count()
    names = sorted(r["l"] for r in d.groupBy("l").count().where((F.col("count") >= least) & F.col("l").isNotNull()).collect())
    d = d.select(F.when(F.col("l").isin(names), F.col("l")).alias("l") if names else F.lit(None).cast("string").alias("l"), "t")
    columns = [f"c{i}" for i in range(len(CLASSES) + 1)]
    d = d.withColumn("b", _blanks(F.col("t")))
    c, counts, _ = _classes(d, "t", "b")
    c = c.select("l", *(x.alias(n) for n, x in zip(columns, counts)))
    classes = {r["l"]: [r[n] or 0 for n in columns] for r in c.groupBy("l").agg(*(F.sum(n).alias(n) for n in columns)).collect()}
    w = d.select("l", F.explode(_words(F.col("b"))).alias("w")).groupBy("l", "w").count()
    w = w.select("l", _plain(F.col("w")).alias("w"), "count").groupBy("l", "w").agg(F.sum("count").alias("k"))
    order = (F.col("k").desc(), F.col("w"))
    by_salt, by_lang = Window.partitionBy("l", "salt"), Window.partitionBy("l")
    # the best words of each salt and the sum of all, then the best of the few rows left
    w = w.withColumn("salt", F.pmod(F.hash("w"), F.lit(64)))
    w = w.withColumn("sum", F.sum("k").over(by_salt)).withColumn("r", F.row_number().over(by_salt.orderBy(*order))).where(F.col("r") <= TOP_WORDS + 1)
    w = w.withColumn("all", F.sum(F.when(F.col("r") == 1, F.col("sum"))).over(by_lang)).where("w != ''")
    rows = w.withColumn("r", F.row_number().over(by_lang.orderBy(*order))).where(F.col("r") <= TOP_WORDS).select("l", "w", "k", "all").collect()
    out = []
    for name in sorted(classes, key=lambda x: (x is None, x)):
        *some, total = classes[name]
        shares = [x / total if total else 0.0 for x in (*some, total - sum(some))]
        out.append({"classes": shares, "words": {r["w"]: r["k"] / r["all"] for r in rows if r["l"] == name}})
    return out


def _divergence(p: str, q: str) -> str:
    """Terms of the Jensen-Shannon divergence in bits."""
    return f"(CASE WHEN {p} > 0 THEN 0.5D * {p} * log2(2D * {p} / ({p} + {q})) ELSE 0D END + CASE WHEN {q} > 0 THEN 0.5D * {q} * log2(2D * {q} / ({p} + {q})) ELSE 0D END)"


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into`` (renamed if taken): the measures, ``base_failed``, the distances, ``kept``."""
    refs = references(docs, text, lang)
    names = [free_name(docs, n) for n in ("_t", "_b", "_w", "_g", "_c", "_m")]
    t, b, w, g, c, m = names
    d = docs.withColumn(t, text_of(text)).withColumn(b, _blanks(F.col(t))).withColumn(w, _words(F.col(b)))
    # hashes of one word and the next, of two and the next two, of four and the next four; at the end they lack words
    of = w
    for k in (2**n for n in range(WINDOW.bit_length() - 1)):
        d = d.withColumn(pairs := free_name(d, g), F.expr(f"zip_with({of}, slice({of}, {k + 1}, size({of})), (x, y) -> xxhash64(x, y))"))
        of = pairs
    g = free_name(d, g)
    d = d.withColumn(g, F.expr(f"slice({of}, 1, greatest(0, size({w}) - {WINDOW - 1}))"))
    # starts of windows that occur twice, and the words that they cover
    starts = f"""transform(array(sort_array(transform({g}, (x, i) -> struct(x AS h, i AS i)))), s -> sort_array(transform(
        filter(s, (e, k) -> coalesce((k > 0 AND get(s, k - 1).h = e.h) OR get(s, k + 1).h = e.h, false)), e -> e.i)))[0]"""
    covered = f"aggregate(transform(array({starts}), p -> aggregate(transform(p, (x, k) -> coalesce(least({WINDOW}, get(p, k + 1) - x), {WINDOW})), 0, (a, b) -> a + b)), 0, (a, b) -> a + b)"
    repeated = f"CASE WHEN size(array_distinct({g})) < size({g}) THEN {covered} ELSE 0 END"
    common = sorted({x for r in refs for x in r["words"]})
    # all words of a text are made plain in one pass
    d = d.withColumn(c, F.sort_array(F.filter(F.split(_plain(F.col(b)), " "), lambda x: x.isin(common))) if common else F.array().cast("array<string>"))
    lines = f"filter(split({t}, '\\n'), x -> x rlike '{WORD}')".replace("\\", "\\\\").replace("\\\\n", "\\n")
    d, counts, rest = _classes(d, t, b)
    measures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        (counts[-1] - counts[CLASSES.index(r"\s+")]).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(rest, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> CAST(size(l) - size(array_distinct(l)) AS long))[0]").alias("n_dup_lines"),
        F.expr(f"CAST({repeated} AS long)").alias("n_repeat_words"),
        F.transform(F.array(*counts, F.lit(0)), lambda x: x.cast("double")).alias("classes"),
        # distinct common words with their counts
        F.expr(f"""transform(array(filter(transform({c}, (x, i) -> struct(x AS w, i AS i)), e -> e.i = 0 OR e.w != get({c}, e.i - 1))),
            u -> transform(u, (e, k) -> struct(e.w AS w, CAST(coalesce(get(u, k + 1).i, size({c})) - e.i AS double) / size({w}) AS p)))[0]""").alias("words"),
    )
    d = d.withColumn(m, measures)
    n = len(CLASSES)
    known = F.from_json(F.lit(json.dumps([r | {"rest": 1.0 - sum(r["words"].values())} for r in refs])), "array<struct<classes: array<double>, words: map<string, double>, rest: double>>")
    d = d.withColumn(refs_at := free_name(d, "_r"), known)
    share = f"(CASE WHEN i < {n} THEN get({m}.classes, i) ELSE get({m}.classes, {n}) - aggregate(slice({m}.classes, 1, {n}), 0D, (a, b) -> a + b) END / get({m}.classes, {n}))"
    p_of = f"transform(sequence(0, {n}), i -> {share})"
    by_class = f"transform(array({p_of}), ps -> array_min(transform({refs_at}, r -> aggregate(zip_with(ps, r.classes, (p, q) -> {_divergence('p', 'q')}), 0D, (a, b) -> a + b))))[0]"
    q = "coalesce(element_at(r.words, e.w), 0D)"
    per_ref = f"""transform(array(aggregate(filter({m}.words, e -> element_at(r.words, e.w) IS NOT NULL), named_struct('s', 0.5D * (1D - r.rest), 'p', 0D),
        (a, e) -> named_struct('s', a.s - 0.5D * {q} + {_divergence('e.p', q)}, 'p', a.p + e.p))), a -> a.s + {_divergence('greatest(0D, 1D - a.p)', 'r.rest')})[0]"""
    by_word = f"array_min(transform({refs_at}, r -> {per_ref}))"
    distances = F.struct(
        F.expr(f"CASE WHEN get({m}.classes, {n}) >= {MIN_CHARS_FOR_CLASSES} THEN sqrt(greatest(0D, {by_class})) END").alias("class_distance"),
        F.expr(f"CASE WHEN {m}.n_words >= {MIN_WORDS_FOR_WORDS} THEN sqrt(greatest(0D, {by_word})) END").alias("word_distance"),
    )
    d = d.withColumn(dist := free_name(d, "_d"), distances)
    failed = (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))
    near = (F.coalesce(F.col(f"{dist}.class_distance"), F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce(F.col(f"{dist}.word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE)
    result = F.struct(*(F.col(f"{m}.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col(f"{dist}.class_distance").alias("class_distance"), F.col(f"{dist}.word_distance").alias("word_distance"), failed.alias("base_failed"), (~failed & near).alias("kept"))
    # behind a generator, filters on the result don't repeat the expressions below
    return d.select(*docs.columns, F.explode(F.array(result)).alias(free_name(docs, into)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return d.select("doc_id", "quality.*")
