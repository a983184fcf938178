"""Mixing sources to target weights by a low-discrepancy source schedule.

Each source's documents are shuffled by a hash and laid on a line of words, which is cut into blocks of equal length.
Slot t of the schedule takes the golden-ratio point ``frac((t + 1) * phi)`` through the sources' cumulative shares; the
r-th slot of a source plays the r-th block of its line, beginning anew when the line is used up, until the source's
target is met to the word.  The schedule says when a document is played (its first slots by round), and the mix itself is
sorted by these slots, so that every stretch of it holds the sources near their shares.  Ranks within a source are counted in chunks of the schedule and line positions in salts of
the hash, each with a running sum over the few chunk or salt totals, so no source is gathered in one task.  What is broadcast are
tables of a row for each source, which the driver holds anyway, and what Spark itself finds small.

Defined cases: a null text has size 0; a null source is the last source; a document of size 0 is never taken; repeated
rows are documents of their own; an empty table gives an empty result; other columns are left alone.  The sources and
their sizes go to the driver: one small row for each source to which a weight is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tamarack.llm.common import WORD, documents, free_name, materialize, text_of

WEIGHTS, TOTAL_SHARE, MOST_TIMES = (5, 2, 1), 1.5, 2
BLOCK_WORDS, CHUNK = 2048, 1 << 16
GOLDEN = (5**0.5 - 1) / 2


def targets(sizes: list[int], weights: list[float], total: float, most: list[float]) -> list[float]:
    """Shares of ``total`` by weight, none above its limit; what is cut off is shared anew among the others."""
    left, weight = float(total), float(sum(weights))
    out = [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (most[i] / weights[i], i)):
        level = left / weight
        if most[i] / weights[i] >= level:
            break
        out[i] = float(most[i])
        left, weight = left - most[i], weight - weights[i]
    else:
        return out
    return [x if most[i] / weights[i] < level else weights[i] * level for i, x in enumerate(out)]


def plan(totals: list[tuple[str | None, int]], weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, times: int = MOST_TIMES, block: int = BLOCK_WORDS) -> pd.DataFrame:
    """One row for each source: its number, size, target, words to take, blocks of its line and slots."""
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), [times * n for n in sizes])
    p = pd.DataFrame({"number": range(len(sizes)), "source": [s for s, _ in totals], "source_size": sizes, "target": goal})
    p["quota"] = np.floor(p["target"] + 0.5).astype("int64")
    p["blocks"] = -(-p["source_size"] // block)
    full = p["quota"] // p["source_size"].clip(lower=1)
    p["slots"] = full * p["blocks"] + -(-(p["quota"] - full * p["source_size"]) // block)
    return p


def schedule(spark: SparkSession, p: pd.DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The slots in playing order: ``slot``, source ``number``, ``rank`` in the source, ``round``, ``block`` and its ``words``.

    A source whose points fall short of its slots by the discrepancy of the sequence gets the rest at the end.
    """
    slots = p["slots"].to_numpy()
    total, bounds = int(slots.sum()), np.cumsum(slots) / max(1, slots.sum())

    def points(chunk: int) -> np.ndarray:
        t = np.arange(chunk * CHUNK, min(total, (chunk + 1) * CHUNK), dtype=np.float64)
        return np.minimum(np.searchsorted(bounds, np.modf((t + 1) * GOLDEN)[0], side="right"), len(bounds) - 1)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f["id"]:
                k, n = np.unique(points(c), return_counts=True)
                yield pd.DataFrame({"chunk": c, "number": k, "n": n})

    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f["id"]:
                s = pd.Series(points(c))
                yield pd.DataFrame({"chunk": c, "slot": c * CHUNK + np.arange(len(s)), "number": s, "place": s.groupby(s).cumcount()})

    chunks = spark.range(-(-total // CHUNK))
    counts = chunks.mapInPandas(counted, "chunk long, number long, n long")
    so_far = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "number", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"))
    sources = spark.createDataFrame(p[["number", "source_size", "quota", "blocks", "slots"]], "number long, source_size long, quota long, blocks long, slots long")
    drawn = chunks.mapInPandas(ranked, "chunk long, slot long, number long, place long").join(base, ["chunk", "number"])
    drawn = drawn.select("slot", "number", (F.col("base") + F.col("place")).alias("rank")).join(F.broadcast(sources), "number").where("rank < slots")
    reached = counts.groupBy("number").agg(F.sum("n").alias("n"))
    missing = sources.join(F.broadcast(reached), "number", "left").where("slots > coalesce(n, 0)")
    missing = missing.select((F.lit(total) + F.col("number")).alias("slot"), "number", F.expr("explode(sequence(coalesce(n, 0L), slots - 1))").alias("rank"), "source_size", "quota", "blocks", "slots")
    s = drawn.select("slot", "number", "rank", "source_size", "quota", "blocks").unionByName(missing.drop("slots"))
    s = s.withColumn("block", F.expr("rank % blocks"))
    start = f"(rank div blocks) * source_size + block * {block}"
    return s.select("slot", "number", "rank", F.expr("rank div blocks").alias("round"), "block", F.expr(f"least({block}L, source_size - block * {block}, quota - ({start}))").alias("words"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, times: int = MOST_TIMES, block: int = BLOCK_WORDS, keep: tuple = ()) -> DataFrame:
    """One row for each document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``slots`` and the columns ``keep``.

    ``slots`` are the places in the schedule where the document begins to be played, one for each round, and
    ``first_slot`` is the first of them; null if it is not taken.

    All of ``keep`` should be small: sizes are counted once and written to the shared checkpoint folder.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"), *keep)
    sized = materialize(sized)
    totals = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    p = plan(totals, weights, share, times, block)
    known = spark.createDataFrame(p.astype({"source": object}).where(p.notna(), None), "number long, source string, source_size long, target double, quota long, blocks long, slots long")
    d = sized.join(known.withColumnRenamed("source", "known"), F.col("source").eqNullSafe(F.col("known"))).drop("known", "slots", "blocks")
    # positions on the source's line: salts in the order of the hash, then documents within a salt
    d = d.withColumn("key", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("salt", F.substring("key", 1, 3))
    salts = d.groupBy("number", "salt").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("number").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = salts.select("number", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("number", "salt").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(salts, ["number", "salt"]).withColumn("at", F.col("at") + F.col("base"))
    # a document's part of each block that it lies in, met with the slots that play the block
    parts = d.where("size > 0").select("row", "number", "at", "size", F.expr(f"explode(sequence(at div {block}, (at + size - 1) div {block}))").alias("block"))
    parts = parts.select("row", "number", "block", F.expr(f"greatest(at - block * {block}, 0L)").alias("a"), F.expr(f"least(at + size - block * {block}, {block}L)").alias("b"))
    plays = schedule(spark, p, block).select("number", "round", "block", "words", "slot")
    # both sides grow with the input, so neither is broadcast; what is are a row for each source, and one for each source and salt
    played = parts.join(plays.hint("merge"), ["number", "block"]).where("words > a")
    taken = played.groupBy("row").agg(F.sum(F.expr("least(b, words) - a")).alias("taken"), F.collect_list(F.struct("round", "slot")).alias("plays"))
    # the first slot of each round; there are at most ``times`` rounds
    slots = "transform(array_sort(array_distinct(plays.round)), r -> array_min(transform(filter(plays, x -> x.round = r), x -> x.slot)))"
    taken = taken.select("row", "taken", F.expr(slots).alias("slots"))
    found = d.join(taken.hint("merge"), "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slots", *keep)
    return found.withColumn("first_slot", F.expr("get(slots, 0)"))


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """The mix itself, sorted by slot, with the columns of ``docs``: whole copies, and for the one document at which a source's target is met, its first words.

    Rows are met with their decision by ``doc_id`` and a hash of the text; equal rows get equal shares of what they have together.
    """
    h, got, n, k, own, key, at = (free_name(docs, x) for x in ("_h", "_taken", "_size", "_k", "_own", "_key", "_slots"))
    keyed = docs.withColumn(h, F.xxhash64(text_of(text), F.col(source).cast("string")))
    m = mix(keyed, text, source, doc_id, keep=(h,), **how)
    m = m.groupBy("doc_id", h).agg(F.max("size").alias(n), F.sum("taken").alias("all"), F.count("*").alias("rows"), F.min("slots").alias(at))
    m = m.select(F.col("doc_id").alias(own), F.col(h).alias(key), F.col(n), F.col(at), (F.col("all") / F.col("rows")).cast("long").alias(got)).where(F.col(got) > 0)
    d = keyed.join(m, keyed[doc_id].eqNullSafe(F.col(own)) & (keyed[h] == F.col(key)))
    d = d.withColumn(k, F.explode(F.expr(f"sequence(1L, ({got} + {n} - 1) div {n})")))
    words = F.expr(f"{got} - ({k} - 1) * {n}")
    part = F.when(words >= F.col(n), F.col(text)).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " "))
    out = d.withColumn(text, part)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast("long"))
    place = F.expr(f"coalesce(get({at}, CAST({k} AS int) - 1), get({at}, 0))")
    return out.orderBy(place, F.col(doc_id), F.col(k)).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("row", "slots")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, CAST(2 * n AS DOUBLE) / w AS ratio, 1.5::DOUBLE * sum(n) OVER () AS total,
    coalesce(sum(2 * n) OVER o, 0) AS caps, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest
    FROM w WINDOW o AS (ORDER BY CAST(2 * n AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - caps) / CAST(rest AS DOUBLE) AS level FROM r),
f AS (SELECT first(level ORDER BY ratio, i) AS level FROM l WHERE ratio >= level),
t AS (SELECT source, n, i, CASE WHEN ratio >= (SELECT level FROM f) THEN w * (SELECT level FROM f) ELSE CAST(2 * n AS DOUBLE) END AS target FROM l),
q AS (SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(t.n AS BIGINT) AS source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
    t.i AS number
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT DISTINCT number, source_size AS n, quota, CAST(ceil(source_size / 2048) AS BIGINT) AS blocks FROM q),
z AS (SELECT *, quota // greatest(n, 1) AS whole FROM c),
y AS (SELECT *, whole * blocks + CAST(ceil((quota - whole * n) / 2048) AS BIGINT) AS slots FROM z),
u AS (SELECT *, sum(slots) OVER (ORDER BY number) / CAST(sum(slots) OVER () AS DOUBLE) AS bound, sum(slots) OVER () AS total, max(number) OVER () AS most FROM y),
g AS (SELECT t, least((SELECT count(*) FROM u WHERE u.bound <= (t + 1) * 0.6180339887498949::DOUBLE - floor((t + 1) * 0.6180339887498949::DOUBLE)), (SELECT max(most) FROM u)) AS number
    FROM (SELECT unnest(range(0, CAST((SELECT coalesce(max(total), 0) FROM u) AS BIGINT))) AS t)),
h AS (SELECT t AS slot, number, row_number() OVER (PARTITION BY number ORDER BY t) - 1 AS rank FROM g),
m AS (SELECT u.total + u.number AS slot, u.number, unnest(range(CAST((SELECT count(*) FROM h WHERE h.number = u.number) AS BIGINT), CAST(u.slots AS BIGINT))) AS rank FROM u),
p AS (SELECT a.slot, a.number, a.rank % u.blocks AS block, least(2048, u.n - (a.rank % u.blocks) * 2048, u.quota - (a.rank // u.blocks) * u.n - (a.rank % u.blocks) * 2048) AS words
    FROM (SELECT * FROM h UNION ALL SELECT * FROM m) a JOIN u ON u.number = a.number WHERE a.rank < u.slots),
e AS (SELECT doc_id, number, pos, size, unnest(range(CAST(pos // 2048 AS BIGINT), CAST((pos + size - 1) // 2048 + 1 AS BIGINT))) AS block FROM q WHERE size > 0),
f1 AS (SELECT e.doc_id, min(p.slot) AS first_slot FROM e JOIN p ON p.number = e.number AND p.block = e.block WHERE p.words > greatest(e.pos - e.block * 2048, 0) GROUP BY e.doc_id)
SELECT q.doc_id, size, source_size, target,
    CAST(size * (quota // greatest(source_size, 1)) + greatest(0, least(size, quota - (quota // greatest(source_size, 1)) * source_size - pos)) AS BIGINT) AS taken,
    CAST(f1.first_slot AS BIGINT) AS first_slot
FROM q LEFT JOIN f1 ON f1.doc_id = q.doc_id
"""
