"""Importance resampling towards a target text: weights from bucketed word features, then an exact draw by sorted runs.

Features are runs of one and two words, counted by the buckets of their CRC-32.  A bucket's gain compares its share in the
target (``benchmark``) with that in the documents; a document's weight is the mean gain of its features, read from an
array by bucket number.  A Gumbel number from the document's id is added, so that the highest scores are a draw without
replacement in proportion to the weights.

The draw: each partition sorts its eligible rows to a run, best first, and cuts it into blocks.  Blocks of one range of
scores meet in one task, in the order of their first rows, where a tournament tree merges the runs that are open; a
run has one open block at a time, so memory does not grow with the rows.  Scores are whole numbers between bounds that
the doubles set, so their exact histogram is small, and gives each range its first rank and the score at which the draw
ends.  Rows below that score are not merged at all, and among its own rows the merge stops giving ranks after the last draw.

Defined cases: a null or empty text has no features, weight 0, and is not eligible; ties go to the smaller doc_id, a null
one last, those of repeated rows to any; a null doc_id draws the number of an empty id; an empty table gives an empty
result, empty target texts a target without features; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.common import CRC_TABLE_SQL, crc32_sql, documents, materialize, shuffle_partitions

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Rows of a run that travel together, five numbers each.
BLOCK_ROWS = 128

#: Bytes of words as they are, A-Z in lower case; all others become blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def features(w: list[bytes]) -> list[int]:
    """CRC-32 of each word and of each two words with a blank between."""
    one = list(map(crc32, w))
    # the second word's bytes go on from the first one's sum
    return one + list(map(crc32, w[1:], map(crc32, repeat(b" "), one)))


def count_buckets(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; the driver gets one number for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if f := features(words(text)):
                    total += np.bincount(np.array(f, dtype=np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    found = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's smoothed share in the target over that in the source, floored."""
    of_source, of_target, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(of_source + k)) / (float(s + 1) * float(of_target + k)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gumbel(doc_id: object, seed: int = SEED) -> int:
    """1000 times a Gumbel number that follows from the id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, eligible`` for each document, from an array of gains by bucket."""
    array = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = array.value
        for batch in batches:
            n, weight, total, eligible = [], [], [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(t)
                f = features(w)
                n.append(len(f))
                weight.append(int(gain[np.array(f, dtype=np.int64) % len(gain)].sum()) // len(f) if f else 0)
                total.append(weight[-1] + gumbel(i, seed))
                eligible.append(len(w) >= least_words)
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, weight, total)), pa.array(eligible)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "weight", "score", "eligible"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(score, "doc_id long, n_features long, weight long, score long, eligible boolean")


class Tournament:
    """Open blocks of sorted runs; the winner of all is at the root, and its successor plays its path upwards again.

    A leaf holds the key of the first row of its run that is left, or none; an inner node the leaf that wins below it.
    """

    def __init__(self) -> None:
        self.size, self.keys, self.winner, self.rows, self.free = 1, [None], [0, 0], [None], [0]

    def _better(self, a: int, b: int) -> int:
        return b if self.keys[a] is None or (self.keys[b] is not None and self.keys[b] < self.keys[a]) else a

    def _play(self, leaf: int) -> None:
        at = (leaf + self.size) >> 1
        while at:
            left, right = self.winner[2 * at], self.winner[2 * at + 1]
            self.winner[at] = self._better(left, right)
            at >>= 1

    def _advance(self, leaf: int) -> None:
        """The next row of a leaf's run, or a free leaf."""
        row = next(self.rows[leaf], None)
        if row is None:
            self.keys[leaf], self.rows[leaf] = None, None
            self.free.append(leaf)
        else:
            self.keys[leaf] = row
        self._play(leaf)

    def open(self, block: Iterator[tuple]) -> None:
        if not self.free:
            self.keys += [None] * self.size
            self.rows += [None] * self.size
            self.free = list(range(self.size, 2 * self.size))
            self.size *= 2
            self.winner = [0] * self.size + list(range(self.size))
            for at in range(self.size - 1, 0, -1):
                self.winner[at] = self._better(self.winner[2 * at], self.winner[2 * at + 1])
        leaf = self.free.pop()
        self.rows[leaf] = block
        self._advance(leaf)

    def first(self) -> tuple | None:
        return self.keys[self.winner[1]] if self.size > 1 else self.keys[0]

    def take(self) -> tuple:
        leaf = self.winner[1] if self.size > 1 else 0
        row = self.keys[leaf]
        self._advance(leaf)
        return row


def ranges(histogram: list[tuple[int, int]], draws: int, parts: int) -> list[tuple[int, int]]:
    """``(lowest score, first rank)`` of at most ``parts`` ranges of about as many rows each, best scores first, down to the score of the last draw."""
    out, seen, begun = [], 0, 0
    for score, n in sorted(histogram, reverse=True):
        if seen >= draws:
            break
        if not out or seen - begun >= draws / parts:
            out.append([score, seen])
            begun = seen
        out[-1][0] = score
        seen += n
    return [tuple(x) for x in out]


def draw(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: the best ``percent`` of the eligible rows with their ranks, others without."""
    spark = scored.sparkSession
    # whole scores between bounds: at most some 150,000 rows whatever the input
    histogram = [(r["score"], r["n"]) for r in scored.where("eligible").groupBy("score").agg(F.count("*").alias("n")).collect()]
    draws = percent * sum(n for _, n in histogram) // 100
    names = ["doc_id", "n_features", "weight", "score"]
    if not draws:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    parts = ranges(histogram, draws, shuffle_partitions(spark))
    lowest, begin = np.array([-s for s, _ in parts]), [r for _, r in parts]
    last = parts[-1][0]
    in_run = F.col("eligible") & (F.col("score") >= last)
    runs = scored.where(in_run).select(*names).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"))
    kept = "range int, score long, first long, rows binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a run: a range's rows, at most ``BLOCK_ROWS``, as they are compared: score, whether the id is null, id, and what else is returned."""
        for batch in batches:
            score, n, w = (batch.column(c).to_numpy() for c in ("score", "n_features", "weight"))
            ids = batch.column("doc_id")
            rows = np.column_stack([-score, pc.is_null(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(), n, w]).astype(np.int64)
            of = np.searchsorted(lowest, -score)
            blocks, at = [], 0
            for end in [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(rows)]:
                blocks += [(int(of[at]), rows[k : min(k + BLOCK_ROWS, end)]) for k in range(at, end, BLOCK_ROWS)]
                at = end
            firsts = pa.array([None if x[0, 1] else int(x[0, 2]) for _, x in blocks], pa.int64())
            columns = [pa.array([r for r, _ in blocks], pa.int32()), pa.array([-int(x[0, 0]) for _, x in blocks], pa.int64()), firsts, pa.array([x.tobytes() for _, x in blocks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "score", "first", "rows"])

    out = "doc_id long, n_features long, weight long, score long, rank long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each range in their order, with ranks up to the last draw."""
        tree, at, rank, rows = Tournament(), None, 0, []

        def taken(until: tuple | None) -> Iterator[pa.RecordBatch]:
            nonlocal rank
            while (key := tree.first()) is not None and (until is None or key < until):
                score, missing, i, f, w = tree.take()
                rank += 1
                rows.append((None if missing else i, f, w, -score, rank if rank <= draws else None))
                if len(rows) >= 10_000:
                    yield batch_of()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([],) * 5)], names=[*names, "rank"])
            rows.clear()
            return made

        for batch in batches:
            for of, score, first, block in zip(*(batch.column(c).to_pylist() for c in ("range", "score", "first", "rows"))):
                if of != at:
                    yield from taken(None)
                    at, rank = of, begin[of]
                # rows before this block's first one come from blocks that are open
                yield from taken((-score, int(first is None), first or 0))
                tree.open(tuple(r.tolist()) for r in np.frombuffer(block, np.int64).reshape(-1, 5))
        yield from taken(None)
        yield batch_of()

    n = shuffle_partitions(spark)
    merged = runs.mapInArrow(cut, kept).repartition(n, "range").sortWithinPartitions("range", F.desc("score"), F.asc_nulls_last("first")).mapInArrow(merge, out)
    return merged.union(scored.where(~in_run).select(*names, F.lit(None).cast("long").alias("rank")))


def importance(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each document; ``rank`` is null for those not drawn."""
    source = count_buckets(docs.select(F.col(text).alias("text")), buckets)
    gain = gains(source, count_buckets(target.select(F.col(target_text).alias("text")), buckets))
    return draw(materialize(weighted(docs, gain, doc_id, text, seed, least_words)), percent)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH tab AS ({CRC_TABLE_SQL}),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT k, f, count(*) AS n FROM (SELECT k, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM d) GROUP BY k, f),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM b) GROUP BY f),
names AS (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), tab),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN names USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bf JOIN names USING (f) GROUP BY bucket),
total AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s, coalesce((SELECT sum(n) FROM t), 0) AS t),
g AS (SELECT r.bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(total.s + 10000 AS DOUBLE)) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST(total.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT range AS bucket FROM range(10000)) r LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), total),
w AS (SELECT k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS gain FROM df JOIN names USING (f) JOIN g USING (bucket) GROUP BY k),
x AS (SELECT d.k, d.doc_id, len(d.w) >= {LEAST_WORDS} AS eligible, coalesce(w.n, 0) AS n_features, CASE WHEN w.n IS NULL THEN 0 ELSE w.gain // w.n - CASE WHEN w.gain < 0 AND w.gain % w.n != 0 THEN 1 ELSE 0 END END AS weight,
  CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON w.k = d.k),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r FROM y WHERE eligible)
SELECT y.doc_id, y.n_features, y.weight, y.score, CASE WHEN r.r <= (SELECT {PERCENT} * count(*) // 100 FROM r) THEN r.r END AS rank FROM y LEFT JOIN r ON r.k = y.k
"""
