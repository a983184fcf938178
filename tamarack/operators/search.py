"""Search: substrings, trigram indexes as tables, and results with marked hits.

The stored index of ``SearchIndex`` is a folder of segments.  A segment holds the texts that were new or changed when it
was made, in folders by blocks of keys, and their postings: for a gram and a block of ``BLOCK`` keys the sorted keys that
hold it, so no list grows with the table, in folders by the gram's hash.  A segment counts once its mark is there, so a run
that breaks leaves nothing behind, and nothing that is there is changed.

Defined cases: null and empty texts have no grams and match nothing but the empty term; of rows with one key that with the largest text counts; rows
without a key are left out; grams of old texts stay until ``compact`` and only make candidates, which are checked on
the newest text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.functions.text import search_highlight
from tamarack.operators.tables import file_system, names_below

SHORTEST_GRAM = 3
BLOCK, TEXT_FOLDERS, GRAM_FOLDERS = 4096, 64, 64
#: How the name of a segment ends that replaces all before it.
WHOLE = "-whole"


def contains_term(rows: DataFrame, text: str, term: str) -> DataFrame:
    """Short terms with letters as they are, from three characters on with letters of either case."""
    hit = F.instr(F.lower(text), term.lower()) > 0 if len(term) >= SHORTEST_GRAM else F.instr(text, term) > 0
    return rows.where(hit)


def trigram_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Postings (gram, key): distinct lower-case trigrams of each text, cut in one pass over it."""
    low = rows.select(F.col(key), F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    grams = F.array_distinct(F.regexp_extract_all("_low", F.lit("(?s)(?=(...))."), F.lit(1)))
    return low.select(F.explode(grams).alias("gram"), F.col(key))


def trigram_search(index: DataFrame, rows: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """Rows that hold all of the term's grams, verified on the text."""
    low = term.lower()
    if len(low) < SHORTEST_GRAM:
        return contains_term(rows, text, term)
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    hits = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(grams)).select(key)
    return contains_term(rows.join(hits, key, "left_semi"), text, term)


def search(rows: DataFrame, key: str, text: str, query: str, mode: str = "keyword") -> DataFrame:
    """Hits with a fixed score and the marked snippet."""
    found = contains_term(rows, text, query)
    return found.select(key, F.lit(1.0).alias("score"), search_highlight(text, query, mode).alias("highlight"))


class SearchIndex:
    """A trigram index over ``key`` (a whole number) and text, kept in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def segments(self) -> list[str]:
        """Segments that count, oldest first: the newest one of ``compact`` and those after it, else all."""
        names = names_below(self.spark, f"{self.folder}/marks")
        return names[max((i for i, n in enumerate(names) if n.endswith(WHOLE)), default=0) :]

    def _read(self, kind: str) -> DataFrame:
        """All segments of a kind, each row with its segment's number."""
        parts = [f"{self.folder}/{kind}/segment={s}" for s in self.segments()]
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(*parts)

    def _texts(self) -> DataFrame:
        return self._read("texts")

    def _known(self) -> DataFrame | None:
        """``key, hash`` of the newest version of each key; a null hash where it is gone."""
        if not self.segments():
            return None
        number = F.regexp_extract("segment", r"^(\d+)", 1).cast("int")
        return self._texts().groupBy("key").agg(F.max_by("hash", number).alias("hash"))

    def _write(self, rows: DataFrame, like: str = "") -> int:
        """A segment of (key, text, hash); its number follows the last one's."""
        segments = self.segments()
        name = f"{int(segments[-1][:9]) + 1 if segments else 1:09d}-{uuid.uuid4().hex[:8]}{like}"
        folder = f"segment={name}"
        block = F.expr(f"key div {BLOCK}")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        texts = rows.withColumn("part", F.pmod(block, F.lit(TEXT_FOLDERS)).cast("int")).repartitionByRange(n, "part", "key").sortWithinPartitions("part", "key")
        texts.write.partitionBy("part").parquet(f"{self.folder}/texts/{folder}")
        written = self.spark.read.schema("key long, text string, hash string, part int").parquet(f"{self.folder}/texts/{folder}")
        k = written.count()
        if not k:
            return 0
        grams = trigram_index(written.where("text IS NOT NULL"), "key", "text").withColumn("block", block)
        # a gram's keys of one block: at most BLOCK
        lists = grams.groupBy("gram", "block").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        lists = lists.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(GRAM_FOLDERS)).cast("int")).repartitionByRange(n, "part", "gram", "block").sortWithinPartitions("part", "gram", "block")
        lists.write.partitionBy("part").parquet(f"{self.folder}/grams/{folder}")
        fs, mark = file_system(self.spark, f"{self.folder}/marks/{name}")
        fs.create(mark, False).close()
        return k

    def update(self, rows: DataFrame, key: str, text: str) -> int:
        """Make the index that of ``rows``: new and changed texts are added, keys that are gone are marked; gives their number."""
        now = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(F.coalesce(text, F.lit(""))).alias("text"))
        now = now.withColumn("hash", F.sha2("text", 256))
        known = self._known()
        if known is None:
            return self._write(now)
        held = known.where("hash IS NOT NULL")
        fresh = now.join(held, ["key", "hash"], "left_anti").select("key", "text", "hash")
        gone = held.join(now.select("key"), "key", "left_anti").select("key", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("hash"))
        return self._write(fresh.union(gone))

    def compact(self) -> int:
        """One segment with the newest texts in place of all, without keys that are gone; gives its number of texts.

        The old segments do not count any more, but stay until the next call, so that searches that have begun can end;
        a call that breaks leaves the index as it was.  Nothing is done if there is but one segment or no text left.
        """
        counted = self.segments()
        for old in names_below(self.spark, f"{self.folder}/marks"):
            if old not in counted:
                for path in (f"texts/segment={old}", f"grams/segment={old}", f"marks/{old}"):  # the mark last: a broken call is taken up again
                    fs, p = file_system(self.spark, f"{self.folder}/{path}")
                    fs.delete(p, True)
        if len(counted) < 2:
            return 0
        return self._write(self._newest(self._texts()).withColumn("hash", F.sha2("text", 256)), WHOLE)

    def _newest(self, texts: DataFrame) -> DataFrame:
        number = F.regexp_extract("segment", r"^(\d+)", 1).cast("int")
        return texts.groupBy("key").agg(F.max_by("text", number).alias("text")).where("text IS NOT NULL")

    def search(self, term: str) -> DataFrame:
        """``key, text`` of the rows whose newest text holds the term, as ``contains_term`` reads it.

        Only the folders and row groups of the term's grams are read, and of the texts the folders with candidates.
        """
        texts = self._texts().select("key", "text", "segment", "part")
        low = term.lower()
        if len(low) < SHORTEST_GRAM:
            return contains_term(self._newest(texts), "text", term)
        grams = sorted({low[i : i + SHORTEST_GRAM] for i in range(len(low) - SHORTEST_GRAM + 1)})
        wanted = self.spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("gram")).select(F.pmod(F.xxhash64("gram"), F.lit(GRAM_FOLDERS)).alias("part"))
        folders = sorted({r["part"] for r in wanted.collect()})
        lists = self._read("grams").where(F.col("part").isin(folders) & F.col("gram").isin(grams)).groupBy("block", "gram").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
        blocks = lists.groupBy("block").agg(F.collect_list("keys").alias("lists")).where(F.size("lists") == len(grams))
        keys = F.aggregate(F.slice("lists", 2, len(grams)), F.get("lists", 0), lambda a, b: F.array_intersect(a, b))
        found = blocks.select(F.explode(keys).alias("k"), F.pmod("block", F.lit(TEXT_FOLDERS)).cast("int").alias("p"))
        return contains_term(self._newest(texts.join(found, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")), "left_semi")), "text", term)
