"""N-gram Jaccard join: signatures that similar sets must share, then filters under several global token orders.

Two sets whose Jaccard similarity reaches a threshold differ in few tokens.  Dealt out by a hash to more parts than that,
they must be equal in some of the parts (the pigeonhole principle).

1. Equal sets are one class, known by a hash of the set.
2. The bound of the differing tokens, and so the number of parts, goes by ranges of sizes that grow by the threshold's
   inverse: partners lie in one range or in neighbours.  Each class is dealt out for its own range and, as a guest, for the
   next one.  What lies in a part is its signature; these are shuffled, and pairs of classes with enough common ones are
   candidate links.  A signature holds several tokens, so one frequent token brings no unlike sets together, however
   many texts there are.  Lists longer than ``LONGEST_LIST``, and those that a batch holds ``HOT`` times, link all their
   classes to one of them instead, so no list makes all pairs.
3. Candidate links fall into clusters.  A true link never leaves its cluster.  Texts of clustered classes are shuffled
   to their cluster, and there a pair must pass the filters of three token orders before its sets are compared: sets
   that are similar enough share many of the tokens that come first in any fixed order of all tokens.
   Large clusters are dealt out as pairs of blocks of bounded size.  Pairs already connected are not compared again.
4. The links found are joined to components.

Empty parts say nothing: some are allowed for in the number of parts.  Sets that have more are dealt out anew by another
hash, up to ``DEALS`` times, the last time with their empty parts: of two sets that end at different deals, the one that
ends first has few empty parts there.  So the result is whole for any threshold; below some 70 percent empty parts are
many and it takes long.

Parts that hold frequent tokens alone are dull: lines that many texts share would bring them together.  Some of these are
allowed for as well and not sent; a set that has more of them sends all.  The frequent tokens are a hint, from counts
within batches, of bounded size (``HINTS``); whatever it holds, the result is whole.

Defined cases: a null or empty text has an empty set and is linked with nothing; fewer words than a shingle make one
shingle of all; repeated rows are linked with each other; rows of one doc_id are one document, so texts under one id
are linked; a row without an id is in the component of its set and makes no links, so a set that only such rows hold has
no component (null); ids are whole numbers, others fail in the cast; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.common import documents, materialize, shuffle_partitions
from tamarack.llm.components import connected_components
from tamarack.llm.shingles import hashes, mix, shingle_set, words

WORDS, PERCENT = 5, 80
LONGEST_LIST, HOT, HINTS = 64, 48, 1 << 18
#: Documents and tokens of a block of a large cluster.
BLOCK_ROWS, BLOCK_TOKENS = 1000, 2_000_000
ORDERS = (1, 2, 3)
#: Turns in which the signatures are shuffled, each for its ranges of sizes: two of one range meet in one turn only.
TURNS = 2
#: Spark's setting that a query's shuffle files go at its end and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Salts of a token's part and of its share in the signature; times that sets with many empty parts are dealt out.
PART, SHARE, DEALS = 4, 5, 4
#: In place of a size: a link between two classes.
LINK = -(1 << 31)
#: Words of 64 bits in the map of hashed ids that keeps texts outside clusters from being shuffled: the bound of what is broadcast.
MAP_WORDS = 1 << 19


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Tokens of a set of n of which a partner must share one, under any order."""
    return n - (percent * n + 99) // 100 + 1


def least_common(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Common prefix tokens that sets of n and m tokens need at least: those that the rest cannot make up for."""
    overlap = (percent * (n + m) + 99 + percent) // (100 + percent)
    rest = np.maximum(n - prefix_length(n, percent), m - prefix_length(m, percent))
    return np.maximum(1, overlap - rest)


def _lengths_fit(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _batch_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return [shingle_set(hashes(words(t, lower=True)), width) for t in batch.column("text").to_pylist()]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _class_of(found: np.ndarray) -> int:
    """The lower half of a set's hash, signed, as the tables hold it."""
    low = xxhash.xxh3_128_intdigest(found.tobytes()) & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _sets_and_hints(docs: DataFrame, width: int) -> DataFrame:
    """Per document its set's size and hash; and tokens that several sets of a batch hold, with their count."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _batch_sets(batch, width)
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            ids, size = batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            low = np.array([d & (1 << 64) - 1 for d in digests], dtype=np.uint64)
            high = np.array([d >> 64 for d in digests], dtype=np.uint64)
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, size, _long(low), _long(high), none(len(sets)), none(len(sets))], names=["doc_id", "n", "s1", "s2", "token", "times"])
            distinct = {d: s for d, s in zip(digests, sets)}.values()
            tokens, times = np.unique(np.concatenate([*distinct, np.empty(0, np.uint64)]), return_counts=True)
            tokens, times = tokens[times > 2], times[times > 2]
            k = len(tokens)
            yield pa.RecordBatch.from_arrays([none(k), none(k), none(k), none(k), _long(tokens), pa.array(times, pa.int64())], names=["doc_id", "n", "s1", "s2", "token", "times"])

    return docs.mapInArrow(scan, "doc_id long, n long, s1 long, s2 long, token long, times long")


@cache
def ranges(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of sizes: their smallest ones, the parts of each, and the empty and the dull parts that these allow for.

    A set has no partner two ranges further.  Sets of a range, and their partners of the range before, differ in fewer
    tokens than there are parts less those allowed for.
    """
    least, parts, empty, dull = [1], [], [], []
    while least[-1] < 1 << 31:
        least.append(least[-1] * 100 // min(percent, 99) + 1)
        differ = 2 * (least[-1] - 1) * (100 - percent) // (100 + percent)
        smallest, none = -(-percent * least[-2] // 100), 0
        for _ in range(20):  # the mean number of empty parts of the smallest guest, and what it varies by
            many = differ + 1 + differ // 12 + differ // 16 + none
            mean = many * math.exp(-smallest / many)
            none = min(differ // 3 + 1, math.ceil(mean + 2 * math.sqrt(mean)))
        parts.append(differ + 1 + differ // 12 + differ // 16 + none)
        empty.append(none)
        dull.append(differ // 12)
    return np.array(least), np.array(parts), np.array(empty), np.array(dull)


def needed(n: np.ndarray, m: np.ndarray, percent: int, sizes: tuple[np.ndarray, ...]) -> np.ndarray:
    """Common signatures that sets of n and m tokens need at least, under the larger one's range."""
    at = np.searchsorted(sizes[0], np.maximum(n, m), "right") - 1
    return sizes[1][at] - sizes[2][at] - sizes[3][at] - (n + m) * (100 - percent) // (100 + percent)


def _signatures(docs: DataFrame, width: int, percent: int, hot, turn: int) -> DataFrame:
    """(sign, class, n) for each part of each class, n negative for guests; of a sign that ``HOT`` classes of the batch
    hold one class, with n 0, and links of the others to it, with n ``LINK``.  Of the ranges of sizes each ``TURNS``-th,
    from ``turn`` on."""
    sizes = ranges(percent)

    def signs(token: np.ndarray, owner: np.ndarray, cold: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of classes whose ranges are given: the signs and their owners."""
        found, left = [], np.arange(len(at))
        for deal in range(DEALS):
            parts = sizes[1][at[left]]
            begin = np.cumsum(parts) - parts
            part = (mix(token, PART + 2 * deal) % parts.astype(np.uint64)[owner]).astype(np.int64) + begin[owner]
            total, held = np.zeros(parts.sum(), np.uint64), np.bincount(part, minlength=parts.sum())
            np.add.at(total, part, mix(token, SHARE))
            of = np.repeat(np.arange(len(parts)), parts)
            place = (at[left][of].astype(np.uint64) << np.uint64(32)) + (np.arange(len(of)) - begin[of]).astype(np.uint64)
            dull = (held > 0) & (np.bincount(part[cold], minlength=parts.sum()) == 0)
            over = np.bincount(of[held == 0], minlength=len(parts)) > sizes[2][at[left]]
            dulled = np.bincount(of[dull], minlength=len(parts)) > sizes[3][at[left]]
            sent = (held > 0) & (~dull | dulled[of]) | (held == 0) & over[of] & (deal == DEALS - 1)
            found.append((mix(total[sent] ^ mix(place[sent], PART + 2 * deal), SHARE), left[of[sent]]))
            left, some = left[over], over[owner]
            token, owner, cold = token[some], (np.cumsum(over) - 1)[owner[some]], cold[some]
            if not len(left):
                break
        return tuple(np.concatenate(x) for x in zip(*found))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(hot.value, dtype=np.uint64)
        for batch in batches:
            classes: dict[int, np.ndarray] = {}
            for s in _batch_sets(batch, width):
                if 100 * len(s) >= percent * (len(s) + 1):  # others have no partner but equal sets
                    classes.setdefault(xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 64) - 1, s)
            if not classes:
                continue
            # by name, as the tables hold it, so that all lists hang on few classes
            name = np.array(list(classes), dtype=np.uint64)
            name = name[np.argsort(name.view(np.int64))]
            sets = [classes[c] for c in name.tolist()]
            size = np.array([len(s) for s in sets])
            at, token, owner = np.searchsorted(sizes[0], size, "right") - 1, np.concatenate(sets), np.repeat(np.arange(len(size)), size)
            cold = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] != token if len(known) else np.ones(len(token), bool)
            for further in (0, 1):
                mine = (at + further) % TURNS == turn
                if not mine.any():
                    continue
                some = mine[owner]
                sign, of = signs(token[some], (np.cumsum(mine) - 1)[owner[some]], cold[some], (at + further)[mine])
                of = np.flatnonzero(mine)[of]
                n = np.where(further, -size, size)[of]
                order = np.argsort(sign)
                sign, of, n = sign[order], of[order], n[order]
                head = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
                times = np.diff(np.r_[head, len(sign)])
                many, first, lead = np.repeat(times >= HOT, times), np.zeros(len(sign), bool), np.repeat(np.minimum.reduceat(of, head), times)
                first[head] = True
                rest = many & (of != lead)
                links = np.unique(np.stack([name[lead[rest]], name[of[rest]]], axis=1), axis=0)
                kept = ~many | first
                n, of = np.r_[np.where(many, 0, n)[kept], np.full(len(links), LINK)], np.where(many, lead, of)
                yield pa.RecordBatch.from_arrays([_long(np.r_[sign[kept], links[:, 0]]), _long(np.r_[name[of[kept]], links[:, 1]]), pa.array(n, pa.int32())], names=["sign", "class", "n"])

    return docs.mapInArrow(scan, "sign long, class long, n int")


def _pairs(signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with their common signs here, and those they need (0: linked through a long list)."""
    sizes = ranges(percent)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(c).to_numpy() for c in ("sign", "class", "n")) for b in batches]
        if not parts:
            return
        sign, name, n = (np.concatenate(x) for x in zip(*parts))
        link = n == LINK
        ones = lambda k: np.ones(k, np.int64)
        out = [np.stack([sign[link], name[link], ones(link.sum()), 0 * ones(link.sum())])]
        sign, name, n = sign[~link], name[~link], n[~link].astype(np.int64)
        # most signs are of one class
        order = np.argsort(sign)
        alike = sign[order][1:] == sign[order][:-1]
        order = order[np.r_[alike, False] | np.r_[False, alike]] if len(order) else order
        sign, name, n = sign[order], name[order], n[order]
        order = np.lexsort((abs(n), name, sign))
        sign, name, n = sign[order], name[order], n[order]
        fresh = np.ones(len(sign), bool)
        fresh[1:] = (sign[1:] != sign[:-1]) | (name[1:] != name[:-1])
        sign, name, n = sign[fresh], name[fresh], n[fresh]
        if len(sign):
            start = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
            length = np.diff(np.r_[start, len(sign)])
            hot, own = np.logical_or.reduceat(n == 0, start), np.maximum.reduceat(n, start) >= 0
            star = ((length > LONGEST_LIST) | hot) & own & (length > 1)
            for s, k in zip(start[star], length[star]):
                out.append(np.stack([np.full(k - 1, name[s]), name[s + 1 : s + k], ones(k - 1), 0 * ones(k - 1)]))
            for k in np.unique(length[~star & own]):
                if k < 2:
                    continue
                i, j = np.triu_indices(k, 1)
                heads = start[~star & own & (length == k)]
                for some in np.array_split(heads, max(1, len(heads) * len(i) // 1_000_000)):
                    a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                    fits = ((n[a] > 0) | (n[b] > 0)) & _lengths_fit(abs(n[a]), abs(n[b]), percent)
                    a, b = a[fits], b[fits]
                    out.append(np.stack([name[a], name[b], ones(len(a)), needed(abs(n[a]), abs(n[b]), percent, sizes)]))
        rows = np.concatenate(out, axis=1)
        if not rows.shape[1]:
            return
        order = np.lexsort((rows[3], rows[1], rows[0]))
        rows = rows[:, order]
        head = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]) | (rows[3, 1:] != rows[3, :-1])])
        count = np.add.reduceat(rows[2], head)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows[0, head], rows[1, head], count, rows[3, head])], names=["a", "b", "common", "needed"])

    return signatures.mapInArrow(join, "a long, b long, common long, needed long")


def _links(signatures: DataFrame, percent: int) -> DataFrame:
    """Candidate links, stored.  The shuffled signatures, the most that lies on disk, go when they have been read."""
    spark = signatures.sparkSession
    pairs = _pairs(signatures.repartition(shuffle_partitions(spark), "sign"), percent)
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return materialize(pairs.groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("needed").alias("needed")).where("common >= needed").select("a", "b"))
    finally:
        spark.conf.set(CLEANUP, was)


class _Cluster:
    """Documents of one cluster (or of two of its blocks): finds the links by filters under all orders."""

    def __init__(self, ids: list[int], blocks: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.percent = ids, percent
        self.block = np.array(blocks)
        self.sets, self.n = sets, np.array([len(s) for s in sets])
        self.part = np.arange(len(ids))

    def links(self) -> Iterator[tuple[int, int]]:
        """A forest of links: each joins two parts that were not connected yet."""
        k, n = len(self.ids), self.n
        length = prefix_length(n, self.percent)
        indexes = []
        for salt in ORDERS:
            heads = [s[np.argsort(mix(s, salt), kind="stable")[:p]] for s, p in zip(self.sets, length)]
            number = np.unique(np.concatenate(heads), return_inverse=True)[1]
            owner = np.repeat(np.arange(k), length)
            order = np.argsort(number, kind="stable")
            starts = np.searchsorted(number[order], np.arange(number.max() + 2))
            indexes.append((owner[order], starts, number, np.cumsum(length) - length))
        across = len(set(self.block.tolist())) > 1
        for i in range(k):
            fits = _lengths_fit(n[i], n, self.percent)
            fits[: i + 1] = False
            fits &= self.part != self.part[i]
            if across:
                fits &= self.block != self.block[i]
            needed = least_common(n[i], n, self.percent)
            for owner, starts, number, begin in indexes:
                if not fits.any():
                    break
                own = number[begin[i] : begin[i] + length[i]]
                common = np.bincount(np.concatenate([owner[starts[t] : starts[t + 1]] for t in own]), minlength=k)
                fits &= common >= needed
            for j in np.flatnonzero(fits):
                if (a := self.part[i]) != (b := self.part[j]):
                    both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                    if 100 * both >= self.percent * (n[i] + n[j] - both):
                        self.part[self.part == b] = a
                        yield self.ids[i], self.ids[j]


def _verified(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within clusters, from rows (cluster, i, j, block, class, doc_id, text) that lie together.

    A row whose text is not of the class that it came for, as its id has several texts, is passed over, and so is a
    class that has been seen.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(ids: list, blocks: list, sets: list) -> pa.RecordBatch:
            links = list(_Cluster(ids, blocks, sets, percent).links()) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        at, held, seen = None, ([], [], []), set()
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")))
            for key, doc, block, text, of in zip(keys, *(batch.column(c).to_pylist() for c in ("doc_id", "block", "text", "class"))):
                if key != at:
                    yield found(*held)
                    at, held, seen = key, ([], [], []), set()
                found_set = shingle_set(hashes(words(text, lower=True)), width)
                if of in seen or _class_of(found_set) != of:
                    continue
                seen.add(of)
                for to, x in zip(held, (doc, block, found_set)):
                    to.append(x)
        yield found(*held)

    return rows.mapInArrow(check, "a long, b long")


def _texts(d: DataFrame, members: DataFrame) -> DataFrame:
    """The members with the texts of their ids.  A bit map of their hashed ids, of at most ``MAP_WORDS`` rows, is
    broadcast, so that hardly any other text is shuffled; the join that follows makes the rows exact, however full the
    map is.  Copies of a row go once for each class of its id."""
    at = lambda c: F.expr(f"pmod(xxhash64({c}), {64 * MAP_WORDS}L)")
    bits = members.select(at("rep").alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, int(at % 64))").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    likely = d.withColumn("at", at("doc_id")).join(F.broadcast(bits), F.expr("at div 64") == F.col("word")).where("shiftright(bits, int(at % 64)) & 1 = 1").select("doc_id", "text")
    likely = likely.withColumn("key", F.xxhash64("text"))
    return likely.join(members, F.col("doc_id") == F.col("rep")).dropDuplicates(["doc_id", "key", "class"])


def _one_document(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that stands for several texts."""
    several = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low != high").select("doc_id")
    # ids as a rule have one text: few rows are left, each once for a class
    rows = sets.where("n > 0").join(several, "doc_id", "left_semi").select("doc_id", "s1").distinct()
    return rows.join(classes.select("s1", "rep"), "s1").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")


def ngram_join(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: the set's size and the smallest id that links reach."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = materialize(_sets_and_hints(d, width))
    sets = scanned.where("token IS NULL").select("doc_id", "n", "s1", "s2")
    hints = scanned.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("k")).where(F.col("k") >= HOT)
    hints = sorted(r["token"] & (1 << 64) - 1 for r in hints.orderBy(F.desc("k"), "token").limit(HINTS).collect())
    hot = spark.sparkContext.broadcast(np.array(hints, np.uint64).tobytes())
    links = [_links(_signatures(d, width, percent, hot, turn), percent) for turn in range(TURNS)]
    clusters = connected_components(reduce(DataFrame.union, links))
    # one document of each class, with its cluster
    classes = materialize(sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    members = materialize(classes.join(clusters, F.col("s1") == F.col("node")).select("rep", F.col("s1").alias("class"), "n", F.col("label").alias("cluster")))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("tokens"))
    sizes = sizes.where("k > 1").select(F.col("cluster").alias("of"), F.expr(f"greatest(ceil(k / {BLOCK_ROWS}), ceil(tokens / {BLOCK_TOKENS}))").alias("blocks"))
    members = materialize(members.join(sizes, F.col("cluster") == F.col("of")).select("rep", "class", "cluster", "blocks", F.expr("pmod(xxhash64(rep), blocks)").alias("block")))
    texts = _texts(d, members).withColumn("o", F.expr("explode(sequence(0L, blocks - 1))")).select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "class", "doc_id", "text")
    groups = texts.repartition(shuffle_partitions(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
    labels = connected_components(_verified(groups, width, percent).union(_one_document(sets, classes)))
    best = classes.join(labels, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("best"))
    found = sets.join(best, ["n", "s1", "s2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best", "doc_id").alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), width=4, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT DISTINCT doc_id, unnest(g) AS g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
