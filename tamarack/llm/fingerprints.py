"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

A line is a paragraph; a blank line, or a paragraph whose digest says so, ends a section, and within a paragraph the
words on both sides of a space say whether a piece ends there.  All cuts depend on the content near them, so that an
edit changes the digests on its path to the root and no others.  Equal roots mean equal texts.  Of two trees the
branches that differ are followed down, section by section, then paragraph by paragraph, then piece by piece, each level
compared in order: what is left are the places of the edits, moved, repeated and deleted paragraphs among them.  The
likeness is the share of text under common leaves (twice the common over the sum).

The fingerprint as a string is the root and, behind a bar, the branches: sections parted by ".", in them paragraphs
by ";", in them pieces by ",", each the first bytes of its digest and its length.  It says all that the likeness asks for
(``likeness_of``), in about a third of the text's length.

Neighbours by ``doc_id`` are met without sorting all rows: rows are dealt by ranges of ids with about as many rows each,
and the first document of each range is sent to the range before it as well.  There are at most ``MOST_RANGES`` ranges:
their bounds and first ids (two numbers each) come to the driver, and the first ids are broadcast.

Defined cases: ids are whole numbers of any size (others raise, unless they can be cast); a null text is empty; two empty
texts have likeness 1, an empty and another 0; rows of one id follow each other in the order of their texts, in one task
that holds two of them at a time; rows without an id come first; the only row's next document is itself; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.common import documents, shuffle_partitions, slices, text_of

RANGES_PER_PARTITION, MOST_RANGES = 16, 20_000
#: One space in so many ends a piece, one paragraph in so many ends a section.
PIECE_SPACES, SECTION_PARAGRAPHS = 6, 8
#: A piece has so many spaces at most; a text with no more than that has a piece for each word.
MOST_SPACES = 40
#: Bytes of a piece's digest that the fingerprint holds and likenesses compare, and the letters that they take.
PIECE_BYTES, PIECE_LETTERS = 6, 8


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """``root`` and the nodes of each level, from sections over paragraphs to pieces, as (digest, start, end) in bytes.

    ``parts[k]`` says where the children of each node of level k begin in level k + 1.
    """

    __slots__ = ("root", "levels", "parts", "size")

    def __init__(self, text: str):
        raw = text.encode("utf-8", "surrogatepass")
        self.size = len(raw)
        b = np.frombuffer(raw, dtype=np.uint8)
        space = np.flatnonzero(b[2:-1] == 32) + 2 if len(b) > 3 else np.empty(0, np.int64)
        near = b[space - 1].astype(np.int64) * 29 + b[space - 2] * 13 + b[space + 1] * 7 if len(space) else space
        ends = np.ones(len(space), bool) if len(space) <= MOST_SPACES else near % PIECE_SPACES == 0
        if np.diff(np.flatnonzero(np.r_[True, ends, True])).max() > MOST_SPACES:
            since = np.arange(len(space)) - np.maximum.accumulate(np.where(ends, np.arange(len(space)), 0))
            ends |= since % MOST_SPACES == MOST_SPACES - 1
        cuts = np.union1d(space[ends] + 1, np.flatnonzero(b == 10) + 1).tolist()
        sections, paragraphs, leaves = [], [], []
        section_parts, paragraph_parts = [0], [0]

        def end_section() -> None:
            if (first := section_parts[-1]) < len(paragraphs):
                sections.append((_digest(b"s" + b"".join(d for d, _, _ in paragraphs[first:])), paragraphs[first][1], paragraphs[-1][2]))
                section_parts.append(len(paragraphs))

        start = 0
        for end in [*cuts, len(raw)]:
            if end > start:
                leaves.append((_digest(raw[start:end]), start, end))
            if (end > start and raw[end - 1] == 10 or end == len(raw)) and (first := paragraph_parts[-1]) < len(leaves):
                node = _digest(b"p" + b"".join(d for d, _, _ in leaves[first:]))
                paragraphs.append((node, leaves[first][1], end))
                paragraph_parts.append(len(leaves))
                if raw[leaves[first][1] : end] == b"\n" or node[0] % SECTION_PARAGRAPHS == 0:
                    end_section()
            start = end
        end_section()
        self.levels, self.parts = (sections, paragraphs, leaves), (section_parts, paragraph_parts)
        self.root = _digest(b"r" + b"".join(d for d, _, _ in sections))

    def fingerprint(self) -> str:
        """Root and branches; equal for equal texts only."""
        letters = base64.urlsafe_b64encode(b"".join(d[:PIECE_BYTES] for d, _, _ in self.levels[-1])).decode()
        pieces = [f"{letters[k * PIECE_LETTERS : (k + 1) * PIECE_LETTERS]}{b - a}" for k, (_, a, b) in enumerate(self.levels[-1])]
        below = [",".join(pieces[i:j]) for i, j in zip(self.parts[1], self.parts[1][1:])]
        sections = [";".join(below[i:j]) for i, j in zip(self.parts[0], self.parts[0][1:])]
        return f"{self.root.hex()}|{'.'.join(sections)}"

    def likeness(self, other: Tree) -> float:
        if self.root == other.root:
            return 1.0
        here, there = ([(d[:PIECE_BYTES], b - a) for d, a, b in t.levels[-1]] for t in (self, other))
        return _share(here, there, self.size + other.size)

    def edits(self, other: Tree) -> list[tuple[int, int, int, int]]:
        """Where the texts differ, in bytes: (start, end) here and (start, end) there, in order; none if the roots agree."""
        if self.root == other.root:
            return []
        spans = [(0, len(self.levels[0]), 0, len(other.levels[0]))]
        for level, (a, b) in enumerate(zip(self.levels, other.levels)):
            x, y = [d for d, _, _ in a], [d for d, _, _ in b]
            spans = [d for s in spans for d in _differing(x, y, *s)]
            if level < len(self.parts):
                mine, theirs = self.parts[level], other.parts[level]
                spans = [(mine[i], mine[j], theirs[k], theirs[m]) for i, j, k, m in spans]
        place = lambda nodes, size, i: nodes[i][1] if i < len(nodes) else size
        a, b = self.levels[-1], other.levels[-1]
        return [(place(a, self.size, i), place(a, self.size, j), place(b, other.size, k), place(b, other.size, m)) for i, j, k, m in spans]


def _share(here: list[tuple], there: list[tuple], size: int) -> float:
    """Twice the length of the pieces (name, length) common to both lists over the length of all."""
    left, common = Counter(), 0
    for d, n in here:
        left[d] += n
    for d, n in there:
        if some := left.get(d):
            common += min(some, n)
            left[d] = max(0, some - n)
    return 2 * common / size


def likeness_of(a: str, b: str) -> float:
    """The likeness of two texts by their fingerprints as strings, the same as by their trees."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    lists = [[(p[:PIECE_LETTERS], int(p[PIECE_LETTERS:])) for p in x.partition("|")[2].replace(".", ",").replace(";", ",").split(",") if p] for x in (a, b)]
    return _share(*lists, sum(n for pieces in lists for _, n in pieces))


def _differing(x: list[bytes], y: list[bytes], a: int, b: int, c: int, d: int) -> list[tuple[int, int, int, int]]:
    """The stretches of x[a:b] and y[c:d] that differ: between common ends and the nodes that occur once in both, in order."""
    while a < b and c < d and x[a] == y[c]:
        a, c = a + 1, c + 1
    while a < b and c < d and x[b - 1] == y[d - 1]:
        b, d = b - 1, d - 1
    if a == b and c == d:
        return []
    if a == b or c == d:
        return [(a, b, c, d)]
    here, there = Counter(x[a:b]), Counter(y[c:d])
    at = {v: k for k, v in enumerate(y[c:d], c) if there[v] == 1}
    pairs = [(i, at[v]) for i, v in enumerate(x[a:b], a) if here[v] == 1 and v in at]
    # the longest series of pairs that ascends on both sides
    tails: list[int] = []
    last: list[int] = []
    before = []
    for n, (_, k) in enumerate(pairs):
        p = bisect_left(tails, k)
        before.append(last[p - 1] if p else -1)
        tails[p : p + 1], last[p : p + 1] = [k], [n]
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    if not chain:
        return [(a, b, c, d)]
    out = []
    for i, k in [*reversed(chain), (b, d)]:
        out += _differing(x, y, a, i, c, k)
        a, c = min(i + 1, b), min(k + 1, d)
    return out


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (range, head, doc_id, text) lying together by range, each range followed by the head of the next one."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    ranges = min(n * RANGES_PER_PARTITION, MOST_RANGES)
    parts = [k / ranges for k in range(1, ranges)]
    bounds = d.agg(F.percentile_approx("doc_id", parts, max(10_000, 10 * ranges)).alias("b")).first()["b"] if parts else []
    bounds = np.unique(np.array(bounds or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(i: pd.Series) -> pd.Series:
        here = i.notna()
        out = np.full(len(i), -1, dtype=np.int32)
        out[here] = np.searchsorted(bounds, i[here].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    ids = d.select("doc_id").withColumn("range", range_of("doc_id"))
    # at most MOST_RANGES rows and one for rows without an id
    firsts = sorted((r["range"], r["first"]) for r in ids.groupBy("range").agg(F.min("doc_id").alias("first")).collect())
    to = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(to, "first long, range int"))
    heads = d.join(heads, F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("range", "doc_id").agg(F.min("text").alias("text"))
    rows = d.withColumn("range", range_of("doc_id")).select("range", F.lit(False).alias("head"), "doc_id", "text")
    rows = rows.union(heads.select("range", F.lit(True).alias("head"), "doc_id", "text"))
    return rows.repartition(n, "range").sortWithinPartitions("range", "head", "doc_id", "text")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit: the second half replaced by the beginning of the next document.

    ``near_*`` are likenesses of the fingerprints.  ``first_change`` is the code point at which the first of the edit's
    ``n_edits`` places begins, as the tree tells it; -1 if there is none.
    """
    kinds = {
        "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(),
        "near_next": pa.float64(), "n_sections": pa.int64(), "n_paragraphs": pa.int64(), "n_leaves": pa.int64(), "n_edits": pa.int64(), "first_change": pa.int64(),
    }

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # range, head, id, text, tree
        for batch in slices(batches):
            out = []
            for at, head, i, t in zip(*(batch.column(c).to_pylist() for c in ("range", "head", "doc_id", "text"))):
                row = (at, head, i, t, Tree(t))
                if before and before[0] == at:
                    _, _, own_id, own, tree = before
                    n = len(own)
                    edited = own[: n - n // 2] + t[: n // 2]
                    new = Tree(edited)
                    places = tree.edits(new)
                    first = len(own.encode("utf-8", "surrogatepass")[: places[0][0]].decode("utf-8", "surrogatepass")) if places else -1
                    likenesses = tree.likeness(new), tree.likeness(row[4])
                    out.append((own_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), tree.fingerprint(), new.fingerprint(), *likenesses, *map(len, tree.levels), len(places), first))
                before = row
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'double' if t == pa.float64() else 'long'}" for n, t in kinds.items())
    return with_next(docs, doc_id, text).mapInArrow(scan, schema)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The tree itself, one row for each document: root and the nodes of each level (digest, start and end in bytes)."""
    levels = ("sections", "paragraphs", "leaves")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = pa.list_(pa.struct([("digest", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            trees = [Tree(t) for t in batch.column("text").to_pylist()]
            nodes = [pa.array([[{"digest": d.hex(), "start": a, "end": b} for d, a, b in t.levels[k]] for t in trees], node) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.root.hex() for t in trees], pa.string()), *nodes], names=["doc_id", "root", *levels])

    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return d.mapInArrow(scan, f"doc_id {kind}, root string, " + ", ".join(f"{n} array<struct<digest: string, start: bigint, end: bigint>>" for n in levels))
