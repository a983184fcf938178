"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every window of ``width`` words has an anchor, the smallest hash of a group of ``GROUP`` words within it, so equal
windows have equal anchors.

1. Anchors are counted over the corpus, pre-aggregated in each slice of documents.  Windows whose anchor occurs once are
   unique, and no text is moved for them.
2. The passages under the other windows are dealt to blocks by anchor.  Windows of very frequent anchors are dealt one by
   one by a hash of the whole window instead: passages cut at the edge of a text that a third of all documents share have
   that text's anchors, but other words.
3. A block sorts its passages by document and place, names all windows exactly (equal words, equal names; no hashes) and
   is the reference of each passage in it: a passage is factored greedily, a factor beginning at the first window that
   an earlier place holds, and running on as long as the words there agree.  The window at a factor's end is the next to
   be looked up, so that no repeated window is lost at a boundary.
4. A document's factors are put together in order; words under factors, which are all at least a window long, go.

The frequent anchors come to the driver and are broadcast: at most ``MOST_HOT`` numbers of 8 bytes, whatever the input.
Which of them are on the list decides only where windows are compared.  Memory is bounded by slices of ``SLICE_BYTES`` of
text (or one longer document) and by blocks, of which there are ``BLOCKS_PER_PARTITION`` for each shuffle partition.

Defined cases: ids are whole numbers (others raise, unless they can be cast); a row without an id comes before all
others; a null or empty text has no words; a text shorter than a window keeps all words; rows of one doc_id do not count
as earlier than each other at the same word, so that repeated rows keep or lose the same words; rows of one doc_id with
different texts are parsed each for itself; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.common import documents, materialize, shuffle_partitions, slices
from tamarack.llm.shingles import hashes, mix, windows, words

WIDTH, GROUP = 20, 8
BLOCKS_PER_PARTITION, LONGEST_RUN = 8, 32
#: Anchors that occur so often may be frequent ones; of them the most frequent are.
HOT, MOST_HOT = 1000, 1 << 20
NO_ID = np.iinfo(np.int64).min
#: Factors travel packed, some of a document in a row.
PACKED = np.dtype([("start", "<i4"), ("length", "<i4"), ("ref_doc", "<i8"), ("ref_start", "<i4")])
FACTORS = "doc_id long, h long, found binary"


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    done, have = x, 1
    while have < width:
        step = min(have, width - have)
        done, have = np.minimum(done[: len(done) - step], done[step:]), have + step
    return done


class Slice:
    """Words and windows of some documents; windows are those that lie within one."""

    def __init__(self, texts: list[str | None], width: int):
        self.words = [words(t) for t in texts]
        n = np.array([len(w) for w in self.words], dtype=np.int64)
        h = np.concatenate([hashes(w) for w in self.words] + [np.empty(0, np.uint64)])
        size = max(0, len(h) - width + 1)
        owner = np.repeat(np.arange(len(n)), n)[:size]
        at = np.arange(size) - (np.cumsum(n) - n)[owner]
        whole = at <= n[owner] - width
        group = min(GROUP, width)
        self.grams, self.gram_owner = windows(h, group), np.repeat(np.arange(len(n)), n)
        self.anchor = least_of(self.grams, width - group + 1)[:size][whole] if size else np.empty(0, np.uint64)
        self.seed = windows(h, width)[whole] if size else np.empty(0, np.uint64)
        self.owner, self.at = owner[whole], at[whole]


def _dealt(block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by block, and where each block begins in it."""
    order = np.argsort(block, kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1))


def _low(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _repeated_anchors(docs: DataFrame, width: int, partitions: int) -> DataFrame:
    """``doc_id, marks`` (low halves of the document's anchors that occur elsewhere as well), and frequent anchors: ``hot, n``."""
    blocks = partitions * BLOCKS_PER_PARTITION
    names = ["block", "values", "counts", "docs", "of", "doc_id", "marks"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            s = Slice(part.column("text").to_pylist(), width)
            if not len(s.anchor):
                continue
            # groups that a document holds twice (a chance meeting of two hashes only adds to them)
            within = np.sort(s.grams ^ mix(s.gram_owner[: len(s.grams)].astype(np.uint64), 3))
            within = np.unique(within[1:][within[1:] == within[:-1]])
            head = np.r_[True, (s.anchor[1:] != s.anchor[:-1]) | (s.owner[1:] != s.owner[:-1])]
            v, o = s.anchor[head], s.owner[head]
            order = np.lexsort((o, v))
            v, o = v[order], o[order]
            fresh = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])]
            v, o = v[fresh], o[fresh]
            times = 1 + np.isin(v ^ mix(o.astype(np.uint64), 3), within).astype(np.int64)
            start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            total = np.add.reduceat(times, start)
            known = np.repeat(total > 1, np.diff(np.r_[start, len(v)]))
            rows = []
            by = np.argsort(o[known], kind="stable")
            ko, kv = o[known][by], _low(v[known][by])
            edges = np.searchsorted(ko, np.arange(part.num_rows + 1))
            rows += [(None, None, None, None, None, int(ids[i]), kv[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            # one entry for each anchor: with its document if that is the only one here
            v, o, single = v[start], np.where(total > 1, -1, o[start]), total == 1
            order, edge = _dealt((mix(v, 9) % np.uint64(blocks)).astype(np.int64), blocks)
            v, o, total = v[order], o[order], np.minimum(total[order], 1 << 30).astype(np.int32)
            for b in np.flatnonzero(np.diff(edge)):
                x = slice(edge[b], edge[b + 1])
                many = o[x] < 0
                mine, of = np.unique(o[x][~many], return_inverse=True)
                rows.append((int(b), np.r_[v[x][~many], v[x][many]].tobytes(), total[x][many].tobytes(), ids[mine].tobytes(), of.astype(np.uint16 if len(mine) < 1 << 16 else np.uint32).tobytes(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    found = docs.mapInArrow(scan, "block int, values binary, counts binary, docs binary, of binary, doc_id long, marks binary")
    found = found.repartition(partitions, F.coalesce(F.col("block"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("int"))).sortWithinPartitions("block")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(rows: list) -> pa.RecordBatch:
            v, n, d, has = [], [], [], []
            for values, counts, docs_, of in rows:
                counts, docs_ = np.frombuffer(counts, np.int32), np.frombuffer(docs_, np.int64)
                own = docs_[np.frombuffer(of, np.uint16 if len(docs_) < 1 << 16 else np.uint32)] if len(docs_) else docs_
                v.append(np.frombuffer(values, np.uint64))
                n.append(np.r_[np.ones(len(own), np.int64), counts])
                d.append(np.r_[own, np.zeros(len(counts), np.int64)])
                has.append(np.r_[np.ones(len(own), bool), np.zeros(len(counts), bool)])
            v, n, d, has = (np.concatenate(x) for x in (v, n, d, has))
            order = np.argsort(v, kind="stable")
            v, n, d, has = v[order], n[order], d[order], has[order]
            start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            total = np.add.reduceat(n, start)
            told = has & np.repeat(total > 1, np.diff(np.r_[start, len(v)]))
            doc, mark = d[told], _low(v[told])
            by = np.argsort(doc, kind="stable")
            doc, mark = doc[by], mark[by]
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
            ends = np.r_[head[1:], len(doc)].astype(np.int64)
            hot = total >= HOT
            a, b = len(head), int(hot.sum())
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(doc[head], pa.int64()), pa.nulls(b, pa.int64())]),
                    pa.concat_arrays([pa.array([mark[i:j].tobytes() for i, j in zip(head, ends)], pa.binary()), pa.nulls(b, pa.binary())]),
                    pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(v[start][hot].view(np.int64), pa.int64())]),
                    pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(total[hot], pa.int64())]),
                ],
                names=["doc_id", "marks", "hot", "n"],
            )

        at, held = None, []
        for batch in batches:
            here = batch.filter(batch.column("block").is_null()).select(["doc_id", "marks"])
            if here.num_rows:
                none = pa.nulls(here.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), none, none], names=["doc_id", "marks", "hot", "n"])
            for block, *row in zip(*(batch.column(c).to_pylist() for c in names[:5])):
                if block is None:
                    continue
                if block != at and held:
                    yield counted(held)
                    held = []
                at = block
                held.append(row)
        if held:
            yield counted(held)

    return found.mapInArrow(count, "doc_id long, marks binary, hot long, n long")



def _packed(doc: np.ndarray, h: np.ndarray, start: np.ndarray, length: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray) -> list[pa.Array]:
    """Columns ``doc_id, h, found``; factors that go on where the one before ends, and in the same source, are joined."""
    order = np.lexsort((start, h, doc))
    doc, h, start, length, ref_doc, ref_start = (x[order].astype(np.int64) for x in (doc, h, start, length, ref_doc, ref_start))
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    on = same & (start[1:] <= start[:-1] + length[:-1]) & (ref_doc[1:] == ref_doc[:-1]) & (start[1:] - ref_start[1:] == start[:-1] - ref_start[:-1])
    head = np.flatnonzero(np.r_[True, ~on]) if len(doc) else np.empty(0, np.int64)
    rows = np.empty(len(head), PACKED)
    if len(head):
        rows["start"], rows["ref_doc"], rows["ref_start"] = start[head], ref_doc[head], ref_start[head]
        rows["length"] = np.maximum.reduceat(start + length, head) - start[head]
    doc, h = doc[head], h[head]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else head
    ends = np.r_[first[1:], len(doc)].astype(np.int64)
    return [pa.array(doc[first], pa.int64()), pa.array(h[first], pa.int64()), pa.array([rows[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())]


def _passages(marked: DataFrame, width: int, blocks: int, hot) -> DataFrame:
    """Passages for the blocks, packed (``block`` set), and factors settled within a slice (``block`` null)."""
    names = ["doc_id", "h", "found", "block", "docs", "hs", "of", "starts", "texts"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 5]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(hot.value, np.uint64)
        press = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches):
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            h = part.column("h").to_numpy(zero_copy_only=False)
            s = Slice(part.column("text").to_pylist(), width)
            # (document, mark) pairs as one number each: a document's windows are looked up among its own marks
            marks = [np.frombuffer(b"".join(m), np.uint32) for m in part.column("marks").to_pylist()]
            told = np.repeat(np.arange(len(marks), dtype=np.uint64), [len(m) for m in marks]) << np.uint64(32) | np.concatenate([*marks, np.empty(0, np.uint32)])
            keep = np.isin(s.owner.astype(np.uint64) << np.uint64(32) | _low(s.anchor), told)
            anchor, seed, owner, at = s.anchor[keep], s.seed[keep], s.owner[keep], s.at[keep]
            if not len(at):
                continue
            # runs of neighbours with one anchor make a passage, windows of frequent anchors one each
            alone = np.isin(anchor, frequent)
            new = alone | np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            head = np.flatnonzero(new | (since % LONGEST_RUN == 0))
            length = np.diff(np.r_[head, len(at)])
            to = (mix(np.where(alone[head], seed[head], anchor[head]), 9) % np.uint64(blocks)).astype(np.int64)
            owner, at = owner[head], at[head]
            texts = [b" ".join(s.words[o][a : a + n + width - 1]) for o, a, n in zip(owner.tolist(), at.tolist(), length.tolist())]
            # equal passages are settled here, all but the first
            order = np.lexsort((at, ids[owner]))
            first: dict[bytes, int] = {}
            lead = np.arange(len(texts))
            for i in order.tolist():
                lead[i] = first.setdefault(texts[i], i)
            later = np.flatnonzero((lead != np.arange(len(lead))) & ((ids[owner] != ids[owner[lead]]) | (at != at[lead])))
            if len(later):
                f, o = lead[later], owner[later]
                columns = _packed(ids[o], h[o], at[later], length[later] + width - 1, ids[owner[f]], at[f])
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), t) for t in kinds[3:])], names=names)
            # rows of the same place in one document stay, each with its own text's hash
            sent = np.flatnonzero((lead == np.arange(len(lead))) | ((ids[owner] == ids[owner[lead]]) & (at == at[lead])))
            order, edge = _dealt(to[sent], blocks)
            rows = []
            for b in np.flatnonzero(np.diff(edge)):
                x = sent[order[edge[b] : edge[b + 1]]]
                mine, of = np.unique(owner[x], return_inverse=True)
                rows.append((int(b), ids[mine].tobytes(), h[mine].tobytes(), of.astype(np.uint32).tobytes(), at[x].astype(np.int32).tobytes(), press(b"\n".join([texts[i] for i in x.tolist()]))))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in kinds[:3]), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds[3:]))], names=names)

    return marked.mapInArrow(scan, f"{FACTORS}, block int, docs binary, hs binary, of binary, starts binary, texts binary")


def window_names(x: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all windows of ``width`` neighbours: equal for equal windows and for no others, by doubling."""
    name, have = np.unique(x, return_inverse=True)[1], 1
    while have < width:
        step = min(have, width - have)
        name = np.unique(name[: len(name) - step] * (int(name.max()) + 1) + name[step:], return_inverse=True)[1]
        have += step
    return name


def factors(passages: list[list[int]] | list[np.ndarray], doc: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Greedy factors of passages (words as numbers) against those before them, in the order of ``doc`` and ``at``.

    Returns passage, window and number of windows of each factor, and the passage and window where its source begins.
    """
    order = np.lexsort((at, doc))
    n = np.array([len(passages[i]) for i in order.tolist()], dtype=np.int64)
    x = np.concatenate([passages[i] for i in order.tolist()])
    if len(x) < width:
        return (np.empty(0, np.int64),) * 5
    name = window_names(x, width)
    begin = np.cumsum(n) - n
    c = np.repeat(np.arange(len(n)), n)[: len(name)]
    k = np.arange(len(name)) - begin[c]
    inside = k <= n[c] - width
    name, c, k = name[inside], c[inside], k[inside]
    first, inverse = np.unique(name, return_index=True, return_inverse=True)[1:]
    lead = first[inverse]
    own = order[c]
    hit = (doc[own] != doc[own[lead]]) | (at[own] + k != at[own[lead]] + k[lead])
    m, run = len(name), hit.astype(np.int64)
    # how far the words go on to agree, for all hits at once
    active, step = np.flatnonzero(hit), 1
    while len(active):
        a, b = active + step, lead[active] + step
        fits = (a < m) & (b < m)
        active, a, b = active[fits], a[fits], b[fits]
        active = active[(c[a] == c[active]) & (c[b] == c[lead[active]]) & (name[a] == name[b])]
        run[active] += 1
        step += 1
    next_hit = np.minimum.accumulate(np.where(hit, np.arange(m), m)[::-1])[::-1] if m else np.empty(0, np.int64)
    head = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if m else np.empty(0, np.int64)
    at_, of, found = next_hit[head], c[head], []
    while len(at_):
        here = at_ < m
        at_, of = at_[here], of[here]
        here = c[at_] == of
        at_, of = at_[here], of[here]
        found.append(at_)
        # the window after the factor is the first that it does not cover
        after = at_ + run[at_]
        at_ = np.where(after < m, next_hit[np.minimum(after, m - 1)], m) if m else after
    f = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
    return own[f], k[f], run[f], own[lead[f]], k[lead[f]]


def _parsed(dealt: DataFrame, width: int) -> DataFrame:
    """Factors of the passages, block by block, and those settled before."""
    names = ["block", "docs", "hs", "of", "starts", "texts"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor().decompress

        def parsed(rows: list) -> Iterator[pa.RecordBatch]:
            doc, h, at, texts = [], [], [], []
            for d, hs, of, starts, packed in rows:
                of = np.frombuffer(of, np.uint32)
                doc.append(np.frombuffer(d, np.int64)[of])
                h.append(np.frombuffer(hs, np.int64)[of])
                at.append(np.frombuffer(starts, np.int32))
                texts += press(packed).split(b"\n")
            doc, h, at = (np.concatenate(v) for v in (doc, h, at))
            # a passage that is equal to an earlier one is one factor, the others are parsed
            order = np.lexsort((at, doc))
            first: dict[bytes, int] = {}
            lead = np.empty(len(texts), np.int64)
            for i in order.tolist():
                lead[i] = first.setdefault(texts[i], i)
            later = np.flatnonzero((doc != doc[lead]) | (at != at[lead]))
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            get = number.__getitem__
            mine = np.flatnonzero((doc == doc[lead]) & (at == at[lead]))
            parts = [list(map(get, texts[i].split(b" "))) for i in mine.tolist()]
            size = np.array([texts[i].count(b" ") + 1 for i in later.tolist()], np.int64)
            p, k, run, q, j = factors([np.array(x, np.int64) for x in parts], doc[mine], at[mine], width)
            p, q = mine[p], mine[q]
            whole = (doc[later], h[later], at[later], size, doc[lead[later]], at[lead[later]])
            some = (doc[p], h[p], at[p] + k, run + width - 1, doc[q], at[q] + j)
            yield pa.RecordBatch.from_arrays(_packed(*(np.concatenate(x) for x in zip(whole, some))), names=["doc_id", "h", "found"])

        at, held = None, []
        for batch in batches:
            settled = batch.filter(batch.column("block").is_null()).select(["doc_id", "h", "found"])
            if settled.num_rows:
                yield settled
            for block, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if block is None:
                    continue
                if block != at and held:
                    yield from parsed(held)
                    held = []
                at = block
                held.append(row)
        if held:
            yield from parsed(held)

    return dealt.mapInArrow(look, FACTORS)


def parse(found: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """A document's factors (start, words, source document, source start) joined where their sources go on, and the spans of words under them."""
    phrases: list[list[int]] = []
    spans: list[list[int]] = []
    for start, length, ref_doc, ref_start in sorted(found):
        last = phrases[-1] if phrases else None
        if last and last[2] == ref_doc and start - last[0] == ref_start - last[3] and start <= last[0] + last[1]:
            last[1] = max(last[1], start + length - last[0])
        else:
            phrases.append([start, length, ref_doc, ref_start])
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + length)
        else:
            spans.append([start, start + length])
    return [tuple(p) for p in phrases], [(a, b) for a, b in spans]


def substring_dedup(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept, n_factors, spans``: what is left of each text, and the word spans that went."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    blocks = n * BLOCKS_PER_PARTITION
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    anchors = materialize(_repeated_anchors(d, width, n))
    hot = anchors.where("hot IS NOT NULL").orderBy(F.desc("n"), "hot").limit(MOST_HOT).toPandas()["hot"].to_numpy(np.int64)
    hot = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)).tobytes())
    marks = anchors.where("hot IS NULL").groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("marks").alias("marks"))
    d = d.withColumn("h", F.xxhash64("text"))
    own = F.coalesce(F.col("doc_id"), F.lit(int(NO_ID)))
    marked = d.join(marks, own == F.col("of")).select("doc_id", "h", "text", "marks")
    # one exchange for both kinds of rows: passages go to their block, settled factors anywhere
    dealt = _passages(marked, width, blocks, hot).repartition(n, F.coalesce(F.col("block"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << 20)).cast("int"))).sortWithinPartitions("block")
    found = _parsed(dealt, width).groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).agg(F.collect_list("found").alias("found"))
    met = d.join(found, (own == F.col("of")) & (F.col("h") == F.col("of_h")), "left").select("doc_id", "text", "found")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for t, f in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                w = words(t)
                phrases, spans = parse(np.frombuffer(b"".join(f), PACKED).tolist()) if f else ([], [])
                left, at = [], 0
                for a, b in spans:
                    left += w[at:a]
                    at = b
                left += w[at:]
                for to, x in zip(out, (len(w), len(w) - len(left), b" ".join(left).decode("utf-8", "surrogatepass"), len(phrases), [{"start": a, "end": b} for a, b in spans])):
                    to.append(x)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64(), span)))], names=["doc_id", "n_words", "n_removed", "kept", "n_factors", "spans"])

    return met.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string, n_factors long, spans array<struct<start: bigint, end: bigint>>")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
d AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS dup FROM t),
c AS (SELECT *, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM d),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
