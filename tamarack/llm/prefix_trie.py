"""Conversation prefix trie: shared beginnings of conversations, and totals of all subtrees by leaf-peeling messages.

A node is a distinct sequence of first turns.  Its name is a polynomial hash of the sequence (127 bits), which can be
worked out in parts, so that a conversation of any length is hashed by several tasks: turns are sorted by ranges, each
part's hash is carried over to the next one, and no conversation is gathered.  Texts are read once and not shuffled.

Each node belongs to the member whose hashed id is the smallest.  A node's members are members of its parent, so the nodes of one
owner are a chain that goes down to where its conversation ends, and on a path the owner changes as often as a random
minimum does: a number of times that grows with the logarithm of the conversations.  These chains are the vertices of the message passing.
Each holds the counter of its child chains that are not complete and the totals of those that are; in each round the
chains whose counter is 0 send their totals to their parents, until only the root's chain finishes.  Then a running sum
along the sorted chains gives the total below every node.

Defined cases: turns of one number are ordered by the hash of role and text; a null turn is the first; a null role or
text is an empty one; repeated rows are turns of their own; rows without a conversation belong to none and are left out;
an empty table has no root and gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamarack.llm.common import CRC_TABLE_SQL, crc32_sql, materialize, shuffle_partitions

#: Hashes are polynomials of the turns at this point, modulo a Mersenne prime.
PRIME = (1 << 127) - 1
POINT = 0x5DEECE66D1B2F8A3C9E7415906F2D7B1 % PRIME
#: The prefix of another conversation takes fewer turns than this, and conversations are grouped by so many ids.
MOST_SHARED, GROUP = 6, 100
#: Bytes of the parts in which a long list of members is handed on.
PART_BYTES = 8192


def _number(x: bytes) -> int:
    return int.from_bytes(x, "big")


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


EMPTY = _bytes(0)


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of some columns."""
    return zip(*(batch.column(n).to_pylist() for n in names))


def _batch(schema: str, *columns: list) -> pa.RecordBatch:
    """A batch from lists, for a schema as Spark writes it."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _sorted(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows sorted over all partitions, with the partition's number ``part``; kept, so that two passes see the same."""
    n = shuffle_partitions(rows.sparkSession)
    return materialize(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos`` from 0, the turn's length ``chars``, and ``before``, ``hash``: the hashes without and with it."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    # the length says where the role ends
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32))
    # equal turns may come in any order: a salt lets a long run of them fall into several partitions
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), key.alias("key"), F.length(t).cast("long").alias("chars"),
        F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"),
    )
    rows = _sorted(rows, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key"), F.col("salt")).select("part", "conv_id", "key", "chars")

    kept = "part int, conv_id long, only boolean, n long, hash binary"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last conversation of a partition: whether it is the only one, its turns there and their hash."""
        first, at, n, h, part = None, None, 0, 0, None
        for batch in batches:
            for part, conv, key in _lists(batch, "part", "conv_id", "key"):
                if conv != at:
                    first, at, n, h = conv if at is None else first, conv, 0, 0
                n, h = n + 1, (h * POINT + _number(key) % PRIME) % PRIME
        if at is not None:
            yield _batch(kept, [part], [at], [first == at], [n], [_bytes(h)])

    # one row for each partition
    carried, held = {}, (None, 0, 0)
    for r in sorted(rows.mapInArrow(ends, kept).collect()):
        carried[r["part"]] = held
        n, h = r["n"], _number(r["hash"])
        if r["only"] and held[0] == r["conv_id"]:
            n, h = n + held[1], (held[2] * pow(POINT, n, PRIME) + h) % PRIME
        held = (r["conv_id"], n, h)
    placed_rows = "conv_id long, pos long, chars long, before binary, hash binary"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, h, begun = None, 0, 0, False
        for batch in batches:
            convs, pos, before, after = [], [], [], []
            for part, conv, key in _lists(batch, "part", "conv_id", "key"):
                if not begun:
                    (at, n, h), begun = carried[part], True
                if conv != at:
                    at, n, h = conv, 0, 0
                convs.append(conv)
                pos.append(n)
                before.append(_bytes(h))
                n, h = n + 1, (h * POINT + _number(key) % PRIME) % PRIME
                after.append(_bytes(h))
            yield _batch(placed_rows, convs, pos, batch.column("chars").to_pylist(), before, after)

    return rows.mapInArrow(placed, placed_rows)


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes ``conv_id, depth, hash, before, chars`` of all rebuilt conversations, and ``conv_id, hash`` of the whole ones.

    A conversation begins with the first ``shared`` turns of the first one of its group of ids, and goes on with its own
    turns from there.  A conversation's first turns are at most ``MOST_SHARED`` - 1 here.
    """
    first = F.struct("pos", "hash", "chars")
    heads = own.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.when(F.col("pos") < MOST_SHARED - 1, first))).alias("head"), F.max(F.struct("pos", "hash")).alias("last"))
    heads = materialize(heads)
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")
    donors = heads.select(F.col("conv_id").alias("of"), F.col("head").alias("given"))
    start = heads.withColumn("shared", shared).withColumn("of", F.expr(f"conv_id - conv_id % {GROUP}")).join(donors, "of", "left")
    start = materialize(start.select("conv_id", "turns", "shared", "last", F.coalesce(F.slice("given", F.lit(1), F.col("shared")), F.array().cast(heads.schema["head"].dataType)).alias("given"), F.expr("get(head, shared - 1).hash").alias("left_out")))
    taken = start.select("conv_id", F.posexplode("given").alias("p", "g"), "given").select(
        "conv_id", (F.col("p") + 1).cast("long").alias("depth"), "g.hash", F.expr("coalesce(get(given, p - 1).hash, X'" + EMPTY.hex() + "')").alias("before"), "g.chars"
    )
    # what replaces the conversation's own beginning: its hash, and the number of its turns
    swap = start.select(F.col("conv_id").alias("c"), "turns", "shared", F.size("given").alias("given"), F.coalesce(F.get("given", F.size("given") - 1)["hash"], F.lit(EMPTY)).alias("begin"), F.coalesce("left_out", F.lit(EMPTY)).alias("left_out"))
    rest = own.join(swap, F.col("conv_id") == F.col("c")).where("pos >= shared")

    kept = "conv_id long, depth long, hash binary, before binary, chars long, last boolean"

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for conv, pos, shared, given, turns, chars, begin, left, before, after in _lists(batch, "conv_id", "pos", "shared", "given", "turns", "chars", "begin", "left_out", "before", "hash"):
                other, k = _number(begin) - _number(left), pos - shared
                hashes = (_bytes((other * pow(POINT, k + i, PRIME) + _number(x)) % PRIME) for i, x in ((1, after), (0, before)))
                for to, x in zip(out, (conv, given + k + 1, *hashes, chars, pos == turns - 1)):
                    to.append(x)
            yield _batch(kept, *out)

    rest = materialize(rest.mapInArrow(swapped, kept))
    root = start.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(EMPTY).alias("hash"), F.lit(None).cast("binary").alias("before"), F.lit(0).cast("long").alias("chars"))
    prefixes = root.union(taken).union(rest.drop("last"))
    whole = start.where("turns <= shared").select("conv_id", F.coalesce(F.get("given", F.size("given") - 1)["hash"], F.lit(EMPTY)).alias("hash"))
    return prefixes, whole.union(rest.where("last").select("conv_id", "hash"))


def digests(members: DataFrame) -> DataFrame:
    """``hash, ends_sha256`` for the groups of ``members`` (hash, conv_id): SHA-256 of the sorted ids, comma-joined.

    Members are sorted by ranges and joined in parts of ``PART_BYTES``.  Groups that lie in one partition end there; the
    parts of the two at a partition's borders are read in their order by one task for each group, as the digest asks.
    """
    rows = members.repartitionByRange(shuffle_partitions(members.sparkSession), "hash", "conv_id").sortWithinPartitions("hash", "conv_id")

    kept = "hash binary, first long, ids string, digest string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, begin, ids, size, state, some = None, None, None, [], 0, None, False
        out: tuple[list, ...] = ([], [], [], [])

        def put(*values: object) -> None:
            for to, x in zip(out, values):
                to.append(x)

        def read() -> None:
            state.update(("," * some + ",".join(ids)).encode())

        for batch in batches:
            for name, conv in _lists(batch, "hash", "conv_id"):
                if name != at:
                    if at is not None and at != first:
                        read()
                        put(at, None, None, state.hexdigest())
                    elif at is not None:
                        put(at, begin, ",".join(ids), None)
                    first = name if first is None else first
                    at, begin, ids, size, state, some = name, conv, [], 0, hashlib.sha256(), False
                elif size > PART_BYTES:
                    # it may go on in the next partition, so its parts are handed on
                    put(at, begin, ",".join(ids), None)
                    read()
                    begin, ids, size, some = conv, [], 0, True
                ids.append(x := str(conv))
                size += len(x) + 1
            if len(out[0]) > 1000:
                yield _batch(kept, *out)
                for to in out:
                    to.clear()
        if at is not None:
            put(at, begin, ",".join(ids), None)
        yield _batch(kept, *out)

    found = materialize(rows.mapInArrow(joined, kept))
    done = found.where("digest IS NOT NULL").select("hash", F.col("digest").alias("ends_sha256"))
    # parts of groups that ended in their partition are not needed
    parts = found.where("digest IS NULL").select("hash", "first", "ids").join(done.select("hash"), "hash", "left_anti")

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, names, digests = None, None, [], []
        for batch in batches:
            for name, ids in _lists(batch, "hash", "ids"):
                if name != at:
                    if at is not None:
                        digests.append(state.hexdigest())
                    names.append(name)
                    at, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(("," + ids).encode())
        if at is not None:
            digests.append(state.hexdigest())
        yield _batch("hash binary, ends_sha256 string", names, digests)

    return done.union(parts.repartition("hash").sortWithinPartitions("hash", "first").mapInArrow(ended, "hash binary, ends_sha256 string"))


def peel(chains: DataFrame) -> DataFrame:
    """``chain, leaves, saved``: totals of whole subtrees, from ``chain, parent, leaves, saved`` of each chain alone.

    A round's complete chains are written as they finish and leave the table, so all rounds together move every chain's
    totals once.
    """
    children = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("chain")).agg(F.count("*").alias("waits_for"))
    waiting = materialize(chains.join(children, "chain", "left").select("chain", "parent", "leaves", "saved", F.coalesce("waits_for", F.lit(0)).alias("waits_for")))
    finished = []
    while True:
        done = waiting.where("waits_for = 0")
        finished.append(done.select("chain", "leaves", "saved"))
        left = waiting.where("waits_for > 0")
        sent = done.where("parent IS NOT NULL").groupBy(F.col("parent").alias("chain")).agg(F.count("*").alias("k"), F.sum("leaves").alias("more"), F.sum("saved").alias("most"))
        new = left.join(sent, "chain", "left").select(
            "chain", "parent", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("most", F.lit(0))).alias("saved"), (F.col("waits_for") - F.coalesce("k", F.lit(0))).alias("waits_for")
        )
        waiting = materialize(new)
        if waiting.isEmpty():
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.union(f)
    return out


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    prefixes, whole = rebuilt(turns(conversations, conv_id, turn, role, text))
    nodes = prefixes.groupBy("hash").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(F.struct(F.xxhash64("conv_id").alias("h"), F.col("conv_id").alias("c"))).alias("owner"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.first("before").alias("before")
    )
    nodes = materialize(nodes.select("hash", "before", "n_convs", "conv_id", F.col("owner.c").alias("chain"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    zero = F.lit(0).cast("long")
    children = nodes.where("before IS NOT NULL").groupBy(F.col("before").alias("hash")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "hash", "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("leaf", F.expr("CAST(n_children = 0 AS long)"))
    nodes = materialize(nodes)
    tops = nodes.groupBy("chain").agg(F.min_by(F.struct("hash", "before"), "depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    # the node that a chain hangs on; a node with very many children is a skewed key, which adaptive execution splits
    above = nodes.select(F.col("hash").alias("before"), F.col("chain").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tops = materialize(tops.select("chain", "top.hash", "top.before", "leaves", "saved").join(above, "before", "left"))
    totals = peel(tops.select("chain", "parent", "leaves", "saved"))
    totals = materialize(tops.select("chain", "hash", "before", "parent_conv_id").join(totals, "chain"))
    hung = totals.where("before IS NOT NULL").groupBy(F.col("before").alias("hash")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    # a chain's totals begin at its first node, and lessen by what each node leaves behind
    begins = totals.select("hash", F.col("parent_conv_id").alias("up"), F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    rows = nodes.join(hung, "hash", "left").join(begins, "hash", "left").join(digests(whole), "hash", "left")
    rows = rows.select(
        "chain", "depth", "conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("hung_leaves", zero)).alias("own_leaves"), (F.col("saved") + F.coalesce("hung_saved", zero)).alias("own_saved"),
        "up", "all_leaves", "all_saved", F.unhex("ends_sha256").alias("ends"),
    )
    rows = _sorted(rows, "chain", "depth")
    columns = ("part", "chain", "conv_id", "own_leaves", "own_saved", "up", "all_leaves", "all_saved")
    kept = "part int, chain long, began boolean, leaves long, saved long, last long"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is left at the end of a partition: of the whole chain if it began there, else less than what came in."""
        part, at, began, leaves, saved, last = None, None, False, 0, 0, None
        for batch in batches:
            for part, chain, conv, own_leaves, own_saved, _, all_leaves, all_saved in _lists(batch, *columns):
                if chain != at:
                    at, began, leaves, saved = chain, False, 0, 0
                if all_leaves is not None:
                    began, leaves, saved = True, all_leaves, all_saved
                leaves, saved, last = leaves - own_leaves, saved - own_saved, conv
        if at is not None:
            yield _batch(kept, [part], [at], [began], [leaves], [saved], [last])

    # one row for each partition
    carried, held = {}, (0, 0, None)
    for r in sorted(rows.mapInArrow(ends, kept).collect()):
        carried[r["part"]] = held
        more = (0, 0) if r["began"] else held[:2]
        held = (r["leaves"] + more[0], r["saved"] + more[1], r["last"])
    found = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            parent, leaves, saved = [], [], []
            for part, _, conv, own_leaves, own_saved, up, all_leaves, all_saved in _lists(batch, *columns):
                more, most, last = carried[part] if state is None else state
                if all_leaves is not None:
                    more, most, last = all_leaves, all_saved, up
                parent.append(last)
                leaves.append(more)
                saved.append(most)
                state = (more - own_leaves, most - own_saved, conv)
            same = [batch.column(c).to_pylist() for c in ("conv_id", "depth", "n_convs", "n_children", "ends")]
            yield _batch(found, *same[:2], parent, *same[2:4], leaves, saved, same[4])

    out = rows.mapInArrow(summed, found)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce(F.lower(F.hex("ends")), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH tab AS ({CRC_TABLE_SQL}),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, sha256(concat(length(r), ':', r, x)) AS k, length(x) AS n FROM t),
own AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS s FROM k GROUP BY conv_id),
h AS (SELECT own.*, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM own, tab),
b AS (SELECT h.conv_id, list_concat(coalesce(d.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN own d ON d.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, len(s) AS whole, s[d].n AS n, sha256(array_to_string(list_transform(s[1:d], lambda e: e.k), '')) AS p, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(s[1:d - 1], lambda e: e.k), '')) END AS up
  FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM b)),
n AS (SELECT p, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(n), 0) AS saved,
  sha256(coalesce(string_agg(CASE WHEN d = whole THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY p),
c AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT p.p, count(*) FILTER (WHERE c.up IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.depth LEFT JOIN c ON c.up = n.p GROUP BY p.p)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN n u ON u.p = n.up LEFT JOIN c ON c.up = n.p
"""
