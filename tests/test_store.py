"""Stored tables, versions, ordered hashes and capped limits against plain Python."""

import hashlib
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tamarack.operators import labels, media, practice, tables
from tamarack.operators.search import SearchIndex
from tamarack.sources import files, versions
from tamarack.streaming import limits


def brute_limits(rows, limit, window, cap):
    held, out = defaultdict(dict), {}
    for bucket, i, key, at, ok in sorted(rows, key=lambda r: (r[0], r[3] is not None, r[3] or 0, r[1])):
        if key is None or at is None:
            out[bucket, i] = (False, False)
            continue
        live = {k: v for k, v in held[bucket].items() if v[1] > at}
        n, until = live.get(key, (0, at + window))
        blocked = n >= limit
        counted = not blocked and not ok and (n > 0 or len(live) < cap)
        if counted:
            live[key] = (n + 1, until)
        elif ok and not blocked:
            live.pop(key, None)
        held[bucket] = live
        out[bucket, i] = (blocked, counted)
    return out


def attempts(n=1500, keys=40):
    rng = random.Random(5)
    return [(rng.choice("ab"), i, rng.choice([None, *range(keys)]) if i % 50 == 0 else rng.randint(0, keys), rng.randint(0, 900), rng.choice([True, False, False, None])) for i in range(n)]


SCHEMA = "bucket string, id long, key long, at long, ok boolean"


@pytest.mark.parametrize("limit,window,cap", [(2, 50, 5), (3, 200, 1000), (1, 10, 1)])
def test_capped_limits(spark, limit, window, cap):
    rows = [*attempts(), ("a", 9000, 1, None, False)]
    got = {(r.bucket, r.id): (r.blocked, r.counted) for r in limits.capped_limits(spark.createDataFrame(rows, SCHEMA), limit, window, cap).collect()}
    want = brute_limits(rows, limit, window, cap)
    assert got == want and (cap > 100 or sum(c for _, c in want.values()) < sum(c for _, c in brute_limits(rows, limit, window, 10**6).values()))
    assert limits.capped_limits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_full_bucket_keeps_the_blocked_key():
    w = limits.Windows(limit=2, window_s=60, cap=3)
    assert [w.attempt("x", t, False) for t in (0, 1, 2)] == [(False, True), (False, True), (True, False)]
    assert [w.attempt(f"k{i}", 3 + i, False)[1] for i in range(5)] == [True, True, False, False, False]
    assert w.attempt("x", 10, True) == (True, False) and w.attempt("k9", 60, False)[1] and len(w.held) == 3


def test_stream_and_log_agree(spark, sf_dir, tmp_path):
    """Events as attempts, in three micro-batches: the stream's state gives what the fold over the whole log gives."""
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type AS bucket", "event_id AS id", "user_id AS key", "date_trunc('second', CAST(ts AS timestamp)) AS time", "event_id % 3 = 0 AS ok")
        e = e.withColumn("at", F.unix_seconds("time"))
        for k, (a, b) in enumerate((("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01"))):
            path = str(tmp_path / f"part{k}")
            e.where(f"time >= '{a}' AND time < '{b}'").coalesce(1).write.parquet(path)
            (tmp_path / "in").mkdir(exist_ok=True)
            file = next(x for x in os.listdir(path) if x.endswith(".parquet"))
            os.rename(f"{path}/{file}", tmp_path / "in" / f"{k}.parquet")
            os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = limits.capped_limits_stream(s, 2, 3 * 86400, 10).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r.bucket, r.id): (r.blocked, r.counted) for r in spark.table("limited").collect()}
    finally:
        spark.conf.unset(name)
    want = {(r.bucket, r.id): (r.blocked, r.counted) for r in limits.capped_limits(e, 2, 3 * 86400, 10).collect()}
    assert got == want and len(want) == e.count() and any(b for b, _ in want.values())


def test_search_index(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"))
    rng = random.Random(2)
    texts = {i: "".join(rng.choice("abcABC é\n%") for _ in range(rng.randint(0, 40))) for i in [*range(-30, 60), 4095, 4096, 2**40]}

    def check():
        for term in ("abc", "ABCa", "é\n", "b", "cab", "a%", "zzz", "ab c"):
            low = lambda x: x.lower() if len(term) >= 3 else x  # noqa: E731, B023
            assert sorted(r["key"] for r in index.search(term).collect()) == sorted(i for i, t in texts.items() if t is not None and low(term) in low(t)), term

    frame = lambda d: spark.createDataFrame([*d.items(), (None, "abc abc")], "id long, text string")
    assert index.update(frame(texts), "id", "text") == len(texts)
    check()
    assert index.update(frame(texts), "id", "text") == 0 and len(index.segments()) == 1
    changed = {i: "xx" + texts[i][::-1] for i in list(texts)[:20]}
    gone = list(texts)[25:35]
    texts.update(changed)
    texts.update({7000 + i: "cababc" for i in range(5)})
    texts = {i: t for i, t in texts.items() if i not in gone}
    assert index.update(frame(texts), "id", "text") == 20 + 5 + 10
    check()
    texts[gone[0]] = None  # there again, with an empty text
    assert index.update(frame(texts), "id", "text") == 1
    check()
    # a segment without its mark, as of a writer that broke, is not read
    for kind in ("texts", "grams"):
        os.makedirs(tmp_path / "index" / kind / "segment=000000009-broken" / "part=0")
    check()


def test_versions(spark, tmp_path):
    root = str(tmp_path / "tables")
    one, two = spark.range(5), spark.range(50)
    assert versions.versions(spark, root) == [] and versions.publish(spark, root, {"a": one, "b": two}) == 1
    read = versions.pinned(spark, root)
    before = read("a").count()
    assert versions.publish(spark, root, {"a": two}) == 2
    # the reader goes on with its version; the new one has taken over what was not written
    assert (before, read("a").count(), read("b").count()) == (5, 5, 50)
    later = versions.pinned(spark, root)
    assert (later("a").count(), later("b").count()) == (50, 50)
    assert versions.manifest(spark, root, 2)["tables"]["b"] == versions.manifest(spark, root, 1)["tables"]["b"]
    with pytest.raises(versions.Conflict):
        versions.publish(spark, root, {"a": one}, base=1)
    assert versions.versions(spark, root) == [1, 2] and versions.pinned(spark, root)("a").count() == 50
    with pytest.raises(Exception):  # noqa: B017  a writer that breaks publishes nothing
        versions.publish(spark, root, {"a": one.select(F.raise_error("broken").alias("id"))})
    assert versions.versions(spark, root) == [1, 2]


def test_update_of_derived_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, "old").alias("shown"), F.lit(1).alias("other"))
    tables.write_parted(rows, path, "id", 8)
    stamp = lambda: {f"{d}/{x}": os.stat(f"{d}/{x}").st_mtime_ns for d, _, xs in os.walk(path) for x in xs if x.endswith(".parquet")}
    first = stamp()
    new = spark.createDataFrame([(0, "new"), (1, None), (2, "old"), (999, "none")], "id long, shown string")
    assert tables.update_derived(spark, path, "id", new, 8) == 1
    second = stamp()
    assert len(set(first) - set(second)) == 1
    assert tables.update_derived(spark, path, "id", new, 8) == 0 and stamp() == second
    got = {r["id"]: (r["shown"], r["other"]) for r in spark.read.parquet(path).collect()}
    assert got == {i: ("new" if i == 0 else "old" if i % 2 == 0 else None, 1) for i in range(200)}
    cleared = spark.createDataFrame([(4, None)], "id long, shown string")
    assert tables.update_derived(spark, path, "id", cleared, 8) == 1 and spark.read.parquet(path).where("id = 4").first()["shown"] is None


def test_ranks_and_shards(spark):
    rows = spark.range(1003).select(F.md5(F.col("id").cast("string")).alias("sha256"))
    got = {r["sha256"]: r["shard"] for r in media.shards(rows, 100).collect()}
    assert got == {h: i // 100 for i, h in enumerate(sorted(got))} and len(got) == 1003
    assert tables.ranked(spark.range(0), "id").count() == 0
    assert sorted(r["rank"] for r in tables.ranked(spark.range(40).select(F.lit(1).alias("x")), "x").collect()) == list(range(40))


def test_shards_are_taken_whole(spark):
    work = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (1, "d"), (2, "e"), (3, "f")], "shard long, sha256 string")
    results = spark.createDataFrame([(0, "a", "ok"), (1, "c", "ok"), (1, "c", "ok"), (1, "d", "empty"), (2, "e", None), (3, "a", "ok"), (9, "z", "error")], "shard long, sha256 string, status string")
    taken, faults = media.accepted_results(work, results)
    assert [(r["shard"], r["sha256"]) for r in taken.collect()] == [(0, "a")]
    assert sorted((r["shard"], r["fault"], r["n"]) for r in faults.collect()) == [(1, "repeated", 1), (2, "bad_status", 1), (3, "unknown", 1), (9, "unknown", 1)]


def test_input_hash_is_that_of_the_sequence(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(50)]), rng.choice([None, "", "x", "é"]), i) for i in range(300)]

    def brute(rows):
        cell = lambda x: "~" if x is None else f"{len(str(x))}:{x}"
        xs = [h for _, _, h in sorted((k is not None, k or 0, int(hashlib.sha256((cell(k) + cell(v) + cell(i)).encode()).hexdigest()[:15], 16)) for k, v, i in rows)]
        sums = [0, 0]
        for x in xs:
            sums = [(s * p + x) % labels.PRIME for s, p in zip(sums, labels.POINTS)]
        return hashlib.sha256(":".join(map(str, [len(xs), *sums])).encode()).hexdigest()

    for some in (rows, rows[:1], []):
        for parts in ("1", "3", "16"):
            before = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            try:
                d = spark.createDataFrame(some, "k int, v string, i int").repartition(5)
                assert labels.input_hash(d, "k", ["v", "i"]).first()[0] == brute(some)
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", before)


def test_balanced_owners(spark):
    rng = random.Random(4)
    for k in (1, 2, 3, 5):
        sizes = [rng.randint(1, 60) for _ in range(37)]
        plan = spark.createDataFrame([(f"b{i}", n) for i, n in enumerate(sizes)], "bucket string, n long")
        load, names = defaultdict(int), [f"m{i}" for i in range(k)]
        got = labels.balanced_owners(plan, names).collect()
        for r in got:
            load[r["engine"]] += r["n"]
        assert len(got) == 37 and max(load[m] for m in names) - min(load[m] for m in names) <= max(sizes)


def test_rebuilt_rows_follow_their_anchor(spark):
    # each box is near the one before it, yet far from the row's first one
    boxes = [("s", float(10 - i), i * 4.0, 10.0, f"t{i}") for i in range(6)] + [("s", 0.0, 90.0, 0.0, "low"), ("s", 1.0, 90.5, 0.0, "by"), ("s", 2.0, 1.0, 5.0, ""), ("s", None, 1.0, 5.0, "no place"), ("u", 1.0, 1.0, 1.0, "only")]
    got = {r["sha256"]: r["text"] for r in practice.rebuild_rows(spark.createDataFrame(boxes, "sha256 string, x double, y double, height double, text string")).collect()}
    assert got == {"s": "t1 | t0\nt3 | t2\nt5 | t4\nlow | by", "u": "only"}


def test_export_of_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(2, "=1"), (1, "a,b")], "id long, cell string")
    path = str(tmp_path / "out.csv")
    assert files.export_file(rows, ["id"], path, {"id": "题号", "cell": "模块"}) == 2
    with open(path, "rb") as f:
        assert f.read().decode() == "﻿题号,模块\n1,\"a,b\"\n2,'=1\n"
    with pytest.raises(FileExistsError):
        files.export_file(rows, ["id"], path)
    for bad in (lambda: files.export_file(rows, ["id"], str(tmp_path / "b.csv"), limit=1), lambda: files.export_file(rows.select("id", F.raise_error(F.lit("x")).cast("string").alias("cell")), ["id"], str(tmp_path / "b.csv"))):
        with pytest.raises(Exception):  # noqa: B017
            bad()
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["out.csv"]


def test_search_index_compaction(spark, tmp_path):
    """Old segments stay for searches that have begun, then go; a broken compaction changes nothing."""
    index = SearchIndex(spark, str(tmp_path / "index"))
    assert index.compact() == 0
    lots = [[(1, "one apple"), (2, "two pears"), (3, "apples")], [(1, "one plum"), (2, "two pears"), (3, "apples")], [(1, "one plum"), (3, "apples"), (4, "")]]
    for lot in lots:
        index.update(spark.createDataFrame(lot, "id long, text string"), "id", "text")
    keys = lambda found: sorted(r.key for r in found.collect())
    begun = index.search("apple")
    assert len(index.segments()) == 3 and keys(index.search("plum")) == [1]
    (tmp_path / "index" / "texts" / "segment=000000004-broken-whole").mkdir()  # no mark: not seen
    assert index.compact() == 3 and len(index.segments()) == 1
    assert keys(begun) == keys(index.search("apple")) == [3] and keys(index.search("plum")) == [1] and keys(index.search("pears")) == [] and keys(index.search("")) == [1, 3, 4]
    assert index.compact() == 0 and len(list((tmp_path / "index" / "marks").glob("0*"))) == 1
    assert index.update(spark.createDataFrame([(1, "one plum"), (5, "an apple")], "id long, text string"), "id", "text") == 3
    assert keys(index.search("apple")) == [5] and keys(index.search("plum")) == [1] and len(index.segments()) == 2
