"""Prefix trie, importance resampling and quality classifier: brute force, edge cases, held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tamarack.llm import importance, prefix_trie, quality_classifier as qc


def tuples(d):
    return sorted(map(tuple, d.collect()), key=repr)


# prefix trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32]), (r, x)))
    own = {c: [v for _, v in sorted(x)] for c, x in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:]
        for k in range(len(seq) + 1):
            members[tuple(seq[:k])].add(c)
        ends[tuple(seq)].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n in sorted(members, key=len, reverse=True):
        leaves[n] += not children[n]
        saved[n] += (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
        if n:
            leaves[n[:-1]] += leaves[n]
            saved[n[:-1]] += saved[n]
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted(((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), children[n], leaves[n], saved[n], digest(n)) for n in members), key=repr)


def conversations():
    rng = random.Random(1)
    ids = [*range(-20, 30), *range(100, 260), *(2**62 + i for i in range(20))]
    rows = [(c, t, rng.choice("ab"), rng.choice(["x", "y", "zé"])) for c in ids for t in range(rng.randint(1, 7))]
    # long conversations that begin alike, copies, missing ids and turns, repeated rows, beginnings of each other
    rows += [(c, t, "u", str(t % 3)) for c, n in ((500, 300), (501, 350)) for t in range(n)]
    rows += [(1000 + i, t, "s", "same") for i in range(400) for t in range(3)] + [(2000, 1, "q", "q")] * 200
    rows += [(None, 1, "a", "b"), (7, None, None, None), (7, None, "a", None)] * 3 + [(3000 + i, t, "u", f"t{t}") for i in range(40) for t in range(i + 1)]
    return rows


@pytest.mark.parametrize("part_bytes,batch", [(8192, 10_000), (20, 7)])
def test_prefix_trie(spark, monkeypatch, part_bytes, batch):
    monkeypatch.setattr(prefix_trie, "PART_BYTES", part_bytes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = conversations()
        # other columns, of names that the operator uses, are not looked at
        d = spark.createDataFrame([(*r, 1, "p", b"h", 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, part string, hash binary, chain int")
        assert tuples(prefix_trie.prefix_trie(d)) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_prefix_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert tuples(prefix_trie.prefix_trie(spark.createDataFrame([], schema))) == []
    for rows in ([(1, 0, "a", "é")], [(105, 0, "a", "b")], [(None, 0, "a", "b")], [(100, 0, "u", "x"), (101, 0, "u", "x" * 100_000)]):
        assert tuples(prefix_trie.prefix_trie(spark.createDataFrame(rows, schema))) == brute_trie(rows)


def test_peeling_waits_for_all_children(spark):
    # 0 has two children, of which one has two more
    chains = spark.createDataFrame([(0, None, 0, 5), (1, 0, 1, 7), (2, 0, 0, 1), (3, 2, 1, 2), (4, 2, 1, 3)], "chain long, parent long, leaves long, saved long")
    assert tuples(prefix_trie.peel(chains)) == [(0, 3, 18), (1, 1, 7), (2, 2, 6), (3, 1, 2), (4, 1, 3)]


# importance resampling


def brute_importance(docs, target, percent=25):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *(" ".join(x) for x in zip(w, w[1:]))]]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out, eligible = {}, []
    for k, (i, x) in enumerate(docs):
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[k] = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= 20:
            eligible.append(k)
    eligible.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for r, k in enumerate(eligible[: percent * len(eligible) // 100]):
        out[k][4] = r + 1
    return sorted(map(tuple, out.values()), key=repr)


@pytest.mark.parametrize("block,percent", [(128, 25), (3, 60), (1, 100)])
def test_importance(spark, sf_dir, monkeypatch, block, percent):
    monkeypatch.setattr(importance, "BLOCK_ROWS", block)
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None, ""]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    # repeated rows, missing ids and texts, one id with a third of all rows
    docs += docs[:20] + [(None, docs[0][1]), (None, None), (-5, ""), (-6, " ".join(["A-b é9"] * 30))] + [(77, "same words of one text " * 6)] * 120
    d = spark.createDataFrame([(i, x, 1, 2, "r") for i, x in docs], "doc_id long, text string, score int, eligible int, range string").repartition(7)
    got = tuples(importance.importance(d, spark.createDataFrame([(x,) for x in target], "text string"), percent=percent))
    want = brute_importance(docs, target, percent)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    # equal rows may take each other's ranks
    ranked = lambda rows: sorted((r[4], r[3], r[0] or 0) for r in rows if r[4])
    assert ranked(got) == ranked(want)


def test_importance_of_few_rows(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    for rows in ([], [(1, "one two")], [(1, "w " * 20)], [(i, "w " * 20) for i in range(4)]):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        assert tuples(importance.importance(d, target)) == brute_importance(rows, ["a b"])
        assert tuples(importance.importance(d, target.limit(0))) == brute_importance(rows, [])


def test_tournament_merges_runs():
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9), k) for k in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        tree = importance.Tournament()
        for r in runs:
            tree.open(iter(r))
        out = []
        while tree.first() is not None:
            out.append(tree.take())
        assert out == sorted(x for r in runs for x in r)


def test_ranges_end_at_the_last_draw():
    histogram = [(s, 10) for s in range(100)]
    got = importance.ranges(histogram, 250, 5)
    assert got[0][1] == 0 and got[-1][0] == 75 and len(got) == 5 and [b for _, b in got] == [0, 50, 100, 150, 200]
    assert importance.ranges(histogram, 1, 5) == [(99, 0)] and importance.ranges([(3, 1000)], 250, 5) == [(3, 0)]


# quality classifier


def test_quality_on_held_out_labels(spark):
    """Labels that were not learned from, on the largest test table: 825 rows."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS y")
    out = qc.op11_quality_classifier(spark, sf)
    got = out.where("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", "y").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]) and out.count() == 10_000
    y, hit = got["y"].to_numpy(), got["predicted"].to_numpy() == 1
    rank = got["score"].rank().to_numpy()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert len(y) > 500 and auc > 0.98 and hit[y == 1].mean() > 0.98 and hit[y == 0].mean() < 0.1
    assert ((got["score"] >= 0) & (got["score"] <= 1) & ((got["score"] >= 0.3) == hit)).all()


def test_quality_of_odd_and_empty_tables(spark):
    good = [(i, " ".join(f"word{(i * k) % 97}" for k in range(1, 60)), 1) for i in range(1, 80)]
    bad = [(i, "$$$ ### " * 30, 0) for i in range(100, 160)]
    odd = [(200, None, None), (201, "", None), (202, " \n\t", None), (None, "x y", None), (203, "a " * 100_000, None), (1, good[0][1], 1)]
    d = spark.createDataFrame([(*r, 1, 2.0, "s") for r in good + bad + odd], "doc_id long, text string, y int, k int, score double, x string")
    labels = d.where("y IS NOT NULL").selectExpr("doc_id", "y AS quality", "0 AS toxic").union(spark.createDataFrame([(999, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int"))
    got = qc.quality(d, labels).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(good + bad + odd) and all(0 <= s <= 1 for s in score.values()) and score[200] == score[201] == score[202]
    assert all(score[i] >= 0.5 for i, _, _ in good) and all(score[i] < 0.3 for i, _, _ in bad)
    assert qc.quality(d.limit(0), labels).count() == 0
    assert {r["score"] for r in qc.quality(d, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in qc.quality(d, labels.limit(0)).collect()} == {0.0}


def test_flattened_trees_agree_with_walks():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 4, 600), np.zeros(600)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] == 2)).astype(float)
    trees = qc.fit(x, y, trees=12, depth=3, bins=16)

    def walk(row):
        out = trees.start
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if row[feature[k]] > threshold[k] else 1)
            out += value[k - len(feature)]
        return out

    assert np.allclose(trees.margins(x), [walk(r) for r in x]) and ((trees.scores(x) > 0.5) == (y == 1)).mean() > 0.97
    again = qc.fit(x, y, trees=12, depth=3, bins=16)
    assert (again.value == trees.value).all() and len(trees.margins(x[:0])) == 0


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(6)
    x, g, h = rng.integers(0, 5, (60, 3)), rng.normal(size=60), rng.uniform(0.2, 1, 60)
    hist = lambda v: np.array([[np.bincount(c, weights=v, minlength=5) for c in x.T]])
    f, b, gain = (v[0] for v in qc.best_splits(hist(g), hist(h)))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    every = {(i, j): part(x[:, i] <= j) + part(x[:, i] > j) - part(np.ones(60, bool)) for i in range(3) for j in range(4) if min(h[x[:, i] <= j].sum(), h[x[:, i] > j].sum()) >= 1}
    assert gain == pytest.approx(max(every.values())) and every[f, b] == pytest.approx(gain)


def test_statistics():
    s = dict(zip(qc.STATISTICS, qc.statistics("Aa bb bb\n\nAa, 1é $")))
    assert s["words"] == pytest.approx(math.log1p(6)) and s["lines"] == pytest.approx(math.log1p(2)) and s["distinct_words"] == 5 / 6 and s["same_next"] == 1 / 6
    assert s["commonest_word"] == 2 / 6 and s["distinct_pairs"] == 1.0 and s["symbols"] == pytest.approx(1 / 19) and s["other_bytes"] == pytest.approx(2 / 19)
    assert not qc.statistics(None).any() and not qc.statistics(" \n").any()
