import random
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from tamarack.operators import practice, study
from tamarack.plans import registry
from tamarack.sources import files
from tamarack.streaming import replay


def test_faults_and_submit(spark):
    session = spark.createDataFrame([(1, "single"), (2, "multi"), (3, "judge")], "question_id long, answer_type string")
    options = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "C")], "question_id long, label string")
    answers = spark.createDataFrame([(1, "AB", 5), (2, "AD", -1), (9, "A", 1), (3, "B", 1), (3, "B", 1)], "question_id long, answer string, duration_ms long")
    got = sorted((r.question_id, r.fault) for r in practice.answer_faults(answers, session, options).collect())
    assert got == [(1, "several_letters"), (2, "duration"), (2, "not_an_option"), (3, "repeated"), (9, "not_in_session")]
    q = spark.createDataFrame([(1, "single", "A", "c"), (2, "multi", "AC", "c")], "question_id long, answer_type string, answer string, concept string")
    a = spark.createDataFrame([(7, 1, "B", 1), (7, 1, "A", 2), (7, 2, "", 3), (7, 2, "ca", 4)], "user_id long, question_id long, answer string, at long")
    graded, wrong, known = practice.submit(a, q)
    assert sorted((r["at"], r.is_correct) for r in graded.collect()) == [(1, False), (2, True), (3, False), (4, True)]
    assert [(r.question_id, r.wrong_count, r.resolved) for r in wrong.collect()] == [(1, 1, True)]
    assert [(r.answered, r.correct) for r in known.collect()] == [(3, 2)]


def test_progress(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 10, '{"paper_id": 5}', [1, 2], '[{"question_id":1,"answer":"A"}]', None, t), (1, 11, '{"paper_id": 5}', [1, 2], "[]", t, t), (1, 12, "bad", [1], None, None, t)]
    s = spark.createDataFrame(rows, "user_id long, id long, spec string, question_ids array<long>, draft string, submitted_at timestamp, started_at timestamp")
    assert [(r.id, r.saved, r.total, r.action) for r in practice.paper_progress(s).collect()] == [(10, 1, 2, "resume")]
    assert sorted(r.id for r in practice.latest_unfinished(s, 1).collect()) == [12]


def test_select_and_profiles(spark):
    q = spark.createDataFrame([(i, "single" if i % 2 else "other") for i in range(10)], "id long, answer_type string")
    only = spark.createDataFrame([(1,), (3,), (4,)], "id long")
    assert sorted(r.id for r in practice.select_questions(q, 5, "s", only).collect()) == [1, 3]
    paper = spark.createDataFrame([(3, 1), (1, 2)], "id long, number int")
    assert [r.id for r in practice.select_questions(q, 5, "s", paper=paper).collect()] == [3, 1]
    p = practice.profiles(spark.createDataFrame([(1,), (2,)], "user_id long"), spark.createDataFrame([(1, 30)], "user_id long, goal int"), {"goal": 20})
    assert sorted((r.user_id, r.goal) for r in p.collect()) == [(1, 30), (2, 20)]


def test_rebuild_rows(spark):
    b = spark.createDataFrame([("s", 50.0, 1.0, 10.0, "b"), ("s", 0.0, 0.0, 10.0, "a"), ("s", 0.0, 20.0, 10.0, "c")], "sha256 string, x double, y double, height double, text string")
    assert practice.rebuild_rows(b).first().text == "a | b\nc"


def test_one_model(spark):
    rows = spark.createDataFrame([("b1", "m1", 1), ("b2", None, 2), ("b1", "m1", 3)], "bucket string, engine string, id long")
    label = lambda m, f: pd.DataFrame({"id": f["id"], "model": m})
    got = practice.one_model_per_bucket(rows, "bucket", "engine", "m0", label, "id long, model string")
    assert sorted((r.id, r.model) for r in got.collect()) == [(1, "m1"), (2, "m0"), (3, "m1")]


def test_folds_keep_no_group_whole(spark):
    rng = random.Random(3)
    rows = [(1 if i % 3 else 2 + i % 7, i, datetime(2024, 1, 1 + i // 700), rng.choice([None, *range(5)]), rng.random() < 0.3) for i in range(3000)]
    d = spark.createDataFrame(rows, "u long, i long, ts timestamp, n int, ok boolean").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        quota, drafts = study.accepted_requests(d, "u", "ts", "n", 40, "i"), study.accepted_revisions(d, "u", "i", "n")
        limited = replay.rate_limited(d.selectExpr("u AS key", "i AS at", "ok"), 3, 50)
        for x in (quota, drafts, limited):
            assert "collect_list" not in x._jdf.queryExecution().toString()
        got = [{(r.i): r.accepted for r in x.collect()} for x in (quota, drafts)] + [{r["at"]: r.blocked for r in limited.collect()}]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    used, rev, since, want = {}, {}, {}, ({}, {}, {})
    for u, i, ts, n, ok in rows:
        a = used.get((u, ts), 0)
        want[0][i] = None if n is None else a + n <= 40
        used[u, ts] = a + n if want[0][i] else a
        b = rev.get(u, 0)
        want[1][i] = None if n is None else n == b
        rev[u] = b + 1 if n == b else b
        s, k = since.get(u, (0, 0))
        fresh = k == 0 or i >= s + 50
        want[2][i] = not fresh and k >= 3
        if not want[2][i]:
            since[u] = (0, 0) if ok else (i, 1) if fresh else (s, k + 1)
    assert got == list(want)


def test_milestones_know_streaks(spark, tmp_path):
    days = {1: [*range(1, 8), 20], 2: range(1, 31), 3: [1, 3, 5]}
    rows = [(u, "view", datetime(2024, 1, k, 3)) for u, ks in days.items() for k in ks]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.user_id, r.name): (r.progress, r.reached) for r in registry.QUERIES["milestones_with_streaks"](spark, str(tmp_path)).collect()}
    assert [got[u, "week_streak"] for u in days] == [(7, True), (7, True), (1, False)]
    assert [got[u, "month_streak"] for u in days] == [(7, False), (30, True), (1, False)]


def test_image_size_behind_long_metadata(spark, tmp_path):
    segment = b"\xff\xe1\xff\xff" + b"x" * 65533
    frame = b"\xff\xc0\x00\x11\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x03" + b"\x01\x22\x00" * 3
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + segment * 2 + frame)
    r = files.image_index(spark, str(tmp_path)).first()
    assert (r.bytes, r.width, r.height) == (2 + 2 * 65537 + len(frame), 640, 480)


def test_session_days(spark):
    s = spark.createDataFrame([(1, 7, "2024-01-01 15:59:59", 10), (2, 7, "2024-01-01 16:00:00", 20), (3, 7, "2024-01-01 17:00:00", None), (4, 7, None, 99)], "session_id long, user_id long, at string, duration_ms long")
    a = spark.createDataFrame([(1, "A", True), (1, " ", True), (1, None, None), (1, "B", False), (2, "A", None), (4, "A", True)], "session_id long, user_answer string, is_correct boolean")
    got = study.session_days(s.withColumn("submitted_at", F.col("at").cast("timestamp")), a).orderBy("day").collect()
    assert [(str(r.day), r.answered, r.correct, r.duration_ms, r.sessions) for r in got] == [("2024-01-01", 2, 1, 10, 1), ("2024-01-02", 1, 0, 20, 2)]
