from pyspark.sql import functions as F

from tamarack.streaming import replay


def test_rate_limit(spark):
    rows = [("a", t, False) for t in (0, 10, 20, 30, 100, 101)] + [("b", 0, False), ("b", 1, True), ("b", 2, False)]
    d = replay.rate_limited(spark.createDataFrame(rows, "key string, at long, ok boolean"), limit=2, window_s=100)
    got = {(r.key, r["at"]): r.blocked for r in d.collect()}
    assert got == {("a", 0): False, ("a", 10): False, ("a", 20): True, ("a", 30): True, ("a", 100): False, ("a", 101): False, ("b", 0): False, ("b", 1): False, ("b", 2): False}


def test_ingest_and_state(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 5, 1, "wrong"), (1, 5, 2, "right"), (1, 6, 1, "right"), (2, 5, 1, "wrong"), (2, 5, 2, "blank")], "user_id long, question_id long, at long, kind string")
    rows.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        replay.ingest_available(spark, source, rows.schema, target, str(tmp_path / "check"))
    assert spark.read.parquet(target).count() == 5
    q = replay.wrongbook_updates(spark.readStream.schema(rows.schema).parquet(target)).writeStream.format("memory").queryName("wrongs").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user_id, r.question_id): (r.wrong_count, r.resolved) for r in spark.table("wrongs").orderBy(F.col("user_id")).collect()}
    assert got == {(1, 5): (1, True), (2, 5): (1, False)}


def test_kept_wrongbook(spark, tmp_path):
    """Lots that come late and mixed, a lot without news, rows that count for nothing, and a batch that broke."""
    folder, source = str(tmp_path / "book"), str(tmp_path / "in")
    assert replay.read_wrongbook(spark, folder).count() == 0
    schema = "user_id long, question_id string, at long, wrong boolean"
    lots = [[(1, "a", 5, False), (1, "b", 1, True), (None, "a", 1, True), (1, None, 1, True)], [(1, "a", 2, True), (1, "b", 3, True), (2, "c", 1, None)], [(3, "d", 9, False)]]
    for lot in lots:
        spark.createDataFrame(lot, schema).write.mode("append").parquet(source)
        replay.keep_wrongbook(spark.readStream.schema(schema).parquet(source), folder)
    want = {(1, "a"): (1, 2, True), (1, "b"): (2, 3, False)}
    found = lambda: {(r.user_id, r.question_id): (r.wrong_count, r.last_wrong, r.resolved) for r in replay.read_wrongbook(spark, folder).collect()}
    assert found() == want
    replay.keep_wrongbook(spark.readStream.schema(schema).parquet(source), folder)  # nothing new
    assert found() == want
    last = sorted((tmp_path / "book" / "checkpoint" / "commits").glob("[0-9]*"))[-1]
    (last.parent / f".{last.name}.crc").unlink()
    last.unlink()  # the last batch wrote its rows and broke before its end was noted: it runs again under its number
    replay.keep_wrongbook(spark.readStream.schema(schema).parquet(source), folder)
    assert found() == want
