"""Queries over stored tables: search index, versions, derived columns, shards, ordered hashes, and limits in order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.operators import labels, media, practice, study, tables
from tamarack.operators.search import SearchIndex
from tamarack.plans.registry import ORACLES, SQL_K, query, right, table
from tamarack.sources import versions
from tamarack.streaming import limits

_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index over the documents, made once for an application and kept as a table."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        index = SearchIndex(spark, _folder(spark, "search"))
        index.update(table(spark, sf_dir, "documents"), "doc_id", "text")
        _INDEXES[at] = index
    return _INDEXES[at]


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot')")
def trigram_search(spark, sf_dir):
    return stored_index(spark, sf_dir).search("Idiot").select(F.col("key").alias("doc_id"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed ' || text || ' Wörter' ELSE text END AS text FROM documents WHERE doc_id % 5 != 0),
n AS (SELECT count(*) FILTER (doc_id % 2 = 0) AS first, count(*) FILTER (doc_id % 2 = 1 OR doc_id % 3 = 0 OR doc_id % 5 = 0) AS second FROM documents)
SELECT doc_id, CASE WHEN contains(text, 'Wörter') THEN 'changed' ELSE 'plain' END AS state, n.first, CAST(n.second - (SELECT count(*) FROM documents WHERE doc_id % 2 = 1 AND doc_id % 5 = 0) AS BIGINT) AS second, CAST(0 AS BIGINT) AS third
FROM t, n WHERE contains(lower(text), ' wörter') OR contains(lower(text), 'idiot')""")
def search_index_updates(spark, sf_dir):
    """Half of the texts, then all with changes and without some, then the same again: what each step writes, and what is found."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = d.where("doc_id % 5 != 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("changed "), "text", F.lit(" Wörter"))).otherwise(F.col("text")))
    index = SearchIndex(spark, _folder(spark, "search"))
    written = [index.update(rows, "doc_id", "text") for rows in (d.where("doc_id % 2 = 0"), now, now)]
    found = index.search(" WÖRTER").union(index.search("idiot")).groupBy("key").agg(F.first("text").alias("text"))
    state = F.when(F.col("text").contains("Wörter"), "changed").otherwise("plain")
    return found.select(F.col("key").alias("doc_id"), state.alias("state"), *(F.lit(n).cast("long").alias(c) for n, c in zip(written, ("first", "second", "third"))))


@query("""SELECT doc_id, CAST(3 AS BIGINT) AS before, CAST(1 AS BIGINT) AS after, (SELECT count(*) FROM documents WHERE doc_id % 3 != 0) AS texts, CAST(0 AS BIGINT) AS again FROM documents WHERE doc_id % 3 != 0 AND contains(lower(text), CASE WHEN doc_id % 4 = 1 THEN 'the' ELSE 'tion' END)
UNION ALL SELECT doc_id, 3, 1, (SELECT count(*) FROM documents WHERE doc_id % 3 != 0), 0 FROM documents WHERE doc_id % 3 != 0 AND doc_id % 4 = 1 AND contains(lower(text || ' Zusatz'), 'zusatz')""")
def search_index_compacted(spark, sf_dir):
    """Three segments, the last of which takes texts away, brought into one: what it holds, and what is found in it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    longer = d.withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" Zusatz"))).otherwise(F.col("text")))
    index = SearchIndex(spark, _folder(spark, "search"))
    for rows in (d, longer, longer.where("doc_id % 3 != 0")):
        index.update(rows, "doc_id", "text")
    before, texts = len(index.segments()), index.compact()
    after, again = len(index.segments()), index.compact()
    found = index.search("THE").where("key % 4 = 1").union(index.search("tion").where("key % 4 != 1")).union(index.search("Zusatz"))
    return found.select(F.col("key").alias("doc_id"), *(F.lit(n).cast("long").alias(c) for n, c in ((before, "before"), (after, "after"), (texts, "texts"), (again, "again"))))


LIMIT, WINDOW_S, CAP = 2, 3 * 86400, 20


@query(f"""WITH RECURSIVE e AS (SELECT event_type AS bucket, event_id AS id, user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t, coalesce({SQL_K} >= 50, false) AS ok, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
r AS (SELECT bucket, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(k BIGINT, n BIGINT, u BIGINT)[]) AS s, CAST(NULL AS BIGINT) AS id, false AS blocked, false AS counted FROM (SELECT DISTINCT bucket FROM e)
UNION ALL SELECT bucket, i, CASE WHEN n >= {LIMIT} THEN s WHEN ok THEN list_filter(s, lambda x: x.k != k) WHEN n > 0 THEN list_transform(s, lambda x: {{'k': x.k, 'n': CASE WHEN x.k = k THEN x.n + 1 ELSE x.n END, 'u': x.u}})
    WHEN len(s) >= {CAP} THEN s ELSE list_append(s, {{'k': k, 'n': CAST(1 AS BIGINT), 'u': CAST(t + {WINDOW_S} AS BIGINT)}}) END, id, n >= {LIMIT}, n < {LIMIT} AND NOT ok AND (n > 0 OR len(s) < {CAP})
  FROM (SELECT *, coalesce(list_filter(s, lambda x: x.k = k)[1].n, 0) AS n FROM (SELECT r.bucket, e.i, e.id, e.k, e.t, e.ok, list_filter(r.s, lambda x: x.u > e.t) AS s FROM r JOIN e ON e.bucket = r.bucket AND e.i = r.i + 1)))
SELECT bucket, id, blocked, counted FROM r WHERE i > 0""")
def capped_limits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("bucket"), F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), right().alias("ok"))
    return limits.capped_limits(e, LIMIT, WINDOW_S, CAP)


_CELL = "coalesce(length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '~')"


@query(f"""WITH h AS (SELECT doc_id, CAST('0x' || substr(sha256({' || '.join(_CELL.format(c) for c in ('doc_id', 'text', 'lang'))}), 1, 15) AS BIGINT) AS h FROM documents),
l AS (SELECT count(*) AS n, list(CAST(h AS HUGEINT) ORDER BY doc_id, h) AS xs FROM h)
SELECT sha256(concat_ws(':', n, {', '.join(f"list_reduce(list_concat([CAST(0 AS HUGEINT)], xs), lambda s, x: (s * {p} + x) % {labels.PRIME})" for p in labels.POINTS)})) AS input_hash FROM l""")
def ordered_input_hash(spark, sf_dir):
    return labels.input_hash(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang"])


@query(f"SELECT * FROM ({ORACLES['daily_activity_utc8']}), (SELECT CAST(1 AS INT) AS version, count(*) AS events, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS events_of_next FROM events)")
def pinned_dashboard(spark, sf_dir):
    """Parts of a dashboard read from one version, while a writer publishes the next one between them."""
    root = _folder(spark, "versions")
    e = table(spark, sf_dir, "events")
    version = versions.publish(spark, root, {"events": e, "customer": table(spark, sf_dir, "customer")})
    read = versions.pinned(spark, root)
    before = read("events").agg(F.count("*").alias("events"))
    following = versions.publish(spark, root, {"events": e.where("event_id % 2 = 0")})
    later = versions.pinned(spark, root, following)("events").agg(F.count("*").alias("events_of_next"))
    days = study.daily_activity(read("events"), "user_id", "ts", right(), "value")
    for one in (before, read("customer").agg(F.count("*").alias("customers")), later):
        days = days.join(one)  # one row each
    return days.withColumn("version", F.lit(version))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE lower(lang) END AS shown, n_chars, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS changed, CAST(0 AS BIGINT) AS again FROM documents""")
def derived_column_update(spark, sf_dir):
    path = _folder(spark, "derived")
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("lang").alias("shown"), "n_chars")
    tables.write_parted(d, path, "doc_id", 16)
    new = d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.upper("shown")).otherwise(F.col("shown")).alias("shown"))
    n = [tables.update_derived(spark, path, "doc_id", new, 16) for _ in range(2)]
    return spark.read.parquet(path).select("doc_id", "shown", "n_chars", F.lit(n[0]).cast("long").alias("changed"), F.lit(n[1]).cast("long").alias("again"))


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.md5("text").alias("sha256"), F.lit(None).cast("string").alias("ocr_status"))
    return media.shards(media.ocr_worklist(images), 100)


_WORK_SQL = "SELECT md5(text) AS sha256, min(CAST(doc_id AS VARCHAR)) AS url, (row_number() OVER (ORDER BY md5(text)) - 1) // 100 AS shard FROM documents GROUP BY 1"


@query(_WORK_SQL)
def work_shards(spark, sf_dir):
    return _work(spark, sf_dir)


@query(f"""WITH w AS ({_WORK_SQL}), r AS (SELECT shard, CASE WHEN shard % 3 = 1 AND url LIKE '%1' THEN 'z' || url ELSE sha256 END AS sha256, CASE WHEN shard % 4 = 2 AND url LIKE '%3' THEN 'odd' ELSE 'ok' END AS status FROM w WHERE url NOT LIKE '%5'),
f AS (SELECT r.shard FROM r LEFT JOIN w ON w.shard = r.shard AND w.sha256 = r.sha256 WHERE w.sha256 IS NULL OR r.status = 'odd')
SELECT 'accepted' AS state, shard, count(*) AS n FROM r WHERE shard NOT IN (SELECT shard FROM f) GROUP BY shard
UNION ALL SELECT 'bad_status', shard, count(*) FROM r WHERE status = 'odd' GROUP BY shard
UNION ALL SELECT 'unknown', shard, count(*) FROM r WHERE sha256 LIKE 'z%' GROUP BY shard""")
def shards_taken_whole(spark, sf_dir):
    w = _work(spark, sf_dir)
    digest = F.when((F.col("shard") % 3 == 1) & F.col("url").endswith("1"), F.concat(F.lit("z"), "url")).otherwise(F.col("sha256"))
    r = w.where("url NOT LIKE '%5'").select("shard", digest.alias("sha256"), F.when((F.col("shard") % 4 == 2) & F.col("url").endswith("3"), "odd").otherwise("ok").alias("status"))
    taken, faults = media.accepted_results(w, r)
    return taken.groupBy("shard").agg(F.count("*").alias("n")).select(F.lit("accepted").alias("state"), "shard", "n").union(faults.select("fault", "shard", "n"))


@query("""WITH b AS (SELECT source || '/' || coalesce(lang, '(无标签)') AS bucket, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, (row_number() OVER (ORDER BY n DESC, bucket) - 1) % 6 AS t FROM b)
SELECT bucket, n, ['m0', 'm1', 'm2'][CASE WHEN t < 3 THEN t ELSE 5 - t END + 1] AS engine FROM o""")
def balanced_bucket_owners(spark, sf_dir):
    return labels.balanced_owners(labels.buckets(table(spark, sf_dir, "documents"), "source", F.col("lang")), ["m0", "m1", "m2"])


@query("""WITH RECURSIVE b AS (SELECT CAST(l_suppkey AS VARCHAR) AS sha256, CAST(l_quantity AS DOUBLE) AS x, l_orderkey * 13.0 + (l_linenumber % 4) AS c, 0.6 * greatest(l_linenumber, 1) AS reach, CAST(l_partkey AS VARCHAR) AS text FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY c, x, text) AS i FROM b),
r AS (SELECT sha256, i, x, c, text, c AS anchor, reach AS far, 0 AS row FROM o WHERE i = 1
UNION ALL SELECT o.sha256, o.i, o.x, o.c, o.text, CASE WHEN abs(o.c - r.anchor) > r.far THEN o.c ELSE r.anchor END, CASE WHEN abs(o.c - r.anchor) > r.far THEN o.reach ELSE r.far END, r.row + CAST(abs(o.c - r.anchor) > r.far AS INT) FROM r JOIN o ON o.sha256 = r.sha256 AND o.i = r.i + 1),
l AS (SELECT sha256, row, string_agg(text, ' | ' ORDER BY x, c, text) AS text FROM r GROUP BY sha256, row)
SELECT sha256, md5(string_agg(text, chr(10) ORDER BY row)) AS text_md5, count(*) AS n_rows FROM l GROUP BY sha256""")
def rebuilt_table_rows(spark, sf_dir):
    line = F.col("l_linenumber").cast("double")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("sha256"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_orderkey") * 13.0 + F.col("l_linenumber") % 4 - line / 2).alias("y"), line.alias("height"), F.col("l_partkey").cast("string").alias("text"))
    r = practice.rebuild_rows(b)
    return r.select("sha256", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n")).cast("long").alias("n_rows"))
