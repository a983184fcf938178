"""Queries of forms, profiles, sessions by day, image texts and exports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import media, practice, study
from tamarack.plans.list_registry import _TEX_SQL
from tamarack.plans.registry import query, table
from tamarack.plans.store_registry import _folder
from tamarack.sources import files


@query(r"""WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN chr(9) || ' ' || text || chr(13) || chr(10) WHEN 1 THEN text || chr(8203) WHEN 2 THEN '<b>' || text WHEN 3 THEN text || chr(7) ELSE chr(12288) || text END AS x FROM documents),
s AS (SELECT doc_id, replace(replace(x, chr(13), chr(10)), chr(9), ' ') AS s FROM r)
SELECT doc_id, md5(CASE WHEN NOT regexp_matches(s, '[<>`\x{FFFD}\x{00}-\x{09}\x{0B}-\x{1F}\x{7F}-\x{9F}]|\p{Cf}') THEN regexp_replace(s, '^[\s\x{0b}\p{Z}]+|[\s\x{0b}\p{Z}]+$', '', 'g') END) AS clean_md5 FROM s""")
def sanitized_texts(spark, sf_dir):
    """Whole texts as form input: with blanks around, and with a sign that a form refuses in front or behind."""
    k = F.col("doc_id") % 5
    x = F.when(k == 0, F.concat(F.lit("\t "), "text", F.lit("\r\n"))).when(k == 1, F.concat("text", F.lit("​"))).when(k == 2, F.concat(F.lit("<b>"), "text")).when(k == 3, F.concat("text", F.lit("\x07"))).otherwise(F.concat(F.lit("　"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitize_text(x)).alias("clean_md5"))


@query(r"""WITH m AS (SELECT c_custkey, lower(trim(CASE c_custkey % 9 WHEN 0 THEN '  ' || c_name || '@Shop.Example ' WHEN 1 THEN c_name || '@shop' WHEN 2 THEN c_name || '@@shop.example' WHEN 3 THEN 'a b@shop.example' WHEN 4 THEN '@shop.example'
 WHEN 5 THEN repeat('é', CAST(c_custkey % 300 AS INT)) || '@shop.example' WHEN 6 THEN c_name || '@.' WHEN 7 THEN c_name || '.shop' ELSE '<' || c_name || '>@a.b' END)) AS mail FROM customer),
p AS (SELECT *, string_split(mail, '@') AS parts FROM m)
SELECT c_custkey, md5(mail) AS mail_md5, octet_length(CAST(encode(mail) AS BLOB)) <= 254 AND len(parts) = 2 AND parts[1] != '' AND contains(parts[2], '.') AND NOT regexp_matches(mail, '[ \t\r\n]') AS valid FROM p""")
def mail_addresses(spark, sf_dir):
    k, name = F.col("c_custkey") % 9, F.col("c_name")
    forms = {0: ("  ", name, "@Shop.Example "), 1: ("", name, "@shop"), 2: ("", name, "@@shop.example"), 3: ("a b", F.lit(""), "@shop.example"), 4: ("", F.lit(""), "@shop.example"), 5: ("", F.repeat(F.lit("é"), (F.col("c_custkey") % 300).cast("int")), "@shop.example"), 6: ("", name, "@."), 7: ("", name, ".shop"), 8: ("<", name, ">@a.b")}
    raw = F.coalesce(*(F.when(k == i, F.concat(F.lit(a), x, F.lit(b))) for i, (a, x, b) in forms.items()))
    c = table(spark, sf_dir, "customer").select("c_custkey", T.normalize_email(raw).alias("mail"))
    return c.select("c_custkey", F.md5("mail").alias("mail_md5"), T.valid_email("mail").alias("valid"))


@query("""WITH m AS (SELECT l_orderkey AS id, coalesce(string_agg(chr(64 + l_linenumber), '' ORDER BY l_linenumber) FILTER (l_quantity > 25), '') AS mark FROM lineitem GROUP BY 1)
SELECT id, mark, mark = 'A' AS agrees FROM m""")
def marked_options(spark, sf_dir):
    """Orders as questions, their lines as options: the letters marked as right, and whether the official answer is the same."""
    options = F.array_sort(F.collect_list(F.struct(F.chr(64 + F.col("l_linenumber").cast("long")).alias("label"), (F.col("l_quantity") > 25).alias("is_correct"))))
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(options.alias("options"))
    return q.select("id", T.mark_of(F.col("options")).alias("mark")).withColumn("agrees", F.col("mark") == "A")


@query("""WITH p AS (SELECT c_custkey AS user_id, CASE WHEN c_nationkey % 4 != 0 THEN c_nationkey END AS daily_questions, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment END AS bio, CAST(floor(c_acctbal) AS BIGINT) AS revision FROM customer WHERE c_custkey % 3 = 0)
SELECT c.c_custkey AS user_id, coalesce(daily_questions, 20) AS daily_questions, coalesce(bio, '') AS bio, coalesce(revision, 0) AS revision FROM customer c LEFT JOIN p ON p.user_id = c.c_custkey""")
def profiles_with_defaults(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    stored = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.when(n % 4 != 0, n).alias("daily_questions"), F.when(n % 3 == 0, F.col("c_mktsegment")).alias("bio"), F.floor("c_acctbal").cast("long").alias("revision"))
    return practice.profiles(c.select(F.col("c_custkey").alias("user_id")), stored, {"daily_questions": 20, "bio": "", "revision": 0})


@query("""WITH a AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'A' END AS answer, l_quantity > 25 AS ok FROM lineitem WHERE l_orderkey % 11 != 0),
n AS (SELECT k, count(*) FILTER (trim(answer) != '') AS answered, count(*) FILTER (trim(answer) != '' AND ok) AS correct FROM a GROUP BY 1)
SELECT o_custkey AS user_id, CAST(o_orderdate + INTERVAL 8 HOUR AS DATE) AS day, CAST(coalesce(sum(answered), 0) AS BIGINT) AS answered, CAST(coalesce(sum(correct), 0) AS BIGINT) AS correct, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS duration_ms, count(*) AS sessions
FROM orders LEFT JOIN n ON k = o_orderkey WHERE o_orderstatus != 'P' GROUP BY 1, 2""")
def session_days(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("submitted_at"), F.floor("o_totalprice").cast("long").alias("duration_ms"))
    a = table(spark, sf_dir, "lineitem").where("l_orderkey % 11 != 0").select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise("A").alias("user_answer"), (F.col("l_quantity") > 25).alias("is_correct"))
    return study.session_days(s, a)


@query(f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS url, class FROM ({_TEX_SQL})), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('s1' || url), url) AS round FROM c)
SELECT url, class, round FROM r ORDER BY round, list_position({list(media.SAMPLE_CLASSES)}, class) LIMIT 50""")
def image_class_samples(spark, sf_dir):
    """Texts as those read from images, in the four classes, of which a sample takes turns."""
    k, n = F.col("doc_id") % 4, (F.col("doc_id") % 100).cast("int")
    cut = lambda m: F.substr("text", F.lit(1), m)
    x = F.when(k == 0, F.concat(F.lit("　"), "text", F.lit("; ；"))).when(k == 1, F.concat(F.lit("$ "), cut(n), F.lit(" $ ="))).when(k == 2, cut(n)).otherwise(F.concat(F.lit("题 "), cut((F.col("doc_id") % 90).cast("int"))))
    images = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), x.alias("ocr_tex"))
    return media.class_samples(images, 50, "s1").select("url", "class", F.col("round").cast("long").alias("round"))


@query("""WITH i AS (SELECT doc_id, md5(text) AS sha FROM documents), r AS (SELECT sha, CASE min(doc_id) % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' ELSE 'error' END AS st, 'tex ' || min(doc_id) AS tex FROM i GROUP BY 1 HAVING min(doc_id) % 4 != 0)
SELECT CAST(doc_id AS VARCHAR) AS url, i.sha AS sha256, st AS ocr_status, tex AS ocr_tex FROM i LEFT JOIN r ON r.sha = i.sha""")
def results_by_content(spark, sf_dir):
    """Results of the work list reach all images of the same content."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sha256"))
    first = d.groupBy("sha256").agg(F.min("doc_id").alias("k")).where("k % 4 != 0")
    r = first.select("sha256", F.when(F.col("k") % 3 == 0, "ok").when(F.col("k") % 3 == 1, "empty").otherwise("error").alias("status"), F.concat(F.lit("tex "), F.col("k").cast("string")).alias("tex"))
    images = d.select(F.col("doc_id").cast("string").alias("url"), "sha256", F.lit(None).cast("string").alias("ocr_status"), F.lit(None).cast("string").alias("ocr_tex"))
    return media.apply_results(images, r)


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN '=' || min(o_orderpriority) ELSE max(o_orderpriority) || ', "x"' END AS note FROM orders GROUP BY 1),
l AS (SELECT day, day || ',' || n || ',' || CASE WHEN n % 2 = 0 THEN '''' || note ELSE '"' || replace(note, '"', '\\"') || '"' END AS line FROM d)
SELECT line, CAST(1 AS BIGINT) AS marks, (SELECT count(*) FROM d) AS n FROM (SELECT line FROM l UNION ALL SELECT '日期,n,note')""".replace("\\\\", "\\"))
def exported_file(spark, sf_dir):
    """Orders by day as one CSV file with a byte-order mark and guarded cells, read again line by line."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("low"), F.max("o_orderpriority").alias("high"))
    note = F.when(F.col("n") % 2 == 0, F.concat(F.lit("="), "low")).otherwise(F.concat("high", F.lit(', "x"')))
    path = _folder(spark, "export") + ".csv"
    n = files.export_file(o.select("day", "n", note.alias("note")), ["day"], path, {"day": "日期"})
    marks = spark.read.format("binaryFile").load(path).where("hex(substring(content, 1, 3)) = 'EFBBBF'").count()
    return spark.read.text(path).select(F.col("value").alias("line"), F.lit(marks).cast("long").alias("marks"), F.lit(n).cast("long").alias("n"))
