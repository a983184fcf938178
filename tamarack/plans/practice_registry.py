"""Queries of practice sessions, checks and reports, with their DuckDB SQL, over stand-ins from the driver tables.

``events`` are answers: seven in a row make a session, questions are numbered by ``event_id % 200``, and ``props.k``
gives what was answered.  ``part`` gives labels and concepts, ``orders`` sessions on papers and their drafts.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from tamarack.functions import answers as A, text as T
from tamarack.operators import labels, media, practice, study
from tamarack.plans.registry import QUERIES, SQL_K, query, score, table

SQL_ANSWERS = f"""a AS (SELECT event_id, user_id, ts, event_id % 200 AS question_id, event_id // 7 AS session_id, {SQL_K} AS k,
CASE {SQL_K} % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE 'A' END AS user_answer, {SQL_K} >= 50 AS is_correct FROM events),
s AS (SELECT session_id AS id, min(user_id) AS user_id, CASE WHEN session_id % 5 != 0 THEN max(ts) END AS submitted_at FROM a GROUP BY session_id)"""
SQL_LABELS = """l AS (SELECT p_partkey AS id, p_partkey % 200 AS question_id, p_brand AS subject, p_type AS tertiary FROM part),
n AS (SELECT question_id, arg_max(subject, id) AS subject, arg_max(tertiary, id) AS tertiary FROM l GROUP BY 1),
c AS (SELECT min(id) AS id, subject AS module, tertiary AS name FROM l WHERE tertiary != 'x' GROUP BY 2, 3)"""


def _answers(spark, sf_dir) -> DataFrame:
    k = score()
    e = table(spark, sf_dir, "events").withColumn("question_id", F.col("event_id") % 200).withColumn("session_id", F.expr("event_id div 7"))
    return e.withColumn("k", k).withColumn("user_answer", F.when(k % 4 == 0, "").when(k % 4 == 1, " ").otherwise("A")).withColumn("is_correct", k >= 50)


def _sessions(answers: DataFrame) -> DataFrame:
    return answers.groupBy(F.col("session_id").alias("id")).agg(F.min("user_id").alias("user_id"), F.when(F.col("session_id") % 5 != 0, F.max("ts")).alias("submitted_at"))


def _labels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 200).alias("question_id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("tertiary"))
    return l, l.groupBy(F.col("subject").alias("module"), F.col("tertiary").alias("name")).agg(F.min("id").alias("id"))


@query(f"""WITH {SQL_ANSWERS}, u AS (SELECT DISTINCT user_id FROM a),
w AS (SELECT user_id, question_id, arg_max(is_correct, event_id) AS resolved FROM a GROUP BY 1, 2 HAVING count(*) FILTER (NOT is_correct) > 0)
SELECT u.user_id, (SELECT count(*) FROM a WHERE a.user_id = u.user_id AND user_answer <> '') AS answered, (SELECT count(*) FROM a WHERE a.user_id = u.user_id AND user_answer <> '' AND is_correct) AS correct,
(SELECT count(*) FROM w WHERE w.user_id = u.user_id AND NOT resolved) AS wrong, (SELECT count(*) FROM a JOIN events e ON e.event_id = a.event_id WHERE a.user_id = u.user_id AND e.event_type = 'purchase') AS favorites,
(SELECT count(*) FROM s WHERE s.user_id = u.user_id AND submitted_at IS NOT NULL) AS sessions FROM u""")
def user_stats(spark, sf_dir):
    a = _answers(spark, sf_dir)
    wrong = study.wrongbook(a, "user_id", "question_id", "event_id", ~F.col("is_correct"))
    return practice.user_stats(a, wrong, a.where("event_type = 'purchase'"), _sessions(a))


@query(f"""WITH {SQL_ANSWERS}, {SQL_LABELS}
SELECT s.user_id, c.id AS concept_id, count(*) AS answered, CAST(sum(CAST(is_correct AS INT)) AS BIGINT) AS correct, CAST(sum(CAST(is_correct AS INT)) AS DOUBLE) / count(*) AS mastery
FROM a JOIN s ON s.id = a.session_id JOIN n ON n.question_id = a.question_id JOIN c ON c.module = n.subject AND c.name = n.tertiary WHERE submitted_at IS NOT NULL AND user_answer <> '' GROUP BY 1, 2""")
def concept_mastery(spark, sf_dir):
    a, (l, c) = _answers(spark, sf_dir), _labels(spark, sf_dir)
    return study.mastery(practice.labelled_answers(a, _sessions(a), l, c), ["user_id", "concept_id"], F.col("is_correct"))


@query(f"""WITH m(event_type, place) AS (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('signup', 3), ('error', 4)), g AS (SELECT user_id, event_type, count(*) AS answered, count(*) FILTER ({SQL_K} >= 50) AS correct FROM events GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT user_id, g.event_type, answered, correct, row_number() OVER (PARTITION BY user_id ORDER BY CAST(correct AS DOUBLE) / answered, place) AS rank FROM g JOIN m ON m.event_type = g.event_type QUALIFY rank <= 3""")
def weak_modules(spark, sf_dir):
    order = spark.createDataFrame([(m, i) for i, m in enumerate(("view", "click", "purchase", "signup", "error"))], "event_type string, place int")
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("answered"), F.count_if(score() >= 50).alias("correct"))
    return practice.weak_in_order(g.join(order, "event_type"), "user_id", "place").drop("place")


SQL_QUESTIONS = """q AS (SELECT p_partkey AS id, p_brand AS module, p_name AS stem, CASE p_partkey % 3 WHEN 0 THEN 'judge' WHEN 1 THEN 'single' ELSE 'multi' END AS answer_type, p_type AS a, p_type || p_size AS b, 'why ' || p_name AS explanation FROM part)"""


def _questions(spark, sf_dir) -> DataFrame:
    m = F.col("p_partkey") % 3
    option = lambda label, content, right: F.struct(F.lit(label).alias("label"), content.alias("content"), F.lit(right).alias("is_correct"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("module"), F.col("p_name").alias("stem"), F.when(m == 0, "judge").when(m == 1, "single").otherwise("multi").alias("answer_type"),
        F.array(option("A", F.col("p_type"), True), option("B", F.concat("p_type", F.col("p_size").cast("string")), False)).alias("options"), F.lit("A").alias("answer"), F.concat(F.lit("why "), "p_name").alias("explanation"),
    )


@query(f"WITH {SQL_QUESTIONS} SELECT id, module, stem, answer_type, CASE WHEN answer_type = 'judge' THEN 'A=正确|B=错误' ELSE 'A=' || a || '|B=' || b END AS options FROM q")
def question_view(spark, sf_dir):
    v = practice.hidden_view(_questions(spark, sf_dir))
    return v.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["label"], o["content"])), "|"))


@query(f"WITH {SQL_ANSWERS}, {SQL_QUESTIONS} SELECT DISTINCT a.user_id, q.id, 'A' AS answer, explanation FROM a JOIN s ON s.id = a.session_id JOIN q ON q.id = a.question_id WHERE user_answer <> '' AND submitted_at IS NOT NULL")
def question_reveal(spark, sf_dir):
    a = _answers(spark, sf_dir)
    a = a.join(_sessions(a).select(F.col("id").alias("session_id"), "submitted_at"), "session_id")
    return practice.revealed(_questions(spark, sf_dir), a)


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00'")
def session_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    return practice.alive(e, F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")).select("event_id", "user_id")


@query(f"""SELECT event_type AS model, count(*) AS questions, count(*) FILTER ({SQL_K} % 3 = 0) AS ok, count(*) FILTER ({SQL_K} % 3 = 1) AS failed, count(*) FILTER ({SQL_K} % 3 = 2) AS skipped, CAST(sum({SQL_K}) AS BIGINT) AS tokens_in, CAST(sum({SQL_K} * 2) AS BIGINT) AS tokens_out,
sum(CASE WHEN {SQL_K} > 10 THEN CAST({SQL_K} * 0.5 AS DOUBLE) END) AS cost_usd, CAST(sum({SQL_K} % 7) AS BIGINT) AS duration_sec, string_agg(DISTINCT 'b' || user_id % 4, ',' ORDER BY 'b' || user_id % 4) AS buckets FROM events GROUP BY 1""")
def engine_totals(spark, sf_dir):
    k = score()
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.when(k % 3 == 0, "ok").when(k % 3 == 1, "failed").otherwise("skipped").alias("status"), k.alias("tokens_in"), (k * 2).alias("tokens_out"), F.when(k > 10, k * F.lit(0.5)).alias("cost_usd"), (k % 7).alias("duration_sec"), F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("bucket"))
    return practice.engine_totals(calls).withColumn("buckets", F.array_join("buckets", ","))


@query("""WITH k AS (SELECT p_partkey AS id, p_brand AS module, CASE WHEN p_partkey % 4 = 0 THEN 'gone' ELSE p_type END AS name, p_name AS signal FROM part WHERE p_partkey % 5 != 0),
c AS (SELECT min(p_partkey) AS concept_id, p_brand, p_type FROM part WHERE p_partkey % 2 = 0 GROUP BY 2, 3)
SELECT k.id, CAST(0 AS INT) AS at, name, signal, coalesce(concept_id, 0) AS concept_id FROM k LEFT JOIN c ON c.p_brand = k.module AND c.p_type = k.name""")
def related_concepts(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 4 == 0, "gone").otherwise(F.col("p_type"))
    card = F.to_json(F.array(F.struct(name.alias("考点"), F.col("p_name").alias("区分信号"))))
    p = table(spark, sf_dir, "part")
    cards = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("module"), F.when(F.col("p_partkey") % 5 != 0, card).otherwise("no list").alias("confusable"))
    return practice.related_concepts(cards, p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("module"), F.col("p_type").alias("name")))


@query("""WITH x AS (SELECT c_custkey, CAST(c_custkey % 12 AS INT) AS avatar_id, CAST(c_custkey % 250 AS INT) AS q, CASE c_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE 50 END AS lim, repeat('n', CAST(c_custkey % 60 AS INT)) AS nick,
CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '2024-06-01' WHEN 2 THEN '2031-01-01' WHEN 3 THEN '2020-01-01' ELSE 'soon' END AS d, c_custkey % 2 = 0 AS same FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN avatar_id > 7 THEN 'avatar_id' END, CASE WHEN q NOT BETWEEN 5 AND 200 THEN 'daily_questions' END, CASE WHEN lim = 30 THEN 'default_limit' END, CASE WHEN length(nick) > 40 THEN 'nickname' END,
CASE WHEN d IN ('2031-01-01', 'soon') OR d = '2020-01-01' AND NOT same THEN 'exam_date' END) AS faults FROM x""")
def profile_faults(spark, sf_dir):
    k = F.col("c_custkey")
    day = F.when(k % 5 == 0, "").when(k % 5 == 1, "2024-06-01").when(k % 5 == 2, "2031-01-01").when(k % 5 == 3, "2020-01-01").otherwise("soon")
    c = table(spark, sf_dir, "customer").select(
        k, (k % 12).cast("int").alias("avatar_id"), (k % 250).cast("int").alias("daily_questions"), F.lit(30).alias("daily_minutes"), F.when(k % 4 == 0, 10).when(k % 4 == 1, 30).otherwise(50).alias("default_limit"), F.lit(16).alias("reading_size"),
        F.repeat(F.lit("n"), (k % 60).cast("int")).alias("nickname"), F.lit("").alias("bio"), F.lit("").alias("exam_name"), day.alias("exam_date"), F.when(k % 2 == 0, day).otherwise("").alias("stored_exam_date"),
    )
    return c.select("c_custkey", F.array_join(practice.profile_faults(F.lit(date(2024, 1, 30))), ",").alias("faults"))


@query("""WITH g AS (SELECT p_brand, count(*) AS n, count(DISTINCT p_name) AS d FROM part GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS all_n, CAST(sum(d) AS BIGINT) AS all_d, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS several_n, CAST(coalesce(sum(d) FILTER (n > 1), 0) AS BIGINT) AS several_d, count(*) FILTER (n > 1) AS several_groups, coalesce(string_agg(p_brand, ',' ORDER BY p_brand) FILTER (n > 1 AND n = d), '') AS never FROM g""")
def overall_convergence(spark, sf_dir):
    return practice.overall_convergence(labels.convergence(table(spark, sf_dir, "part"), "p_brand", "p_name"))


@query("SELECT event_id, CASE WHEN value IS NOT NULL AND user_id % 3 != 0 THEN greatest(value, CAST(user_id AS DOUBLE)) END AS most FROM events")
def strict_max(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", A.strict_greatest("value", F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("double"))).alias("most"))


SQL_PAPERS = """s AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 20 AS paper_id, o_orderdate AS day, o_orderstatus != 'O' AS done, CAST(o_orderkey % 3 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS saved FROM orders WHERE o_orderkey % 7 != 0)"""


def _paper_sessions(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    # answers to questions 1 to k % 3, a blank one to 50, one to 60 for even keys, and one that is not asked
    item = lambda q, a: F.struct(q.cast("long").alias("question_id"), F.lit(a).alias("answer"))
    draft = F.concat(F.transform(F.when(k % 3 > 0, F.sequence(F.lit(1).cast("long"), k % 3)).otherwise(F.array().cast("array<bigint>")), lambda q: item(q, "A")), F.array(item(F.lit(50), " "), item(F.lit(999), "B")), F.when(k % 2 == 0, F.array(item(F.lit(60), "C"), item(F.lit(60), "C"))).otherwise(F.array().cast("array<struct<question_id: bigint, answer: string>>")))
    spec = F.when(k % 7 != 0, F.to_json(F.struct((k % 20).alias("paper_id")))).otherwise("not json")
    ids = F.array(*(F.lit(i).cast("long") for i in (1, 2, 3, 50, 60)))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), k.alias("id"), spec.alias("spec"), ids.alias("question_ids"), F.to_json(draft).alias("draft"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("submitted_at"))


@query(f"WITH {SQL_PAPERS} SELECT user_id, paper_id, id, saved, CAST(5 AS INT) AS total, CASE WHEN done THEN 'review' ELSE 'resume' END AS action FROM s QUALIFY row_number() OVER (PARTITION BY user_id, paper_id ORDER BY done, CASE WHEN done THEN day END DESC NULLS LAST, id DESC) = 1")
def paper_progress(spark, sf_dir):
    return practice.paper_progress(_paper_sessions(spark, sf_dir))


@query("SELECT o_custkey AS user_id, o_orderkey AS id, CAST(o_orderkey % 3 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS saved FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def latest_unfinished(spark, sf_dir):
    return practice.latest_unfinished(_paper_sessions(spark, sf_dir)).select("user_id", "id", "saved")


@query(f"""WITH {SQL_ANSWERS}, f AS (SELECT question_id, 'repeated' AS fault FROM a GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT question_id, 'not_in_session' FROM a WHERE question_id >= 150 UNION ALL SELECT question_id, 'duration' FROM a WHERE k > 90
UNION ALL SELECT DISTINCT question_id, 'not_an_option' FROM a WHERE question_id < 150 AND question_id % 2 = 1 AND user_answer = 'A') SELECT question_id, fault, count(*) AS n FROM f GROUP BY 1, 2""")
def answer_faults(spark, sf_dir):
    a = _answers(spark, sf_dir).select("question_id", F.trim("user_answer").alias("answer"), F.when(F.col("k") > 90, F.lit(-1)).otherwise(F.col("k")).alias("duration_ms"))
    session = spark.range(150).select(F.col("id").alias("question_id"), F.lit("single").alias("answer_type"))
    options = spark.range(150).select(F.col("id").alias("question_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("label"))
    return practice.answer_faults(a, session, options).groupBy("question_id", "fault").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT event_id, CASE {SQL_K} % 5 WHEN 0 THEN '' WHEN 1 THEN '（缺）' WHEN 2 THEN 'A' WHEN 3 THEN 'AC' ELSE 'B' END AS answer, {SQL_K} % 3 AS m FROM events)
SELECT event_id, CASE WHEN answer IN ('', '（缺）') THEN 'other' WHEN m = 0 THEN 'judge' WHEN length(answer) > 1 THEN 'multi' ELSE 'single' END AS answer_type,
CASE WHEN answer = '' THEN 'no_answer_line' WHEN answer = '（缺）' THEN 'answer_missing' WHEN m = 0 THEN 'no_options' ELSE
concat_ws(',', CASE WHEN answer != 'A' THEN 'mark_mismatch' END, CASE WHEN m = 1 AND answer IN ('AC', 'B') THEN 'answer_not_in_options' END, CASE WHEN m = 1 THEN 'unusual_option_count' END) END AS warnings FROM e""")
def question_warnings(spark, sf_dir):
    k = score()
    answer = F.when(k % 5 == 0, "").when(k % 5 == 1, "（缺）").when(k % 5 == 2, "A").when(k % 5 == 3, "AC").otherwise("B")
    option = lambda label: F.struct(F.lit(label).alias("label"), F.lit("x").alias("content"), F.lit(label == "A").alias("is_correct"))
    none = F.array().cast("array<struct<label: string, content: string, is_correct: boolean>>")
    options = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(option("A"))).otherwise(F.array(*map(option, "ABCD")))
    e = table(spark, sf_dir, "events").select("event_id", answer.alias("answer"), options.alias("options"))
    return e.select("event_id", A.answer_type("answer", F.col("options")).alias("answer_type"), F.array_join(A.question_warnings("answer", F.col("options"), F.lit(False)), ",").alias("warnings"))


_LETTERS = "list_sort(list_filter(string_split(regexp_replace(upper({0}), '[^A-H]', '', 'g'), ''), lambda x: x != ''))"


@query(f"""WITH e AS (SELECT doc_id, translate(substr(md5(CAST(doc_id AS VARCHAR)), 1, CAST(doc_id % 4 AS INT)), '0123456789', 'ABCDEFGH正x') AS official, text FROM documents),
s AS (SELECT doc_id, official, CASE doc_id % 3 WHEN 0 THEN '选 ' || reverse(lower(official)) || '。' WHEN 1 THEN ' ' || official || chr(12288) ELSE substr(text, 1, CAST(doc_id % 20 AS INT)) END AS said FROM e), l AS (SELECT *, {_LETTERS.format('said')} AS c, {_LETTERS.format('official')} AS a FROM s)
SELECT doc_id, regexp_replace(said, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') = official OR CASE WHEN len(a) > 1 THEN c = a WHEN len(a) = 1 THEN list_contains(c, a[1]) ELSE false END AS matches FROM l""")
def conclusion_matches(spark, sf_dir):
    """Official answers of up to three signs from a hash; conclusions turned round in a sentence, with blanks, or words of a text."""
    k = F.col("doc_id")
    official = F.translate(F.substr(F.md5(k.cast("string")), F.lit(1), (k % 4).cast("int")), "0123456789", "ABCDEFGH正x")
    said = F.when(k % 3 == 0, F.concat(F.lit("选 "), F.reverse(F.lower(official)), F.lit("。"))).when(k % 3 == 1, F.concat(F.lit(" "), official, F.lit("　"))).otherwise(F.substr("text", F.lit(1), (k % 20).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", A.answer_matches(said, official).alias("matches"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string([regexp_replace(x, '^[\s\x{0b}\x{85}\p{Z}]+|[\s\x{0b}\x{85}\p{Z}]+$', '', 'g') FOR x IN string_split(text, chr(10))], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text, sha256(text) AS token FROM documents""")
def collapsed_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_lines("text").alias("text"), T.token_hash("text").alias("token"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN '未知/' || p_name ELSE p_brand || '/' || p_name END AS ref, CAST(p_partkey AS VARCHAR) AS qid, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS tag FROM part""")
def heading_and_image(spark, sf_dir):
    k = F.col("p_partkey")
    src = F.when(k % 4 == 0, F.concat(F.lit("..\\img\\"), "p_brand", F.lit("\\"), "p_name")).when(k % 4 == 1, F.concat(F.lit(" a//"), "p_brand", F.lit("/./"), "p_name")).when(k % 4 == 2, F.col("p_name")).otherwise("")
    sub = T.split_sub(F.concat(F.lit("qid "), k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit(" · "), "p_type")).otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", T.image_reference(src).alias("ref"), sub["qid"].alias("qid"), sub["tag"].alias("tag"))


@query(f"""WITH e AS (SELECT event_id, {SQL_K} AS k, 200 + event_id * 7 % 400 AS status, event_id % 9 AS n, CASE WHEN event_id % 6 = 0 THEN event_id % 90 END AS asked FROM events),
c AS (SELECT *, CASE WHEN status = 429 THEN 'rate_limited' WHEN status IN (408, 409) OR status >= 500 THEN 'retryable' WHEN status >= 400 THEN 'fatal' ELSE 'ok' END AS class FROM e)
SELECT event_id, class, CAST(coalesce(asked, CASE WHEN class = 'rate_limited' THEN least(20 * n, 60) ELSE least(2 ** n, 30) END) AS DOUBLE) AS wait, CASE WHEN k % 3 != 0 THEN (k * 0.5::DOUBLE + 2 * k * 1.5::DOUBLE) / 1000.0::DOUBLE END AS cost FROM c""")
def call_policy(spark, sf_dir):
    """States over their whole range, attempts from 0 to 8, and for some calls a wait that the server asks for."""
    e, k = F.col("event_id"), F.col("k")
    calls = table(spark, sf_dir, "events").select("event_id", score().alias("k"), A.retry_class(200 + e * 7 % 400).alias("class"))
    wait = A.backoff_seconds("class", e % 9, F.when(e % 6 == 0, e % 90))
    return calls.select("event_id", "class", wait.alias("wait"), A.cost_usd("k", k * 2, F.when(k % 3 != 0, F.lit(0.5)), F.lit(1.5)).alias("cost"))


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k % 3 = 2 THEN NULL ELSE event_type END AS subject, CASE WHEN k % 3 = 2 THEN NULL ELSE 'a' || chr(92) || 'frac' END AS detail, CASE WHEN k % 3 != 2 THEN 'x|y' END AS chain FROM e""")
def parsed_labels(spark, sf_dir):
    k = score()
    body = F.to_json(F.struct(F.col("event_type").alias("subject"), F.lit("a\frac").alias("detail"), F.array(F.lit("x"), F.lit("y")).alias("reasoning_chain")))
    raw = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise("sorry")
    e = table(spark, sf_dir, "events").select("event_id", A.parse_label(raw).alias("l"))
    return e.select("event_id", "l.subject", "l.detail", F.array_join("l.reasoning_chain", "|").alias("chain"))


@query(r"""WITH x AS (SELECT p_partkey AS k, p_brand, p_type, p_type || '-' || p_size AS name FROM part), t AS (SELECT DISTINCT p_brand, p_type, name FROM x WHERE k % 2 = 0),
l AS (SELECT k, CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN 'none' ELSE p_brand END AS subject, CASE WHEN k % 17 = 0 THEN 'other' WHEN k % 5 = 0 THEN '' ELSE p_brand END AS module,
CASE WHEN k % 19 = 0 THEN NULL WHEN k % 7 = 0 THEN p_type || 's' ELSE p_type END AS secondary, CASE WHEN k % 23 = 0 THEN ' ' WHEN k % 29 = 0 THEN p_type WHEN k % 3 = 0 THEN ' ' || name ELSE name END AS tertiary,
CASE WHEN k % 4 = 0 THEN chr(12288) WHEN k % 4 = 1 THEN NULL ELSE 'd' END AS detail, k % 6 AS steps, CASE k % 3 WHEN 0 THEN '选A' WHEN 1 THEN 'B' ELSE '' END AS conclusion FROM x),
v AS (SELECT l.*, trim(tertiary) AS name, subject IN (SELECT p_brand FROM t) AS s_known, coalesce((subject, secondary) IN (SELECT (p_brand, p_type) FROM t), false) AS t_known, coalesce((subject, secondary, trim(tertiary)) IN (SELECT (p_brand, p_type, name) FROM t), false) AS n_known FROM l),
w AS (SELECT *, CASE WHEN name = '' THEN 'empty' WHEN instr(name, '-') < 2 THEN 'no_prefix' WHEN split_part(name, '-', 1) != secondary THEN 'wrong_prefix' WHEN n_known THEN 'ok' ELSE 'novel' END AS verdict, s_known AND coalesce(secondary, '') != '' AS judged FROM v)
SELECT k AS p_partkey, concat_ws(',', CASE WHEN subject = '' THEN 'subject:empty:true' WHEN NOT s_known THEN 'subject:unknown:true' WHEN module != '' AND module != subject THEN 'subject:other_module:true' END,
CASE WHEN secondary IS NULL THEN 'secondary:empty:true' WHEN NOT t_known THEN 'secondary:unknown:true' END, CASE WHEN judged AND verdict NOT IN ('ok', 'novel') THEN 'tertiary:' || verdict || ':true' END,
CASE WHEN k % 4 < 2 THEN 'detail:empty:true' END, CASE WHEN k % 4 < 2 THEN 'boundary:empty:false' END, CASE WHEN steps = 0 THEN 'reasoning_chain:empty:true' WHEN steps < 3 THEN 'reasoning_chain:short:false' END,
CASE WHEN steps >= 2 THEN 'reasoning_chain:blank_step_2:true' END, CASE WHEN k % 5 = 0 THEN 'key_features:empty:true' END, CASE WHEN k % 5 = 0 THEN 'pitfalls:empty:false' END, CASE WHEN k % 2 = 0 THEN 'typical_ask:empty:false' END,
CASE WHEN conclusion = 'B' THEN 'conclusion:other_answer:false' END) AS problems, CASE WHEN judged AND verdict = 'novel' THEN name END AS novel FROM w""")
def label_problems(spark, sf_dir):
    k, name = F.col("p_partkey"), F.concat("p_type", F.lit("-"), F.col("p_size").cast("string"))
    p = table(spark, sf_dir, "part")
    taxonomy = p.where(k % 2 == 0).select(F.col("p_brand").alias("subject"), F.col("p_type").alias("secondary"), name.alias("tertiary")).distinct()
    detail = F.when(k % 4 == 0, "\u3000").when(k % 4 != 1, "d")
    filled = F.array(F.lit("x"))
    l = p.select(
        "p_partkey", F.when(k % 11 == 0, "").when(k % 13 == 0, "none").otherwise(F.col("p_brand")).alias("subject"), F.when(k % 17 == 0, "other").when(k % 5 == 0, "").otherwise(F.col("p_brand")).alias("module"),
        F.when(k % 19 == 0, None).when(k % 7 == 0, F.concat("p_type", F.lit("s"))).otherwise(F.col("p_type")).alias("secondary"),
        F.when(k % 23 == 0, " ").when(k % 29 == 0, F.col("p_type")).when(k % 3 == 0, F.concat(F.lit(" "), name)).otherwise(name).alias("tertiary"),
        detail.alias("detail"), detail.alias("boundary"), *(F.lit("y").alias(c) for c in ("question_model", "fastest_solution", "template")),
        F.slice(F.array(*(F.lit("\t" if i == 1 else "z") for i in range(5))), 1, (k % 6).cast("int")).alias("reasoning_chain"),
        F.when(k % 5 != 0, filled).alias("key_features"), F.when(k % 5 != 0, filled).alias("pitfalls"), F.when(k % 2 != 0, filled).alias("typical_ask"),
        F.when(k % 3 == 0, "选A").when(k % 3 == 1, "B").otherwise("").alias("conclusion"), F.lit("A").alias("answer"),
    )
    shown = F.transform("problems", lambda x: F.concat_ws(":", x["field"], x["problem"], x["fatal"].cast("string")))
    return labels.label_problems(l, taxonomy).select("p_partkey", F.array_join(shown, ",").alias("problems"), "novel")


SQL_REPORT = """i AS (SELECT CASE WHEN k % 3 = 0 THEN '题目图' ELSE '公式图' END AS kind, CASE WHEN k % 7 != 0 THEN 'h' END AS sha256, CASE k % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' WHEN 2 THEN 'ok' END AS ocr_status, CASE k % 10 WHEN 0 THEN ' ' WHEN 2 THEN '2024年' WHEN 4 THEN NULL ELSE 'x' END AS ocr_tex FROM (SELECT event_id AS k FROM events)),
q AS (SELECT CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '⟦IMG:公式图/a⟧' WHEN 3 THEN '⟦IMG:题目图/a⟧' ELSE 'e' END AS explanation, CASE k % 4 WHEN 0 THEN 'e' WHEN 1 THEN '⟦IMG:公式图/a⟧' WHEN 2 THEN '' END AS filled, k % 6 = 0 AS missing, CASE WHEN k % 3 = 0 THEN 's ⟦IMG:公式图/b⟧' ELSE 's' END AS stem, k % 9 = 0 AS done FROM (SELECT p_partkey AS k FROM part)),
m AS (SELECT c_custkey % 2 = 0 AS has, c_custkey % 8 = 0 AS done FROM customer)"""


@query(f"""WITH {SQL_REPORT}, r AS (SELECT kind, count(*) AS total, count(sha256) AS indexed, count(*) FILTER (ocr_status = 'ok') AS ok, count(*) FILTER (ocr_status = 'error') AS error, count(*) FILTER (ocr_status IS NULL) AS pending,
count(*) FILTER (ocr_status = 'ok' AND coalesce(trim(ocr_tex), '') = '') AS empty, count(*) FILTER (ocr_status = 'ok' AND ocr_tex LIKE '%年%') AS year FROM i GROUP BY 1),
x(measure, value) AS (SELECT 'formula_' || c, v FROM (SELECT unnest(['total', 'indexed', 'read', 'error', 'pending', 'empty', 'year']) AS c, unnest([total, indexed, ok, error, pending, empty, year]) AS v FROM r WHERE kind = '公式图')
UNION ALL SELECT 'figure_' || c, v FROM (SELECT unnest(['total', 'indexed', 'read', 'error']) AS c, unnest([total, indexed, ok, error]) AS v FROM r WHERE kind = '题目图')
UNION ALL SELECT 'question_total', count(*) FROM q UNION ALL SELECT 'question_with_formula', count(*) FROM q WHERE filled <> '' UNION ALL SELECT 'question_formula_missing', count(*) FROM q WHERE missing
UNION ALL SELECT 'question_without_explanation', count(*) FROM q WHERE coalesce(explanation, '') = '' UNION ALL SELECT 'placeholders_total', count(*) FROM q WHERE explanation LIKE '%⟦IMG:公式图%'
UNION ALL SELECT 'placeholders_left', count(*) FROM q WHERE filled LIKE '%⟦IMG:公式图%' UNION ALL SELECT 'stems_with_image', count(*) FROM q WHERE stem LIKE '%⟦IMG:%' UNION ALL SELECT 'stems_resolved', count(*) FROM q WHERE done
UNION ALL SELECT 'materials_with_image', count(*) FROM m WHERE has UNION ALL SELECT 'materials_resolved', count(*) FROM m WHERE done)
SELECT measure, CAST(value AS DOUBLE) AS value FROM x UNION ALL SELECT 'materials_percent', CAST(count(*) FILTER (done) AS DOUBLE) * 100 / count(*) FILTER (has) FROM m""")
def media_report(spark, sf_dir):
    k = F.col("event_id")
    images = table(spark, sf_dir, "events").select(
        F.when(k % 3 == 0, "题目图").otherwise("公式图").alias("kind"), F.when(k % 7 != 0, "h").alias("sha256"), F.when(k % 4 == 1, "error").when(k % 2 == 0, "ok").alias("ocr_status"),
        F.when(k % 10 == 0, " ").when(k % 10 == 2, "2024年").when(k % 10 != 4, "x").alias("ocr_tex"),
    )
    k = F.col("p_partkey")
    questions = table(spark, sf_dir, "part").select(
        F.when(k % 5 == 1, "").when(k % 5 == 2, "⟦IMG:公式图/a⟧").when(k % 5 == 3, "⟦IMG:题目图/a⟧").when(k % 5 == 4, "e").alias("explanation"),
        F.when(k % 4 == 0, "e").when(k % 4 == 1, "⟦IMG:公式图/a⟧").when(k % 4 == 2, "").alias("explanation_with_formula"), (k % 6 == 0).alias("formula_missing"),
        F.when(k % 3 == 0, "s ⟦IMG:公式图/b⟧").otherwise("s").alias("stem"), F.when(k % 9 == 0, "s b").alias("stem_with_text"),
    )
    k = F.col("c_custkey")
    materials = table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "⟦IMG:题目图/a⟧").otherwise("m").alias("body"), F.when(k % 8 == 0, "m a").alias("body_with_text"))
    return media.report(images, questions, materials)


@query(f"""SELECT event_id, CASE {SQL_K} % 5 WHEN 0 THEN value WHEN 1 THEN 0.5::DOUBLE END AS price_in, CAST(CASE {SQL_K} % 5 WHEN 0 THEN 2.5 WHEN 1 THEN 0.001 END AS DOUBLE) AS price_out FROM events""")
def parsed_pricing(spark, sf_dir):
    k = score()
    text = F.when(k % 5 == 0, F.concat(F.col("value").cast("string"), F.lit(", 2.5"))).when(k % 5 == 1, " .5 ,1e-3").when(k % 5 == 2, "1,2,3").when(k % 5 == 3, "free,1")
    e = table(spark, sf_dir, "events").select("event_id", A.parse_pricing(text).alias("p"))
    return e.select("event_id", F.col("p.input").alias("price_in"), F.col("p.output").alias("price_out"))


def _dashboard_sql() -> str:
    from tamarack.plans.registry import ORACLES

    parts = {n: f"({ORACLES[n]})" for n in ("period_vs_previous", "streak_longest_current", "user_stats")}
    return f"""SELECT p.user_id, period_answered, previous_answered, lifetime_answered, period_accuracy, coalesce(longest, 0) AS longest, coalesce(current, 0) AS current, wrong, favorites, sessions
    FROM {parts['period_vs_previous']} p LEFT JOIN {parts['streak_longest_current']} t ON t.user_id = p.user_id LEFT JOIN {parts['user_stats']} u ON u.user_id = p.user_id"""


@query(_dashboard_sql())
def dashboard(spark, sf_dir):
    p, t, u = (QUERIES[n](spark, sf_dir) for n in ("period_vs_previous", "streak_longest_current", "user_stats"))
    d = p.join(t, "user_id", "left").join(u.drop("answered", "correct"), "user_id", "left")
    return d.select("user_id", "period_answered", "previous_answered", "lifetime_answered", "period_accuracy", F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("current", F.lit(0)).alias("current"), "wrong", "favorites", "sessions")
