"""Character references, note summaries, lists and the vocabulary file against plain Python."""

import html
import random

import pytest
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import corpus, practice, study
from tamarack.sources import files, notes


def test_unescape_reads_references_once(spark):
    rng = random.Random(7)
    parts = ["&", "&amp;", "amp;", "&lt", "&ltx", "&notit;", "&notin;", "&nosuch;", "&eacute", "&#65;", "&#x41", "&#X1F600;", "&#0;", "&#128;", "&#150", "&#xD800;", "&#x110000;", "&#99999999999;", "&#;", "&#x;", "&#", ";", "x", "é", " ", "&CounterClockwiseContourIntegral;", "&NotEqualTilde;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ["", "plain", "&" * 50]
    got = {r["t"]: r["u"] for r in spark.createDataFrame([(t,) for t in set(texts)] + [(None,)], "t string").select("t", T.unescape("t").alias("u")).collect()}
    assert got.pop(None) is None
    bad = {t: (u, html.unescape(t)) for t, u in got.items() if u != html.unescape(t)}
    assert not bad, list(bad.items())[:3]


def test_strip_tags_reads_all_references(spark):
    d = spark.createDataFrame([("<p a='1'>x &ge; 3 &amp;lt; <b>y</b>&nbsp;&rarr;</p>",)], "t string")
    assert d.select(T.strip_tags("t", every=True)).first()[0] == "x ≥ 3 &lt; y\xa0→"


def test_unescape_of_closed_references(spark):
    cases = {"&amp;&ge;&#65;&#x42;": "&≥AB", "&amp &ampx &#65 &#x42,": "&amp &ampx &#65 &#x42,", "&notit;&notin;": "&notit;∉", "&am&amp;amp;&": "&am&amp;&", "&;&#;&#x;": "&;&#;&#x;"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.unescape("t", closed=True)).collect()
    assert dict(map(tuple, got)) == cases
    assert [notes.html_to_text(t, closed=True)[0] for t in cases] == list(cases.values())


def test_note_warnings(spark):
    head = "---\n试卷: A\n题数: {}\n---\n"
    question = "## 第 1 题\n- **A** . x\n- **B** . y\n{}**答案** : A\n"
    contents = {
        "good": head.format(1) + question.format(""), "count": head.format(3) + question.format(""), "none": question.format("\n"), "undeclared": head.format("many") + question.format(""),
        "goes_on": head.format(1) + question.format("still y\nand y\n"), "empty": "", "null": None, "no_questions": head.format(2), "dos": (head.format(1) + question.format("")).replace("\n", "\r\n"), "open": "---\n题数: 1\n",
    }
    d = spark.createDataFrame(list(contents.items()), "path string, content string")
    s = notes.note_summaries(d)
    assert s.count() == len(contents)
    got = sorted((r["path"], r["line"], r["kind"]) for r in notes.note_warnings(s).collect())
    missing = [(p, 1, "no_frontmatter") for p in ("none", "empty", "null", "open")]
    assert got == sorted([*missing, ("count", 1, "count_mismatch"), ("no_questions", 1, "count_mismatch"), ("goes_on", 8, "option_continuation"), ("goes_on", 9, "option_continuation")])
    assert notes.note_warnings(notes.note_summaries(d.limit(0))).count() == 0


def test_user_pages(spark):
    rows = [(u, i) for u, n in ((1, 7), (2, 3), (None, 2)) for i in range(n)]
    got = sorted((r["u"] or 0, r["i"], r["total"], r["page"], r["place"]) for r in study.user_pages(spark.createDataFrame(rows, "u long, i long"), "u", [F.desc("i")], 3).collect())
    assert got == sorted((u or 0, i, n, (n - 1 - i) // 3 + 1, (n - 1 - i) % 3 + 1) for u, n in ((1, 7), (2, 3), (None, 2)) for i in range(n))


def test_contract_measures(spark):
    o = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, ""), (4, None), (5, "")], "question_id long, raw_qid string")
    q = spark.createDataFrame([(1, "judge"), (2, None)], "id long, answer_type string")
    w = spark.createDataFrame([("answer_missing",), ("other",), (None,)], "kind string")
    got = {r["metric"]: (r["actual"], r["ok"]) for r in corpus.contract(o, q, w, {"qid_split": 1, "qid_merged": 0}).collect()}
    assert got == {"occurrences": (6, True), "entities": (2, True), "judge_questions": (1, True), "mark_mismatch": (0, True), "answer_missing": (1, True), "qid_split": (1, True), "qid_merged": (1, False)}
    assert {r["actual"] for r in corpus.contract(o.limit(0), q.limit(0), w.limit(0), {}).collect()} == {0}


def test_vocabulary_file(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "t.yaml"
    path.write_text("version: v1\nmodules:\n  - subject: 数学\n    secondary:\n      - name: 运算\n        tertiary: [运算-加, 运算-减]\n      - name: 图形\n  - subject: 语言\n    secondary:\n      - name: 填空\n        tertiary:\n          - 填空-词\n", encoding="utf-8")
    assert sorted(map(tuple, files.read_taxonomy(spark, str(path)).collect())) == [("数学", "运算", "运算-减"), ("数学", "运算", "运算-加"), ("语言", "填空", "填空-词")]
    path.write_text("version: v1\n")
    with pytest.raises(ValueError):
        files.read_taxonomy(spark, str(path))


def test_papers_and_sources(spark):
    schema = "id long, name string, exam_type string, region string, module string, paper_variant string, year int, question_count int"
    p = spark.createDataFrame([(1, "a", None, "x", "m", None, None, None), (2, "b", "t", "x", "", "v", 2023, 5), (3, "c", "t", "y", "m", "v", 2024, 7), (4, "d", "t", "x", "m", "", 2024, 0)], schema)
    shown = lambda d: [r.id for r in d.collect()]
    assert shown(practice.paper_list(p)) == [3, 4, 2, 1] and shown(practice.paper_list(p, limit=2)) == [3, 4]
    assert shown(practice.paper_list(p, year=2024, region="x")) == [4] and shown(practice.paper_list(p, module="", exam_type="t")) == [3, 4, 2]
    assert practice.paper_list(p, module="m", region="x").collect()[-1][:] == (1, "a", "", "x", "m", "", 0, 0)
    with pytest.raises(ValueError):
        practice.paper_list(p, color="red")
    o = spark.createDataFrame([(9, 1), (9, 2), (9, 2), (9, 4), (9, 77), (8, 1)], "question_id long, paper_id long")
    assert {(r.question_id, r["rank"], r.paper_id) for r in practice.question_sources(o, p, limit=2).collect()} == {(9, 1, 4), (9, 2, 2), (8, 1, 1)}


def test_concept_cards_and_list(spark):
    c = spark.createDataFrame([(1, "s", "t", "x", 3), (2, "s", "u", "x", 0), (3, "r", "t", "y", 1)], "id long, module string, name string, secondary string, question_count long")
    rows = [(k, k, "s", "t", "old", "b", '["f"]') for k in range(1, 8)] + [(20, 3, "s", "t", "new", None, "not a list"), (21, 4, "s", "gone", "z", "z", None)]
    labels = spark.createDataFrame(rows, "id long, question_id long, subject string, tertiary string, template string, boundary string, key_features string")
    got = {r.id: (r.template, r.boundary, r.key_features, r.samples) for r in practice.concept_cards(c, labels).collect()}
    assert got == {1: ("new", "", [], [1, 2, 3, 5, 6]), 2: ("", "", [], []), 3: ("", "", [], [])}
    stats = spark.createDataFrame([(5, 1, 4, 1, 0.25), (6, 3, 2, 2, 1.0)], "user_id long, concept_id long, answered long, correct long, mastery double")
    assert [(r.id, r.answered, r.mastery) for r in practice.concept_list(c, stats, 5).collect()] == [(3, 0, 0.0), (1, 4, 0.25)]
    assert [r.id for r in practice.concept_list(c, stats, 5, secondary="x").collect()] == [1]
