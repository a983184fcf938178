"""Scalar cases, goldens with a fixed clock, and the sources."""

import ipaddress
import random
import struct
import zlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tamarack.functions import answers as A, dates as D, text as T
from tamarack.operators import corpus, labels, media, study
from tamarack.sources import files, notes


def column(spark, f, values, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in d.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_text(spark):
    assert column(spark, T.normalize_for_hash, ["A　b ✅，C", "\u00a0x\ty"]) == ["ab，c", "xy"]
    assert column(spark, T.collapse_lines, ["\n\n a \n\n\n\n　b　\n", ""]) == ["a\n\nb", ""]
    assert column(spark, T.display_tex, ["  x^2 ； ", "$ a $ 和 $b $", "约三成", "$a$ + $ b", "", "y" * 81, "\\frac{1}{2};;"]) == ["$x^2$", "$a$ 和 $b$", "约三成", "$a$ + $b", "", "y" * 81, "$\\frac{1}{2}$"]
    assert column(spark, T.tex_class, ["", "$a$", "约", "x=1"]) == ["empty", "has_delim", "cjk_text", "math_wrap"]
    assert column(spark, T.safe_csv_cell, ["=1", " +1", "\tx", "a", "\ufeff@x", "-"]) == ["'=1", "' +1", "'\tx", "a", "'\ufeff@x", "'-"]
    assert column(spark, T.sanitize_text, ["a\tb\r", "<b>", "a\u200bb", "x`", " ok "]) == ["a b", None, None, None, "ok"]
    assert column(spark, T.repair_escapes, ["\frac \bar \right\t\n"]) == ["\\frac \\bar \\right\t\n"]
    assert column(spark, T.mask_ip, ["1.2.3.4", "2001:db8:1:2::3", "x"]) == ["1.2.3.*", "2001:db8:1::/48", ""]
    assert column(spark, lambda x: T.search_highlight(x, "HIT"), ["a<hit>b", "none", "x" * 30 + "hit" + "y" * 30]) == ["a&lt;<mark>hit</mark>&gt;b", None, "…" + "x" * 20 + "<mark>hit</mark>" + "y" * 20 + "…"]
    assert column(spark, lambda x: T.like_literal(x, "a_%"), ["xA_%y", "xabcy"]) == [True, False]
    assert column(spark, T.image_reference, ["../90-图片/题目图/a.png", "a.png", " ", "b\\c.png"]) == ["题目图/a.png", "未知/a.png", None, "b/c.png"]
    assert column(spark, T.split_sub, ["qid 12 · 图形", "none"]) == [("12", "图形"), ("", "")]


def test_class_samples_of_long_formulas(spark):
    """Thousands of dollar signs in a text, of an even and an odd number."""
    rows = [("even", "a $ " * 20000), ("odd", "a $ " * 20001 + "b"), ("han", "约" * 20000), ("none", " ; ；")]
    got = media.class_samples(spark.createDataFrame(rows, "url string, ocr_tex string"), 9, "s").collect()
    assert sorted((r.url, r["class"]) for r in got) == [("even", "has_delim"), ("han", "cjk_text"), ("none", "empty"), ("odd", "has_delim")]


def trimmed_inside(s):
    """Without the blanks behind an opening and in front of a closing dollar sign, of at least two."""
    parts = s.split("$")
    inside = lambda i, x: x.lstrip(" ") if i == len(parts) - 1 and i % 2 else x.strip(" ") if i % 2 else x
    return "$".join(inside(i, x) for i, x in enumerate(parts)) if len(parts) > 2 else s


def test_formulas_against_plain_python(spark):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice(("$", " ", "a", "约")) for _ in range(rng.randrange(12))).split()) for _ in range(2000)]
    texts += [" ".join(rng.choice(("$", "$b", "b$", "b")) for _ in range(n)) for n in (5000, 5001, 30000, 30001)]
    assert column(spark, T.normalize_tex, texts) == [trimmed_inside(x) for x in texts]


def test_answers(spark):
    assert column(spark, A.normalized_answer, ["c, a", "AA", "A1", ""]) == ["AC", "A", None, ""]
    d = spark.createDataFrame([("multi", "AC", "c a"), ("single", "A", "AB"), ("single", "A", "a"), ("judge", "B", "")], "k string, o string, a string")
    assert [r[0] for r in d.select(A.grade("k", "o", "a")).collect()] == [True, False, True, False]
    d = spark.createDataFrame([("选AC", "CA"), ("答案是B", "B"), ("A", "C"), ("错误", "错误")], "c string, a string")
    assert [r[0] for r in d.select(A.answer_matches("c", "a")).collect()] == [True, True, False, True]
    assert column(spark, lambda x: A.json_long(x, "$.paper_id"), ['{"paper_id": 7}', "{bad", None, '{"paper_id": "x"}']) == [7, None, None, None]
    assert column(spark, lambda x: A.answered_in_draft(x, F.array(F.lit(1), F.lit(2)).cast("array<bigint>")), ['[{"question_id":1,"answer":"A"},{"question_id":1,"answer":"B"},{"question_id":9,"answer":"A"},{"question_id":2,"answer":" "}]', None]) == [1, 0]
    label = column(spark, A.parse_label, ['```json\n{"subject":"m","detail":"x","pitfalls":["a"]}\n```', "nothing"])
    assert label[0]["subject"] == "m" and label[0]["pitfalls"] == ["a"] and label[1] is None


def test_dashboard_golden(spark):
    """Fixed clock 2026-10-04T05:00Z: the window of 7 local days, the one before, today and all time."""
    ts = lambda s: datetime.fromisoformat(s)
    sessions = spark.createDataFrame(
        [(1, 1, ts("2026-10-03T15:59:59"), 1000), (2, 1, ts("2026-10-03T16:00:00"), 2000), (3, 1, ts("2026-09-27T16:00:00"), 3000), (4, 1, ts("2026-09-27T15:59:59"), 4000), (5, 1, None, 50000), (6, 2, ts("2026-10-03T16:00:00"), 9000)],
        "id long, user_id long, submitted_at timestamp_ntz, duration_ms long",
    )
    answers = spark.createDataFrame([(1, "H", 1), (1, "B", 0), (1, " ", 1), (2, "H", 1), (2, "AC", 1), (3, "B", 0), (4, "H", 1), (5, "H", 1), (6, "H", 1)], "session_id long, user_answer string, is_correct int")
    days = study.sessions_by_day(sessions, answers)
    r = study.period_totals(days, *D.window_days(date(2026, 10, 4), 7)).where("user_id = 1").first()
    got = {n: (r[f"{n}_answered"], r[f"{n}_correct"], r[f"{n}_duration_ms"], r[f"{n}_sessions"], round(r[f"{n}_accuracy"], 2)) for n in ("period", "previous", "today", "lifetime")}
    assert got == {"period": (5, 3, 6000, 3, 60.0), "previous": (1, 1, 4000, 1, 100.0), "today": (2, 2, 2000, 1, 100.0), "lifetime": (6, 4, 10000, 4, 66.67)}
    s = study.streaks(days.where("answered > 0"), "user_id", F.lit(date(2026, 10, 4))).where("user_id = 1").first()
    assert (s["current"], s["longest"], s["practiced_today"]) == (2, 2, True)


def test_idempotent_write_and_conflict(spark):
    stored = spark.createDataFrame([(1, "a")], "k int, v string")
    incoming = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [r.k for r in corpus.new_rows(stored, incoming, ["k"], ["v"]).collect()] == [2]
    with pytest.raises(corpus.ContractError):
        corpus.new_rows(stored, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"], ["v"])


NOTE = """---
试卷: 2024年国家公务员考试（副省级）
地区: 国考
模块: 资料
年份: "2024"
题数: "4"
---
## 材料 1
<p>看图<img src="../90-图片/题目图/m.png"></p>
### 第 1 题　<sub>qid 11 · 增长</sub>
<p>题干一</p>
- **A**. 一　✅
- **B**. 二
- **C**. 三
- **D**. 四
**答案**：A
**官方解析**
<p>因为</p>
---
### 第 2 题
题干二
- **A**. 一　✅
- **B**. 二
- **C**. 三　✅
- **D**. 四
多出的一行
**答案**：AC
**官方解析**
<img src="../90-图片/公式/e.png">
---
## 第 3 题
判断
- （选项）[]
**答案**：B
---
## 第 4 题
缺
"""


def test_notes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text(NOTE)
    (tmp_path / "README.md").write_text("x")
    q = notes.typed(notes.questions(notes.discover(spark, str(tmp_path))))
    q = q.withColumn("kind", A.answer_type("answer", F.col("options"))).withColumn("warnings", A.question_warnings("answer", F.col("options"), F.col("option_placeholder")))
    rows = q.orderBy("number").collect()
    assert [r.number for r in rows] == [1, 2, 3, 4]
    assert [r.kind for r in rows] == ["single", "multi", "judge", "other"]
    assert [r.material_seq for r in rows] == [1, 1, 0, 0] and rows[0].material_figure and not rows[2].material_figure
    assert rows[0].qid == "11" and rows[0].tag == "增长" and rows[0].year == 2024 and rows[0].declared == 4
    assert rows[0].stem == "题干一" and rows[0].explanation == "因为" and rows[0].options[0].is_correct and rows[0].options[0].content == "一"
    assert rows[1].explanation == "⟦IMG:公式/e.png⟧" and len(rows[1].continuations) == 1
    assert [r.warnings for r in rows] == [[], [], [], ["no_answer_line"]]


def test_html():
    assert notes.html_to_text("<p>a&amp;b<br>c</p><ul><li>x</li><li>y</li></ul><script>s=1</script>")[0] == "a&b\nc\n\nx\n\ny\ns=1"
    assert notes.html_to_text("<img src=''>z") == ("z", [])


def test_images_and_worklist(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 3, 2) + b"\x08\x00\x00\x00\x00" + struct.pack(">I", zlib.crc32(b""))
    folder = tmp_path / "题目图"
    folder.mkdir()
    (folder / "a.png").write_bytes(png)
    (folder / "b.png").write_bytes(png)
    index = files.image_index(spark, str(tmp_path))
    rows = index.orderBy("url").collect()
    assert [(r.url, r.width, r.height) for r in rows] == [("题目图/a.png", 3, 2), ("题目图/b.png", 3, 2)]
    refs = spark.createDataFrame([("题目图/a.png",), ("题目图/gone.png",)], "url string")
    missing, orphans = files.missing_and_orphans(refs, index)
    assert [r.url for r in missing.collect()] == ["题目图/gone.png"] and [r.url for r in orphans.collect()] == ["题目图/b.png"]
    work = media.ocr_worklist(index.withColumn("ocr_status", F.lit(None).cast("string")))
    assert [r.url for r in work.collect()] == ["题目图/a.png"]


def test_shards_and_results(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"sha256":"a","status":"ok","tex":"x"}\n\n{"sha256":"a","status":"ok"}\n{"sha256":"z","status":"odd"}\n{"sha2')
    results = files.read_results(spark, str(tmp_path / "r.jsonl"))
    shard = spark.createDataFrame([("a",), ("b",)], "sha256 string")
    assert sorted((r.sha256, r.fault) for r in media.shard_faults(shard, results).collect()) == [("a", "repeated"), ("b", "missing"), ("z", "bad_status"), ("z", "unknown")]


def test_export_limit(spark, tmp_path):
    rows = spark.range(6).withColumn("x", F.lit("=1"))
    assert files.export_csv(rows, ["id"], str(tmp_path / "out"), limit=6) == 6
    with pytest.raises(ValueError):
        files.export_csv(rows, ["id"], str(tmp_path / "out2"), limit=5)


def test_input_hash_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "k int, v string")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    h = [labels.input_hash(d, "k", ["v"]).first()[0] for d in (a, b, c)]
    assert h[0] == h[1] != h[2]


def masked(x):
    """What ``mask_ip`` is to give, by the standard library."""
    try:
        ip = ipaddress.ip_address(x.split("%")[0] if ":" in x and not x.endswith("%") else x)
    except ValueError:
        return ""
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return str(ip).rpartition(".")[0] + ".*" if ip.version == 4 else str(ipaddress.ip_network(f"{ip}/48", strict=False))


def test_mask_ip_against_the_standard_library(spark):
    rng = random.Random(5)
    addresses = [None, "", ":", "::", ":::", "::1", "1::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "0:5:1::2", "12345::", "g::", "::ffff:1.2.3.4", "::FFFF:102:304", "1:2::1.2.3.4", "::1.2.3.400", "1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", "1.2.3.4\n", "fe80::1%eth0", "fe80::1%", "1.2.3.4%eth0", " ::1"]
    for _ in range(400):
        groups = [rng.choice(("0", "0", "00f", "10", f"{rng.randrange(65536):X}")) for _ in range(rng.choice((8, 8, 7, 6, 4, 2)))]
        at = rng.randrange(len(groups) + 1)
        addresses.append(":".join(groups) if rng.random() < 0.3 else ":".join(groups[:at]) + "::" + ":".join(groups[at:]))
        addresses.append(".".join(str(rng.choice((0, 7, 99, 255, 256, rng.randrange(300)))) for _ in range(4)))
    assert column(spark, T.mask_ip, addresses) == [masked(x or "") for x in addresses]


def test_mail_addresses(spark):
    mails = ["a@b.c", "a@.", "a@b", "@b.c", "a@@b.c", "a@b.c@d.e", "a b@c.d", "a@b.c\n", "", "<a>@b.c", "é" * 126 + "@b", "é" * 125 + "@b.c", "é" * 126 + "@b.c"]
    assert column(spark, T.valid_email, mails) == [True, True, False, False, False, False, False, False, False, True, False, True, False]
