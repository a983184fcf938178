"""Notes: markdown files with a header, materials and questions, read into typed rows.

Files are found and read by Spark; one task parses a file at a time, as what a line means depends on the lines before
it.  Everything after the parse is native columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The note grammar.  A gap may hold ideographic spaces.
GAP = r"[\s　]*"
MATERIAL = re.compile(rf"##{GAP}材料{GAP}(\d+){GAP}$")
QUESTION = re.compile(rf"(##|###){GAP}第{GAP}(\d+){GAP}题(?:{GAP}<sub>(.*?)</sub>{GAP})?$")
OPTION = re.compile(rf"-{GAP}\*\*([A-Z])\*\*{GAP}[.．、]{GAP}(.*)$")
PLACEHOLDER = re.compile(rf"-{GAP}（选项）{GAP}\[\]{GAP}$")
ANSWER = re.compile(rf"\*\*答案\*\*{GAP}[：:]{GAP}(.*)$")
EXPLANATION = re.compile(rf"\*\*官方解析\*\*{GAP}$")
HEADER_KEYS = {"试卷": "name", "地区": "region", "年份": "year", "模块": "module", "题数": "declared"}
IMAGE_FOLDER, FIGURE_KIND = "90-图片", "题目图"
BLOCKS = {"p", "div", "li", "tr"}
#: An ampersand, with the reference that a semicolon closes where there is one.
REFERENCE = re.compile(r"&(#(?:[0-9]+|[xX][0-9a-fA-F]+);|[A-Za-z][A-Za-z0-9]*;)?")
#: Stands for an ampersand that is no reference while a fragment is parsed: half a surrogate pair, which no UTF-8 text holds.
AMPERSAND = "\ud800"

QUESTION_SCHEMA = (
    "source_path string, paper_name string, region string, module string, year string, declared string, has_header boolean, number int, line int, material_seq int, material string, material_figure boolean, "
    "qid string, tag string, stem string, explanation string, answer string, option_placeholder boolean, "
    "options array<struct<label: string, content: string, is_correct: boolean>>, images array<struct<url: string, place: string>>, continuations array<int>"
)


def image_ref(src: str) -> str | None:
    """``folder/name`` of an image path; None without a name."""
    parts = [p for p in src.strip().replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or src.strip().endswith("/"):
        return None
    folder = parts[-2] if len(parts) > 1 and parts[-2] != ".." else "未知"
    return f"{folder}/{parts[-1]}"


class _Text(HTMLParser):
    """Text of a fragment: line ends around blocks and for breaks, images as placeholders; scripts count as text."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.images: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "img":
            if ref := image_ref(dict(attrs).get("src") or ""):
                self.images.append(ref)
                self.out.append(f"⟦IMG:{ref}⟧")
        elif tag == "br" or tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag == "br":
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        self.out.append(data)


def collapse(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.strip() for line in text.split("\n"))).strip("\n")


def html_to_text(fragment: str | None, closed: bool = False) -> tuple[str, list[str]]:
    """Plain text of a fragment and its images in order.

    Character references are read as browsers do, the old names without a semicolon too, or ``closed`` ones alone.
    """
    source = (fragment or "").strip()
    if closed:
        source = REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else AMPERSAND + m[0][1:], source)
    parser = _Text()
    parser.feed(source)
    parser.close()
    shown = lambda x: x.replace(AMPERSAND, "&") if closed else x
    return shown(collapse("".join(parser.out))), [shown(x) for x in parser.images]


def html_text(fragment: Column, closed: bool = False) -> Column:
    """Plain text of a column of fragments, in Arrow batches."""

    def plain(fragments: pd.Series) -> pd.Series:
        return fragments.map(lambda x: html_to_text(x, closed)[0])

    return F.pandas_udf(plain, "string")(fragment)


def header_of(lines: list[str]) -> tuple[dict[str, str], int]:
    """Keys between the two fences at the top and the line after them; nothing and 0 without fences."""
    if not lines or lines[0].strip() != "---":
        return {}, 0
    for end in range(1, len(lines)):
        if lines[end].strip() == "---":
            pairs = (line.split(":", 1) for line in lines[1:end] if ":" in line)
            return {HEADER_KEYS[k.strip()]: v.strip().strip("\"'") for k, v in pairs if k.strip() in HEADER_KEYS} | {"": ""}, end + 1
    return {}, 0


def parse_note(content: str, path: str) -> list[dict]:
    """Questions of a note, in order; an empty note gives none."""
    lines = content.replace("\r\n", "\n").split("\n")
    header, begin = header_of(lines)
    paper = {"source_path": path, "paper_name": header.get("name", ""), "region": header.get("region", ""), "module": header.get("module", ""), "year": header.get("year", ""), "declared": header.get("declared", ""), "has_header": bool(header)}
    found: list[dict] = []
    material: dict = {"seq": 0, "lines": []}
    question: dict | None = None
    into: list[str] | None = None  # where plain lines go; None: nowhere

    def close() -> None:
        nonlocal question
        if question is None:
            return
        body, figures = html_to_text("\n".join(question["in_material"]["lines"]) + "\n")
        stem, in_stem = html_to_text("\n".join(question["stem_lines"]))
        why, in_why = html_to_text("\n".join(question["why_lines"]))
        options, images = [], []
        for label, raw in question["raw_options"]:
            text, refs = html_to_text(raw.replace("✅", "").rstrip("　 \t"))
            options.append({"label": label, "content": text, "is_correct": "✅" in raw})
            images += [{"url": r, "place": "option"} for r in refs]
        images += [{"url": r, "place": "stem"} for r in in_stem] + [{"url": r, "place": "explanation"} for r in in_why]
        found.append(
            paper
            | {k: question[k] for k in ("number", "line", "qid", "tag", "answer", "option_placeholder", "continuations")}
            | {"material_seq": question["in_material"]["seq"], "material": body, "material_figure": any(f.startswith(FIGURE_KIND + "/") for f in figures), "stem": stem, "explanation": why, "options": options, "images": images}
        )
        question = None

    for number, line in enumerate((x.strip() for x in lines[begin:]), begin + 1):
        if not line:
            continue
        if line == "---":
            close()
            into = None
        elif m := MATERIAL.match(line):
            close()
            material = {"seq": int(m[1]), "lines": []}
            into = material["lines"]
        elif m := QUESTION.match(line):
            close()
            if m[1] == "##":
                material = {"seq": 0, "lines": []}
            note = m[3] or ""
            qid = re.search(rf"qid{GAP}(\d+)", note)
            question = {"number": int(m[2]), "line": number, "qid": qid[1] if qid else "", "tag": note.split("·", 1)[1].strip() if "·" in note else "", "answer": "", "option_placeholder": False, "raw_options": [], "stem_lines": [], "why_lines": [], "continuations": [], "in_material": material}
            into = question["stem_lines"]
        elif question and (m := ANSWER.match(line)):
            question["answer"], into = m[1].strip(), None
        elif question and EXPLANATION.match(line):
            into = question["why_lines"]
        elif question and PLACEHOLDER.match(line):
            question["option_placeholder"], into = True, None
        elif question and (m := OPTION.match(line)):
            question["raw_options"].append((m[1], m[2]))
            into = question["continuations"]
        elif into is not None:
            into.append(number if question and into is question["continuations"] else line)
    close()
    return found


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of all notes below a folder, without image folders, read-me files and method notes."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    name = F.substring_index(path, "/", -1)
    keep = (name != "README.md") & ~name.contains("蒸馏方法") & ~path.contains(f"/{IMAGE_FOLDER}/") & ~path.contains("/.git/")
    return files.select(path.alias("path"), F.col("value").alias("content")).where(keep)


def questions(notes: DataFrame) -> DataFrame:
    """Question rows from (path, content); year and declared count stay text until ``typed``."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in re.sub(r"<[^<>]*(<[^<>]*>)?[^<>]*>", "", QUESTION_SCHEMA).split(", ")]
        for f in frames:
            rows = [q for p, c in zip(f["path"], f["content"]) for q in parse_note(c or "", p)]
            yield pd.DataFrame(rows, columns=columns)

    return notes.mapInPandas(parse, QUESTION_SCHEMA)


NOTE_SCHEMA = "path string, has_header boolean, declared string, n_questions int, continuations array<int>"


def note_summaries(notes: DataFrame) -> DataFrame:
    """One row for each note (path, content), those without a question too: header, counts, and lines after an option."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                header, _ = header_of((content or "").replace("\r\n", "\n").split("\n"))
                found = parse_note(content or "", path)
                rows.append((path, bool(header), header.get("declared", ""), len(found), [k for q in found for k in q["continuations"]]))
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 5, kinds)], names=["path", "has_header", "declared", "n_questions", "continuations"])

    return notes.select("path", "content").mapInArrow(read, NOTE_SCHEMA)


def note_warnings(summaries: DataFrame) -> DataFrame:
    """(path, line, kind) of notes: no header, another number of questions than declared, lines that go on after an option."""
    declared = F.coalesce(F.trim(F.col("declared")).try_cast("int"), F.lit(0))
    one = lambda kind, when: F.when(when, F.struct(F.lit(1).alias("line"), F.lit(kind).alias("kind")))
    lines = F.transform("continuations", lambda k: F.struct(k.alias("line"), F.lit("option_continuation").alias("kind")))
    found = F.concat(F.array(one("no_frontmatter", ~F.col("has_header")), one("count_mismatch", (declared > 0) & (declared != F.col("n_questions")))), lines)
    return summaries.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("w")).select("path", "w.line", "w.kind")


def typed(raw: DataFrame) -> DataFrame:
    """Year and declared count as numbers; what is no number is 0."""
    number = lambda c: F.coalesce(F.trim(F.col(c)).try_cast("int"), F.lit(0))
    return raw.withColumns({"year": number("year"), "declared": number("declared")})
