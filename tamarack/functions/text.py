"""Text expressions: fingerprints, markup clean-up, formulas, search snippets and safe output.  All are native columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, functions as F

#: Keywords of a paper's variant, the first that its name holds counts.
VARIANTS = ("副省级", "地市级", "行政执法", "乡镇", "甲级", "乙级", "A类", "B类", "C类", "定向", "选调")
#: What only formulas hold.
MATH_MARKERS = ("\\", "=", "≈", "≠", "≤", "≥", "×", "÷", "√", "∑", "∫", "∞", "±", "^", "_{", "^{")
LONGEST_WRAPPED = 80
#: A space of any alphabet.
SPACE = r"[\s\x{0b}\x{85}\p{Z}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(x: Column | str) -> Column:
    """Without white space of any alphabet at both ends."""
    return F.regexp_replace(col(x), rf"^{SPACE}++|(?<!{SPACE}){SPACE}++$", "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out a single time, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)


def normalize_for_hash(x: Column | str) -> Column:
    """Lower case, without any white space and check marks; punctuation stays."""
    return F.lower(F.regexp_replace(col(x), r"[\s\x{0b}\x{85}\p{Z}✅]", ""))


def content_hash(stem: Column | str, options: Column | None = None, material: Column | None = None, punctuation: bool = True) -> Column:
    """128 bits, in hex, of a question's stem and ordered options (structs of label and content).

    The fingerprint can take the shared material in, or leave punctuation out, to compare definitions.
    """
    norm = normalize_for_hash if punctuation else lambda x: F.regexp_replace(normalize_for_hash(x), r"[\p{P}\p{S}]", "")
    parts = [norm(F.coalesce(col(stem), F.lit(""))), F.lit("|")]
    if options is not None:
        parts.append(F.coalesce(F.array_join(F.transform(options, lambda o: F.concat(o["label"], norm(o["content"]), F.lit("|"))), ""), F.lit("")))
    if material is not None:
        parts += [norm(F.coalesce(material, F.lit(""))), F.lit("|")]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def collapse_lines(x: Column | str) -> Column:
    """Trimmed lines, at most one blank line in a row, none at the ends."""
    lines = F.array_join(F.transform(F.split(col(x), "\n"), trim_all), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def _character(code: Column) -> Column:
    """The character of a code point; of one that is none, the replacement character, and for 128 to 159 that of Windows-1252."""
    windows = {c: bytes([c]).decode("cp1252", "replace") for c in range(0x80, 0xA0)}
    known = F.from_json(F.lit(json.dumps({c: x for c, x in windows.items() if x != "\ufffd"})), "map<string, string>")
    wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
    return F.coalesce(F.element_at(known, code.cast("string")), plain)


def unescape(x: Column | str, closed: bool = False) -> Column:
    """Text with its character references read once, from left to right, as browsers do.

    Named ones are those of HTML 5; without a semicolon the longest of the old names at the front counts, or none if only
    ``closed`` ones are asked for.  Numbers may be decimal or hexadecimal.  What is no reference stays.
    """
    names = {k: v for k, v in html5.items() if k.endswith(";")}
    old = {k: v for k, v in html5.items() if not k.endswith(";")}
    named, short = (F.from_json(F.lit(json.dumps(m)), "map<string, string>") for m in (names, old))
    longest, end = (0, ";") if closed else (max(map(len, old)), ";?")

    def read(piece: Column) -> Column:
        word = F.regexp_extract(piece, rf"^[A-Za-z][A-Za-z0-9]*{end}", 0)
        shorter = [F.struct(F.lit(n).alias("n"), F.element_at(short, F.when(F.length(word) >= n, F.left(word, F.lit(n)))).alias("x")) for n in range(longest, 1, -1)]
        first = F.get(F.filter(F.array(F.struct(F.length(word).alias("n"), F.element_at(named, word).alias("x")), *shorter), lambda c: c["x"].isNotNull()), F.lit(0))
        number = F.regexp_extract(piece, rf"^#(?:[xX][0-9a-fA-F]+|[0-9]+){end}", 0)
        digits = F.regexp_replace(number, r"^#[xX]?0*|;$", "")
        large = F.length(digits) > 7
        short_digits = F.when(digits == "", "0").when(~large, digits)
        code = F.coalesce(F.when(number.rlike("^#[xX]"), F.conv(short_digits, 16, 10)).otherwise(short_digits).cast("long"), F.lit(0x110000))
        rest = lambda n: F.substr(piece, n + 1)
        return F.when(number != "", F.concat(_character(code), rest(F.length(number)))).when(first.isNotNull(), F.concat(first["x"], rest(first["n"]))).otherwise(F.concat(F.lit("&"), piece))

    read_all = F.array_join(F.transform(F.split(col(x), "&", -1), lambda p, i: F.when(i == 0, p).otherwise(read(p))), "")
    return F.when(F.contains(col(x), F.lit("&")), read_all).otherwise(col(x))


#: The character references that are read where no others occur.
COMMON = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_tags(x: Column | str, every: bool = False, closed: bool = False) -> Column:
    """Without tags, the common character references read, or ``every`` one (of ``closed`` ones): the fallback where markup cannot be parsed."""
    plain = F.regexp_replace(col(x), r"<[^>]*>", "")
    return unescape(plain, closed) if every else reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), COMMON, plain)


def image_reference(src: Column | str) -> Column:
    """``kind/name`` of an image path: its folder and file name, null without a name."""
    clean = F.regexp_replace(F.translate(trim_all(src), "\\", "/"), r"/(?:\./|/)+", "/")
    kind, name = F.regexp_extract(clean, r"([^/]+)/[^/]+$", 1), F.regexp_extract(clean, r"([^/]+)$", 1)
    return F.when(name != "", F.concat(F.when(kind.isin("", "."), "未知").otherwise(kind), F.lit("/"), name))


def split_sub(x: Column | str) -> Column:
    """(qid, tag) of a heading's note: digits after ``qid``, what follows the middle dot."""
    tag = F.when(F.instr(col(x), "·") > 0, trim_all(F.regexp_extract(col(x), r"(?s)·(.*)$", 1))).otherwise("")
    return F.struct(F.regexp_extract(col(x), r"qid[\s\x{3000}]*(\d+)", 1).alias("qid"), tag.alias("tag"))


def first_of(x: Column | str, keywords: tuple[str, ...], default: str = "") -> Column:
    """The first of ``keywords``, in their order, that the text holds."""
    return F.coalesce(*(F.when(col(x).contains(k), k) for k in keywords), F.lit(default))


def classify_paper(name: Column | str, region: Column | str) -> Column:
    """(exam_type, variant) of a paper by ordered rules on its name and region."""
    n = col(name)
    kind = (
        F.when(n.contains("国家公务员") | (col(region) == "国考"), "国考")
        .when(n.contains("选调"), "选调")
        .when(n.contains("市考") | n.contains("深圳市") | n.contains("上海市"), "市考")
        .when(n.contains("公务员") | n.contains("联考"), "省考")
        .otherwise("其他")
    )
    return F.struct(kind.alias("exam_type"), first_of(n, VARIANTS).alias("variant"))


def has_math_marker(x: Column | str) -> Column:
    return reduce(lambda a, b: a | b, (col(x).contains(m) for m in MATH_MARKERS))


def has_math_delimiter(x: Column | str) -> Column:
    """At least two dollar signs."""
    return F.length(col(x)) - F.length(F.replace(col(x), F.lit("$"), F.lit(""))) >= 2


def contains_han(x: Column | str) -> Column:
    return col(x).rlike(r"\p{IsHan}")


def normalize_tex(x: Column | str) -> Column:
    """One line, single spaces, no trailing semicolons, no blanks inside the dollar signs (an unpaired last one included).

    Pairs are taken possessively: a loop that may go back holds a stack frame for each pair, and thousands end the executor.
    """
    s = trim_all(F.regexp_replace(trim_all(F.regexp_replace(col(x), rf"{SPACE}++", " ")), r"(?<![;； ])[;； ]++$", ""))

    def inner(s: Column) -> Column:
        pairs = F.regexp_replace(s, r"\$[ \t]*([^$]*?)[ \t]*\$", r"\$$1\$")
        return F.when(has_math_delimiter(s), F.regexp_replace(pairs, r"^((?:[^$]*+\$[^$]*+\$)*+[^$]*+\$)[ \t]++([^$]*+)$", "$1$2")).otherwise(s)

    return once(s, inner)


def tex_class(x: Column | str) -> Column:
    return once(normalize_tex(x), lambda s: F.when(s == "", "empty").when(has_math_delimiter(s), "has_delim").when(contains_han(s) & ~has_math_marker(s), "cjk_text").otherwise("math_wrap"))


def display_tex(x: Column | str) -> Column:
    """As it is if empty, delimited, Han text without formula signs or long; else between dollar signs."""

    def shown(s: Column) -> Column:
        plain = (s == "") | has_math_delimiter(s) | (contains_han(s) & ~has_math_marker(s)) | (F.length(s) > LONGEST_WRAPPED)
        return F.when(plain, s).otherwise(F.concat(F.lit("$"), s, F.lit("$")))

    return once(normalize_tex(x), shown)


def escape_html(x: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), x)


def search_highlight(text: Column | str, query: str, mode: str = "keyword", around: int = 20) -> Column:
    """The first hit, letters of either case, marked, with ``around`` characters on both sides; null without a hit."""
    q = query.strip()
    if mode == "concept" or not q:
        return F.lit(None).cast("string")
    t, n = col(text), len(q)
    at = F.instr(F.lower(t), q.lower())
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + n + around - 1, F.length(t))
    cut = lambda a, b: escape_html(F.substring(t, a, F.greatest(b - a, F.lit(0))))
    marked = F.concat(F.when(start > 1, "…").otherwise(""), cut(start, at), F.lit("<mark>"), cut(at, at + n), F.lit("</mark>"), cut(at + n, end + 1), F.when(end < F.length(t), "…").otherwise(""))
    return F.when(at > 0, marked)


def sanitize_text(x: Column | str) -> Column:
    """Tabs become spaces, line ends one kind; null if angle brackets, backticks, control or format characters remain."""
    s = F.translate(F.replace(col(x), F.lit("\r"), F.lit("\n")), "\t", " ")
    return F.when(~s.rlike(r"[<>`\x{fffd}]|[\p{Cc}&&[^\n]]|\p{Cf}"), trim_all(s))


def safe_csv_cell(x: Column | str) -> Column:
    """A quote in front of what a spreadsheet would run."""
    return F.when(col(x).rlike(r"^[\s\p{Z}\p{Cc}\x{FEFF}]*[=+\-@]|^[\t\r\n]"), F.concat(F.lit("'"), col(x))).otherwise(col(x))


def repair_escapes(x: Column | str) -> Column:
    """Form feeds, backspaces and carriage returns back to the backslash pairs that a JSON reader took for escapes."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), (("\f", "\\f"), ("\b", "\\b"), ("\r", "\\r")), col(x))


def json_object_in(x: Column | str) -> Column:
    """From the first opening to the last closing brace, whatever fences and words stand around."""
    return F.regexp_extract(col(x), r"(?s)\{.*\}", 0)


def prefix_before_dash(x: Column | str) -> Column:
    return F.when(F.instr(col(x), "-") > 1, F.substring_index(col(x), "-", 1)).otherwise("")


def shorten(x: Column | str, n: int, mark: str = "…") -> Column:
    """At most n code points, with a mark where something is left out."""
    return F.when(F.length(col(x)) > n, F.concat(F.substring(col(x), 1, n), F.lit(mark))).otherwise(col(x))


def brief(x: Column | str, n: int = 40) -> Column:
    return F.replace(F.substring(col(x), 1, n), F.lit("\n"), F.lit(" "))


def mark_of(options: Column) -> Column:
    """Labels of the options marked as correct, in order."""
    return F.array_join(F.transform(F.filter(options, lambda o: o["is_correct"]), lambda o: o["label"]), "")


#: A number of an IPv4 address, without leading zeros.
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
QUAD = r"\.".join([OCTET] * 4)


def ipv6_groups(x: Column) -> Column:
    """The eight numbers of an IPv6 address in lower case, two colons filled up with zeros; null for anything else."""
    octets = [F.regexp_extract(x, rf":{QUAD}\z", k).try_cast("int") for k in (1, 2, 3, 4)]
    pair = lambda a, b: F.hex(a * 256 + b)
    plain = F.when(octets[0].isNull(), x).otherwise(F.lower(F.concat(F.regexp_replace(x, r"[0-9.]+\z", ""), pair(*octets[:2]), F.lit(":"), pair(*octets[2:]))))

    def groups(sides: Column) -> Column:
        side = lambda k: F.when(F.coalesce(F.get(sides, k), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(sides, k), ":", -1))
        missing = 8 - F.size(side(0)) - F.size(side(1))
        filled = F.concat(side(0), F.array_repeat(F.lit("0"), F.when((F.size(sides) == 2) & (missing > 0), missing).otherwise(0)), side(1))
        return F.when(F.size(sides) <= 2, once(filled, lambda g: F.when((F.size(g) == 8) & ((F.size(sides) == 1) | (missing > 0)) & F.forall(g, lambda x: x.rlike(r"\A[0-9a-f]{1,4}\z")), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int")))))

    return once(F.split(plain, "::", -1), groups)


def mask_ip(x: Column | str) -> Column:
    """IPv4 without its last number, also where it is mapped into IPv6; IPv6 cut to its first 48 bits and written in
    its shortest form, without a zone; empty for null and anything else."""

    def short(g: Column) -> Column:
        at = lambda k: F.get(g, k)
        mapped = (F.greatest(*(at(k) for k in range(5))) == 0) & (at(5) == 0xFFFF)
        four = F.concat(F.concat_ws(".", F.floor(at(6) / 256).cast("string"), (at(6) % 256).cast("string"), F.floor(at(7) / 256).cast("string")), F.lit(".*"))
        head = F.regexp_replace(F.lower(F.concat_ws(":", *(F.hex(at(k)) for k in range(3)))), r"(?:(?:\A|:)0)+\z", "")
        return F.when(g.isNull(), "").when(mapped, four).otherwise(F.concat(head, F.lit("::/48")))

    low = F.coalesce(F.lower(col(x)), F.lit(""))
    six = once(ipv6_groups(F.regexp_replace(low, r"(?s)(?<=.)%.+\z", "")), short)
    return F.when(low.rlike(rf"\A{QUAD}\z"), F.regexp_replace(low, r"[0-9]+\z", "*")).when(low.contains(":"), six).otherwise("")


def device_label(agent: Column | str) -> Column:
    """Browser and system of a user agent, in broad classes."""
    a = col(agent)
    browser = F.when(a.rlike("Edg/|EdgA/|EdgiOS/"), "Edge").when(a.rlike("Firefox/|FxiOS/"), "Firefox").when(a.rlike("Chrome/|CriOS/"), "Chrome").when(a.contains("Safari/"), "Safari").otherwise("其他浏览器")
    system = F.when(a.contains("Android"), "Android").when(a.rlike("iPhone|iPad"), "iOS").when(a.contains("Windows"), "Windows").when(a.contains("Mac OS X"), "macOS").when(a.contains("Linux"), "Linux").otherwise("未知系统")
    return F.concat(browser, F.lit(" / "), system)


def controlled_device(label: Column | str) -> Column:
    return F.when(col(label).rlike("^(Chrome|Edge|Firefox|Safari|其他浏览器) / (Windows|macOS|Linux|Android|iOS|未知系统)$"), col(label)).otherwise("信息未知")


def normalize_email(x: Column | str) -> Column:
    return F.lower(trim_all(x))


def valid_email(x: Column | str) -> Column:
    """At most 254 bytes, no blanks, one @ with something on both sides, and a dot behind it."""
    return (F.octet_length(col(x)) <= 254) & col(x).rlike(r"^[^@ \t\r\n]+@[^@ \t\r\n]*\.[^@ \t\r\n]*\z")


def token_hash(x: Column | str) -> Column:
    return F.sha2(col(x), 256)


def ascii_lower(x: Column | str) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(col(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_literal(x: Column | str, term: str) -> Column:
    """Contains, ASCII letters of either case, with the term's wildcards taken literally."""
    return F.contains(ascii_lower(x), ascii_lower(F.lit(term)))
