"""Line dedup: lines that a large share of a host's pages repeat are boilerplate and go, in native column expressions.

Pages are grouped by host.  A line's ratio is the number of the host's pages that hold it, divided by the host's pages;
lines above the limit are dropped from every page of the host.  Lines are counted under a 128-bit hash of two 64-bit
ones, pre-aggregated before the shuffle.  As the ratios of a host's lines sum to its mean number of lines a page, a host
has at most (mean lines) / ratio such lines: a bounded list that is joined to the pages by host.  The pages
of a host are dealt to ``SALTS`` parts there, as one host may hold a third of all pages; the list is repeated for each.

Defined cases: a null text stays null; lines are compared as they are, but for white space at their ends; lines without
a word are kept and not counted; a null host is a host of its own; hosts with fewer than ``min_pages`` pages are left
alone; repeated rows are pages of their own unless ``by_text``, where pages with one text count as a single page; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamarack.llm.common import free_name, shared_folder

RATIO, MIN_PAGES = 0.2, 5
#: Parts into which a host's pages are dealt when they meet its list.
SALTS = 64


def _key(line: str) -> str:
    """128 bits of a line without the white space at its ends."""
    x = f"trim(BOTH ' \\t\\r' FROM {line})"
    return f"struct(xxhash64({x}) AS a, xxhash64(1, {x}) AS b)"


def frequent_lines(pages: DataFrame, host: Column, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, by_text: bool = False) -> DataFrame:
    """One row for each host with boilerplate: ``host`` and ``lines``, the hashes of its frequent lines."""
    p = pages.select(host.alias("host"), F.col(text).alias("t"))
    # a page's text as 128 bits: only these are shuffled with its lines, once for all of its copies in a task
    own = [F.expr("struct(xxhash64(t) AS a, xxhash64(1, t) AS b)").alias("own")] if by_text else []
    count = F.countDistinct("own") if by_text else F.count("*")
    totals = p.select("host", *own).groupBy("host").agg(count.alias("pages")).where(F.col("pages") >= min_pages)
    k = F.explode(F.expr(f"array_distinct(transform(filter(split(t, '\\n'), x -> x rlike '[^\\\\s]'), x -> {_key('x')}))"))
    counts = p.select("host", *own, k.alias("k")).groupBy("host", "k").agg(count.alias("n")).where(F.col("n") > 1)
    counts = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).drop(totals["host"])
    return counts.where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("k").alias("lines"))


def line_dedup(pages: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None, by_text: bool = False) -> DataFrame:
    """``pages`` with ``text`` freed of boilerplate; ``dropped`` names a column for the number of lines that went."""
    known = frequent_lines(pages, host, text, ratio, min_pages, by_text)
    h, lines, kept = (free_name(pages, n) for n in ("_host", "_lines", "_kept"))
    known = known.select(F.col("host").alias(h + "k"), F.col("lines").alias(lines))
    # the few rows of the lists are repeated for each salt, so that a host's pages go to as many tasks
    salt = free_name(pages, "_salt")
    known = known.withColumn(salt + "k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = pages.withColumn(h, host).withColumn(salt, F.pmod(F.xxhash64(text, *pages.columns[:1]), F.lit(SALTS)).cast("int"))
    d = d.join(known, d[h].eqNullSafe(F.col(h + "k")) & (d[salt] == F.col(salt + "k")), "left")
    d = d.withColumn(kept, F.expr(f"filter(split(`{text}`, '\\n'), x -> NOT array_contains({lines}, {_key('x')}))"))
    new = F.when(F.col(lines).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = [new.alias(c) if c == text else F.col(c) for c in pages.columns]
    if dropped:
        n = F.expr(f"CASE WHEN {lines} IS NULL OR `{text}` IS NULL THEN 0L ELSE CAST(size(split(`{text}`, '\\n')) - size({kept}) AS long) END")
        out.append(n.alias(dropped))
    return d.select(*out)


#: Marks openings without an end while the others go; where a page holds it already, it is followed by 0.
MARK = "\ue000"
#: Openings of what goes whole, with the pattern of their ends.
WHOLE = (("script", "</script>"), ("style", "</style>"), ("!--", "-->"))
_BLOCKS = "p|div|li|ul|ol|nav|br|h[1-6]|article|header|footer|title|head|body|table|tr|section"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out a single time, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)


def _before_last(h: Column, end: str, change: Callable[[Column], Column]) -> Column:
    """``change`` up to the last ``end``."""
    cut = lambda x, rest: F.concat(change(F.left(x, F.length(x) - F.length(rest))), rest)
    return _once(h, lambda x: _once(F.substring_index(x, end, -1), lambda rest: cut(x, rest)))


def _marked(h: Column) -> Column:
    """Openings behind the last end of their kind, marked."""
    h = F.replace(h, F.lit(MARK), F.lit(MARK + "0"))
    for begin, end in WHOLE:
        head = F.regexp_extract(h, f"(?is)^.*{end}", 0)
        h = F.concat(head, F.regexp_replace(F.substr(h, F.length(head) + 1), f"(?i)<(?={begin})", f"<{MARK}1"))
    return h


def page_lines(html: str | Column) -> Column:
    """A page as lines: scripts, styles and comments go, block elements begin lines, other tags become nothing.

    No pattern is tried where its end is missing, so the time is in proportion to the page: openings behind the last end
    of their kind, which few pages have, are marked first, tags are sought up to the last ``>``, and blanks from their
    beginning only.
    """
    page = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    low = F.lower(page)
    open_ended = reduce(or_, (F.contains(F.substring_index(low, end, -1), F.lit(f"<{begin}")) for begin, end in WHOLE))
    h = F.when(open_ended, _marked(page)).otherwise(page)
    h = F.regexp_replace(h, "(?is)<(?:" + "|".join(f"{b}.*?{e}" for b, e in WHOLE) + ")", "")
    h = _before_last(h, ">", lambda x: F.regexp_replace(x, f"(?i)</?({_BLOCKS})[^>]*>", "\n"))
    h = _before_last(h, ">", lambda x: F.regexp_replace(x, r"<[^>]*>", ""))
    h = _once(h, lambda x: F.when(open_ended, F.replace(F.replace(x, F.lit(MARK + "1"), F.lit("")), F.lit(MARK + "0"), F.lit(MARK))).otherwise(x))
    # a run of blanks is tried at its first one only
    h = F.regexp_replace(h, r"[ \t\r](?<![ \t\r]{2})[ \t\r]*+\n\s*+|\n\s*+", "\n")
    return F.btrim(h, F.lit(" \t\n\x0b\f\r"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    p = p.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), page_lines("html").alias("text"))
    # the lines are read twice, to be counted and to be kept, and made once
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    p.write.parquet(folder)
    p = spark.read.parquet(folder)
    d = line_dedup(p, F.col("host"), dropped="n_dropped")
    return d.select("page_id", "host", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH raw AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, coalesce(html, '') AS h FROM pages),
a AS (SELECT page_id, host, regexp_replace(h, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS h FROM raw),
b AS (SELECT page_id, host, regexp_replace(regexp_replace(h, '(?i)</?(p|div|li|ul|ol|nav|br|h[1-6]|article|header|footer|title|head|body|table|tr|section)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, host, regexp_replace(regexp_replace(h, '[ \t\r]*\n[\s]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM b),
l AS (SELECT page_id, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM c),
x AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
n AS (SELECT host, k, count(DISTINCT page_id) AS n FROM x WHERE regexp_matches(k, '\S') GROUP BY host, k),
s AS (SELECT host, count(*) AS pages FROM raw GROUP BY host),
f AS (SELECT n.host, n.k FROM n JOIN s ON n.host = s.host WHERE s.pages >= 5 AND n.n > 1 AND n.n > 0.2 * s.pages),
kept AS (SELECT x.page_id, string_agg(x.line, chr(10) ORDER BY x.i) AS t FROM x LEFT JOIN f ON x.host = f.host AND x.k = f.k WHERE f.k IS NULL GROUP BY x.page_id),
d AS (SELECT x.page_id, count(*) AS n FROM x JOIN f ON x.host = f.host AND x.k = f.k GROUP BY x.page_id)
SELECT raw.page_id, raw.host, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dropped, CAST(length(coalesce(kept.t, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM raw LEFT JOIN kept ON raw.page_id = kept.page_id LEFT JOIN d ON raw.page_id = d.page_id
"""
