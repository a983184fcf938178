"""Secret scans: all rules in one byte pass of one combined deterministic automaton.

Each rule is a regular expression and a least length.  The rules' triggers (the expression up to the first byte of its
last part, or a run of the least length) are compiled together by subset construction and minimisation into one
transition array, on the driver: some 2,700 states whatever the input, a broadcast of a few MB.  One pass over the bytes of a text gives the ends of all triggers; a small automaton of the reversed
rule leads from an end to the start, and one of the whole rule from the start to the longest match.  Matches of a rule
are taken from the left without overlaps, and those that are too short are dropped after that.

Defined cases: a null or empty text has no spans; repeated rows are scanned alike; an empty table gives an empty result;
other columns are left alone; spans count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.automata import backwards, compile_trees, fold_case, parse
from tamarack.llm.common import documents

VALUE = "[A-Za-z0-9+/_.=-]"
KEYWORD = "(password|passwd|secret|token|api_?key)"
#: Rules as (kind, trigger, what may follow the trigger, least length, whether of the last part alone).
#: ``KEYWORD`` stands for letters of either case.
RULES = (
    ("assign", KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?" + VALUE, VALUE, 8, True),
    ("access", "AKIA[A-Z0-9]", "[A-Z0-9]", 16, False),
    ("hex", "[0-9a-f]{32}", "[0-9a-f]", 32, False),
    ("github", "gh(p|o|u|s|r)_[A-Za-z0-9]", "[A-Za-z0-9]", 36, False),
    ("gitlab", "glpat-[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 26, False),
    ("slack", "xox(a|b|p|r|s)-[A-Za-z0-9-]", "[A-Za-z0-9-]", 20, False),
    ("google", "AIza[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 39, False),
    ("stripe", "(sk|rk)_(live|test)_[A-Za-z0-9]", "[A-Za-z0-9]", 24, False),
    ("npm", "npm_[A-Za-z0-9]", "[A-Za-z0-9]", 40, False),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 40, False),
    ("private_key", "-----BEGIN( (RSA|DSA|EC|OPENSSH|PGP))? PRIVATE KEY( BLOCK)?-----", "", 20, False),
    ("aws_temporary", "ASIA[A-Z0-9]", "[A-Z0-9]", 20, False),
    ("github_fine", "github_pat_[A-Za-z0-9_]", "[A-Za-z0-9_]", 40, False),
    ("slack_app", "xapp-[A-Za-z0-9-]", "[A-Za-z0-9-]", 24, False),
    ("slack_hook", "https://hooks\\.slack\\.com/services/[A-Za-z0-9/]", "[A-Za-z0-9/]", 60, False),
    ("discord_hook", "https://discord\\.com/api/webhooks/[0-9]", "[A-Za-z0-9/_-]", 80, False),
    ("sendgrid", "SG\\.[A-Za-z0-9_-]", "[A-Za-z0-9_.-]", 60, False),
    ("mailgun", "key-[0-9a-z]", "[0-9a-z]", 36, False),
    ("twilio", "(SK|AC)[0-9a-f]", "[0-9a-f]", 34, False),
    ("digitalocean", "do(o|p|r)_v1_[0-9a-f]", "[0-9a-f]", 71, False),
    ("shopify", "shp(at|ca|pa|ss)_[0-9A-Fa-f]", "[0-9A-Fa-f]", 38, False),
    ("square", "sq0(atp|csp|idp)-[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 29, False),
    ("pypi", "pypi-[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 60, False),
    ("rubygems", "rubygems_[0-9a-f]", "[0-9a-f]", 57, False),
    ("hugging_face", "hf_[A-Za-z0-9]", "[A-Za-z0-9]", 37, False),
    ("google_oauth", "ya29\\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 30, False),
    ("google_client", "GOCSPX-[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 35, False),
    ("atlassian", "ATATT3[A-Za-z0-9_=-]", "[A-Za-z0-9_=-]", 100, False),
    ("new_relic", "NRAK-[A-Z0-9]", "[A-Z0-9]", 32, False),
    ("databricks", "dapi[0-9a-f]", "[0-9a-f]", 36, False),
    ("vault", "hvs\\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 90, False),
    ("doppler", "dp\\.pt\\.[A-Za-z0-9]", "[A-Za-z0-9]", 49, False),
    ("linear", "lin_api_[A-Za-z0-9]", "[A-Za-z0-9]", 48, False),
    ("planetscale", "pscale_(tkn|pw)_[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 40, False),
    ("age", "AGE-SECRET-KEY-1[A-Z0-9]", "[A-Z0-9]", 70, False),
    ("authorization", "(A|a)uthorization:\\x20*(Bearer|bearer|Basic|basic)\\x20+[A-Za-z0-9+/_.=-]", "[A-Za-z0-9+/_.=-]", 16, True),
)
KINDS = tuple(r[0] for r in RULES)
BASE_KINDS = KINDS[:3]


@cache
def _compiled() -> tuple:
    """The combined automaton as a flat list (state * 256 + byte), its accepting states last, and the small ones."""
    trees = []
    for kind, trigger, more, _, _ in RULES:
        if kind == "assign":
            tree = ("cat", [fold_case(parse(KEYWORD)), parse(trigger.removeprefix(KEYWORD))])
        else:
            tree = parse(trigger)
        trees.append((tree, ("cat", [tree, ("*", parse(more))]) if more else tree))
    moves, ends = compile_trees([t for t, _ in trees], anywhere=True)
    order = sorted(range(len(ends)), key=lambda s: (bool(ends[s]), s))
    place = {s: i for i, s in enumerate(order)}
    flat = [place[int(x)] * 256 for s in order for x in moves[s]]
    first_end = sum(not e for e in ends) * 256
    by_state = {place[s] * 256: sorted(e) for s, e in enumerate(ends) if e}
    small = []
    for tree, whole in trees:
        parts = [compile_trees([t], anywhere=False) for t in (backwards(tree), whole)]
        small.append([([row.tolist() for row in m], [bool(e) for e in a]) for m, a in parts])
    return flat, place[0] * 256, first_end, by_state, small


def _walk(automaton: tuple, data: bytes, steps: range) -> int | None:
    """The last position of ``steps`` after which the automaton accepts."""
    moves, ends = automaton
    state, last = 0, None
    for i in steps:
        state = moves[state][data[i]]
        if state < 0:
            break
        if ends[state]:
            last = i
    return last


def find(data: bytes, automata: tuple | None = None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in bytes, by start, then kind as listed."""
    flat, state, first_end, by_state, small = automata or _compiled()
    hits = []
    for i, b in enumerate(data):
        state = flat[state + b]
        if state >= first_end:
            hits.append((i, state))
    if not hits:
        return []
    done, out = [0] * len(RULES), []
    for i, state in hits:
        for r in by_state[state]:
            if i < done[r]:
                continue
            start = _walk(small[r][0], data, range(i, done[r] - 1, -1))
            if start is None:
                continue
            end = _walk(small[r][1], data, range(start, len(data))) + 1
            done[r] = end
            kind, trigger, more, least, last_part = RULES[r]
            # of an assignment the value counts: what follows the trigger, and its last byte
            long_enough = end - i if last_part else end - start
            if long_enough >= least:
                out.append((start, r, end))
    return [(KINDS[r], a, b) for a, r, b in sorted(out)]


def in_code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The same spans counted in code points; offsets are translated in one pass from left to right."""
    if data.isascii():
        return spans
    places, at, n = {}, 0, 0
    for x in sorted({x for _, a, b in spans for x in (a, b)}):
        n += sum((c & 0xC0) != 0x80 for c in data[at:x])
        places[x], at = n, x
    return [(k, places[a], places[b]) for k, a, b in spans]


def secret_scans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end) in code points."""
    compiled = docs.sparkSession.sparkContext.broadcast(_compiled())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        automata = compiled.value
        for batch in batches:
            rows = []
            for data in batch.column("text").cast(pa.binary()).to_pylist():
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in in_code_points(data, find(data, automata))] if data else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, span)], names=["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secret_scans(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
