"""Other sources: image folders, line-delimited results, the taxonomy; and the sinks' CSV export."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.functions.text import safe_csv_cell
from tamarack.operators.tables import file_system

RESULT_SCHEMA = "sha256 string, status string, tex string, error string, model string"
EXPORT_LIMIT = 5000


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG, GIF or JPEG; zeros for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            kind, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + length
    return 0, 0


def image_index(spark: SparkSession, folder: str) -> DataFrame:
    """``url, bytes, sha256, width, height`` of the images below a folder."""

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            wh = [image_size(bytes(x)) for x in f.pop("content")]
            yield f.assign(width=[w for w, _ in wh], height=[h for _, h in wh])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    parts = F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/")
    url = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    found = files.select(url.alias("url"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")  # whole: metadata may stand before a JPEG's frame
    return found.mapInPandas(sizes, "url string, bytes long, sha256 string, width int, height int")


def missing_and_orphans(references: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References without a file, and files that nothing refers to."""
    return references.join(files, "url", "left_anti"), files.join(references, "url", "left_anti")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of workers, one JSON object a line; blank and cut-off lines are skipped."""
    return spark.read.schema(RESULT_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("sha256 IS NOT NULL")


def taxonomy(spark: SparkSession, modules: dict[str, dict[str, list[str]]]) -> DataFrame:
    """The closed vocabulary (subject, secondary, tertiary); an empty one is an error."""
    rows = [(m, s, t) for m, secondaries in modules.items() for s, tertiaries in secondaries.items() for t in tertiaries]
    if not rows:
        raise ValueError("the taxonomy has no modules")
    return spark.createDataFrame(rows, "subject string, secondary string, tertiary string")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The closed vocabulary of a YAML file: modules with their subject, these with secondary ones by name and their tertiary ones.

    The file is a written list of some hundred names, read whole.
    """
    import yaml  # only for this reader

    text = spark.read.text(path, wholetext=True).first()
    modules = (yaml.safe_load(text[0]) if text else None) or {}
    return taxonomy(spark, {m.get("subject", ""): {s.get("name", ""): s.get("tertiary") or [] for s in m.get("secondary") or []} for m in modules.get("modules") or []})


def export_csv(rows: DataFrame, order: list[str], path: str, limit: int = EXPORT_LIMIT, hidden: str | None = None) -> int:
    """Rows as CSV with guarded text cells; more than ``limit`` rows are refused as a whole.  ``hidden`` only orders."""
    n = rows.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} rows")
    safe = rows.select(*(safe_csv_cell(c).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
    safe.orderBy(*order).drop(*([hidden] if hidden else [])).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return n


def export_file(rows: DataFrame, order: list[str], path: str, names: dict[str, str] | None = None, limit: int = EXPORT_LIMIT) -> int:
    """One CSV file at ``path``, with a byte-order mark, guarded cells and the headings of ``names``; all of it or nothing.

    It is written beside its place and moved there when it is whole; a file that is there is not replaced.  More than
    ``limit`` rows are refused, so the file has a bound.
    """
    spark = rows.sparkSession
    fs, target = file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    _, folder = file_system(spark, draft)
    try:
        n = export_csv(_headed(rows, order, names or {}), ["_at"], draft, limit, hidden="_at")
        part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        if not fs.rename(part, target):
            raise OSError(f"{path} could not be put in place")
        return n
    finally:
        fs.delete(folder, True)


def _headed(rows: DataFrame, order: list[str], names: dict[str, str]) -> DataFrame:
    """The columns under their headings, the mark before the first one, and ``_at`` for the order."""
    first = rows.columns[0]
    return rows.select(*(F.col(c).alias(("\ufeff" if c == first else "") + names.get(c, c)) for c in rows.columns), F.struct(*order).alias("_at"))
