"""Versions of a set of tables: each is written whole, named by a manifest, and never changed.

A reader takes one version and reads all of its tables from it, whatever writers publish meanwhile.  A manifest is made
under its number at once or not at all, so of two writers of one number one fails, and a version without a manifest is
not seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.operators.tables import file_system, names_below


class Conflict(RuntimeError):
    """Another writer has published the number that this one was to get."""


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in names_below(spark, f"{root}/manifests") if n.endswith(".json")]


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    """Folder, number of rows and schema of each table of a version."""
    rows = spark.read.text(f"{root}/manifests/{version:09d}.json", wholetext=True).first()
    return json.loads(rows[0])


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int | None = None) -> int:
    """Write ``tables`` as the version after ``base`` (the newest one if not given); tables not named are taken over from it."""
    known = versions(spark, root)
    base = (known[-1] if known else 0) if base is None else base
    held = manifest(spark, root, base)["tables"] if base else {}
    for name, rows in tables.items():
        folder = f"{root}/data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        written = spark.read.parquet(folder)
        held[name] = {"folder": folder, "rows": written.count(), "schema": written.schema.simpleString()}
    version = base + 1
    text = json.dumps({"version": version, "base": base, "tables": held}, ensure_ascii=False, sort_keys=True)
    fs, target = file_system(spark, f"{root}/manifests/{version:09d}.json")
    _, draft = file_system(spark, f"{root}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs.mkdirs(target.getParent())
    # a rename does not replace a file that is there
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {root} is taken")
    return version


def pinned(spark: SparkSession, root: str, version: int | None = None) -> Callable[[str], DataFrame]:
    """A reader of the tables of one version, the newest one if none is given."""
    if version is None:
        version = versions(spark, root)[-1]
    tables = manifest(spark, root, version)["tables"]
    return lambda name: spark.read.parquet(tables[name]["folder"])
