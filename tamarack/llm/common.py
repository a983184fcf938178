"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(text: str | Column = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; where none is set, a temporary one if all tasks run on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tamarack-"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate table whose rows are not needed again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of text that a task takes at once, at least a row.
SLICE_BYTES = 3 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``SLICE_BYTES`` of text, at least a row each."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        part, at = size // SLICE_BYTES, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
            if end > at:
                yield batch.slice(at, end - at)
            at = end


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a session, unless their ``PYTHONPATH`` names its folder anyway."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark, "_tamarack_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tamarack-")) / "tamarack_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "tamarack").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark._tamarack_shipped = True


#: DuckDB SQL: one row, the list ``tab`` of the CRC-32 of all bytes, worked out from its polynomial.
CRC_TABLE_SQL = "SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))"


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the CRC-32 of a text's UTF-8 bytes, with ``tab`` of ``CRC_TABLE_SQL`` in scope."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
