"""A training corpus in five stages: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a DataFrame
that is written as Parquet in the shared folder and read again as the next one's documents.  All but the last return
the columns of ``documents``.

Defined cases of all stages: a null text counts as an empty one, which the quality rules reject; a null source is a
source of its own; repeated rows are copies, of which one stays after the third stage; an empty table stays empty; other
columns are carried along to the packing, which returns its own.  The table of a stage is deleted when the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.common import documents, free_name, remove_folder, shared_folder, ship, text_of
from tamarack.llm.line_dedup import line_dedup
from tamarack.llm.mixing import apply_mix
from tamarack.llm.ngram_join import ngram_join
from tamarack.llm.packing import pack, tokenizer_path
from tamarack.llm.quality_rules import quality_rules

#: A line that more than one text in twenty of a source holds is that source's boilerplate; copies of a text count once.
LINE_RATIO, LINE_DOCUMENTS = 0.05, 100
#: Near duplicates: five words, a similarity of 0.8.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality_rules(docs, into="quality_of").where("quality_of.kept").drop("quality_of")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; one that has nothing else goes."""
    found = line_dedup(docs, F.col("source"), ratio=LINE_RATIO, min_pages=LINE_DOCUMENTS, by_text=True)
    found = found.where(F.col("text").rlike(r"[^\s]"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near duplicates; repeated rows of an id are such a group.

    A row without an id gets one far above others from a hash of its text, so copies of a text are found with and without
    ids, and the row with an id stays.
    """
    ship(spark)
    key = free_name(docs, "_key")
    named = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text_of()).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))))
    groups = ngram_join(named, WORDS, PERCENT, doc_id=key)
    gone = groups.where("component_id != doc_id").select(F.col("doc_id").alias(key))
    return named.join(gone, key, "left_anti").dropDuplicates([key]).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: sources near their targets, whole documents repeated or left out, one a source cut at its target."""
    ship(spark)
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, like documents side by side."""
    ship(spark)
    return pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Hashed orders, sketches and a tokenizer: not for SQL.  The stages' operators are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written to the shared folder."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                remove_folder(spark, f"{folder}/{i - 1}")
    return docs
