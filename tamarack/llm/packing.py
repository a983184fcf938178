"""Packing along a space-filling curve: documents that are alike lie next to each other in the training sequences.

A document's token ids give a vector of hashed features, projected to a few dimensions by a fixed random matrix and
mapped to its place on a Hilbert curve.  Documents are range-sorted by that key, a prefix sum over the few range totals
and within each range gives every document its place in one endless stream of tokens, and the stream is cut every
``length`` tokens.  Only the last sequence can need padding.  Texts are tokenized once, and their ids written to the
shared folder; small rows (id, key, number of tokens) are sorted, and the ids are shuffled once, to meet their places.

Defined cases: a null text is empty, so a document of one token; equal rows lie one after the other; an empty table
gives an empty result; copies without end at one place of the curve are dealt by a hash of the id; other columns are
not looked at.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tamarack.llm.common import documents, materialize, shared_folder, shuffle_partitions, slices, text_of

LENGTH, END_ID = 4096, 2
DIMENSIONS, BITS = 4, 10
#: Runs whose ids a Python process keeps, twice: those of late and those before.
KNOWN_RUNS = 300_000


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _gather(pool: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of ``pool`` (of these lengths, one behind the other) that ``codes`` name, and where each ends."""
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.repeat((np.cumsum(lengths) - lengths)[codes] - ends + n, n)
    at += np.arange(len(at))
    return pool[at], ends


class Encoder:
    """Token ids of texts, as 16 or 32-bit numbers.

    No token of this tokenizer spans white space.  The words of many texts are cut by Arrow, once for each different word,
    into their runs of letters, digits and signs, and the tokenizer's model gives the ids of a run that is not known.  Words
    with anything but printable ASCII and Latin-1 letters, and with the signs of special tokens, go through the whole tokenizer.
    """

    PLAIN = "[\x21-\x7e\xc0-\xff]*"
    #: One run; Arrow puts a blank behind each.
    RUN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        #: Runs (and words that are not plain) seen of late, and those seen before.
        self.known, self.known_before = {}, {}
        self.type, self.code = (np.uint16, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        self.end, self.letters = end, _byte_letters()
        self.plain = re.compile(self.PLAIN).fullmatch

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            found = self.tokenize(part)
        elif not self.plain(part) or "<|" in part:
            return array(self.code, self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        else:
            found = self.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))
        return array(self.code, [t.id for t in found]).tobytes()

    def _parts(self, parts: list[str]) -> list[bytes]:
        out = list(map(self.known.get, parts))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            if len(self.known) >= KNOWN_RUNS:
                self.known_before, self.known = self.known, {}
            part = parts[i]
            if (ids := self.known_before.get(part)) is None:
                ids = self._part(part)
            out[i] = self.known[part] = ids
        return out

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text ends."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        n_words = words.value_lengths().to_numpy().astype(np.int64)
        words = words.flatten().dictionary_encode()
        different = words.dictionary
        plain = pc.and_not(pc.match_substring_regex(different, f"^{self.PLAIN}$"), pc.match_substring(different, "<|"))
        runs = pc.replace_substring_regex(pc.utf8_lower(different), self.RUN, r"\0 ")
        parts = pc.split_pattern(pc.if_else(plain, runs, different), " ")
        n_parts = parts.value_lengths().to_numpy().astype(np.int64)
        parts = parts.flatten().dictionary_encode()
        ids = self._parts(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.type().itemsize
        pool, ends = _gather(np.frombuffer(b"".join(ids), dtype=self.type), lengths, parts.indices.to_numpy())
        # the ids of each different word, and behind them the id that ends a text, as one more word
        ends = np.append(0, ends)[np.cumsum(n_parts)]
        lengths = np.append(np.diff(ends, prepend=0), 1)
        codes = np.insert(words.indices.to_numpy(), np.cumsum(n_words), len(different))
        found, ends = _gather(np.append(pool, self.type(self.end)), lengths, codes)
        return found, ends[np.cumsum(n_words + 1) - 1]

    def __call__(self, text: str | None) -> bytes:
        return self.many(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=1)
def encoder(path: str, end: int) -> Encoder:
    """One of a Python process, so that the next task there knows the runs of those before."""
    return Encoder(path, end)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of whole numbers below 2**bits) on a Hilbert curve through all dimensions."""
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(len(x), dtype=np.int64), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def encoded(docs: DataFrame, path: str, end: int = END_ID) -> DataFrame:
    """``doc_id, h, tokens, place, ids``: from (doc_id, h, text), the token ids, their number and the place on the curve."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end)
        matrix = np.random.default_rng(7).normal(size=(1 << 16, DIMENSIONS)).astype(np.float32)
        for part in slices(batches):
            found, ends = encode.many(part.column("text"))
            tokens = np.diff(ends, prepend=0)
            points = np.add.reduceat(matrix[found & 0xFFFF], ends - tokens, axis=0) / tokens[:, None].astype(np.float32)
            grid = np.clip((points + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64)
            offsets = np.append(0, ends * found.itemsize).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(tokens), pa.array(hilbert(grid, BITS)), ids], names=["doc_id", "h", "tokens", "place", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(keyed, f"doc_id {kind}, h long, tokens long, place long, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: its document, start and length there, the sequence and the offset there."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("text"))
    table = f"{shared_folder(spark)}/encoded-{uuid.uuid4().hex}"
    encoded(d, path, end).write.option("compression", "zstd").parquet(table)
    coded = spark.read.parquet(table)
    keys = coded
    keys = keys.groupBy("doc_id", "h", "tokens", "place").agg(F.count("*").alias("copies")).withColumn("tie", F.xxhash64("doc_id"))
    keys = materialize(keys)
    order = ["place", "tie", "doc_id", "h"]
    keys = materialize(keys.repartitionByRange(shuffle_partitions(spark), *order).withColumn("range", F.spark_partition_id()))
    amount = F.col("tokens") * F.col("copies")
    ranges = keys.groupBy("range").agg(F.sum(amount).alias("n"))
    # as many rows as there are ranges, never more
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.withColumn("at", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(ranges, "range")
    placed = placed.select("doc_id", "h", "tokens", "copies", (F.col("at") + F.col("base")).alias("at"))
    once = coded.groupBy("doc_id", "h").agg(F.any_value("ids").alias("ids"))
    placed = placed.select(F.col("doc_id").alias("id"), F.col("h").alias("k"), "tokens", "copies", "at")
    met = once.join(placed, once["doc_id"].eqNullSafe(F.col("id")) & (once["h"] == F.col("k"))).select("doc_id", "ids", "tokens", "copies", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        for batch in batches:
            take, out = [], {n: [] for n in names}
            columns = [batch.column(n).to_pylist() for n in ("ids", "tokens", "copies", "at")]
            for i, (stored, tokens, copies, at) in enumerate(zip(*columns)):
                kind = np.uint16 if len(stored) == 2 * tokens else np.uint32
                ids = memoryview(np.frombuffer(stored, dtype=kind).astype("<u4").tobytes())
                for copy in range(copies):
                    first, a = at + copy * tokens, 0
                    while a < tokens:
                        b = min(tokens, a + length - (first + a) % length)
                        take.append(i)
                        for n, v in zip(names, (a, b - a, zlib.crc32(ids[4 * a : 4 * b]), tokens, (first + a) // length, (first + a) % length)):
                            out[n].append(v)
                        a = b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(take, pa.int64())), *(pa.array(out[n], pa.int64()) for n in names)], names=["doc_id", *names])

    kind = d.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())
