"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

1. A character trigram model is counted over all documents.
2. Tokens that look obfuscated (digits or signs for letters, letters spaced out, letters repeated) become lattices of
   what each character may stand for; a Viterbi search finds the likeliest word under the model and the channel's costs.
3. Words and their first letters get weights from labelled rows; a document's score is a logistic function of the
   weights of the strongest tokens of its text, each as it stands and as restored.

Labels are learned only from rows that are not held out, of those from at most ``TRAIN_ROWS`` with the smallest hashes:
three quarters give the weights, a quarter the logistic function.  The trigram table has at most 64 ** 3 entries, and the
weight table no more than the words of at most ``TRAIN_ROWS`` texts that ``LEAST_ROWS`` toxic ones hold, whatever the
input; both are broadcast.

Defined cases: a null or empty text gets the score of a text without any weighted token; rows without a label and labels
without a row are not learned from; repeated labels of one id count as toxic if one says so; without labels of both
kinds, every score is the share of toxic rows, or 0; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.common import documents

TRAIN_ROWS, KNOWN_TOKENS = 40_000, 200_000
HELD_OUT_OF = 5
LEAST_ROWS, PRIOR_ROWS = 4, 4.0
#: Lengths of the beginnings of words that count as features.
PREFIXES = (4, 5, 6)
#: What digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Costs of the channel (negative logarithms): a sign for a letter, a sign that is itself, a dropped repetition, a dropped separator.
LEET_COST, KEPT_COST, REPEAT_COST, SEPARATOR_COST = 1.0, 12.0, 0.7, 0.2
SEPARATORS = ".-_*~'’·"

_BOUNDARY, _OTHER = 0, 63
#: All patterns take time in proportion to a token or text: what repeats has nothing in common with what follows it.
_INNER = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_LETTERS = r"[^\W\d_]"
_ONE = r"(?:(?!_)[\w@$!|])"
_ODD = re.compile(rf"{_LETTERS}[0-9@$!|+(€£]+{_LETTERS}|^[@$!|0-9(]{{1,2}}{_LETTERS}{{2}}|{_LETTERS}{{2}}[0-9@$!]{{1,2}}$|({_LETTERS})\1\1|{_LETTERS}[.\-_*~]{_LETTERS}[.\-_*~]{_LETTERS}|{_LETTERS}[.*_~·]{_LETTERS}|(?:^|(?<![.\-_*~]{_ONE})[.\-_*~]){_ONE}[.\-_*~]{_ONE}(?:[.\-_*~]{_ONE})+(?![\w@$!|])")
#: What may stand around a word of letters without making it odd; such a word is odd only with a letter three times in a row.
_PLAIN_ENDS, _THRICE = ",;:?\"()[]{}.", re.compile(r"(.)\1\1")
#: What may as well belong to a word: a letter twice, a single hyphen between letters.
_DOUBTFUL = re.compile(rf"({_LETTERS})\1|(?<={_LETTERS})-(?={_LETTERS})")
_SPACED = re.compile(r"(?<!\S)[^\s.\-_](?:[ .\-_]++[^\s.\-_]){2,}(?!\S)")


def _inner(token: str) -> str:
    """The token from its first letter or digit to its last one."""
    found = _INNER.search(token)
    return found[0] if found else ""


def _without_signs(token: str) -> str:
    """The token without a sign that it repeats three times or more at its end."""
    last = token[-1:]
    short = token if not last or last == "_" or last.isalnum() else token.rstrip(last)
    return short if len(token) - len(short) > 2 else token


def _symbol_table() -> np.ndarray:
    """Symbols of code points: 1 to 26 for a to z, then the lower-case letters of Latin-1; other letters share one."""
    t = np.zeros(0x110000, dtype=np.uint8)
    t[0x100:] = _OTHER
    for a, b in ((0x2000, 0x2070), (0x3000, 0x3003)):
        t[a:b] = _BOUNDARY
    t[ord("a") : ord("z") + 1] = np.arange(1, 27)
    t[0xDF:0x100] = np.arange(27, 60)
    return t


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all of ``docs`` (text), as an array of 64 x 64 x 64."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _symbol_table(), np.zeros(1 << 18, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    s = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
                    s = np.concatenate([[0, 0], s, [0]])
                    total += np.bincount((s[:-2] << 12) | (s[1:-1] << 6) | s[2:], minlength=1 << 18)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["code", "n"])

    counts = docs.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << 18, dtype=np.float64)
    out[counts["code"].to_numpy(np.int64)] = counts["n"]
    return out.reshape(64, 64, 64)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the third symbol, trigrams backed by bigrams and those by single symbols."""
    one = counts.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (counts + 5 * two[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


class Decoder:
    """Viterbi search over the lattice of a token; states are the last two symbols."""

    def __init__(self, model: np.ndarray):
        self.model, self.table = model.tolist(), _symbol_table()

    def options(self, token: str, i: int) -> list[tuple[str, float]]:
        """What character i may stand for, with costs; an empty string drops it."""
        c = token[i]
        out = []
        if c.isalpha():
            out.append((c, 0.0))
            if i and token[i - 1] == c:
                out.append(("", REPEAT_COST))
        elif c in SEPARATORS or c.isspace():
            return [("", SEPARATOR_COST)]
        else:
            out.append(("", KEPT_COST))
        return out + [(x, LEET_COST) for x in LEET.get(c, "")] + ([("", REPEAT_COST)] if i and token[i - 1] == c and not c.isalpha() else [])

    def decode(self, token: str) -> str:
        token = token.lower()
        # a state's word is a chain of its letters, last one first, so that a step costs the same at any length
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i in range(len(token)):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter, cost in self.options(token, i):
                s = int(self.table[ord(letter)]) if letter else -1
                for (a, b), (score, word) in states.items():
                    if s < 0:
                        key, value = (a, b), score - cost
                    else:
                        key, value = (b, s), score - cost + self.model[a][b][s]
                    if key not in after or value > after[key][0]:
                        after[key] = (value, (word, letter) if letter else word)
            states = after
        chain, out = max(((score + self.model[a][b][_BOUNDARY], word) for (a, b), (score, word) in states.items()), key=lambda x: x[0])[1], []
        while chain:
            chain, letter = chain
            out.append(letter)
        return "".join(reversed(out))


class Tokens:
    """Tokens of a text with the features of each, as they stand and as restored."""

    def __init__(self, model: np.ndarray):
        self.decoder = Decoder(model)

    def restored(self, token: str) -> str | None:
        if _ODD.search(core := _without_signs(token).strip(",;:?\"()[]{}")):
            return self.decoder.decode(core.strip("."))
        return None

    @staticmethod
    def _of(word: str) -> list[str]:
        n = len(word)
        return [word, *[word[:k] + "~" for k in PREFIXES if n > k]] if n > 1 else []

    def features(self, token: str) -> list[str]:
        plain = token.strip(_PLAIN_ENDS)
        if plain.isalpha() and not _THRICE.search(plain):
            return self._of(plain.lower())
        out = self._of(_inner(token).lower())
        if word := self.restored(token):
            out += self._of(word)
        return out

    def readings(self, token: str) -> list[str]:
        """The features, and where a repetition or hyphen may hide a word, those of the token without it."""
        out = self.features(token)
        if (short := _DOUBTFUL.sub(r"\1", token)) != token:
            out = out + self.features(short)
        return out

    def tokens(self, text: str | None) -> set[str]:
        """Distinct raw tokens; single characters in a row make one more token."""
        text = text or ""
        found = set(text.split())
        found.update(m[0].replace(" ", ".") for m in _SPACED.finditer(text))
        return found


class Scorer:
    """Document measures from token weights: strongest, sum of the three strongest, number of weighted tokens, length."""

    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        self.tokens, self.weights, self.known = Tokens(model), weights, {}

    def weight(self, token: str) -> float:
        if len(self.known) >= KNOWN_TOKENS:
            self.known.clear()
        get, best = self.weights.get, 0.0
        for f in self.tokens.readings(token):
            if (w := get(f, 0.0)) > best:
                best = w
        self.known[token] = best
        return best

    def measures(self, text: str | None) -> list[float]:
        tokens, get, best = self.tokens.tokens(text), self.known.get, []
        for t in tokens:
            if (w := get(t)) is None:
                w = self.weight(t)
            if w > 0.0:
                best.append(w)
        best.sort(reverse=True)
        return [best[0] if best else 0.0, sum(best[:3]), math.log1p(len(best)), math.log1p(len(tokens))]


def _weights(sample: DataFrame, model, base_rate: float) -> dict[str, float]:
    """Log odds of features that speak for label 1, from (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = Tokens(model.value), {}
        for batch in batches:
            one, all_ = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found: set[str] = set()
                for t in tokens.tokens(text):
                    if t not in known:
                        if len(known) >= KNOWN_TOKENS:
                            known.clear()
                        known[t] = tokens.readings(t)
                    found.update(known[t])
                all_.update(found)
                if toxic:
                    one.update(found)
            # what no toxic row holds never speaks for the label
            names = list(one)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([one[f] for f in names], pa.int64()), pa.array([all_[f] for f in names], pa.int64())], names=["f", "one", "n"])
            others = [f for f in all_ if f not in one]
            yield pa.RecordBatch.from_arrays([pa.array(others, pa.string()), pa.array([0] * len(others), pa.int64()), pa.array([all_[f] for f in others], pa.int64())], names=["f", "one", "n"])

    c = sample.mapInArrow(count, "f string, one long, n long").groupBy("f").agg(F.sum("one").alias("one"), F.sum("n").alias("n"))
    share = (F.col("one") + PRIOR_ROWS * base_rate) / (F.col("n") + PRIOR_ROWS)
    c = c.where(F.col("one") >= LEAST_ROWS).withColumn("w", F.log(share / (1 - share)) - math.log(base_rate / (1 - base_rate)))
    return {r["f"]: r["w"] for r in c.where("w > 1").select("f", "w").collect()}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (the last one constant), means and scales: logistic regression by Newton steps with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
    return w, mean, scale


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document."""
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == 0
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = spark.sparkContext.broadcast(log_model(count_trigrams(d.select("text"))))
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = known.where(~held).withColumn("k", F.xxhash64("doc_id")).orderBy("k", "doc_id").limit(train_rows).select(F.col("doc_id").alias("of"), "toxic", "k")
    # at most train_rows rows of three numbers
    sample = d.join(F.broadcast(known), F.col("doc_id") == F.col("of")).select("text", "toxic", "k")
    rows, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = toxic / rows if rows else 0.0
    fit = None
    if 0 < base < 1:
        quarter = F.pmod("k", F.lit(4)) == 0
        weights = spark.sparkContext.broadcast(_weights(sample.where(~quarter).select("text", "toxic"), model, base))

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(model.value, weights.value)
            for batch in batches:
                m = np.array([scorer.measures(t) for t in batch.column("text").to_pylist()]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(m[:, i]) for i in range(4))], names=["toxic", "a", "b", "c", "d"])

        # a quarter of train_rows rows of five numbers
        m = sample.where(quarter).select("text", "toxic").mapInArrow(measured, "toxic int, a double, b double, c double, d double").toPandas()
        if 0 < m["toxic"].sum() < len(m):
            fit = _logistic(m[["a", "b", "c", "d"]].to_numpy(), m["toxic"].to_numpy(float))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, weights.value) if fit else None
        for batch in batches:
            if scorer:
                w, mean, scale = fit
                m = np.array([scorer.measures(t) for t in batch.column("text").to_pylist()]).reshape(-1, 4)
                score = 1 / (1 + np.exp(-np.clip((m - mean) / scale @ w[:-1] + w[-1], -30, 30)))
            else:
                score = np.full(batch.num_rows, base)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
