"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to Latin letters
and turns everything but letters to single spaces. The lexicon holds word
beginnings and whole words; its weights are log odds learned from labelled
rows. One Aho-Corasick pass finds the entries; a word counts with its heaviest
entry, and exception phrases (a match with its neighbour word, seen mostly in
clean rows, or given) are taken out. The weights' sum, normalised by length,
goes through a logistic curve fitted on the same rows.

Fitting uses at most about ``TRAIN_ROWS`` labelled rows, picked by a digest of
the id; scoring covers every row and whole texts. Plan: the picked labels (a
bounded set) are broadcast to find their documents; gram counts are summed in
tasks before a small shuffle, and only grams with significant evidence leave it;
scoring is a map, with the lexicon broadcast. The lexicon is as long as the
evidence of the bounded sample makes it; nothing is cut off.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, field, give_back, map_rows

TRAIN_ROWS = 20_000
#: Grams that a task counts before it hands them on.
FLUSH = 200_000
SHORTEST, LONGEST = 3, 10
MIN_DOCS, MIN_Z, MIN_LOG_ODDS, CLEARLY, STRONG, ROUNDS = 4, 4.0, 1.0, 0.7, 0.3, 3

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": " ",
}
_FOLD = str.maketrans(_LOOKALIKES | {chr(0xFF41 + k): chr(0x61 + k) for k in range(26)})
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words, each with a space before and behind."""
    return f" {_OTHER.sub(' ', (text or '').lower().translate(_FOLD)).strip()} "


def grams(word: str) -> list[str]:
    """Beginnings of a word, marked by the space before it, and the whole word."""
    return [f" {word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [f" {word} "]


class Lexicon:
    """Entries with weights, exception phrases and the logistic curve."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str], curve: tuple[float, ...]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.trie = None
        if weights:
            self.trie = ahocorasick.Automaton()
            for entry, weight in weights.items():
                self.trie.add_word(entry, (len(entry), weight))
            self.trie.make_automaton()

    def matches(self, folded: str) -> dict[int, float]:
        """Heaviest weight of each matched word by the place of the space before it."""
        out: dict[int, float] = {}
        if self.trie is not None:
            for end, (size, weight) in self.trie.iter(folded):
                at = end - size + 1
                out[at] = max(weight, out.get(at, weight))
        return out

    def phrases(self, folded: str, at: int) -> Iterator[str]:
        """The matched word with the word before it and with the word behind it."""
        stop = folded.index(" ", at + 1)
        if at > 0:
            yield folded[folded.rindex(" ", 0, at) + 1 : stop]
        if stop < len(folded) - 1:
            yield folded[at + 1 : folded.index(" ", stop + 1)]

    def features(self, text: str | None) -> list[float]:
        folded = fold(text)
        found = self.matches(folded)
        if self.exceptions and found:
            found = {at: w for at, w in found.items() if self.exceptions.isdisjoint(self.phrases(folded, at))}
        total, words = sum(found.values()), folded.count(" ") - 1 if len(folded) > 2 else 0
        return [1.0, math.log1p(total), math.log1p(100 * total / max(1, words)), math.log1p(words) / 5]

    def score(self, text: str | None) -> float:
        x = sum(a * b for a, b in zip(self.features(text), self.curve, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _counted(sample: DataFrame) -> DataFrame:
    """(gram, toxic rows, clean rows) over the sample."""
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("p", T.LongType()), T.StructField("n", T.LongType())])

    def flushed(by: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(by[0].keys() | by[1].keys())
        out = [pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()), pa.array([by[0][k] for k in keys], pa.int64())]
        by[0].clear()
        by[1].clear()
        return pa.RecordBatch.from_arrays(out, names=["gram", "p", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                by[toxic].update({g for w in set(fold(text.as_py()).split()) for g in grams(w)})
                if len(by[0]) + len(by[1]) > FLUSH:
                    yield flushed(by)
        yield flushed(by)
        give_back()

    return sample.select("text", "toxic").mapInArrow(count, schema).groupBy("gram").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).filter(F.col("p") >= MIN_DOCS)


def _significant(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The grams whose evidence (see ``_evidence``) may suffice."""
    share, rows = toxic / (toxic + clean), F.col("p") + F.col("n")
    z = (F.col("p") - rows * share) / F.sqrt(rows * (share * (1 - share)) * (1 - rows / (toxic + clean)) + 1e-9)
    odds = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
    return counts.filter((z >= MIN_Z - 1e-6) & (odds >= MIN_LOG_ODDS - 1e-6))


def _evidence(p: int, n: int, toxic: int, clean: int) -> tuple[float, float]:
    """(z, log odds) of p toxic and n clean rows."""
    rows, share = p + n, toxic / (toxic + clean)
    z = (p - rows * share) / math.sqrt(rows * share * (1 - share) * (1 - rows / (toxic + clean)) + 1e-9)
    return z, math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))


def _chosen(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries that hold on their own: longer ones must beat their beginnings, which must hold without them.

    Entries far below the strongest wait for the next round, which looks only
    at toxic rows that the stronger ones do not explain.
    """
    evidence = {g: _evidence(p, n, toxic, clean) for g, (p, n) in counts.items()}
    least = max(MIN_Z, STRONG * max((z for z, _ in evidence.values()), default=0))
    good = lambda z, odds: z >= least and odds >= MIN_LOG_ODDS
    odds = {g: o for g, (z, o) in evidence.items() if good(z, o)}
    begins = lambda g: (g[:k] for k in range(SHORTEST + 1, min(len(g), LONGEST + 2)))
    kept = {g: o for g, o in odds.items() if not any(odds.get(b, -9) >= o - CLEARLY for b in begins(g) if b != g)}
    left = {g: list(counts[g]) for g in kept}
    for g in sorted(kept, key=len, reverse=True):
        if good(*_evidence(max(0, left[g][0]), max(0, left[g][1]), toxic, clean)) and left[g][0] >= MIN_DOCS:
            for b in begins(g):
                if b != g and b in left:
                    left[b][0] -= left[g][0]
                    left[b][1] -= left[g][1]
        else:
            left[g] = [0, 0]
    return {g: _evidence(*left[g], toxic, clean)[1] for g in sorted(kept) if left[g][0] >= MIN_DOCS}


def _unexplained(sample: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The clean rows, and the toxic rows without a match."""
    if not weights:
        return sample
    shared = sample.sparkSession.sparkContext.broadcast((weights, frozenset(), ()))

    def found(batch: pa.RecordBatch) -> dict:
        matched = [bool(_lexicon(shared).matches(fold(t.as_py()))) for t in batch.column("text")]
        return {"text": batch.column("text"), "toxic": batch.column("toxic"), "matched": matched}

    schema = T.StructType([sample.schema["text"], sample.schema["toxic"], T.StructField("matched", T.BooleanType())])
    return map_rows(sample.select("text", "toxic"), schema, found).filter("toxic = 0 OR NOT matched").drop("matched")


def _phrases(sample: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Phrases around matches that clean rows hold at least as often as toxic ones do."""
    schema = T.StructType([T.StructField("phrase", T.StringType()), T.StructField("toxic", T.LongType())])
    shared = sample.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.curve))

    def around(batch: pa.RecordBatch) -> dict:
        lex = _lexicon(shared)
        out = {"phrase": [], "toxic": []}
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            folded = fold(text.as_py())
            for phrase in {p for at in lex.matches(folded) for p in lex.phrases(folded, at)}:
                out["phrase"].append(phrase)
                out["toxic"].append(toxic)
        return out

    seen = map_rows(sample.select("text", "toxic"), schema, around).groupBy("phrase").agg(F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("p"))
    often = seen.filter((F.col("rows") >= 2 * MIN_DOCS) & (F.col("p") * 20 <= F.col("rows")))
    return frozenset(r[0] for r in often.select("phrase").collect())  # of a bounded sample


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a little shrinkage."""
    w = np.zeros(x.shape[1])
    shrink = 1e-5 * len(y) + 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w)), x.T @ (p - y) + shrink * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


@lru_cache(maxsize=2)
def _lexicon(shared) -> Lexicon:
    return Lexicon(*shared.value)


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] = (), train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Learns a lexicon from rows whose crc32 of the id, as text, is not divisible by 5.

    Rows without a label or an id teach nothing; an id with several labels has
    the largest. With no row of either class the lexicon is empty and every
    score is the share of toxic rows (0 without rows). ``exceptions`` are
    phrases of two words that never count.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    usable = usable.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = max(1, usable.count())
    picked = usable.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < train_rows)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    sample = scratch.keep(texts.join(F.broadcast(picked), "id").select("id", "text", "toxic"), "sample")
    by = dict(sample.groupBy("toxic").count().collect())
    clean, toxic = by.get(0, 0), by.get(1, 0)
    given = frozenset(fold(e).strip() for e in exceptions)
    if not clean or not toxic:
        share = toxic / max(1, clean + toxic)
        return Lexicon({}, given, (-30.0 if share == 0 else 30.0, 0.0, 0.0, 0.0))
    weights: dict[str, float] = {}
    for _ in range(ROUNDS):
        left = _unexplained(sample, weights)
        by = dict(left.groupBy("toxic").count().collect())
        if by.get(1, 0) < MIN_DOCS:
            break
        rows = _significant(_counted(left), by[1], by[0]).collect()
        all_rows = math.log((toxic + 1) / (by[1] + 1))  # odds against all toxic rows, not just those left
        more = {g: w - all_rows for g, w in _chosen({r[0]: (r[1], r[2]) for r in rows}, by[1], by[0]).items() if g not in weights and w - all_rows >= MIN_LOG_ODDS}
        if not more:
            break
        weights |= more
    plain = Lexicon(weights, given, (0.0,) * 4)
    lexicon = Lexicon(weights, given | _phrases(sample, plain), (0.0,) * 4)
    shared = spark.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.curve))
    schema = T.StructType([field(sample, "id"), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "y": batch.column(2), "x": [_lexicon(shared).features(t.as_py()) for t in batch.column(1)]}

    points = map_rows(sample, schema, measure).orderBy("id", "x").collect()  # train_rows short rows, in an order that reruns share
    lexicon.curve = _curve(np.array([r["x"] for r in points]), np.array([float(r["y"]) for r in points]))
    scratch.drop(sample)
    return lexicon


def score(documents: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, held_out: bool = True) -> DataFrame:
    """One row per document row: id, held_out (null if not asked for), score, predicted.

    Null and empty texts score as texts without words. A null id counts as an
    empty one for ``held_out``. Repeated rows are each scored.
    """
    shared = documents.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.curve))
    schema = T.StructType([field(documents, id_col), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def judge(batch: pa.RecordBatch) -> dict:
        scores = [_lexicon(shared).score(t.as_py()) for t in batch.column(1)]
        return {id_col: batch.column(0), "held_out": batch.column(2), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0 if held_out else F.lit(None).cast("boolean")
    return map_rows(documents.select(F.col(id_col), F.col(text_col), held.alias("held")), schema, judge)
