"""Token counts without token ids.

A text is cut at ASCII white space, where no pre-token can cross.

1. The distinct cuts of the corpus are found (first in each task, then by
   shuffle), normalised and split into pre-tokens; the tokenizer's own model
   counts the pieces of each distinct pre-token of the corpus once. Joined back,
   this gives a dictionary: cut, tokens.
2. Each document's cut frequencies are joined to the dictionary and summed. The
   ``HEAD`` most frequent cuts travel to the tasks as packed hashes and counts, a
   table of at most 12 bytes an entry, and meet the frequencies there. What is
   not among them, the long tail of cuts that few documents hold, is joined by
   shuffle. Ids are never made for the corpus.

So every row is joined exactly at any size of the vocabulary, and only rare cuts
are ever moved.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, field, give_back, map_rows

HEAD, FLUSH, MEMO = 2_000_000, 100_000, 200_000

_CUT = T.StructType([T.StructField("cut", T.BinaryType()), T.StructField("n", T.LongType())])


class Pieces:
    """Pre-tokens of a cut, and the pieces of a pre-token, as the tokenizer's file has them.

    Cutting at white space is safe for a tokenizer whose pre-tokens hold none and
    whose normaliser never joins characters across it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def whole(self, cut: str) -> int | None:
        """Tokens of a cut that holds a special string: the library takes these out of the raw text before all else."""
        return len(self.tok.encode(cut, add_special_tokens=False).ids) if any(s in cut for s in self.special) else None

    def words(self, cut: str) -> list[str]:
        normal = self.tok.normalizer.normalize_str(cut) if self.tok.normalizer else cut
        return [word for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, word: str) -> int:
        return len(self.tok.model.tokenize(word))


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _hash(cuts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, cuts), np.uint64, len(cuts))


def distinct_cuts(texts: DataFrame) -> DataFrame:
    """(cut, n): how many texts hold each cut, summed in tasks before the shuffle. One column of texts, as bytes, goes in."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["cut", "n"])
            seen.clear()
            return out

        seen: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw:
                    seen.update(set(raw.split()))
                    if len(seen) > FLUSH:
                        yield flushed()
        yield flushed()
        give_back()

    return texts.mapInArrow(found, _CUT).groupBy("cut").agg(F.sum("n").alias("n"))


def dictionary(cuts: DataFrame, tokenizer_path: str, scratch: Scratch) -> DataFrame:
    """(cut, n, tokens): each distinct pre-token of all cuts is counted once."""
    split_schema = T.StructType([*_CUT, T.StructField("tokens", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def split(batch: pa.RecordBatch) -> dict:
        pieces = _pieces(tokenizer_path)
        texts = [c.decode() for c in batch.column(0).to_pylist()]
        whole = [pieces.whole(t) for t in texts]
        words = [pieces.words(t) if w is None else [] for t, w in zip(texts, whole, strict=True)]
        return {"cut": batch.column(0), "n": batch.column(1), "tokens": whole, "words": words}

    counted = T.StructType([T.StructField("word", T.StringType()), T.StructField("pieces", T.LongType())])

    def count(batch: pa.RecordBatch) -> dict:
        pieces = _pieces(tokenizer_path)
        return {"word": batch.column(0), "pieces": [pieces.count(w) for w in batch.column(0).to_pylist()]}

    cuts = scratch.keep(map_rows(cuts, split_schema, split), "cuts")
    held = cuts.select("cut", F.explode("words").alias("word"))
    words = scratch.keep(map_rows(held.select("word").distinct(), counted, count), "words")
    summed = held.join(words, "word").groupBy("cut").agg(F.sum("pieces").alias("pieces"))
    return scratch.keep(cuts.join(summed, "cut", "left").select("cut", "n", F.coalesce("tokens", "pieces", F.lit(0).cast("long")).alias("tokens")), "dictionary")


class Head:
    """Tokens of the frequent cuts by hash, with a memo of those a task meets again; -1 for the others."""

    def __init__(self, hashes: bytes, tokens: bytes):
        self.hashes, self.tokens = np.frombuffer(hashes, np.uint64), np.frombuffer(tokens, np.int32)
        self.memo: dict[bytes, int] = {}

    def of(self, cuts: list[bytes]) -> list[int]:
        memo = self.memo
        new = [c for c in cuts if c not in memo]
        if new and len(self.hashes):
            h = _hash(new)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = np.where(self.hashes[at] == h, self.tokens[at], -1).tolist()
        else:
            found = [-1] * len(new)
        if len(memo) + len(new) > MEMO:
            fresh = dict(zip(new, found, strict=True))
            out = [fresh[c] if c in fresh else memo[c] for c in cuts]
            memo.clear()
            return out
        memo.update(zip(new, found, strict=True))
        return [memo[c] for c in cuts]


@lru_cache(maxsize=2)
def _head(shared) -> Head:
    return Head(*shared.value)


def _frequent(words: DataFrame, head: int, scratch: Scratch) -> tuple[bytes, bytes]:
    """Hashes, in order, and tokens of the ``head`` most frequent cuts whose hash no other cut has."""
    hashed = T.StructType([*words.schema, T.StructField("h", T.LongType())])
    rows = map_rows(words, hashed, lambda b: {**{c: b.column(c) for c in ("cut", "n", "tokens")}, "h": _hash(b.column(0).to_pylist()).view(np.int64)})
    single = rows.groupBy("h").agg(F.count(F.lit(1)).alias("cuts"), F.sum("n").alias("n"), F.max("tokens").alias("tokens")).filter("cuts = 1 AND tokens < 2147483647")
    single = scratch.keep(single.select("h", "n", "tokens"), "single")
    # The n from which on at most ``head`` cuts remain; a count per n is a short table.
    upto, least = 0, 1
    for r in single.groupBy("n").count().orderBy(F.desc("n")).limit(head + 1).toLocalIterator():
        upto += r[1]
        if upto > head:
            least = r[0] + 1
            break
    kept = single.filter(F.col("n") >= least).select("h", F.col("tokens").cast("int")).toArrow()
    h, tokens = kept["h"].to_numpy().view(np.uint64), kept["tokens"].to_numpy()
    order = np.argsort(h)
    return h[order].tobytes(), tokens[order].tobytes()


def count_tokens(documents: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, head: int = HEAD) -> DataFrame:
    """One row per document row: id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside a
    text count as the library counts them by default. Repeated rows, null ids
    and ids of any type pass through. An empty table gives no rows.
    ``tokenizer_path`` must be readable on every executor.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "tokens")
    words = dictionary(distinct_cuts(documents.select(F.col(text_col).cast("binary"))), tokenizer_path, scratch)
    shared = spark.sparkContext.broadcast(_frequent(words, head, scratch))
    rest = T.ArrayType(T.StructType([T.StructField("cut", T.BinaryType()), T.StructField("times", T.LongType())]))
    schema = T.StructType([field(documents, id_col, "id"), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("rest", rest), T.StructField("row", T.StringType())])

    def count(batch: pa.RecordBatch) -> dict:
        known = _head(shared)
        size, total, tails = [], [], []
        for raw in batch.column(1).to_pylist():
            raw = raw or b""
            times = Counter(raw.split())
            cuts = list(times)
            found = known.of(cuts)
            tail = [(c, times[c]) for c, k in zip(cuts, found, strict=True) if k < 0]
            size.append(len(raw))
            total.append(sum(k * times[c] for c, k in zip(cuts, found, strict=True) if k > 0))
            tails.append([{"cut": c, "times": n} for c, n in tail] or None)
        return {"id": batch.column(0), "n_bytes": size, "n_tokens": total, "rest": tails, "row": [None if t is None else uuid4().hex for t in tails]}

    counted = map_rows(documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw")), schema, count)
    answer = lambda df: df.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    if words.count() <= len(shared.value[0]) // 8:  # no cut is left for the shuffle
        return answer(counted)
    counted = scratch.keep(counted, "counted")  # rows are numbered at random, so once
    tails = counted.filter("rest IS NOT NULL").select("row", F.explode("rest").alias("t")).select("row", "t.cut", "t.times")
    more = tails.join(words.select("cut", "tokens"), "cut").groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("more"))
    summed = counted.filter("rest IS NOT NULL").join(more, "row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    cols = ("id", "n_bytes", "n_tokens")
    return answer(counted.filter("rest IS NULL").select(*cols).unionByName(summed.select(*cols)))
