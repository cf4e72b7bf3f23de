"""Benchmark decontamination: one Aho-Corasick automaton over benchmark windows.

Texts are normalised to words (A-Z lower-cased; digits, letters and all
non-ASCII characters make words). A window is ten consecutive words of an item,
or the whole item where it has fewer. The automaton runs over word numbers, not
characters: unknown words fall to its root, so one pass over a document's words
finds every window, and word offsets map to the original text's code points.

Plan: documents are only mapped, never shuffled, and only id and text are read.
The automaton is broadcast in parts of at most ``part_windows`` windows; a
larger benchmark makes more parts, each another pass over the same row, so what
is broadcast stays bounded while every window is searched.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_rows

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
_WORD_BYTES = re.compile(rb"[^ ]+")

#: Windows in one automaton; about 100 MB in each Python worker.
PART_WINDOWS = 100_000


def words_of(text: str | None) -> list[bytes]:
    """Normalised words; null has none."""
    return text.encode().translate(_FOLD).split() if text else []


def _windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """Distinct (window, item) rows; the window's words are joined by spaces."""
    schema = T.StructType([T.StructField("window", T.StringType()), T.StructField("item", T.StringType())])

    def cut(batch: pa.RecordBatch) -> dict:
        windows, items = [], []
        for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(body)
            for k in range(max(1, len(words) - size + 1) if words else 0):
                windows.append(b" ".join(words[k : k + size]).decode())
                items.append(item)
        return {"window": windows, "item": items}

    picked = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return map_rows(picked, schema, cut).distinct()


@lru_cache(maxsize=2)
def _automaton(part) -> tuple[dict[bytes, int], object]:
    numbers: dict[bytes, int] = {}
    trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, items in part.value:
        words = window.encode().split()
        trie.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words), (len(words), items))
    if numbers:
        trie.make_automaton()
    return numbers, trie


def _mark(words: list[bytes], numbers: dict[bytes, int], trie, mask: bytes | None, items: list[str]) -> tuple[bytes | None, list[str]]:
    """Adds the windows found to the mask of hit words and the items hit."""
    if not words or not numbers:
        return mask, items
    marks = None
    for end, (size, of) in trie.iter(tuple([numbers.get(w, 0) for w in words])):
        if marks is None:
            marks, items = bytearray(mask or bytes(len(words))), set(items)
        marks[end - size + 1 : end + 1] = b"\1" * size
        items.update(of)
    return (mask, items) if marks is None else (bytes(marks), sorted(items))


def _spans(text: str, mask: bytearray) -> list[tuple[int, int]]:
    """Code-point spans of the runs of hit words."""
    raw = text.encode()
    ends = [m.span() for m in _WORD_BYTES.finditer(raw.translate(_FOLD))]
    runs, k = [], mask.find(1)
    while k >= 0:
        stop = mask.find(0, k)
        stop = len(mask) if stop < 0 else stop
        runs.append((ends[k][0], ends[stop - 1][1]))
        k = mask.find(1, stop)
    out, at, chars = [], 0, 0
    for a, b in runs:
        chars += len(raw[at:a].decode())
        size = len(raw[a:b].decode())
        out.append((chars, chars + size))
        at, chars = b, chars + size
    return out


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    part_windows: int = PART_WINDOWS,
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items, spans.

    ``items`` are the item ids (as strings, sorted) with a window in the
    document; ``spans`` the code-point ranges of maximal runs of hit words.
    A null or wordless text has no words and no hits; a null or wordless item
    has no window; a null item id counts as the empty string. Repeated rows are
    each judged. An empty benchmark hits nothing. Other columns are ignored.
    """
    spark = documents.sparkSession
    cut = _windows(benchmark, item_id_col, item_text_col, window).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    parts = max(1, -(-cut.count() // part_windows))
    names = ("id", "text", "mask", "items")
    passed = T.StructType([field(documents, id_col, "id"), field(documents, text_col, "text"), T.StructField("mask", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    final = T.StructType([field(documents, id_col), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for k in range(parts):
        rows = cut.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == k).collect()  # about part_windows rows
        part = spark.sparkContext.broadcast([(r["window"], tuple(r["items"])) for r in rows])

        def scan(batch: pa.RecordBatch, part=part, first=k == 0, last=k == parts - 1) -> dict:
            numbers, trie = _automaton(part)
            ids, texts = batch.column(0), batch.column(1)
            before = [(None, [])] * len(ids) if first else zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            cols: list[list] = [[], [], [], []]
            for text, (mask, items) in zip(texts, before, strict=True):
                text = text.as_py()
                words = words_of(text)
                mask, items = _mark(words, numbers, trie, mask, items)
                row = (len(words), mask.count(1), items, [{"start": a, "end": b} for a, b in _spans(text, bytearray(mask))]) if last and mask else (len(words), 0, items, []) if last else (mask, items)
                for col, value in zip(cols, row, strict=False):
                    col.append(value)
            return dict(zip(final.fieldNames(), (ids, *cols), strict=True)) if last else dict(zip(names, (ids, texts, *cols[:2]), strict=True))

        out = map_rows(out, final if k == parts - 1 else passed, scan)
    return out
