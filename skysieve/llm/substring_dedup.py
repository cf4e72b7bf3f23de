"""Exact removal of long repeated byte strings with a run-length index.

A window is ``length`` bytes of one text. Its anchor is its leftmost smallest
32-byte gram (by hash), so equal windows have equal anchors at equal places.
Consecutive windows with one anchor form a segment, about one per 185 bytes.

1. Segments meet by anchor as (anchor, digest). Equal segments repeat as a
   whole. Segments whose anchor is unique repeat nowhere. What is left are
   segments that share an anchor but differ: the edges of repeats.
2. Their bytes are fetched and meet by anchor again. Each bounded collection
   gets a run-length index: the Burrows-Wheeler transform as run heads and
   lengths, with the text positions of run starts and ends and the longest
   matches there; the suffix array is dropped once runs are known. Matching
   statistics of the collection against itself, to both neighbours in suffix
   order, are streamed out of these samples (they fall by one from byte to byte
   between samples). Windows that match ``length`` bytes elsewhere are marked.
3. Anchors that more than ``HOT`` different segments share (a passage in very
   many texts) would make a collection of unbounded size; their windows meet
   one by one instead, by a 128-bit digest, summed in tasks first.
4. Marks are joined to the texts, merged and cut out.

Texts are known by a digest of their bytes, so copies share marks: a text that
stands in two rows repeats as a whole, and one of its rows stands for all as a
partner of others. Everything is shuffled by hash in bounded groups; nothing is
broadcast or collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, field, map_rows

LENGTH, GRAM = 400, 32
CHUNK = 2_000_000
LOCALLY_HOT, HOT = 32, 1000
SEPARATOR = 7
SLICE_BYTES, BLOCK_BYTES = 32 << 20, 1_500_000
MARK, COLD, WARM = 0, 1, 2
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 24) - 1)


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buf)]).view("<u8").ravel()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    n, x = len(buf) - GRAM + 1, _words(buf)
    h = x[:n] * _M1
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += x[k : k + n]
        h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    return h ^ (h >> np.uint64(29))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    rows = -(-len(v) // width)
    grid = np.full(rows * width, np.uint64(2**64 - 1))
    grid[: len(v)] = v
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    m = len(v) - width + 1
    return np.minimum(ahead[:m], behind[width - 1 : width - 1 + m])


def segments_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, anchor, digest) of each segment of texts of at least ``length`` bytes.

    Long texts are cut into chunks whose windows do not overlap.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    todo = [(k, at, t[at : at + CHUNK + length - 1]) for k, t in enumerate(texts) for at in range(0, max(0, len(t) - length + 1), CHUNK)]
    at = 0
    while at < len(todo):
        stop, size = at, 0
        while stop < len(todo) and (stop == at or size + len(todo[stop][2]) <= CHUNK):
            size += len(todo[stop][2])
            stop += 1
        part, at = todo[at:stop], stop
        whole = b"".join(x[2] for x in part)
        offsets = np.cumsum([0, *(len(x[2]) for x in part)])
        h = _gram_hashes(np.frombuffer(whole, np.uint8))
        anchor = (_sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & _PLACE).astype(np.int64)
        owner = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
        inside = np.arange(len(anchor)) + length <= offsets[owner + 1]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[first[1:], len(anchor)]
        real = inside[first]
        first, last = first[real], last[real]
        view, digest = memoryview(whole), xxhash.xxh3_64_intdigest
        d = np.fromiter((digest(view[a : b + length - 1]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
        who = owner[first]
        base = np.array([x[1] for x in part], np.int64)
        for col, value in zip(out, (np.array([x[0] for x in part], np.int64)[who], first - offsets[who] + base[who], last - first, h[anchor[first]], d), strict=True):
            col.append(value)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(c).astype(k) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, for texts of under 2^21 bytes whose suffixes differ within about 1,200 bytes.

    Prefix doubling from 5 bytes; each round sorts (rank, rank further on,
    place) packed in one number.
    """
    n = len(text)
    if n >= 1 << 21:
        raise ValueError(f"{n} bytes are too many for one index")
    low = np.uint64((1 << 21) - 1)
    place = np.arange(n, dtype=np.uint64)
    five = _words(text).byteswap() >> np.uint64(24)
    rank, reach = None, 5
    while True:
        if rank is None:
            key = (five << np.uint64(21)) | place
        else:
            further = np.zeros(n, np.uint64)
            further[: n - reach] = rank[reach:] + np.uint64(1)
            key = (((rank << np.uint64(21)) | further) << np.uint64(21)) | place
            reach *= 2
        key.sort()
        order = (key & low).astype(np.int64)
        key >>= np.uint64(21)
        new = np.zeros(n, np.uint64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        if new[-1] == n - 1 or reach > 1200:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = new


def _common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Longest common prefix of the suffixes at ``a`` and ``b``, eight bytes a step."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = np.maximum(x, y) < n
        live, x, y = live[ok], x[ok], y[ok]
        differ = words[x] ^ words[y]
        same = differ == 0
        bits = differ[~same]
        lowest = bits & (~bits + np.uint64(1))
        out[live[~same]] += (np.log2(lowest.astype(np.float64)).astype(np.int64)) // 8
        live = live[same]
        out[live] += 8
    return np.minimum(out, n - np.maximum(a, b))


def _separator(k: int) -> bytes:
    """A number in bytes that UTF-8 text never holds, so that no match of text runs into it."""
    return bytes(0xF8 + (k >> shift & 7) for shift in range(3 * (SEPARATOR - 1), -1, -3))


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of a text, with samples at the ends of its runs.

    ``heads`` and ``lengths`` are the runs. Inside a run a place's neighbour in
    suffix order moves on with the place, so neighbours and their common prefixes
    are known everywhere from the run starts (neighbour above) and run ends
    (neighbour below): ``samples`` holds, for each of the two, text positions in
    order and the longest match there. Repetitive text has few runs.
    """

    def __init__(self, text: np.ndarray):
        self.size = n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1].astype(np.int16)
        bwt[order == 0] = -1  # nothing stands before the first place
        starts = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.heads, self.lengths = bwt[starts], np.diff(np.r_[starts, n])
        words = _words(text)
        self.samples = []
        for rows, step in ((starts, -1), (starts + self.lengths - 1, 1)):
            mate = rows + step
            has = (mate >= 0) & (mate < n)
            match = np.zeros(len(rows), np.int64)
            match[has] = _common_prefix(words, order[rows[has]], order[mate[has]], n)
            by_place = np.argsort(order[rows])
            self.samples.append((order[rows][by_place], match[by_place]))

    def statistics(self) -> np.ndarray:
        """For each place the longest match with another place, streamed from sample to sample."""
        best, place = np.zeros(self.size, np.int64), np.arange(self.size)
        for at, match in self.samples:  # the first place is a sample: its run is its own
            ahead = np.diff(np.r_[at, self.size])
            best = np.maximum(best, np.repeat(match + at, ahead) - place)
        return best


def matching_statistics(pieces: list[bytes]) -> np.ndarray:
    """For each place of the joined pieces (each followed by a separator): the longest match with another place."""
    joined = b"".join(p + _separator(k) for k, p in enumerate(pieces))
    return RunLengthIndex(np.frombuffer(joined, np.uint8)).statistics()


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def index_marks(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each piece the runs (first, behind last) of window starts that occur elsewhere in the pieces."""
    stats, at, out = matching_statistics(pieces), 0, []
    for p in pieces:
        out.append(_runs(stats[at : at + len(p) - length + 1] >= length))
        at += len(p) + SEPARATOR
    return out


def window_digests(piece: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each window: sums of mixed words times fixed odd numbers."""
    x = _mixed(_words(np.frombuffer(piece, np.uint8)) * _M1)
    n = len(piece) - length + 1
    a, b, f, g = np.zeros(n, np.uint64), np.zeros(n, np.uint64), 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        f, g = (f * 0x5851F42D4C957F2D + 1442695040888963407) % 2**64, (g * 0x2545F4914F6CDD1D + 0x1234567) % 2**64
        a += x[k : k + n] * np.uint64(f | 1)
        b += x[k : k + n] * np.uint64(g | 1)
    return _mixed(a), _mixed(b)


_BLOB = T.StructType([
    T.StructField("slice", T.IntegerType()), T.StructField("anchor", T.BinaryType()), T.StructField("digest", T.BinaryType()), T.StructField("key", T.BinaryType()),
    T.StructField("copy", T.BinaryType()), T.StructField("start", T.BinaryType()), T.StructField("windows", T.BinaryType()), T.StructField("flag", T.BinaryType()),
])
#: A mark (bytes start to stop of a text), or a segment whose bytes are wanted (windows from start on).
_FOUND = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("copy", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("stop", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("whole", T.BooleanType()),
])
_FIRST = T.StructType([*_BLOB.fields, T.StructField("found", T.ArrayType(_FOUND))])


def _rows(kind: int, key: np.ndarray, copy: np.ndarray, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray, whole: np.ndarray) -> list[dict]:
    return [
        {"kind": kind, "key": k.tobytes(), "copy": c, "start": s, "stop": e, "anchor": a, "whole": w}
        for k, c, s, e, a, w in zip(key, copy.tolist(), start.tolist(), stop.tolist(), anchor.view(np.int64).tolist(), whole.tolist(), strict=True)
    ]


def _cut(batches: Iterator[pa.RecordBatch], length: int, slices: int, locally_hot: int) -> Iterator[pa.RecordBatch]:
    """Segments of a task's texts as blobs by slice; what repeats inside a batch is marked, and stands once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_FIRST)
    for batch in batches:
        seen: dict[bytes, int] = {}
        texts, keys, copies, times = [], [], [], []
        for key, copy, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            if (raw := text.as_py()) is None or len(raw := raw.encode()) < length:
                continue
            k = key.as_py()
            if k in seen:
                times[seen[k]] += 1
            else:
                seen[k] = len(texts)
                texts.append(raw)
                keys.append(k)
                copies.append(copy.as_py())
                times.append(1)
        if not texts:
            continue
        who, start, windows, anchor, digest = segments_of(texts, length)
        key = np.frombuffer(b"".join(keys), "V16")[who]
        copy, twice = np.array(copies, np.int64)[who], np.array(times)[who] > 1
        order = np.lexsort((digest, anchor))
        who, start, windows, anchor, digest, key, copy, twice = (x[order] for x in (who, start, windows, anchor, digest, key, copy, twice))
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])]
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        many = (size[group] > 1) | (np.bincount(group, twice)[group] > 0)
        found = _rows(MARK, key[many], copy[many], start[many], (start + windows + length - 1)[many], anchor[many], many[many])
        keep = np.flatnonzero(new)
        start, windows, anchor, digest, key, copy, many = (x[keep] for x in (start, windows, anchor, digest, key, copy, many))
        fresh = np.r_[True, anchor[1:] != anchor[:-1]]
        of = np.cumsum(fresh) - 1
        warm = np.bincount(of)[of] > locally_hot
        found += _rows(WARM, key[warm], copy[warm], start[warm], (start + windows)[warm], anchor[warm], many[warm])
        flag = np.where(warm, 2, many).astype(np.uint8)  # 2: only says that this anchor is hot
        stay = ~warm | fresh
        to = ((anchor >> np.uint64(20)) % np.uint64(slices)).astype(np.int64)
        out = []
        for s in np.unique(to[stay]).tolist():
            m = stay & (to == s)
            out.append({"slice": s, "anchor": anchor[m].tobytes(), "digest": digest[m].tobytes(), "key": key[m].tobytes(), "copy": copy[m].tobytes(), "start": start[m].tobytes(), "windows": windows[m].tobytes(), "flag": flag[m].tobytes(), "found": None})
        for k in range(0, len(found), 50_000):
            out.append({"slice": None, "found": found[k : k + 50_000]})
        yield pa.RecordBatch.from_pylist(out, schema=arrow)


def _meet(table: pa.Table, length: int, most: int) -> pa.Table:
    """A slice's segments by anchor: marks of those that repeat, and the ones that need a closer look."""
    from pyspark.sql.pandas.types import to_arrow_schema

    col = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    anchor, digest, key, copy = col("anchor", np.uint64), col("digest", np.uint64), col("key", "V16"), col("copy", np.int64)
    start, windows, flag = col("start", np.int64), col("windows", np.int64), col("flag", np.uint8)
    hot = np.unique(anchor[flag == 2])
    real = flag < 2
    anchor, digest, key, copy, start, windows, flag = (x[real] for x in (anchor, digest, key, copy, start, windows, flag))
    order = np.lexsort((digest, anchor))
    anchor, digest, key, copy, start, windows, flag = (x[order] for x in (anchor, digest, key, copy, start, windows, flag))
    out: list[dict] = []
    if len(anchor):
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])]
        group = np.cumsum(new) - 1
        many = (np.bincount(group)[group] > 1) | (np.bincount(group, flag == 1)[group] > 0)
        out = _rows(MARK, key[many], copy[many], start[many], (start + windows + length - 1)[many], anchor[many], many[many])
        keep = np.flatnonzero(new)
        start, windows, anchor, key, copy, many = (x[keep] for x in (start, windows, anchor, key, copy, many))
        of = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
        differ = np.bincount(of)[of]
        warm = np.isin(anchor, hot) | (differ > most)
        for kind, m in ((COLD, ~warm & (differ > 1)), (WARM, warm)):
            out += _rows(kind, key[m], copy[m], start[m], (start + windows)[m], anchor[m], many[m])
    return pa.Table.from_pylist(out, schema=to_arrow_schema(_FOUND))


_PIECE = T.StructType([T.StructField("slice", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("start", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("piece", T.BinaryType())])
_SPAN = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])


def _index(table: pa.Table, length: int) -> pa.Table:
    """A slice's pieces, anchor by anchor, in blocks that the index holds at once."""
    rows = zip(table["anchor"].to_pylist(), table["key"].to_pylist(), table["start"].to_pylist(), table["whole"].to_pylist(), table["piece"].to_pylist(), strict=True)
    rows = [r for _, r in sorted({r[:3]: r for r in rows}.items())]  # a repeated row sends its pieces again
    out: list[dict] = []
    block: list[tuple] = []

    def flush() -> None:
        if block:
            for (_, key, start, whole, _), runs in zip(block, index_marks([r[4] for r in block], length), strict=True):
                if not whole:  # the others are marked already, and stand here as partners
                    out.extend({"key": key, "start": start + a, "stop": start + b - 1 + length} for a, b in runs)
            block.clear()

    size, at = 0, 0
    while at < len(rows):
        stop = at
        while stop < len(rows) and rows[stop][0] == rows[at][0]:
            stop += 1
        more = sum(len(r[4]) + SEPARATOR for r in rows[at:stop])
        if size + more > BLOCK_BYTES:
            flush()
            size = 0
        block.extend(rows[at:stop])
        size, at = size + more, stop
    flush()
    return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())]))


_WINDOW = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Window digests of hot anchors' pieces. Windows that repeat inside a batch go out marked (null digest), and one of them to meet others."""
    names = [f.name for f in _WINDOW]
    for batch in batches:
        pieces = batch.column("piece").to_pylist()
        if not pieces:
            continue
        digests = [window_digests(p, length) for p in pieces]
        sizes = [len(d[0]) for d in digests]
        a, b = (np.concatenate([d[k] for d in digests]) for k in (0, 1))
        who = np.repeat(np.arange(len(pieces)), sizes)
        start = np.concatenate([s + np.arange(n) for s, n in zip(batch.column("start").to_pylist(), sizes, strict=True)])
        whole = np.array(batch.column("whole").to_pylist())[who]
        order = np.lexsort((b, a))
        a, b, who, start, whole = (x[order] for x in (a, b, who, start, whole))
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        group = np.cumsum(new) - 1
        many = (np.bincount(group)[group] > 1) | (np.bincount(group, whole)[group] > 0)
        key = batch.column("key")
        local = np.flatnonzero(many & ~whole)
        one = np.flatnonzero(new)
        put = lambda at, n, x, y: pa.RecordBatch.from_arrays([x, y, key.take(pa.array(who[at])), pa.array(start[at]), pa.array(n, pa.int64())], names=names)
        yield put(local, np.zeros(len(local), np.int64), pa.nulls(len(local), pa.int64()), pa.nulls(len(local), pa.int64()))
        yield put(one, np.where(many[one], 2, 1), pa.array(a[one].view(np.int64)), pa.array(b[one].view(np.int64)))


def repeated_spans(documents: DataFrame, *, text_col: str = "text", length: int = LENGTH, locally_hot: int = LOCALLY_HOT, hot: int = HOT) -> DataFrame:
    """(key, spans): for each text digest with repeats, all marked byte ranges, unmerged."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "substrings")
    keyed = documents.select(F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("key"), F.col("copy"), F.col(text_col).alias("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SLICE_BYTES)
    first = scratch.keep(keyed.mapInArrow(lambda it: _cut(it, length, slices, locally_hot), _FIRST), "segments")
    met = first.filter("slice IS NOT NULL").drop("found").groupBy("slice").applyInArrow(lambda t: _meet(t, length, hot), _FOUND)
    found = scratch.keep(first.filter("slice IS NULL").select(F.explode("found").alias("f")).select("f.*").unionByName(met), "found")
    scratch.drop(first)
    marks = found.filter(F.col("kind") == MARK).select("key", "start", "stop")

    # Texts that stand in several rows repeat as a whole, and are fetched from one of them.
    long = keyed.select("key", "copy", F.octet_length("text").cast("long").alias("n")).filter(F.col("n") >= length)
    repeated = long.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("copy").alias("first"), F.first("n").alias("n")).filter("rows > 1")
    repeated = scratch.keep(repeated.select("key", "first", "n"), "repeated")
    marks = marks.unionByName(repeated.select("key", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))
    asked = found.filter(F.col("kind") != MARK).join(repeated, "key", "left")
    asked = asked.withColumns({"whole": F.col("whole") | F.col("first").isNotNull(), "copy": F.coalesce("first", "copy")})
    asked = asked.groupBy("key", "copy").agg(F.collect_set(F.struct("kind", "start", "stop", "anchor", "whole")).alias("asked"))
    asked = scratch.keep(asked, "asked")
    total = found.filter(F.col("kind") == COLD).agg(F.sum(F.col("stop") - F.col("start") + length)).first()[0] or 0
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SLICE_BYTES)
    pieces_schema = T.StructType([T.StructField("kind", T.IntegerType()), *_PIECE.fields])

    def fetch(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in pieces_schema.fieldNames()}
        seen = set()
        for key, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if key in seen:
                continue  # a repeated row
            seen.add(key)
            raw = text.as_py().encode()
            for r in asked.as_py():
                row = {"kind": r["kind"], "slice": (r["anchor"] >> 20) % slices, "anchor": r["anchor"], "key": key, "start": r["start"], "whole": r["whole"], "piece": raw[r["start"] : r["stop"] + length - 1]}
                for n, v in row.items():
                    out[n].append(v)
        return out

    fetched = keyed.filter(F.octet_length("text") >= length).join(asked, ["key", "copy"]).select("key", "text", "asked")
    pieces = scratch.keep(map_rows(fetched, pieces_schema, fetch), "pieces")
    cold = pieces.filter(F.col("kind") == COLD).drop("kind").groupBy("slice").applyInArrow(lambda t: _index(t, length), _SPAN)
    warm = pieces.filter(F.col("kind") == WARM).select("key", "start", "whole", "piece").mapInArrow(lambda it: _windows(it, length), _WINDOW)
    warm = scratch.keep(warm, "windows")
    local = warm.filter("a IS NULL").select("key", "start")
    seen = warm.filter("a IS NOT NULL")
    often = scratch.keep(seen.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1").select("a", "b"), "often")
    met = seen.join(often, ["a", "b"], "left_semi").select("key", "start")
    windows = local.unionByName(met).withColumn("stop", F.col("start") + length)
    spans = marks.unionByName(cold).unionByName(windows)
    return scratch.keep(spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of byte ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_substrings(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, locally_hot: int = LOCALLY_HOT, hot: int = HOT, keep_bytes: bool = False) -> DataFrame:
    """One row per document row: id, n_bytes, spans (start, end), kept_sha256, and the kept bytes if asked for.

    ``spans`` are the maximal runs of bytes covered by a ``length``-byte string
    that also starts anywhere else in the corpus, the same document included.
    Null texts are empty; texts shorter than ``length`` keep all bytes. Repeated
    rows are copies of each other, so both lose what they share.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    body = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("copy"), body.alias("text"))
    spans = repeated_spans(docs, length=length, locally_hot=locally_hot, hot=hot)
    joined = docs.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary")))).join(spans, "key", "left").select("id", "text", "spans")
    fields = [field(documents, id_col, "id"), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept_sha256", T.StringType())]
    if keep_bytes:
        fields.append(T.StructField("kept", T.BinaryType()))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_bytes": [], "spans": [], "kept_sha256": [], "kept": []}
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_py().encode()
            runs = merged([(s["start"], s["stop"]) for s in spans.as_py() or ()])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)], strict=True))
            out["n_bytes"].append(len(raw))
            out["spans"].append([{"start": a, "end": b} for a, b in runs])
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if keep_bytes:
                out["kept"].append(kept)
        return {"id": batch.column(0), **out}

    return map_rows(joined, T.StructType(fields), cut).withColumnRenamed("id", id_col)
