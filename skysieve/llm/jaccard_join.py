"""Exact n-gram Jaccard join by PartEnum signatures, with every document's links and component.

A text's set is its distinct shingles of words, as 64-bit hashes. Sets fall in
size bands; a set signs for its own band and, where a larger partner may fall
there, for the next. In a band two similar sets differ in at most k elements.
PartEnum cuts the hash domain in ranges ("partitions") and signs subsets of
them, so that two sets that differ in few partitions agree on a whole subset:

* Small sets (k up to 3): n2 > k partitions, and every subset of n2 - k of them
  is enumerated. At most k partitions can differ, so one subset agrees.
* Larger sets: more than k partitions, and the subsets are the single
  partitions, the fewest signatures. Of the partitions that hold elements of a
  set at most k can differ in its partner, so if it fills more than k of them the
  two agree on a filled one.

Sets that fill at most k partitions also sign their empty subsets, under a mark
of their own, so that two such sets meet too.

1. Signatures travel as packed blobs, one row per task and slice of the signature
   space. A slice gives the buckets of sets that share a signature. Buckets of at
   most ``COLD`` sets stay together; larger ones are hot, and only needed for sets
   that have at most k signatures left without the hot ones.
2. In a bucket, sets are close if size and a parity sketch, about two bits an
   element, do not rule a link out. A bucket gives a spanning forest of its close
   pairs, at most one row per member, found by walking from set to set: near
   copies are settled by the first step. Large buckets are walked in chunks, then
   in pairs of chunks as far as chunks hold different components.
3. The components of the close pairs hold every link. Inside each, the common
   elements of all pairs are counted at once, exactly, from the whole sets:
   elements of one set are left out, frequent ones are multiplied as a matrix,
   the others are joined by an inverted index. What leaves a task is a row per
   set: its links, and the smallest set it reaches. Components beyond ``BLOCK``
   sets or ``BLOCK_ELEMENTS`` elements fall in size bands, bands in blocks, and
   blocks meet in pairs; their sets travel as differences from one set of the
   component, which is far less than the sets where these are near copies.

Copies share a set id, so they cost nothing after the first pass. No group is
ever held but a slice, a chunk of a bucket, and a pair of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, field, give_back, map_rows

WORDS, SHARE = 5, (4, 5)
COLD, LOCALLY_HOT, CHUNK, FEW_TEXTS = 64, 256, 4096, 100_000
BLOCK, BLOCK_ELEMENTS, STRIP = 4096, 1 << 20, 2 << 20
SKETCH_BITS = (512, 65536)
#: Partitions for small k, whose subsets are enumerated.
ENUMERATED = {1: 3, 2: 5, 3: 6}
SLICE_BYTES, FLUSH, MEMO = 24 << 20, 500_000, 200_000
_M = np.uint64(0x9E3779B97F4A7C15)
_LOW40 = np.uint64((1 << 40) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


class WordHashes(dict):
    """64-bit hash of each word, kept for the words a task meets again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes. Words are runs without ASCII white space, A-Z lower-cased; fewer words than ``size`` make one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = _hashes()
    h = np.array([known[w] for w in words], np.uint64)
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64) * _M
    for k in range(width):
        out = (out ^ h[k : k + n]) * _M
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


@lru_cache(maxsize=4)
def _bands(share: tuple[int, int]) -> np.ndarray:
    """Upper ends of the size bands; each is at most 1 / share times its lower end."""
    top, ends = 1, [1]
    while top < 1 << 40:
        top = max(top + 1, (top + 1) * share[1] // share[0])
        ends.append(top)
    return np.array(ends, np.int64)


@lru_cache(maxsize=4096)
def plan(band: int, share: tuple[int, int]) -> tuple[int, int, int]:
    """(k, partitions, partitions in a signature) for pairs of sets in this band, or in the one below and this."""
    ends = _bands(share)
    low, high = int(ends[band - 1]) + 1 if band else 1, int(ends[band])
    below = low - 1
    a, b = share
    # Similar sets of x and y elements differ in at most (x + y) (b - a) / (b + a), and y <= x b / a.
    k = max(2 * high * (b - a) // (b + a), below * (b - a) // a)
    if k in ENUMERATED:
        return k, ENUMERATED[k], ENUMERATED[k] - k
    least = max(int(ends[band - 2]) + 1 if band > 1 else 1, -(-low * a // b))
    parts = k + 1
    while True:
        empty = math.exp(-least / parts)
        spread = math.sqrt(max(1e-9, parts * empty * (1 - (1 + least / parts) * empty)))
        if parts * (1 - empty) - 2.5 * spread >= k + 1 or parts > 8 * (k + 8):
            return k, parts, 1
        parts += max(1, parts // 50)


@lru_cache(maxsize=8)
def _subsets(parts: int, take: int) -> np.ndarray:
    """A row per subset of ``take`` of the partitions, 1 where a partition is in it."""
    out = np.zeros((math.comb(parts, take), parts), np.uint64)
    for row, members in enumerate(combinations(range(parts), take)):
        out[row, list(members)] = 1
    return out


def signatures(h: np.ndarray, share: tuple[int, int]) -> list[tuple[np.ndarray, int, int]]:
    """For the own band, then the next: (signatures, filled partitions, k). The lowest bit tells the two apart and is no part of the signature.

    Where subsets are enumerated, a hot one leaves no count of agreeing
    partitions to go by, so k stands for the filled partitions: such sets meet
    in all their hot buckets.
    """
    ends = _bands(share)
    own = int(np.searchsorted(ends, len(h)))
    mixed = _mix(h ^ _M)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    high = h >> np.uint64(32)
    out = []
    for which, band in enumerate((own, own + 1)):
        if which and len(h) * share[1] < (int(ends[own]) + 1) * share[0]:
            continue  # no partner that large
        k, parts, take = plan(band, share)
        of = ((high * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        total = sums[np.r_[first[1:], len(h)]] - sums[first]
        salt = np.uint64((band * 0x51ED2701 + 1) % 2**64)
        if take > 1:
            subsets = _subsets(parts, take)
            each = np.zeros(parts, np.uint64)
            each[of[first]] = total
            filled = np.zeros(parts, np.uint64)
            filled[of[first]] = 1
            full = (subsets @ filled) > 0
            at = np.arange(len(subsets), dtype=np.uint64)
            sig = _mix((subsets[full] @ each) ^ _mix(at[full] * _M + salt))
            empty, told = at[~full], k
        else:
            sig = _mix(total ^ _mix(of[first].astype(np.uint64) * _M + salt))
            empty, told = np.setdiff1d(np.arange(parts), of[first]).astype(np.uint64), len(first)
        if len(first) <= k:
            sig = np.concatenate([sig, _mix(_mix(empty * _M + salt) + np.uint64(0xABCDEF))])
        out.append(((sig & ~np.uint64(1)) | np.uint64(which), told, k))
    return out


def sketch(h: np.ndarray) -> bytes:
    """Parities of at least twice as many classes as elements (a power of two, within ``SKETCH_BITS``).

    Two sets differ in at least as many elements as their sketches in bits.
    """
    least, most = SKETCH_BITS
    bits = min(most, max(least, 1 << (2 * len(h) - 1).bit_length()))
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """A row of words per sketch, all as short as the shortest: classes that fall together add their parities."""
    width = min(len(x) for x in sketches) // 8
    out = np.empty((len(sketches), width), np.uint64)
    for k, x in enumerate(sketches):
        words = np.frombuffer(x, np.uint64)
        out[k] = words if len(words) == width else np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)
    return out


#: What a set is: size, filled partitions and k in its two bands, sketch.
_SET = [*(T.StructField(x, T.LongType()) for x in ("n", "m0", "k0", "m1", "k1")), T.StructField("sketch", T.BinaryType())]


def _doc_schema(id_field: T.StructField) -> T.StructType:
    """Rows of the first pass: a document (kind 0), a blob of signatures (1), or a hot signature of a set (2)."""
    return T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("slice", T.LongType()), id_field, T.StructField("set", T.LongType()), T.StructField("key", T.BinaryType()),
        T.StructField("copy", T.LongType()), *_SET, T.StructField("low", T.BinaryType()), T.StructField("top", T.BinaryType()), T.StructField("who", T.BinaryType()),
        T.StructField("sets", T.BinaryType()), T.StructField("bucket", T.LongType()), T.StructField("next", T.LongType()),
    ])


def _place(sig: np.ndarray, slices: int) -> np.ndarray:
    return ((sig >> np.uint64(40)) % np.uint64(slices)).astype(np.int64)


def _bucket(sig40: np.ndarray, slice_: np.ndarray | int) -> np.ndarray:
    """A bucket's number: a mix of its slice and the 40 bits kept of its signature."""
    return _mix(sig40 + (np.asarray(slice_).astype(np.uint64) << np.uint64(40))).view(np.int64)


def _blobs(sigs: list[np.ndarray], sets: list[int], slices: int, locally_hot: int) -> list[dict]:
    """Packed rows by slice; signatures that many sets of this lot share go out as rows of their own, with a mark for the slice."""
    sig = np.concatenate(sigs)
    who = np.repeat(np.arange(len(sigs), dtype=np.uint16), [len(s) for s in sigs])
    ids = np.array(sets, np.int64)
    order = np.argsort(sig, kind="stable")
    sig, who = sig[order], who[order]
    bare = sig >> np.uint64(1)
    new = np.flatnonzero(np.r_[True, bare[1:] != bare[:-1]])
    size = np.diff(np.r_[new, len(sig)])
    hot = np.repeat(size > locally_hot, size)
    out: list[dict] = []
    if hot.any():
        low, at = sig[hot] & _LOW40, _place(sig[hot], slices)
        first = new[size > locally_hot]
        for b, s, w in zip(_bucket(low >> np.uint64(1), at).tolist(), ids[who[hot]].tolist(), (sig[hot] & np.uint64(1)).tolist(), strict=True):
            out.append({"kind": 2, "slice": (s + b) % slices, "bucket": b, "set": s, "next": w})
        who = who.copy()
        who[first] = 0xFFFF
        stay = ~hot
        stay[first] = True
        sig, who = sig[stay], who[stay]
    at = _place(sig, slices)
    order = np.argsort(at, kind="stable")
    at, sig, who = at[order], sig[order], who[order]
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        used, local = np.unique(who[a:b], return_inverse=True)
        real = used[used != 0xFFFF]
        local = np.where(who[a:b] == 0xFFFF, 0xFFFF, local).astype(np.uint16)
        s = sig[a:b] & _LOW40
        out.append({"kind": 1, "slice": int(at[a]), "low": (s & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), "top": (s >> np.uint64(32)).astype(np.uint8).tobytes(), "who": local.tobytes(), "sets": ids[real].tobytes()})
    return out


def _sign(batches: Iterator[pa.RecordBatch], schema: T.StructType, slices: int, size: int, share: tuple[int, int], locally_hot: int) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    pack = lambda rows: pa.RecordBatch.from_pylist(rows, schema=arrow)
    for batch in batches:
        rows: list[dict] = []
        done: dict[int, dict] = {}
        sigs: list[np.ndarray] = []
        sets: list[int] = []
        held = 0
        for ident, key, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            h = shingles(text.as_py(), size)
            row = {"kind": 0, "id": ident, "key": key, "copy": copy, "n": len(h), "set": None, "slice": (copy + len(rows)) % slices}
            if len(h):
                own = int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))
                if own not in done:
                    made = signatures(h, share) if len(h) * (share[1] - share[0]) >= share[0] else []  # smaller sets match only their equals
                    told = {"m0": 1, "k0": 0, "m1": 1, "k1": 0}
                    for which, (s, m, k) in enumerate(made):
                        told |= {f"m{which}": m, f"k{which}": k}
                        sigs.append(s)
                        sets.append(own)
                        held += len(s)
                    told["sketch"] = sketch(h)
                    done[own] = told
                row |= {"set": own} | done[own]
            rows.append(row)
            if held > FLUSH or len(sets) > 60_000:
                yield pack(_blobs(sigs, sets, slices, locally_hot))
                sigs, sets, held = [], [], 0
        if sigs:
            yield pack(_blobs(sigs, sets, slices, locally_hot))
        for k in range(0, len(rows), 20_000):
            yield pack(rows[k : k + 20_000])
    give_back()


def _result_schema(id_field: T.StructField) -> T.StructType:
    return T.StructType([
        T.StructField("kind", T.IntegerType()), id_field, T.StructField("set", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("copy", T.LongType()),
        *_SET, T.StructField("bucket", T.LongType()), T.StructField("next", T.LongType()), T.StructField("members", T.ArrayType(T.LongType())),
    ])


def _gather(table: pa.Table, schema: T.StructType, cold: int) -> pa.Table:
    """A slice: its document rows and hot rows as they came, and its buckets of two or more sets."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    kind = np.array(table["kind"].to_pylist())
    plain = table.filter(pa.array(kind != 1))
    n = len(plain)
    parts = [pa.table([plain[f.name].cast(f.type) if f.name in plain.column_names else pa.nulls(n, f.type) for f in arrow], schema=arrow)]
    blobs = table.filter(pa.array(kind == 1))
    sig, sets, marks = [], [], []
    at = 0
    for low, top, who, ids in zip(*(blobs[c].to_pylist() for c in ("low", "top", "who", "sets")), strict=True):
        sig.append(np.frombuffer(low, np.uint32).astype(np.uint64) | (np.frombuffer(top, np.uint8).astype(np.uint64) << np.uint64(32)))
        own = np.frombuffer(ids, np.int64)
        who = np.frombuffer(who, np.uint16)
        sets.append(np.where(who == 0xFFFF, np.int64(0), own[np.minimum(who, max(0, len(own) - 1))] if len(own) else np.int64(0)))
        marks.append(who == 0xFFFF)
        at = blobs["slice"][0].as_py()
    if not sig:
        return parts[0]
    sig, sets, marks = np.concatenate(sig), np.concatenate(sets), np.concatenate(marks)
    sig, which = sig >> np.uint64(1), (sig & np.uint64(1)).astype(np.int64)
    marked = np.unique(sig[marks])
    sig, sets, which = sig[~marks], sets[~marks], which[~marks]
    order = np.argsort(sig, kind="stable")
    sig, sets, which = sig[order], sets[order], which[order]
    # Only signatures seen twice, or hot elsewhere, go on.
    group = np.cumsum(np.r_[True, sig[1:] != sig[:-1]][: len(sig)]) - 1
    keep = (np.bincount(group)[group] > 1) if len(sig) else np.zeros(0, bool)
    if len(marked):
        keep |= np.isin(sig, marked)
    sig, sets, which = sig[keep], sets[keep], which[keep]
    order = np.lexsort((sets, sig))
    sig, sets, which = sig[order], sets[order], which[order]
    once = np.r_[True, (sig[1:] != sig[:-1]) | (sets[1:] != sets[:-1])][: len(sig)]
    sig, sets, which = sig[once], sets[once], which[once]
    if len(sig):
        edges = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True])
        bucket = _bucket(sig[edges[:-1]], at)
        is_marked = np.isin(sig[edges[:-1]], marked)
        seen: set[tuple] = set()
        rows: list[dict] = []
        for b, a, z, m in zip(bucket.tolist(), edges[:-1].tolist(), edges[1:].tolist(), is_marked.tolist(), strict=True):
            if m or z - a > cold:
                rows.extend({"kind": 2, "bucket": b, "set": s, "next": w} for s, w in zip(sets[a:z].tolist(), which[a:z].tolist(), strict=True))
            elif z - a > 1 and (members := tuple(sets[a:z].tolist())) not in seen:
                seen.add(members)
                rows.append({"kind": 1, "members": members})
        parts.append(pa.Table.from_pylist(rows, schema=arrow))
    return pa.concat_tables(parts)


_MEMBER = T.StructType([T.StructField("slice", T.LongType()), T.StructField("group", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("set", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])
_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): rows sorted by the keys (the last first), and where groups of equal keys begin, with the end."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.r_[np.flatnonzero(new), len(order)]


def _walk(n: np.ndarray, sketches: list[bytes], share: tuple[int, int]) -> list[tuple[int, np.ndarray]]:
    """A spanning forest of the close pairs, as (root, others). Each set met is compared with those not met yet."""
    a, b = share
    words = _folded(sketches)
    left = np.arange(len(n))
    out = []
    while len(left):
        root, left, queue, found = int(left[0]), left[1:], [int(left[0])], []
        while queue and len(left):
            at = queue.pop()
            differ = np.bitwise_count(words[left] ^ words[at]).sum(axis=1, dtype=np.int64)
            m = n[left]
            near = (np.minimum(m, n[at]) * b >= np.maximum(m, n[at]) * a) & (differ * (a + b) <= (m + n[at]) * (b - a))
            if near.any():
                found.append(left[near])
                queue.extend(left[near].tolist())
                left = left[~near]
        if found:
            out.append((root, np.concatenate(found)))
    return out


def _forest(table: pa.Table, share: tuple[int, int]) -> pa.Table:
    """A slice of buckets (or chunks of them, or pairs of chunks): edges that span the close pairs of each."""
    group, chunk, ids, n = (table[c].to_numpy().astype(np.int64) for c in ("group", "chunk", "set", "n"))
    order, edges = _groups(chunk, group)
    sketches = table["sketch"].to_pylist()
    ids, n, sketches = ids[order], n[order], [sketches[k] for k in order.tolist()]
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for root, others in _walk(n[lo:hi], sketches[lo:hi], share):
            x.append(ids[lo + others])
            y.append(np.full(len(others), ids[lo + root]))
    return pa.table({"a": np.concatenate(x), "b": np.concatenate(y)})


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(set, comp): the smallest set reachable, for sets with an edge. Rounds of taking the neighbours' smallest label, then the label's label."""
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("set").alias("b"), "comp"), "b").groupBy(F.col("a").alias("set")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "set").select("set", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        jump = step.join(labels.select(F.col("set").alias("via"), F.col("comp").alias("far")), "via", "left").select("set", "old", F.least("via", F.coalesce("far", "via")).alias("comp"))
        grown = scratch.keep(jump, "labels")
        changed = not grown.filter("comp <> old").isEmpty()
        labels = grown.select("set", "comp")
        if not changed:
            return labels


def _hot_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, buckets): the hot buckets of the sets that have at most k signatures of a band without them."""
    mine = rows.groupBy("set").agg(F.collect_set(F.struct("bucket", "next")).alias("hot"))  # as many as a set has signatures
    of = lambda which: F.filter("hot", lambda x: x["next"] == which)
    few = lambda which: F.when(F.col(f"m{which}") - F.size(of(which)) <= F.col(f"k{which}"), of(which)).otherwise(F.array_except(of(which), of(which)))
    kept = F.transform(F.concat(few(0), few(1)), lambda x: x["bucket"])
    return mine.join(sets.select("set", "m0", "k0", "m1", "k1"), "set").select("set", kept.alias("buckets")).filter(F.size("buckets") > 0)


def _sliced(rows: DataFrame, key: tuple[str, ...], size: F.Column, kernel: Callable[[pa.Table], pa.Table], schema: T.StructType, scratch: Scratch, name: str) -> DataFrame:
    """Runs ``kernel`` over slices of whole groups. ``rows`` are written first, so that their bytes give the number of slices."""
    rows = scratch.keep(rows, name)
    total = rows.agg(F.sum(size)).first()[0] or 0
    slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SLICE_BYTES)
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64(*key), F.lit(slices)).cast("long"))
    return dealt.groupBy("slice").applyInArrow(kernel, schema)


def _close(scratch: Scratch, buckets: DataFrame, hot: DataFrame, sets: DataFrame, share: tuple[int, int], chunk: int) -> DataFrame | None:
    """(a, b) that span the close pairs of all buckets, or None where nothing is close."""
    known = sets.select("set", "n", "sketch")
    weigh = F.octet_length("sketch") + F.lit(40)
    forest = lambda t: _forest(t, share)
    cold = buckets.select(F.xxhash64("members").alias("group"), F.lit(0).cast("long").alias("chunk"), F.explode("members").alias("set"))
    warm = scratch.keep(hot.select("set", F.explode("buckets").alias("group")), "hot-rows")
    sizes = warm.groupBy("group").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > chunk).select("group", F.ceil(F.col("c") / chunk).cast("long").alias("parts"))
    sizes = scratch.keep(sizes, "large")
    large = not sizes.isEmpty()
    if large:
        warm = warm.join(sizes, "group", "left")
        part = F.pmod(F.xxhash64("set", "group"), F.coalesce("parts", F.lit(1).cast("long")))
    else:
        part = F.lit(0).cast("long")
    rows = cold.select("group", "chunk", "set").unionByName(warm.select("group", part.alias("chunk"), "set")).join(known, "set")
    edges = scratch.keep(_sliced(rows, ("group", "chunk"), weigh, forest, _EDGE, scratch, "members").distinct(), "forest")
    if edges.isEmpty():
        edges = None
    if not large:
        return edges

    # Large buckets: pairs of chunks that hold different components. A small component stays in one chunk, and each pair is
    # met from its smaller component, so a large component and a few strays cost the component's size times the strays' chunks.
    inside = warm.filter("parts IS NOT NULL")
    inside = inside.withColumn("comp", F.col("set")) if edges is None else _labelled(inside, components(scratch, edges))
    weights = inside.select("comp", "set").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    spread = F.pmod(F.xxhash64("comp", F.pmod(F.xxhash64("set"), F.least("weight", "parts"))), F.col("parts"))
    inside = scratch.keep(inside.join(weights, "comp").select("group", "set", "comp", "weight", spread.alias("chunk")), "inside")
    order = F.struct("weight", "comp")
    each = scratch.keep(inside.groupBy("group", "chunk").agg(F.min(order).alias("low"), F.max(order).alias("high")), "chunks")
    side = lambda p: each.select("group", F.col("chunk").alias(p), F.col("low").alias(f"{p}_low"), F.col("high").alias(f"{p}_high"))
    met = side("p").join(side("q"), "group").filter("p_low < q_high AND p <> q OR p = q AND p_low <> p_high")
    met = met.select("group", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    ends = met.select("group", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("chunk"))
    pairs = inside.join(ends, ["group", "chunk"]).select(F.xxhash64("group", "p").alias("group"), F.col("q").alias("chunk"), "set").join(known, "set")
    more = scratch.keep(_sliced(pairs, ("group", "chunk"), weigh, forest, _EDGE, scratch, "pairs").distinct(), "forest")
    if more.isEmpty():
        return edges
    return more if edges is None else edges.unionByName(more)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``comp``; a set without links is its own."""
    return rows.join(labels, "set", "left").withColumn("comp", F.coalesce("comp", "set"))


class Shared:
    """How many elements sets have in common, for strips of sets against all.

    Elements that many sets hold are multiplied as a matrix; for the others the
    holders of each are listed. Elements of one set play no part.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.total = len(sets)
        elements = np.concatenate(sets)
        who = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
        order = np.argsort(elements, kind="stable")
        elements, who = elements[order], who[order]
        first = np.flatnonzero(np.r_[True, elements[1:] != elements[:-1]][: len(elements)])
        held = np.diff(np.r_[first, len(elements)])
        often = max(8, len(sets) // 16)
        of = np.repeat(np.arange(len(held)), held)
        many = held[of] > often
        columns = np.cumsum(held > often) - 1
        self.dense = np.zeros((len(sets), int((held > often).sum())), np.float32)
        self.dense[who[many], columns[of[many]]] = 1
        few = (held[of] > 1) & ~many
        self.holders = who[few]
        start = np.cumsum(np.r_[0, held * ((held > 1) & (held <= often))])
        entry = np.argsort(self.holders, kind="stable")
        self.by_set = np.searchsorted(self.holders[entry], np.arange(len(sets) + 1))
        self.start, self.held = start[of[few]][entry], held[of[few]][entry]

    def strip(self, low: int, high: int) -> np.ndarray:
        """Common elements of the sets low to high with every set."""
        out = (self.dense[low:high] @ self.dense.T).astype(np.int64)
        flat = out.ravel()
        at, stop = int(self.by_set[low]), int(self.by_set[high])
        while at < stop:
            upto = at + max(1, int(np.searchsorted(np.cumsum(self.held[at:stop]), STRIP)))
            held = self.held[at:upto]
            place = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held) + np.repeat(self.start[at:upto], held)
            row = np.searchsorted(self.by_set, np.arange(at, upto), side="right") - 1 - low
            flat += np.bincount(np.repeat(row, held) * self.total + self.holders[place], minlength=len(flat))
            at = upto
        return out


def links_of(sets: list[np.ndarray], n: np.ndarray, copies: np.ndarray, share: tuple[int, int], split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each set: documents of other sets it links with, and the first set it reaches.

    ``sets`` are the sets, or all their differences from one base; ``n`` are the
    sets' own sizes. With ``split``, only pairs across that place count.
    """
    a, b = share
    total = len(sets)
    common = Shared(sets)
    # With d differing elements: link if (n + m - d) b >= (n + m + d) a, and d is what differs from the base, less twice what is common.
    own = n * (b - a) - np.array([len(h) for h in sets], np.int64) * (a + b)
    links, root, weight = np.zeros(total, np.int64), np.arange(total), copies.astype(np.float64)
    height = max(1, min(total, STRIP // total))
    for low in range(0, total if split is None else split, height):
        high = min(low + height, total if split is None else split)
        linked = common.strip(low, high) * (2 * (a + b)) + own[low:high, None] + own[None, :] >= 0
        if split is None:
            linked[np.arange(high - low), np.arange(low, high)] = False
        else:
            linked[:, :split] = False
            links += (weight[low:high] @ linked).astype(np.int64)
        links[low:high] += (linked @ weight).astype(np.int64)
        for row in range(high - low):
            mine = root[low + row]
            theirs = root[linked[row]]
            theirs = theirs[theirs != mine]
            if len(theirs):
                joined = np.unique(np.r_[theirs, mine])
                root[np.isin(root, joined)] = joined[0]
    return links, root


_PLACE = T.StructType([T.StructField("low", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("high", T.IntegerType()), T.StructField("j", T.LongType()), T.StructField("side", T.IntegerType())])
_FETCHED = T.StructType([
    T.StructField("comp", T.LongType()), T.StructField("places", T.ArrayType(_PLACE)), T.StructField("set", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("copies", T.LongType()), T.StructField("h", T.BinaryType()),
])
_LINKED = T.StructType([T.StructField("set", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType()), T.StructField("whole", T.BooleanType())])


def _linked(table: pa.Table, share: tuple[int, int]) -> pa.Table:
    """A slice of components or pairs of their blocks: links and root of each set. Rows that stand twice count once."""
    comp, group, ids, n, copies, side = (table[c].to_numpy().astype(np.int64) for c in ("comp", "group", "set", "n", "copies", "side"))
    order, edges = _groups(ids, side, group, comp)
    starts = order[edges[:-1]]
    comp, group, ids, n, copies, side = (x[starts] for x in (comp, group, ids, n, copies, side))
    packed = table["h"].take(pa.array(starts)).to_pylist()
    _, edges = _groups(group, comp)  # in order already
    out: list[tuple[np.ndarray, ...]] = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = side[lo:hi]
        split = None if own[0] == 2 else int((own == 0).sum())
        if split in (0, hi - lo):
            continue  # a block that met no other
        links, root = links_of([np.frombuffer(h, np.uint64) for h in packed[lo:hi]], n[lo:hi], copies[lo:hi], share, split)
        out.append((ids[lo:hi], links, ids[lo:hi][root], group[lo:hi] == 0))
    kinds = {"set": np.int64, "links": np.int64, "root": np.int64, "whole": bool}
    return pa.table({c: np.concatenate([x[k] for x in out]) if out else np.zeros(0, t) for k, (c, t) in enumerate(kinds.items())})


def _places(scratch: Scratch, mine: DataFrame, block: int, share: tuple[int, int]) -> DataFrame:
    """Adds ``places``: the pairs of blocks in which a set of a large component meets others; null in the others.

    Components of more than ``block`` sets or ``BLOCK_ELEMENTS`` elements fall in
    size bands, of which only neighbours can link, and bands in blocks.
    """
    large = mine.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).filter((F.col("c") > block) | (F.col("s") > BLOCK_ELEMENTS))
    large = scratch.keep(large.select("comp"), "large")
    if large.isEmpty():
        return mine.withColumn("places", F.lit(None).cast(T.ArrayType(_PLACE)))
    ends = F.array(*(F.lit(int(e)) for e in _bands(share)))
    mine = mine.withColumn("band", F.size(F.filter(ends, lambda e: e < F.col("n"))))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("n") / F.lit(BLOCK_ELEMENTS))).cast("long")
    bands = mine.join(large, "comp").groupBy("comp", "band").agg(parts.alias("parts"))
    bands = scratch.keep(bands.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts")), "bands")
    of = lambda band: F.coalesce(F.try_element_at("parts", band), F.lit(0).cast("long"))
    key = lambda low, i, high, j, side: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), F.lit(side).alias("side"))
    each = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda j: j < n), f)
    band, chunk = F.col("band"), F.col("part")
    same = each(of(band), lambda j: F.when(j > chunk, key(band, chunk, band, j, 0)).when(j < chunk, key(band, j, band, chunk, 1)).otherwise(key(band, j, band, j, 2)))
    above = each(of(band + 1), lambda j: key(band, chunk, band + 1, j, 0))
    below = each(of(band - 1), lambda j: key(band - 1, j, band, chunk, 1))
    rows = mine.join(bands, "comp", "left").withColumn("part", F.pmod(F.xxhash64("set"), F.greatest(of(band), F.lit(1))))
    return rows.withColumn("places", F.when(F.col("parts").isNotNull(), F.concat(same, above, below)).cast(T.ArrayType(_PLACE))).drop("band", "part", "parts")


def _exact(scratch: Scratch, mine: DataFrame, docs: DataFrame, size: int, share: tuple[int, int], block: int) -> DataFrame:
    """(set, links, comp) for the sets with a close pair: the documents of other sets that each links with, and its component."""
    mine = scratch.keep(_places(scratch, mine, block, share), "placed")
    few = F.broadcast(mine) if mine.count() <= FEW_TEXTS else mine

    def hashed(batch: pa.RecordBatch) -> dict:
        ids = batch.column(0).to_numpy()
        first = np.sort(np.unique(ids, return_index=True)[1])  # repeated rows
        batch = batch.take(pa.array(first))
        return {
            **{c: batch.column(c) for c in ("comp", "places", "set", "n", "copies")},
            "h": [shingles(t.as_py(), size).tobytes() for t in batch.column("text")],
        }

    found = docs.filter("text IS NOT NULL").select("key", "copy", "text").join(few, ["key", "copy"])
    fetched = scratch.keep(map_rows(found.select("set", "comp", "places", "n", "copies", "text"), _FETCHED, hashed), "hashes")
    cols = ("comp", "group", "side", "set", "n", "copies", "h")
    rows = fetched.filter("places IS NULL").withColumns({"group": F.lit(0).cast("long"), "side": F.lit(2)}).select(*cols)
    large = fetched.filter("places IS NOT NULL")
    if not large.isEmpty():
        base = large.groupBy("comp").agg(F.min_by("h", "set").alias("base"))
        told = T.StructType([*(f for f in _FETCHED if f.name != "comp"), T.StructField("comp", T.LongType())])

        def differing(batch: pa.RecordBatch) -> dict:
            made = [np.setxor1d(np.frombuffer(h, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True).tobytes() for h, b in zip(batch.column("h").to_pylist(), batch.column("base").to_pylist(), strict=True)]
            return {**{c: batch.column(c) for c in ("comp", "places", "set", "n", "copies")}, "h": made}

        apart = map_rows(large.join(base, "comp"), told, differing).withColumn("place", F.explode("places"))
        group = F.xxhash64("place.low", "place.i", "place.high", "place.j").bitwiseOR(F.lit(1))  # 0 is a whole component
        rows = rows.unionByName(apart.withColumns({"group": group, "side": F.col("place.side")}).select(*cols))
    found = _sliced(rows, ("comp", "group"), F.octet_length("h") + F.lit(64), lambda t: _linked(t, share), _LINKED, scratch, "met")
    found = scratch.keep(found, "linked")
    whole = found.filter("whole").select("set", "links", F.col("root").alias("comp"))
    part = found.filter("NOT whole")
    if part.isEmpty():
        return whole
    edges = scratch.keep(part.filter("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b")).distinct(), "edges")
    summed = part.groupBy("set").agg(F.sum("links").alias("links"))
    return whole.unionByName((_labelled(summed, components(scratch, edges)) if not edges.isEmpty() else summed.withColumn("comp", F.col("set"))).select("set", "links", "comp"))


def join_components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, share: tuple[int, int] = SHARE, cold: int = COLD, locally_hot: int = LOCALLY_HOT, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row per document row: id, n_shingles, set_id, n_links, component_id.

    Two documents link when their shingle sets' common part is at least
    ``share`` of their union; ``component_id`` is the smallest id reachable by
    links, itself included; ``n_links`` is the number of other document rows it
    links with, copies included. Documents with equal sets have one ``set_id``.
    Null and wordless texts have no set and link with nothing (their component is
    their own id). Null ids are no component's smallest unless there is no
    other. Repeated rows are copies. An empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    text = F.col(text_col)
    docs = documents.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("key"), F.xxhash64(F.col(id_col).cast("string")).alias("copy"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SLICE_BYTES)
    ident = field(documents, id_col, "id")
    first, result = _doc_schema(ident), _result_schema(ident)
    signed = docs.mapInArrow(lambda it: _sign(it, first, slices, size, share, locally_hot), first)
    gathered = scratch.keep(signed.groupBy("slice").applyInArrow(lambda t: _gather(t, result, cold), result), "gathered")

    rows = gathered.filter("kind = 0").select("id", "n", "set")
    one = F.min_by(F.struct("key", "copy", *(f.name for f in _SET)), F.struct("key", "copy")).alias("x")
    sets = scratch.keep(gathered.filter("kind = 0 AND set IS NOT NULL").groupBy("set").agg(one, F.min("id").alias("smallest"), F.count(F.lit(1)).alias("copies")).select("set", "smallest", "copies", "x.*"), "sets")
    buckets = gathered.filter("kind = 1").select("members").distinct()
    edges = _close(scratch, buckets, _hot_sets(gathered.filter("kind = 2"), sets), sets, share, chunk)
    named = sets.select("set", "smallest", "copies")
    if edges is None:
        named = named.select("set", F.col("smallest").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
    else:
        mine = components(scratch, edges).join(sets.select("set", "key", "copy", "n", "copies"), "set")
        named = named.join(_exact(scratch, mine, docs, size, share, block), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
        named = scratch.keep(named, "named")
        least = named.groupBy("comp").agg(F.min("smallest").alias("component_id"))
        named = named.join(least, "comp").select("set", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = scratch.keep(named, "components")
    answer = F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.join(named, "set", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("set").alias("set_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), answer.alias("component_id"))
