"""URL filters: a blocked Bloom filter, then an exact hash join.

A list entry is a canonical URL prefix: a host (with all its subdomains) and
the start of a path, with an action. A page's URL yields one probe per host
suffix and listed path length. The probes run against a blocked Bloom filter
(one 256-bit block per key, eight bits in it); what passes goes to an exact
hash join with the list, which removes false positives.

Plan: pages are mapped once, with only id and URL read. Verdicts depend on
host and path alone, so distinct (host, path, probe) rows that passed the
filter are joined to the list, then joined back; pages of which nothing passed,
null URLs among them, take no part in either join. The filter never grows beyond
``MAX_FILTER_BYTES``: a longer list fills it more densely, so that more false
positives pass on to the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_rows

MAX_FILTER_BYTES, BITS_A_KEY, SMALL_LIST = 64 << 20, 16, 10_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Odd multipliers that pick a bit in each of a block's eight words.
_SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)

RULES = T.StructType([T.StructField("action", T.StringType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType())])


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-cased host after the first ``://``, and the path before ``?`` or ``#``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    stop = min((k for k in (rest.find(c, end) for c in "?#") if k >= 0), default=len(rest))
    return rest[:end].encode().translate(_LOWER).decode(), rest[end:stop]


def _suffixes(host: str) -> list[str]:
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return [x for x in out if x]


def _key(host: str, path: str) -> str:
    return f"{host}\n{path}"


def _places(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and 8 x 32-bit mask of each key."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    with np.errstate(over="ignore"):
        bits = (h.astype(np.uint32)[:, None] * _SALT) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << bits


def build_filter(keys: DataFrame, n: int) -> np.ndarray:
    """The filter of the ``key`` column: words are or-ed per block by Spark, then gathered (at most the size limit)."""
    blocks = min(max(1, -(-n * BITS_A_KEY // 256)), MAX_FILTER_BYTES // 32)
    schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(f"w{k}", T.LongType()) for k in range(8))])

    def spread(batch: pa.RecordBatch) -> dict:
        block, mask = _places(batch.column(0).to_pylist(), blocks)
        return {"block": block, **{f"w{k}": mask[:, k].astype(np.int64) for k in range(8)}}

    rows = map_rows(keys, schema, spread).groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8))).collect()
    out = np.zeros((blocks, 8), np.uint32)
    for r in rows:
        out[r[0]] = r[1:]
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row per page row: id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's path; the longest host plus path wins, then the longer host, then
    ``block``. A page that no rule fits gets a null rule and ``otherwise``. A
    null URL, or one without ``://``, has an empty host and path and fits no
    rule. Rules with a null or empty host fit nothing; repeated rules count
    once; an empty list fits nothing. Repeated pages are each judged.
    """
    spark: SparkSession = pages.sparkSession
    listed = rules.filter("host IS NOT NULL AND host <> ''").select(
        F.concat_ws("\n", "host", F.coalesce("path", F.lit(""))).alias("key"), F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"),
        F.length("host").alias("of_host"), F.length(F.coalesce("path", F.lit(""))).alias("of_path"), "action",
    ).groupBy("key", "rule", "of_host", "of_path").agg(F.max("action").alias("action"))
    n = listed.count()
    lengths = sorted(r[0] for r in listed.select("of_path").distinct().collect())  # as many as there are path lengths
    words = build_filter(listed.select("key"), n)
    shared = spark.sparkContext.broadcast((words, lengths))
    schema = T.StructType([field(pages, id_col, "id"), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("probes", T.ArrayType(T.StringType()))])

    def probe(batch: pa.RecordBatch) -> dict:
        words, lengths = shared.value
        parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
        keys, owners = [], []
        for row, (host, path) in enumerate(parts):
            for s in _suffixes(host):
                for size in lengths:
                    if size > len(path):
                        break
                    keys.append(_key(s, path[:size]))
                    owners.append(row)
        probes: list[list[str]] = [[] for _ in parts]
        block, mask = _places(keys, len(words))
        for at in np.flatnonzero(((words[block] & mask) == mask).all(axis=1)):
            probes[owners[at]].append(keys[at])
        return {"id": batch.column(0), "host": [h for h, _ in parts], "path": [p for _, p in parts], "probes": probes}

    judged = map_rows(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), schema, probe)
    possible = judged.select("host", "path", F.explode("probes").alias("key")).distinct()
    listed = F.broadcast(listed) if n <= SMALL_LIST else listed
    best = F.max_by(F.struct("rule", "action"), F.struct(F.col("of_host") + F.col("of_path"), "of_host", "action"))
    exact = possible.join(listed, "key").groupBy("host", "path").agg(best.alias("best"))
    hit = judged.filter(F.size("probes") > 0).join(exact, ["host", "path"], "left").select("id", "host", "path", "best")
    missed = judged.filter(F.size("probes") == 0).select("id", "host", "path", F.lit(None).cast(exact.schema["best"].dataType).alias("best"))
    return hit.unionByName(missed).select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(otherwise)).alias("verdict"))
