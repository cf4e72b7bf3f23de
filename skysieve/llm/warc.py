"""WARC: writing records, and reading archives back by boundary-chain verification.

Writing: one record per page. Of records with equal payloads of at least
``least`` bytes the one with the smallest id is a ``response``; the others are
``revisit`` records that refer to it. Spark's text sink writes the files, with
the blank lines that end a record as its separator, so any store that Spark
writes to will do.

Reading: Spark's text source splits files at the record magic, so files of any
size are read in parallel blocks; a piece between two magics is a candidate.
A magic inside a payload also makes a candidate. Tasks number the bytes of
their block and emit each candidate's offset and its successor's (its own
header and content length), and where a chain from it leaves the block. Block
offsets are sums of block lengths; pointer jumping over the blocks' exits from
each file's start finds the candidate at which the true chain enters each
block, and walking from there keeps the reachable ones. A record that inner
magics cut into pieces is put together again from its pieces.

Plan: pages are shuffled only as (digest, length, id); the html stays in the
map, as the pages with duplicates come back by broadcast when there are at most
``FEW_COPIES`` of them and by a shuffle join beyond. Pointer jumping takes
log2(blocks of a file) rounds over block exits, not over records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, field

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
LEAST_BYTES, FEW_COPIES = 100, 100_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ID = re.compile(rb"<urn:page:(.*)>$")


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST_BYTES) -> None:
    """Writes the archive folder ``path``, a file per task.

    A null html is an empty payload. Null ids sort last and are written as an
    empty id; repeated rows that share the smallest id are each a response. A
    null url has no target line; control characters and spaces in a url are
    written as ``%20``. An empty table writes an empty folder.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("html"))
    picked = picked.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    copies = picked.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = Scratch(pages.sparkSession, "copies").keep(copies.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "copies")
    small = copies.limit(FEW_COPIES + 1).count() <= FEW_COPIES
    rows = picked.join(F.broadcast(copies) if small else copies, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(again, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn("id")), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", urn("first")), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


_CANDIDATE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("next", T.LongType()), T.StructField("leaves", T.LongType()), T.StructField("total", T.LongType()), T.StructField("whole", T.BooleanType()),
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])
#: One row of each block says how long it is; it is no candidate.
_SUMMARY = -1
#: Pieces and the records they belong to meet by file and 2^16 bytes of offset.
_REACH = 16


def _parse(piece: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Header fields by lower-case name, header bytes and content bytes; None if this is no header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for row in piece[:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    size = fields.get(b"content-length", b"")
    return (fields, end + 4, int(size)) if size.isdigit() and b"warc-type" in fields else None


def _described(piece: bytes, keep: bool) -> dict | None:
    """What a record's bytes behind the magic say; a payload that is cut short has no digest of its own."""
    parsed = _parse(piece)
    if parsed is None:
        return None
    fields, head, size = parsed
    text = lambda k: fields[k].decode(errors="replace") if k in fields else None
    urn = lambda k: m[1].decode() if (m := _ID.match(fields.get(k, b""))) else None
    out = {"id": urn(b"warc-record-id") or None, "type": text(b"warc-type"), "uri": text(b"warc-target-uri"), "refers_to": urn(b"warc-refers-to") or None}
    out |= {"length": head + size, "whole": len(piece) >= head + size, "payload_bytes": None, "payload_digest": None, "payload": None}
    content = piece[head : head + size]
    if out["type"] == "revisit":
        length = fields.get(b"warc-payload-length", b"")
        out |= {"payload_bytes": int(length) if length.isdigit() else None, "payload_digest": (text(b"warc-payload-digest") or "").removeprefix("sha256:") or None}
    elif out["whole"]:
        cut = content.find(b"\r\n\r\n") + 4 if b"http" in fields.get(b"content-type", b"") else 0
        payload = content[max(0, cut) :] if cut != 3 else content
        out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload if keep else None}
    return out


def _candidates(keep: bool):
    gap, blank = len(MAGIC), {n: None for n in _CANDIDATE.fieldNames()}

    def closed(file: str, block: int, rows: list[dict], total: int) -> Iterator[dict]:
        leaves: dict[int, int] = {}
        for r in reversed(rows):
            n = r["next"]
            r["leaves"] = leaves[r["at"]] = -1 if n < 0 else n if n >= total else leaves.get(n, -1)
        yield from rows
        yield blank | {"file": file, "block": block, "at": _SUMMARY, "total": total}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(_CANDIDATE)
        pack = lambda rows: pa.RecordBatch.from_pylist(rows, schema=arrow)
        where, rows, total = None, [], 0
        for batch in batches:
            for piece, file, block in zip(*(batch.column(k) for k in range(3)), strict=True):
                piece, here = piece.as_py(), (file.as_py(), block.as_py())
                if here != where:
                    if where:
                        yield pack(list(closed(*where, rows, total)))
                    where, rows, total = here, [], 0
                    if here[1] == 0:  # what stands before the first magic of a file
                        total = len(piece)
                        continue
                told = _described(piece, keep)
                at, total = total, total + gap + len(piece)
                row = blank | {"file": here[0], "block": here[1], "at": at, "size": gap + len(piece), "next": -1, "whole": False}
                if told:
                    row |= {k: v for k, v in told.items() if k in row} | {"next": at + gap + told["length"] + len(END)}
                rows.append(row)
        if where:
            yield pack(list(closed(*where, rows, total)))

    return run


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_warc(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """Records (id, type, uri, refers_to, payload_bytes, payload_digest, payload) of an archive folder.

    Only records on the chain from a file's start count. Revisit records have
    no payload; their length and digest are those their header names. A file
    whose start is no record, or whose chain breaks, gives what was reached
    before the break. Ids come back as strings, an empty id as null.
    """
    scratch = Scratch(spark, "warc")
    found = scratch.keep(_pieces(spark, path).mapInArrow(_candidates(keep_payload), _CANDIDATE), "candidates")
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.filter(F.col("at") == _SUMMARY).select("file", "block", "total").withColumn("base", F.coalesce(F.sum("total").over(by_file), F.lit(0)))
    blocks = scratch.keep(blocks, "blocks")
    real = found.filter(F.col("at") >= 0)
    based = real.join(blocks.select("file", "block", "base"), ["file", "block"])
    exits = based.filter("leaves >= 0").select("file", (F.col("base") + F.col("at")).alias("x"), (F.col("base") + F.col("leaves")).alias("y"))
    entries = _entries(scratch, exits, blocks)
    reached = _walk(real.select("file", "block", "at", "next"), entries.join(blocks.select("file", "block", "base", "total"), "file").filter("x >= base AND x < base + total").select("file", "block", (F.col("x") - F.col("base")).alias("enter")))
    records = real.join(reached, ["file", "block", "at"])
    columns = ("id", "type", "uri", "refers_to", "payload_bytes", "payload_digest", "payload")
    whole = records.filter("whole").select(*columns)
    cut = scratch.keep(records.filter("NOT whole").join(blocks.select("file", "block", "base"), ["file", "block"]).select("file", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("next")).alias("stop")), "cut")
    return whole if cut.isEmpty() else whole.unionByName(_joined(spark, path, cut, blocks, columns, keep_payload))


def _entries(scratch: Scratch, exits: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, x): the candidates at which the chain from each file's start enters a block.

    Pointer jumping: each round doubles how far the jumps reach.
    """
    targets = exits.select("file", F.col("y").alias("x")).distinct()
    start = blocks.select("file").distinct().withColumn("x", F.lit(0).cast("long"))
    jumps = scratch.keep(exits.join(targets.unionByName(start).distinct(), ["file", "x"], "left_semi"), "jumps")
    reached, n = scratch.keep(start, "reached"), 0
    while True:
        more = reached.join(jumps, ["file", "x"]).select("file", F.col("y").alias("x"))
        grown = scratch.keep(reached.unionByName(more).distinct(), "reached")
        if (m := grown.count()) == n:
            return grown
        further = jumps.join(jumps.select("file", F.col("x").alias("y"), F.col("y").alias("z")), ["file", "y"]).select("file", "x", F.col("z").alias("y"))
        reached, n, jumps = grown, m, scratch.keep(further, "jumps")


def _walk(nodes: DataFrame, enter: DataFrame) -> DataFrame:
    """(file, block, at) of the candidates on the chain from each block's entry; a block is one bounded group."""
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("at", T.LongType())])

    def follow(key, left: pa.Table, right: pa.Table) -> pa.Table:
        step = dict(zip(left["at"].to_pylist(), left["next"].to_pylist(), strict=True))
        out = []
        for at in right["enter"].to_pylist():
            while at in step:
                out.append(at)
                at = step.pop(at)
        return pa.table({"file": [key[0].as_py()] * len(out), "block": [key[1].as_py()] * len(out), "at": out}, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64())]))

    return nodes.groupBy("file", "block").cogroup(enter.groupBy("file", "block")).applyInArrow(follow, schema)


def _joined(spark: SparkSession, path: str, cut: DataFrame, blocks: DataFrame, columns: tuple[str, ...], keep: bool) -> DataFrame:
    """Records that inner magics cut: their pieces are read again and joined in order."""
    piece_schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("piece", T.BinaryType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, total = None, 0
        for batch in batches:
            at = []
            for piece, file, block in zip(*(batch.column(k) for k in range(3)), strict=True):
                here = (file.as_py(), block.as_py())
                first = here != where
                where, total = here, 0 if first else total
                at.append(_SUMMARY if first and here[1] == 0 else total)
                total += len(piece.as_py()) + (0 if first and here[1] == 0 else len(MAGIC))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.int64()), batch.column(0)], names=["file", "block", "at", "piece"])

    pieces = _pieces(spark, path).mapInArrow(numbered, piece_schema).filter(F.col("at") >= 0)
    pieces = pieces.join(blocks.select("file", "block", "base"), ["file", "block"]).withColumn("pos", F.col("base") + F.col("at"))
    near = F.explode(F.sequence(F.shiftright("start", _REACH), F.shiftright(F.col("stop") - 1, _REACH))).alias("near")
    pieces = pieces.withColumn("near", F.shiftright("pos", _REACH))
    mine = pieces.join(cut.select("file", "start", "stop", near), ["file", "near"]).filter("pos >= start AND pos < stop").select("file", "start", "pos", "piece")
    out = T.StructType([x for x in _CANDIDATE if x.name in columns])

    def together(group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        ordered = sorted(zip(group["pos"].to_pylist(), group["piece"].to_pylist(), strict=True))
        told = _described(MAGIC.encode().join(p for _, p in ordered), keep)
        return pa.Table.from_pylist([{c: told[c] for c in out.fieldNames()}], schema=to_arrow_schema(out))

    return mine.groupBy("file", "start").applyInArrow(together, out).select(*columns)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep_payload: bool = False) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads the records back, ids in their own type."""
    spark = pages.sparkSession
    path = Scratch(spark, "archives").path("warc")
    write_warc(pages, path, id_col=id_col, url_col=url_col, html_col=html_col)
    kind = field(pages, id_col).dataType
    return read_warc(spark, path, keep_payload=keep_payload).withColumn("id", F.col("id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
