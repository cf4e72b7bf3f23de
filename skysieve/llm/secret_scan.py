"""Secret scans: pattern kinds, and novelty under a dictionary-primed compressor.

Three kinds are patterns: an assignment to a secret-like name, an access key
id, and a long run of hex digits. The fourth, ``novel``, is measured: each
candidate string in a sensitive context is compressed by zstandard behind its
surrounding text with a dictionary of common code identifiers; what the
candidate adds to the compressed size, per character, is its novelty. Words,
identifiers and repeats add little; keys add most of their length. Candidates
that add at least ``min_bytes`` and ``min_ratio`` are reported where no
pattern span covers them already.

Plan: a map over id and text; no shuffle, nothing collected or broadcast.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_rows

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_IS_HEX = bytes(0x31 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Names that make the text after them a sensitive context.
CONTEXT_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "credential", "bearer", "private", "signature", "access_key", "client_id")
_CONTEXT = re.compile("|".join(CONTEXT_NAMES), re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: From a sensitive name to its value, and a name with it: the rest of the identifier, a quote, blanks, a separator.
_BEHIND = re.compile(r"""[A-Za-z0-9+/_.-]*["']?[ \t]*[:=]{1,2}[ \t]*["']?""")
_NAMED = re.compile(f"(?:{_CONTEXT.pattern})[A-Za-z0-9+/_.-]{{0,48}}={{1,2}}", re.IGNORECASE | re.ASCII)

#: Identifiers that code is full of; they prime the compressor.
IDENTIFIERS = (
    "import return function class const public private static void string boolean integer float double object self this null None true false "
    "request response session config settings environment variable default value default_value client_id client_secret access_token refresh_token "
    "authorization authentication Authorization Bearer Content-Type application/json username password passwd secret token api_key apiKey API_KEY "
    "https://www.example.com http://localhost:8080 database connection_string host port user admin root exception handler listener callback "
    "getElementById addEventListener setAttribute createElement toString valueOf hasOwnProperty __init__ __main__ __name__ "
    "index length append insert update delete select from where order_by group_by abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
)


@lru_cache(maxsize=1)
def _compressor(level: int = 3) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bytes(before: str, candidate: str, after: str) -> int:
    """Compressed bytes that ``candidate`` adds to the text around it."""
    pack = _compressor().compress
    around = (before + "\n" + after).encode()
    return len(pack(around + b"\n" + candidate.encode())) - len(pack(around))


def pattern_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three pattern kinds, unsorted."""
    raw = text.encode() if raw is None else raw
    low, out = raw.translate(_LOWER), []
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"1" * 16 in raw.translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return out


def novel_spans(text: str, taken: list[tuple[int, int, int]], *, reach: int = 48, around: int = 256, min_bytes: int = 10, min_ratio: float = 0.6) -> list[tuple[int, int, int]]:
    """Incompressible strings at most ``reach`` characters behind a sensitive name, its unquoted ``name=value`` included.

    A run that is not novel itself is measured by parts where further sensitive
    names are assigned to in it.
    """
    out: list[tuple[int, int, int]] = []
    done = 0
    taken = sorted(taken)
    starts = [s for s, _, _ in taken]
    reached = list(accumulate((e for _, _, e in taken), max))  # the last end of the spans so far

    def novel(a: int, b: int) -> bool:
        before = bisect_left(starts, b)
        if b - a < 16 or before and reached[before - 1] > a:
            return False
        added = marginal_bytes(text[max(0, a - around) : a], text[a:b], text[b : b + around])
        return added >= min_bytes and added >= min_ratio * (b - a)

    def measure(a: int, b: int) -> None:
        if novel(a, b):
            out.append((a, 3, b))
        elif "=" in text[a:b] and (named := [m.span() for m in _NAMED.finditer(text, a, b)]):
            cuts = sorted({a, b, *(x for span in named for x in span)})
            out.extend((x, 3, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if novel(x, y))

    for name in _CONTEXT.finditer(text):
        end = name.end()
        behind = _BEHIND.match(text, end, end + reach)
        if behind and behind.end() >= done and (m := _RUN.match(text, behind.end())):
            done = m.end()
            measure(*m.span())
        for m in _CANDIDATE.finditer(text, max(done, end - 1)):
            a, b = m.span()
            if a > end + reach:
                break
            done = b
            if a >= end:
                measure(a, b)
    return out


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """All spans by start, then kind."""
    if not text:
        return []
    raw = text.encode()
    low = raw.translate(_LOWER)
    base = pattern_spans(text, raw)
    return sorted(base + novel_spans(text, base)) if any(n.encode() in low for n in CONTEXT_NAMES) else sorted(base)


def scan_secrets(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", redact: str | None = None) -> DataFrame:
    """One row per document row: id, spans (kind, start, end), and the redacted text if asked for.

    Spans are in code points, end exclusive, by start, then kind as in
    ``KINDS``. Null and empty texts have no spans; null stays null when
    redacting. Overlapping spans are redacted as one. Repeated rows are each
    scanned; other columns are ignored.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [field(documents, id_col, "id"), T.StructField("spans", T.ArrayType(span))]
    if redact is not None:
        fields.append(T.StructField("redacted", T.StringType()))

    def scan(batch: pa.RecordBatch) -> dict:
        spans, texts = [], []
        for text in batch.column(1):
            text = text.as_py()
            found = spans_of(text)
            spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
            if redact is not None:
                texts.append(_redacted(text, found, redact))
        return {"id": batch.column(0), "spans": spans, "redacted": texts}

    out = map_rows(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), T.StructType(fields), scan)
    return out.withColumnRenamed("id", id_col)


def _redacted(text: str | None, found: list[tuple[int, int, int]], mark: str) -> str | None:
    if not found:
        return text
    out, at, open_to = [], 0, -1
    for a, _, b in found:
        if a >= open_to:
            out += [text[at:a], mark]
        open_to = at = max(open_to, b)
    return "".join([*out, text[at:]])
