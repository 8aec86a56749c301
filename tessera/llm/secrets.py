"""Secret scans: fixed patterns, and windows of high Shannon entropy beside them.

Candidates are runs of 20 or more characters that keys are written in. Each has a character class
(hexadecimal, alphanumeric, or with base64's signs); a window of ``WINDOW`` characters slides
over it and its entropy follows from counts that change by one character in and one out. Windows
that reach the class's threshold, with letters and digits in them, form spans of kind ``entropy``.
An allow-list suppresses UUIDs, plain numbers, and paths or names made of words; a piece between separators
that holds a placeholder or a run in order is cut out, and what stands beside it is judged alone. Spans that touch a pattern's span add nothing and are left out.

Edge cases: null and empty texts have no spans; texts are scanned whole; null ids and repeated
rows are rows like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import ship, table

WINDOW = 20
#: Bits a character that a window must reach.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORD = re.compile(r"(?:passw|secret|token|api_?key)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Greedy runs, so asking for 32 at once finds the same as finding all runs and dropping short ones.
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[-_]|x{6}|0123456789|abcdefgh|([A-Z0-9])\1{5}", re.IGNORECASE | re.ASCII)
_SEPARATORS = "-_/=+"
_PIECE_END, _NAME_END = re.compile(r"[-_/=+]"), re.compile(r"[/=+]")
_PIECES, _WORD = re.compile(r"[-_/=+]+"), re.compile(r"[A-Za-z]+[0-9]{0,2}|[0-9]{1,4}")
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end) of the fixed patterns; each kind is scanned on its own."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def char_class(s: str) -> str:
    if all(c in "0123456789abcdefABCDEF" for c in s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def window_entropies(s: str, window: int = WINDOW) -> Iterator[float]:
    """Shannon entropy in bits of every window of ``s``, each from the last by two changed counts."""
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _C_LOG_C[n + 1] - _C_LOG_C[n]
        counts[c] = n + 1
        if i >= window - 1:
            yield math.log2(window) - total / window
            n = counts[old := s[i - window + 1]]
            total -= _C_LOG_C[n] - _C_LOG_C[n - 1]
            counts[old] = n - 1


def stretches(s: str) -> Iterator[tuple[int, str]]:
    """(start, part): ``s`` without the pieces between separators that hold a placeholder."""
    at = 0
    while m := _PLACEHOLDER.search(s, at):
        begin = max(at, *(s.rfind(c, at, m.start()) + 1 for c in _SEPARATORS))
        end = (_NAME_END if m.group()[-1] in "-_" else _PIECE_END).search(s, m.end())
        yield at, s[at:begin].rstrip(_SEPARATORS)
        if not end:
            return
        at = end.end()
        while at < len(s) and s[at] in _SEPARATORS:
            at += 1
    yield at, s[at:]


def is_allowed(s: str) -> bool:
    """Whether a stretch is letters, digits, a UUID, or a path or name all of whose pieces are words or short numbers.

    Pieces are cut first and each is matched alone, so the time is linear in the stretch.
    """
    return s.isalpha() or s.isdigit() or bool(_UUID.fullmatch(s)) or all(_WORD.fullmatch(p) for p in _PIECES.split(s) if p)


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out = []
    for first, s in ((m.start() + at, part) for m in _CANDIDATE.finditer(text) for at, part in stretches(m.group())):
        if len(s) < WINDOW or is_allowed(s):
            continue
        least = THRESHOLDS[char_class(s)]
        for i, bits in enumerate(window_entropies(s)):
            if bits >= least:
                w = s[i : i + WINDOW]
                if any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
                    a, b = first + i, first + i + WINDOW
                    if out and out[-1][1] >= a:
                        out[-1] = (out[-1][0], b)
                    else:
                        out.append((a, b))
    return out


def find_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, kind index, end) of the fixed patterns, and of all spans, each in order."""
    text = text or ""
    base = sorted(base_spans(text))
    more = [(a, 3, b) for a, b in entropy_spans(text) if all(b <= x or a >= y for x, _, y in base)]
    return base, sorted(base + more)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (string) and spans (array of kind, start, end) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.secrets import KINDS, _listed, find_spans

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            base, spans = [], []
            for t in b.column(1):
                x, y = find_spans(t.as_py())
                base.append(_listed(x))
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in y])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.string()), pa.array(spans, kind)], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base string, spans array<struct<kind: string, start: int, end: int>>")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the digest of the patterns' spans, and all spans of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2("base", 256).alias("base_sha256"), listed.alias("spans"), n("entropy"))
