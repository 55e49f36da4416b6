"""Secret scan: fixed patterns, and the Shannon entropy of a window that slides over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # greedy runs: the same as all runs less the short ones

#: Character classes of candidate strings: name, pattern, window, least bits per character.
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]{24,}"), 24, 3.0), ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.9))
#: Candidates that match one of these whole are no secrets: words, numbers, separators, repeated samples, UUIDs, placeholders.
ALLOW = tuple(re.compile(p) for p in (
    r"[A-Za-z_=+/-]+", r"[0-9_=+/-]+", r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"(?i).*(example|placeholder|dummy|changeme|xxxx).*", r"[a-z]+([_/-][a-z]+)*[_/-]?[0-9]{1,4}",
))


def high_entropy(text: str, window: int, least: float) -> tuple[int, int] | None:
    """First start and last end of the windows whose entropy is `least` bits or more; counts are kept up step by step."""
    if len(text) < window:
        return None
    plogp = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total, first, last = 0.0, -1, -1
    most = window * (math.log2(window) - least)  # entropy >= least where the sum of c log c is at most this
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += plogp[c + 1] - plogp[c]
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += plogp[c - 1] - plogp[c]
        if i >= window - 1 and total <= most + 1e-9:
            first = i - window + 1 if first < 0 else first
            last = i + 1
    return None if first < 0 else (first, last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def scan(text: str | None, classes=CLASSES, allow=ALLOW) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind, end) in code points: those of the fixed patterns, and all with those of the entropy method."""
    text = text or ""
    base = base_spans(text)
    extra = set()
    for _, pattern, window, least in classes:
        for m in pattern.finditer(text):
            s = m.group()
            if any(p.fullmatch(s) for p in allow):
                continue
            if hit := high_entropy(s, window, least):
                extra.add((m.start() + hit[0], KINDS.index("entropy"), m.start() + hit[1]))
    return base, sorted(base + sorted(extra))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    if not text:
        return text
    out, at, end = [], 0, -1
    for a, _, b in scan(text)[1]:
        if a >= max(end, 0) and a >= at:
            out += [text[at:a], mark]
            at = end = b
        elif b > end:
            at = end = b
    return "".join(out) + text[at:] if out else text


_SCHEMA = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Whole texts, offsets in code points, ends exclusive. Null and empty texts have no spans (base_sha256 is that of the
    empty string). Rows may repeat, ids may be null; other columns are not read. No shuffle.
    """

    def run(batches):
        for b in batches:
            rows = []
            for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, spans = scan(text.as_py())
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((ident, *n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with secrets replaced in the text; all rows and columns stay."""

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index(text_col)
            yield b.set_column(k, b.schema.field(k), pa.array([redact(t.as_py()) for t in b.column(k)], b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op3(spark, sf_dir):
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
