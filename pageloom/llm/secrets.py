"""Secret scan: fixed patterns, and runs of high Shannon entropy in candidate strings.

Patterns (assign, access, hex) give the base spans. Beside them, candidate strings are cut into runs of each character
class; a window slides over a run, its character counts change by one in and one out, and its entropy follows from
those counts; windows that reach the class's threshold are merged into one span. Candidates that an allow-list pattern covers are
left alone, and so are runs that lack the mixture of characters their class asks for. Words of placeholders cut a
candidate: what stands beside them is scanned, each part for itself.

Null and empty texts have no spans. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .common import drop_held, small_batches

# The three patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: kind, run of the class, what a run must hold, bits a character that a window must reach.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-f]{%d,}" % WINDOW), (re.compile("[0-9]"), re.compile("[a-f]")), 2.9),
    ("entropy_upper", re.compile(r"[0-9A-Z]{%d,}" % WINDOW), (re.compile("[0-9]"), re.compile("[A-Z]")), 3.4),
    ("entropy_mixed", re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW), (re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")), 3.8),
    ("entropy_lower", re.compile(r"[0-9a-z]{%d,}" % WINDOW), (re.compile("[0-9]"), re.compile("[g-z]")), 3.6),
)
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # a UUID
    re.compile(r"(.{1,8}?)\1{2,}.{0,8}"),  # repeats
)
#: Words that mark a placeholder; no window reaches into one.
WORDS = re.compile(r"(?i)example|sample|placeholder|changeme|xxxx|abcdef|012345|123456")
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))
_RANK = {k: i for i, k in enumerate(KINDS)}
_TERM = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def high_entropy(run: str, least: float) -> Iterator[tuple[int, int]]:
    """Merged windows of run whose entropy reaches least: H = log2(W) - sum(n log2 n) / W over the window's counts."""
    counts = Counter(run[:WINDOW])
    total = sum(_TERM[n] for n in counts.values())
    limit = (math.log2(WINDOW) - least) * WINDOW + 1e-9
    start = end = -1
    for at in range(len(run) - WINDOW + 1):
        if at:
            gone, new = run[at - 1], run[at + WINDOW - 1]
            if gone != new:
                n = counts[gone]
                total += _TERM[n - 1] - _TERM[n]
                counts[gone] = n - 1
                n = counts[new]
                total += _TERM[n + 1] - _TERM[n]
                counts[new] = n + 1
        if total <= limit:
            if start < 0:
                start = at
            elif at > end:
                yield start, end
                start = at
            end = at + WINDOW
    if start >= 0:
        yield start, end


def entropy_spans(text: str, allow: tuple[re.Pattern, ...] = ALLOW) -> list[Span]:
    found: list[Span] = []
    for m in CANDIDATE.finditer(text):
        candidate = m.group()
        if candidate.isalpha() or any(a.fullmatch(candidate) for a in allow):
            continue
        cuts = [0, *(at for word in WORDS.finditer(candidate) for at in word.span()), len(candidate)]
        for start, end in zip(cuts[::2], cuts[1::2], strict=True):
            if end - start < WINDOW:
                continue
            for kind, runs, needs, least in CLASSES:
                for run in runs.finditer(candidate, start, end):
                    if all(n.search(run.group()) for n in needs):
                        at = m.start() + run.start()
                        found += [(kind, at + s, at + e) for s, e in high_entropy(run.group(), least)]
    return found


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """text with every stretch of overlapping spans replaced by mark."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: s[1])
    while i < len(spans):
        start, end = spans[i][1], spans[i][2]
        i += 1
        while i < len(spans) and spans[i][1] <= end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = entropy_spans(text)
                kinds = Counter(k for k, _, _ in base)
                for c, v in zip(cols, (kinds["assign"], kinds["access"], kinds["hex"], len(more), hashlib.sha256(_joined(_ordered(base)).encode()).hexdigest(), _joined(_ordered(base + more))), strict=True):
                    c.append(v)
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds_of, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets of text replaced and, where there is an n_chars of a number or string type, counted anew;
    clean rows, and n_chars of another type, stay as they are."""
    at = docs.columns.index("text")
    has_n = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, (NumericType, StringType))

    def run(batches):
        drop_held()
        for batch in batches:
            texts, sizes, changed = [], [], False
            for value in batch.column(at):
                text = value.as_py()
                spans = base_spans(text) + entropy_spans(text) if text else []
                if spans:
                    text, changed = redacted(text, spans), True
                texts.append(text)
                sizes.append(len(text) if spans else None)
            if changed:
                batch = batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))
                if has_n:
                    n = batch.schema.get_field_index("n_chars")
                    counted = pa.array(sizes, pa.int64()).cast(batch.schema.field(n).type)
                    batch = batch.set_column(n, batch.schema.field(n), pa.compute.coalesce(counted, batch.column(n)))
            yield batch

    import pyarrow.compute  # noqa: F401

    return small_batches(docs).mapInArrow(run, docs.schema)
