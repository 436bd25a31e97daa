"""Secret scans with multipart credential linking.

Strong findings (assignments, access keys, long hex runs) are reported as they stand. Weak candidates (an account or
client identifier, a random-looking string, an endpoint) mean little alone: they are reported only when an
interval join inside one scope (a window of code points) finds their complementary parts, that is an identifier or an
endpoint near a secret, or an identifier near an endpoint and a secret candidate.

Spans are code points, end exclusive. A null text counts as empty; an empty table gives an empty one. Repeated rows give repeated results; a null id is
carried through. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, string_batch

KINDS = ("assign", "access", "hex", "identifier", "candidate", "endpoint")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name)?|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s\"'<>]+|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9.-]+)", re.IGNORECASE | re.ASCII)
#: The linear-time prefilters: a text without a match has none of the above.
_ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
_WEAK_HINT = r"(?i:access_?key|client_?id|account|user|login|://|host|endpoint|server)"


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong findings."""
    found = []
    if assign:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if access:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    found.sort()
    return found


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """Weak candidates whose complementary parts stand within `scope` code points of them."""
    identifiers = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    endpoints = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if not identifiers and not endpoints and not any(k == 1 for _, k, _ in base):
        return []
    strong = [(s, e) for s, k, e in base if k != 1]
    access = [(s, e) for s, k, e in base if k == 1]
    starts, reach = [], []  # of the base spans, with the furthest end so far: does a span overlap one of them?
    for s, _, e in base:
        starts.append(s)
        reach.append(max(e, reach[-1]) if reach else e)

    def covered(s: int, e: int) -> bool:
        i = bisect.bisect_left(starts, e) - 1
        return i >= 0 and reach[i] > s

    weak = []
    for m in CANDIDATE.finditer(text):
        t = m.group()
        if re.search(r"[0-9]", t) and re.search(r"[A-Za-z]", t) and not covered(m.start(), m.end()) and entropy(t) >= 3.5:
            weak.append((m.start(), m.end()))

    def near(spans: list[tuple[int, int]]):
        """A test for a member of spans within the scope; spans are sorted by start and may lie inside one another."""
        begin, furthest = [s for s, _ in spans], list(itertools.accumulate((e for _, e in spans), max))
        return lambda s, e: (i := bisect.bisect_right(begin, e + scope)) > 0 and furthest[i - 1] >= s - scope

    by_id, by_end, by_weak, by_strong = near(sorted(identifiers + access)), near(endpoints), near(weak), near(sorted(strong))
    out = [(s, 4, e) for s, e in weak if by_id(s, e) or by_end(s, e)]
    out += [(s, 3, e) for s, e in identifiers if by_strong(s, e) or by_weak(s, e)]
    out += [(s, 5, e) for s, e in endpoints if by_strong(s, e) or (by_weak(s, e) and by_id(s, e))]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_linked", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_NOTHING = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, scope: int = 300) -> DataFrame:
    """Findings of each row of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                text = pc.fill_null(part.column("text"), "")
                hints = [np.asarray(pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False), bool) for p in (_ASSIGN_HINT, r"[0-9a-f]{24}", _WEAK_HINT)]
                hints.insert(1, np.asarray(pc.match_substring(text, "AKIA").to_numpy(zero_copy_only=False), bool))
                n = part.num_rows
                counts = np.zeros((4, n), np.int64)
                digest, spans = [_NOTHING] * n, [""] * n
                for i in np.flatnonzero(hints[0] | hints[1] | hints[2] | hints[3]):
                    t = text[i].as_py()
                    base = base_spans(t, hints[0][i], hints[1][i], hints[2][i])
                    weak = linked_spans(t, base, scope) if hints[3][i] or hints[1][i] else []
                    for _, k, _ in base:
                        counts[k, i] += 1
                    counts[3, i] = len(weak)
                    if base:
                        digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    if base or weak:
                        spans[i] = joined(sorted(base + weak))
                yield string_batch(SCHEMA, doc_id=part.column("doc_id"), n_assign=counts[0], n_access=counts[1], n_hex=counts[2], n_linked=counts[3], base_sha256=digest, spans=spans)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string")
