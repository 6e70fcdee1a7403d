"""Secret scanning with multipart credential linking.

Base patterns give the certain spans: assignments, access identifiers and long hexadecimal strings. Weak parts
(account identifiers, endpoints, random-looking words) are common in clean text, so each is reported only when
complementary parts stand within ``REACH`` code points of it and inside the same scope (a block between blank
lines). The link is an interval join: the parts of a document sorted by start, with the greatest end so far, joined by
binary search, so a document with many parts costs n log n and no pair list is built. A document is scanned in one Arrow-batched
pass, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linkquarry.llm.common import append_columns

REACH = 240
KINDS = ("assign", "access", "hex", "account", "endpoint", "weak")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ACCOUNT = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""", re.I | re.A)
_ENDPOINT = re.compile(r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+(?:com|net|org|io|dev|internal)(?::\d{2,5})(?![0-9])", re.I | re.A)
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    found: list[Span] = []
    if any(w in low for w in _WORDS):
        # A match whose value is too short still takes its place: the next match starts behind it.
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def _random_looking(word: str) -> bool:
    kinds = bool(re.search("[a-z]", word)) + bool(re.search("[A-Z]", word)) + bool(re.search("[0-9]", word))
    if kinds < 3:
        return False
    count = np.unique(np.frombuffer(word.encode(), np.uint8), return_counts=True)[1] / len(word)
    return float(-(count * np.log2(count)).sum()) >= 3.5


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts that have their complements near: a random-looking word needs an identifier, an account or an
    endpoint needs a secret part (assignment, hexadecimal string or random-looking word) and an endpoint an
    identifier beside it."""
    covered: list[list[int]] = []  # base spans without overlaps
    for _, s, e in base:
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(e, covered[-1][1])
        else:
            covered.append([s, e])
    starts = [s for s, _ in covered]

    def free(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return k == 0 or covered[k - 1][1] <= s

    weak = {"account": [(m.start(), m.end()) for m in _ACCOUNT.finditer(text)] if ("=" in text or ":" in text) else [], "endpoint": [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)] if ":" in text else []}
    if not base and not weak["account"]:
        return []  # every link has an identifier, and an access identifier is a base span
    weak["weak"] = [(m.start(), m.end()) for m in _WEAK.finditer(text) if _random_looking(m[0])]
    weak = {k: [x for x in v if free(*x)] for k, v in weak.items()}
    if not any(weak.values()):
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    by = {k: [(s, e) for kind, s, e in base if kind == k] for k in ("assign", "access", "hex")} | weak
    role = {"secret": sorted({*by["assign"], *by["hex"], *by["weak"]}), "ident": sorted({*by["access"], *by["account"]})}
    first = {r: [s for s, _ in v] for r, v in role.items()}
    last = {r: list(accumulate((e for _, e in v), max)) for r, v in role.items()}

    def near(span: tuple[int, int], r: str) -> bool:
        s, e = span
        block = bisect_right(cuts, s)
        high = min(e + reach, cuts[block] if block < len(cuts) else len(text))
        i, m, j = bisect_left(first[r], cuts[block - 1] if block else 0), bisect_left(first[r], s), bisect_right(first[r], high)
        # No part crosses a blank line, so parts of earlier blocks end before any of this one.
        return (i < m and last[r][m - 1] >= s - reach) or any(role[r][k] != span for k in range(m, min(j, m + 2)))

    found = [("weak", *x) for x in weak["weak"] if near(x, "ident")]
    found += [("account", *x) for x in weak["account"] if near(x, "secret")]
    found += [("endpoint", *x) for x in weak["endpoint"] if near(x, "secret") and near(x, "ident")]
    return found


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and linked spans together, each by start and then by kind."""
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base), key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by a mark with its first kind."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = T.StructType(
    [T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_linked", T.LongType())]
)


def scan(docs: DataFrame, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """docs with counts and spans (offsets in code points, ends exclusive); ``with_text`` also replaces the text by its redacted form.

    A null or empty text has no span, the digest of the empty string and the empty list; redaction keeps null as null.
    """
    schema = T.StructType([*SCHEMA, T.StructField(text_col, T.StringType())]) if with_text else SCHEMA

    def compute(texts: pa.Array) -> list:
        out: list[list] = [[] for _ in schema]
        for text in texts.to_pylist():
            base, spans = find_secrets(text or "")
            row = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]] + [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)]
            for column, value in zip(out, [*row, text and redact(text, spans)], strict=False):
                column.append(value)
        return out

    return append_columns(docs, text_col, schema, lambda: compute)
