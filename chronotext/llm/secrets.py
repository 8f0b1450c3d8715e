"""Secret scan: certain spans by pattern, weak ones linked by an interval join within scopes."""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from chronotext.llm.common import small_batches, texts, with_text

# The certain patterns, in the order in which equal starts are listed.
BASE = (
    (
        "assign",
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
        lambda m: len(m[2]) >= 6,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# Parts that are weak alone. An identifier, a secret and an endpoint complement each other.
# Names may have a prefix (DB_USER), but the name of a secret (SECRET_ACCESS_KEY) is no identifier; a secret may follow '='.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|(?<!secret_)access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", re.ASCII | re.IGNORECASE)
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:https?|ftp|postgres(?:ql)?|mysql|redis|amqp)://[^\s\"'<>]{4,}|(?<![A-Za-z0-9])(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9.-]{4,})", re.ASCII | re.IGNORECASE)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
#: Parts belong together within a paragraph, however far apart they stand in it.
SCOPE_CHARS = sys.maxsize
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Certain spans (start, number of kind, end), leftmost without overlap per kind, in order."""
    found = []
    for number, (kind, pattern, keep) in enumerate(BASE):
        # A run of 24 hexadecimal digits is a match of the plain pattern that is long enough.
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if keep(m):
                found.append((m.start(), number, m.end()))
    return sorted(found)


def _scopes(text: str) -> list[int]:
    """Where paragraphs begin."""
    return [0, *(m.end() for m in re.finditer(r"\n\s*\n", text))]


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that a complementary part stands beside, in one paragraph.

    A weak part whose value lies inside certain spans says nothing new and is left out; one that goes
    beyond them, such as a URL with a key in it, stays whole.

    The parts are intervals; for each, the sorted starts of the parts of another role are searched
    for the nearest ones, so the join takes n log n steps however many parts a text has.
    """
    weak = []
    for number, pattern in ((3, IDENTIFIER), (4, WEAK_SECRET), (5, ENDPOINT)):
        if number == 4 and not _may_hold_secret(text):
            continue
        # The value is the group, or all of a match without one.
        weak += [(m.start(), number, m.end(), m.start(m.lastindex or 0)) for m in pattern.finditer(text)]
    if not weak:
        return []
    covered: list[list[int]] = []
    for start, _, end in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    starts = [c[0] for c in covered]

    def known(start, end):
        before = bisect_right(starts, start)
        return before and covered[before - 1][1] >= end

    roles: dict[str, list[tuple[int, int]]] = {"identifier": [], "secret": [], "endpoint": []}
    for start, number, end in base:
        roles["identifier" if number == 1 else "secret"].append((start, end))
    weak = [(start, number, end) for start, number, end, value in weak if not known(value, end)]
    for start, number, end in weak:
        roles[KINDS[number]].append((start, end))
    indexed = {}
    for role, spans in roles.items():
        spans.sort()
        tops, top = [], 0
        for _, end in spans:
            top = max(top, end)
            tops.append(top)
        indexed[role] = ([s for s, _ in spans], tops)
    paragraphs = _scopes(text)
    partners = {3: ("secret",), 4: ("identifier", "endpoint"), 5: ("secret",)}
    out = []
    for start, number, end in weak:
        begin = paragraphs[bisect_right(paragraphs, start) - 1]
        following = bisect_right(paragraphs, start)
        finish = paragraphs[following] if following < len(paragraphs) else len(text)
        low, high = max(begin, start - SCOPE_CHARS), min(finish, end + SCOPE_CHARS)
        for role in partners[number]:
            role_starts, tops = indexed[role]
            i = bisect_left(role_starts, high)
            if i and tops[i - 1] > low:
                out.append((start, number, end))
                break
    return out


def _may_hold_secret(text: str) -> bool:
    """A cheap test before the look-ahead pattern: is there a long run of its characters at all?"""
    return re.search(r"[A-Za-z0-9+/_-]{20}", text, re.ASCII) is not None


def spans_of(text: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base))


def written(spans) -> str:
    return ",".join(f"{KINDS[number]}:{start}:{end}" for start, number, end in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            base, spans = spans_of(text)
            kinds = [number for _, number, _ in base]
            rows.append((doc_id, *(kinds.count(i) for i in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs`` with an id.

    ``spans`` lists ``kind:start:end`` in characters, by start, then kind. Texts are scanned where they
    are read, whole and without a shuffle; nothing is kept from one text to the next. Null and empty
    texts have no spans, repeated rows give one row each, other columns are not read.
    """
    return texts(docs).mapInPandas(_scan, SCHEMA)


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield with_text(batch, [None if text is None else redact(text) for text in batch.column("text").to_pylist()])


def redact(text: str) -> str:
    """The text with every span that was found as ``[SECRET]``; overlapping spans become one."""
    _, spans = spans_of(text)
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    parts, at = [], 0
    for start, end in merged:
        parts += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; all rows and other columns stay as they are."""
    return small_batches(docs).mapInArrow(_redact, docs.schema)
