"""Secret scans with multipart credential linking.

Strong spans stand alone: assigned values, access identifiers, long hex strings. Weak
candidates are parts that mean little alone: short identifiers, user names, short or opaque
values, endpoints. Parts have a role (identifier, secret, endpoint). Within a scope, a run of
lines without a blank one, the parts of each role are joined as intervals, and a weak candidate is
reported only if the parts that would make it a usable credential lie in the same scope: a secret
for an identifier, an identifier or an endpoint for a secret, both of them for an endpoint. With
``reach`` they must also lie within so many code points.

An endpoint ends before the first named part inside it, such as a user name in a query. All
candidates are joined before overlaps are resolved; parts that share text do not complement each
other, and of linked spans that meet the leftmost and longest is reported.

A document is read whole where it lies; nothing is shuffled. The join sorts the parts of a
scope and asks by bisection, so many parts in one scope make no pairs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaleaf.llm.common import whole

# no bound but the scope
REACH = math.inf

# fixed values: the strong kinds in order, their patterns, lengths and roles
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{4,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}

# weak kinds in order; the short forms of the strong ones come from the patterns above
WEAK = ("short_assign", "short_access", "short_hex", "named_id", "opaque", "endpoint")
LEAST_SHORT_ASSIGN = 6
LEAST_SHORT_HEX = 8
NAMED_ID = re.compile(
    r"""(?:access_?key_?id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.I | re.A
)
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(
    r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b""", re.A
)
KINDS = BASE + WEAK
ORDER = {kind: i for i, kind in enumerate(KINDS)}
ROLE = {
    "assign": "secret", "access": "identifier", "hex": "secret", "short_assign": "secret", "short_access": "identifier",
    "short_hex": "secret", "named_id": "identifier", "opaque": "secret", "endpoint": "endpoint",
}
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def strong_and_short(text: str) -> tuple[list[Span], list[Span]]:
    """The strong spans, and the matches of their patterns that are too short to be strong."""
    strong: list[Span] = []
    short: list[Span] = []
    for m in ASSIGN.finditer(text):
        length = m.end(2) - m.start(2)
        if length >= LEAST["assign"]:
            strong.append(("assign", *m.span()))
        elif length >= LEAST_SHORT_ASSIGN:
            short.append(("short_assign", *m.span()))
    for m in ACCESS.finditer(text):
        kind = "access" if m.end() - m.start() >= LEAST["access"] else "short_access"
        (strong if kind == "access" else short).append((kind, *m.span()))
    for m in HEX.finditer(text):
        length = m.end() - m.start()
        if length >= LEAST["hex"]:
            strong.append(("hex", *m.span()))
        elif length >= LEAST_SHORT_HEX and any(c.isdigit() for c in m[0]):
            short.append(("short_hex", *m.span()))
    return strong, short


def _is_opaque(value: str) -> bool:
    return any(map(str.isdigit, value)) and any(map(str.isupper, value)) and any(map(str.islower, value))


class Reachable:
    """Intervals of one role; says whether one of them meets a given interval."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((start, end) for _, start, end in spans)
        self.starts = [start for start, _ in ordered]
        self.ends = sorted(end for _, end in ordered)
        self.furthest = list(accumulate((end for _, end in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.furthest[before - 1] > start

    def beside(self, start: int, end: int, reach: float) -> bool:
        """Whether one that shares nothing with the interval lies within reach of it."""
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start - reach or after < len(self.starts) and self.starts[after] < end + reach


def _endpoints(text: str, parts: list[Span]) -> list[Span]:
    """Endpoints, cut before the first of the parts that starts inside."""
    starts = sorted(start for _, start, _ in parts)
    out: list[Span] = []
    for m in ENDPOINT.finditer(text):
        start, end = m.span()
        first = bisect_right(starts, start)
        if first < len(starts) and starts[first] < end:
            end = start + len(text[start : starts[first]].rstrip("?&;#,"))
        out.append(("endpoint", start, end))
    return out


def _apart(strong: list[Span], weak: list[Span]) -> list[Span]:
    """Weak spans that meet no strong one; of those that meet each other the leftmost, longest."""
    out: list[Span] = []
    for span in sorted(_clear(strong, weak), key=lambda span: (span[1], -span[2], ORDER[span[0]])):
        if not out or span[1] >= out[-1][2]:
            out.append(span)
    return out


def _clear(strong: list[Span], weak: list[Span]) -> list[Span]:
    """Weak spans that meet no strong one."""
    taken = Reachable(strong)
    return [span for span in weak if not taken.meets(span[1], span[2])]


def _linked(strong: list[Span], weak: list[Span], text: str, reach: float) -> list[Span]:
    """The weak spans whose complementary parts lie in their scope, within reach."""
    cuts = [m.start() for m in SCOPE_END.finditer(text)]
    scopes: dict[int, dict[str, list[Span]]] = {}
    for span in strong + weak:
        scope = scopes.setdefault(bisect_right(cuts, span[1]), {})
        scope.setdefault(ROLE[span[0]], []).append(span)
    joins = {n: {role: Reachable(spans) for role, spans in roles.items()} for n, roles in scopes.items()}
    nothing = Reachable([])
    found = []
    for span in weak:
        kind, start, end = span
        scope = joins[bisect_right(cuts, start)]
        near = {
            role: scope.get(role, nothing).beside(start, end, reach)
            for role in ("identifier", "secret", "endpoint")
            if role != ROLE[kind]
        }
        if ROLE[kind] == "identifier" and near["secret"]:
            found.append(span)
        elif ROLE[kind] == "secret" and (near["identifier"] or near["endpoint"]):
            found.append(span)
        elif ROLE[kind] == "endpoint" and near["identifier"] and near["secret"]:
            found.append(span)
    return found


def spans_of(text: str, reach: float = REACH) -> list[Span]:
    """All reported spans (kind, start, end) of a text by start, kind and end."""
    strong, weak = strong_and_short(text)
    weak += [("named_id", *m.span()) for m in NAMED_ID.finditer(text)]
    named = strong + [span for span in weak if span[0] in ("short_assign", "named_id")]
    weak += [("opaque", *m.span()) for m in OPAQUE.finditer(text) if _is_opaque(m[0])]
    weak += _endpoints(text, [span for span in named if span[0] != "hex"])
    if weak:
        weak = _clear(strong, weak)
        weak = _apart(strong, _linked(strong, weak, text, reach)) if len(strong) + len(weak) > 1 else []
    return sorted(strong + weak, key=lambda span: (span[1], ORDER[span[0]], span[2]))


def scan(docs: DataFrame, text: str = "text", reach: float = REACH) -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end).

    Positions count code points, the end is exclusive. Null and empty texts have no span, an empty
    table gives no rows. Very long texts are read whole; ties are ordered by kind and end. Repeated rows
    are returned each; other columns of ``docs`` are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(x, reach)] for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select("doc_id", whole(text).alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_kind}, spans array<struct<kind: string, start: long, end: long>>")
