"""Secret scan with multipart credential linking."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kind, pattern, group whose length counts, and that length at least. The patterns run over text whose A-Z are
#: lower case where the kind says so (offsets stay), which is many times faster than matching without regard to case.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", re.A), 2, 8, True),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.A), 0, 16, False),
    ("hex", re.compile(r"[0-9a-f]{32,}", re.A), 0, 32, False),
)
ORDER = {"assign": 0, "access": 1, "hex": 2, "id": 3, "key": 4, "endpoint": 5}

#: Parts that are weak evidence alone: identifiers, short or unnamed secrets, and endpoints. Looked for in lower-cased text.
WEAK_ID = re.compile(r"""(?<![a-z0-9])(?:access_?key_?id|client_?id|user_?name|username|user|login|account(?:_?id)?|principal)["']?\x20*[:=]\x20*["']?([a-z0-9@._+-]{3,})""", re.A)
WEAK_KEY = re.compile(r"""(?<![a-z0-9])(?:pwd|pass|passphrase|key|private_?key|access_?key|client_?key|auth|credential|bearer)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=!@#$%^&*-]{6,})""", re.A)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|(?<![a-z0-9])(?:host|hostname|endpoint|server|base_?url|db_?url)["']?\x20*[:=]\x20*["']?[a-z0-9.-]+(?::\d+)?""", re.A)
#: An unnamed secret: 40 letters and digits of both cases and digits, as cloud providers issue.
BARE_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", re.A)
#: A scope ends at a blank line, or at a bracketed section heading.
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n|\n(?=\[[^\]\n]{1,80}\][\x20\t\r]*\n)")
#: What may follow a value that ends its line, and precede a name that begins one.
LINE_REST = re.compile(r"""[\x20\t\r"'`,;}\])]*(?:\n|\Z)""")
BEFORE_NAME = frozenset(" \t\"'`{[(,-*")
#: Characters that a plain word of prose has not.
NOT_PROSE = re.compile(r"[0-9_@+/=!#$%^&*]|(?<=.)[A-Z]|[a-z][.-][a-z]", re.A)
#: Cheap signs, one of which any text with a weak part has.
WEAK_SIGNS = ("://", "=", ":")

Span = tuple[str, int, int]


def ascii_lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def base_spans(text: str, lowered: str) -> list[Span]:
    """The contract's spans, leftmost and non-overlapping within a kind, by start, then kind."""
    spans = [(kind, m.start(), m.end()) for kind, pattern, group, least, low in BASE for m in pattern.finditer(lowered if low else text) if m.end(group) - m.start(group) >= least]
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]]))


def _overlaps(spans: list[Span]):
    """A test whether an interval overlaps one of ``spans``."""
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def test(a: int, b: int) -> bool:
        k = bisect_right(starts, b - 1) - 1
        return k >= 0 and merged[k][1] > a

    return test


def _plausible(text: str, m: re.Match) -> bool:
    """Whether a weak name's value looks like one: assigned with = or quoted, no plain word, or a plain word that fills its line (``user: admin``), unlike in prose."""
    a, b = m.span(1)
    k = a - 1
    while k > m.start() and text[k] in " \"'":
        if text[k] != " ":
            return True
        k -= 1
    if text[k] == "=" or NOT_PROSE.search(text, a, b):
        return True
    if text[b - 1] in ".-" or not LINE_REST.match(text, b):
        return False
    k = m.start() - 1
    while k >= 0 and text[k] in BEFORE_NAME:
        k -= 1
    return k < 0 or text[k] == "\n"


def _first_of_each(spans: list[Span]) -> list[Span]:
    """Spans without those that overlap an earlier one of their kind; the longer of two that start together stays."""
    out, ends = [], {}
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= ends.get(kind, 0):
            out.append((kind, a, b))
            ends[kind] = b
    return out


def linked_spans(text: str, lowered: str, base: list[Span]) -> list[Span]:
    """Weak parts that a complementary part in their scope confirms.

    An interval join of parts with scopes: identifiers (access keys of the base and weak ones), secrets (assignments and hex
    of the base and weak ones) and endpoints fall into the scope that holds their start. In a scope with both an identifier and a secret
    its weak identifiers, secrets and endpoints are reported; in one with a secret and an endpoint, the weak secrets are.
    Parts that overlap a base span are that span, and of weak parts of one kind that overlap the first one counts. Named values have to look like values.
    """
    if not any(s in text for s in WEAK_SIGNS) and not base:
        return []
    taken = _overlaps(base)
    found = [("id", m.start(), m.end()) for m in WEAK_ID.finditer(lowered) if _plausible(text, m)]
    found += [("key", m.start(), m.end()) for m in WEAK_KEY.finditer(lowered) if _plausible(text, m)]
    found += [("key", m.start(), m.end()) for m in BARE_KEY.finditer(text)]
    found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(lowered)]
    weak = _first_of_each([s for s in found if not taken(s[1], s[2])])
    if not weak:
        return []
    ends = [m.end() for m in SCOPE_END.finditer(text)]
    role = {"assign": "key", "hex": "key", "access": "id"}
    roles: dict[int, set[str]] = {}
    for kind, a, _ in (*base, *weak):
        roles.setdefault(bisect_right(ends, a), set()).add(role.get(kind, kind))
    out = []
    for s in weak:
        there = roles[bisect_right(ends, s[1])]
        if {"id", "key"} <= there or (s[0] == "key" and "endpoint" in there):
            out.append(s)
    return out


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and linked spans of a whole text."""
    text = text or ""
    lowered = ascii_lowered(text)
    base = base_spans(text, lowered)
    return base, linked_spans(text, lowered, base)


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in each row's whole text.

    Base kinds are assign, access and hex as the patterns say; linked kinds are id, key and endpoint, reported only where
    complementary parts stand in one scope (a paragraph or bracketed section). Offsets are code points, end exclusive.

    Nulls: a null text counts as empty; a null id stays null. Empty texts have no spans. Repeated rows are scanned each.
    An empty table gives an empty result. Other columns are ignored. Rows stay where they are: no shuffle.

    Returns doc_id, base and linked: arrays of (kind, start, end).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [scan(t) for t in b["text"]]
            as_rows = [[[{"kind": k, "start": x, "end": y} for k, x, y in s] for s in two] for two in both]
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": [x for x, _ in as_rows], "linked": [x for _, x in as_rows]})

    return rows.mapInPandas(run, f"doc_id {kind}, base {span}, linked {span}")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    rank = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))
    key = lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.transform(F.sort_array(F.transform(F.concat("base", "linked"), key)), text)
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.array_join(F.transform("base", text), ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
