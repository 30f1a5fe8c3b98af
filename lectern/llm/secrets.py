"""Secret scans: three base patterns, and credentials whose parts are linked within a scope.

Identifiers (user names, client ids, access ids), endpoints (addresses with a
scheme, hosts with a port) and weak secrets (quoted or bare high-entropy strings
after a weaker name, alone or within a compound one) count for nothing alone. Each part opens an interval of
REACH characters within its scope (a run of lines without a blank one between);
a weak secret and an identifier or endpoint whose intervals meet are reported as a
linked credential. Base spans are always reported.

Rows: a null text counts as empty; a null doc_id is carried along; repeated rows
are scanned alike; an empty table gives no rows; other columns are not read. Very
long texts cost time in proportion. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, plain, texts_of

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
KINDS = ["assign", "access", "hex"]

#: Characters between complementary parts at most.
REACH = 200
#: Bits a character that a weak secret has at least, and its least length.
ENTROPY, LEAST_WEAK = 3.2, 12
#: A name may follow others, joined by '_', '-' or camel case, and be followed by a few parts joined alike, but for those that name something else.
_BORDER = r"(?:\b|(?<=_)|(?-i:(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"
_SECRET = r"(?:secret|token|password|passwd)"
_WEAK = r"(?:(?:db|user|root|admin)?(?:pass(?:phrase|code)?|pwd)|(?:(?:secret|access|account|private|shared|signing|storage|master|auth|client|user)[_-]?)*keys?|auth|credentials?|signature|bearer)"
_SUFFIX = r"[0-9]{{0,4}}(?:(?:[_-]|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?!(?:{})(?-i:(?![a-z0-9])))(?-i:[A-Z]?[a-z0-9]++|[A-Z0-9]++)){{0,4}}+"
_NOT_WEAK = "ids?|names?|paths?|files?|dir|ur[il]|host|port|type|size|len|length|count|alg|algorithm|format|version|method|mode"
_NOT_IDENTIFIER = f"{_SECRET}s?|{_WEAK}|agent|type|size|count|mode|role|group"
_SET = r"""["']?+[ \t]*+[:=][ \t]*+["']?+"""
IDENTIFIER = re.compile(rf"""{_BORDER}(?:user(?:name|id)?|login|account(?:name|id)?|client[_-]?id|access[_-]?(?:key[_-]?)?id|key[_-]?id){_SUFFIX.format(_NOT_IDENTIFIER)}{_SET}([A-Za-z0-9@._-]{{3,}})""", re.I | re.A)
ENDPOINT = re.compile(rf"""\b[a-z][a-z0-9+]{{1,12}}://[^\s"'<>]{{4,}}|{_BORDER}(?:host(?:name)?|server|endpoint|url)[0-9]{{0,4}}{_SET}[A-Za-z0-9.-]{{4,}}(?::[0-9]{{2,5}})?""", re.I | re.A)
WEAK = re.compile(rf"""{_BORDER}(?:(?:{_WEAK}|{_SECRET}){_SUFFIX.format(_NOT_WEAK)}{_SET}|{_WEAK}["']?+[ \t]++["']?+)([A-Za-z0-9+/_=-]{{12,}})""", re.I | re.A)
_SCOPE = re.compile(r"\n[ \t\r]*\n")
#: One of these stands in every text with a base span; cheap to look for.
_HINT = re.compile(r"password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{24}", re.I | re.A)
_PARTS = re.compile(r"pass|pwd|key|auth|credential|signature|bearer|secret|token", re.I | re.A)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    if not _HINT.search(text):
        return []
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def linked_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak secrets near an identifier or endpoint of their scope, and those parts; nothing where parts do not co-occur.

    Parts are sorted, so each one's interval is joined with the others by bisection.
    """
    if not _PARTS.search(text):
        return []
    weak = [("weak_secret", m.start(1), m.end(1)) for m in WEAK.finditer(text) if m.end(1) - m.start(1) >= LEAST_WEAK and entropy(m[1]) >= ENTROPY]
    if not weak:
        return []
    parts = [[("identifier", m.start(1), m.end(1)) for m in IDENTIFIER.finditer(text)], [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)], [("identifier", a, b) for k, a, b in base if k == "access"]]
    if not any(parts):
        return []
    scopes = [m.end() for m in _SCOPE.finditer(text)]
    scope = lambda at: bisect_right(scopes, at)
    # Parts of one kind do not overlap, so their starts and ends are both in order.
    edges = [([x[1] for x in kind], [x[2] for x in kind], kind) for kind in parts]
    strong = sorted((a, b) for _, a, b in base)
    reached = [0, *accumulate((b for _, b in strong), max)]  # how far the first i base spans reach
    known = {(a, b) for k, a, b in base if k == "access"}
    found = set()
    for w in weak:
        if reached[bisect_left(strong, (w[2], 0))] > w[1]:
            continue  # already a base span
        near = [o for starts, ends, kind in edges for o in kind[bisect_left(ends, w[1] - REACH) : bisect_right(starts, w[2] + REACH)]]
        partners = [o for o in near if scope(o[1]) == scope(w[1]) and (o[2] <= w[1] or o[1] >= w[2])]
        if partners:
            found.add(w)
            found.update(o for o in partners if o[0] != "identifier" or (o[1], o[2]) not in known)
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def ordered(spans: list[tuple[str, int, int]], kinds: list[str]) -> str:
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], rank.get(x[0], len(rank)), x[0], x[2])))


def _maker():
    def step(batch: pa.RecordBatch):
        texts = texts_of(batch.column("text"))
        base = [base_spans(t) for t in texts]
        more = [linked_spans(t, b) for t, b in zip(texts, base, strict=True)]
        count = lambda k: pa.array([sum(x[0] == k for x in b) for b in base], pa.int64())
        digest = [hashlib.sha256(ordered(b, KINDS).encode()).hexdigest() for b in base]
        full = [ordered(b + m, KINDS) for b, m in zip(base, more, strict=True)]
        return [batch.column("doc_id"), *(count(k) for k in KINDS), pa.array(digest), pa.array(full, pa.string()), pa.array([len(m) for m in more], pa.int64())]

    return step


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every document, in one pass and without a shuffle."""
    return arrow_map(plain(docs, "doc_id", "text"), _maker, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redacted(text: str) -> str:
    """The text with every secret span replaced by its kind in angle brackets; overlapping spans become one."""
    base = base_spans(text)
    spans = [(a, b, k) for k, a, b in base + [x for x in linked_spans(text, base) if x[0] == "weak_secret"]]
    if not spans:
        return text
    out, pos = [], 0
    merged: list[list] = []
    for a, b, k in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[pos:a], f"<{k}>"]
        pos = b
    return "".join([*out, text[pos:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows with their secrets replaced in ``text`` (and ``n_chars``, where there is one, brought up to date)."""
    names = docs.columns
    kinds = dict(docs.dtypes)

    def make():
        def step(batch: pa.RecordBatch):
            texts = [t if t is None else redacted(t) for t in batch.column("text").to_pylist()]
            out = []
            for i, name in enumerate(names):
                if name == "text":
                    out.append(pa.array(texts, batch.column(i).type))
                elif name == "n_chars" and kinds[name] in ("bigint", "int"):
                    old = batch.column(i).to_pylist()
                    out.append(pa.array([o if t is None or o is None else len(t) for o, t in zip(old, texts, strict=True)], batch.column(i).type))
                else:
                    out.append(batch.column(i))
            return out

        return step

    return arrow_map(docs, make, docs.schema)
