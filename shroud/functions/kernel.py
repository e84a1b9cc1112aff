"""Per-text scanning helpers that run inside Arrow batches on executors.

Two small functions, both compiled once per Python worker:

* :func:`pii_spans` - every priority pattern over the *original* text; a
  match overlapping an already accepted span is dropped whole (C1).
* :func:`mask_text` - secrets, then PII, then NER entities, each pass over the
  already-substituted text, one shared counter per type (D1-D3). Token
  numbers here are local to the text; conversation-wide numbers are applied
  by a window in :mod:`shroud.operators.mask`.

Everything else (grouping, numbering across messages, joins, reports) is Spark.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache
from re import _parser as parser

try:  # variable-width lookbehind (ROUTING) needs the third-party engine
    import regex as _regex
except ImportError:  # pragma: no cover
    _regex = None

from shroud.functions.patterns import Pattern, catalogue

TOKEN_RE = re.compile(r"\[([A-Z_]+)_(\d+)\]")
_DIGITS = re.compile(r"[0-9]+")

# Cheap necessary conditions, checked before running a pattern. Each is implied
# by the pattern itself (it cannot match without it), so skipping is exact.
_LOWER_WORDS = {
    "ROUTING": ("routing",), "MRN": ("mrn",), "NHC": ("nhc",),
    "EMP_ID": ("emp",), "LAWYER_ID": ("ica",),
}


def _compile(p: Pattern):
    flags = re.ASCII | (re.IGNORECASE if p.ci else 0)
    try:
        return re.compile(p.python, flags)
    except re.error:
        if _regex is None:
            raise
        rflags = _regex.ASCII | _regex.V0 | (_regex.IGNORECASE if p.ci else 0)
        return _regex.compile(p.python, rflags)


class Seen:
    """What the prefilters ask of a text: lower-cased form, ASCII digits in all, longest run of them."""
    __slots__ = ("lower", "digits", "run")

    def __init__(self, text: str):
        self.lower = text.lower()
        runs = list(map(len, _DIGITS.findall(text)))
        self.digits, self.run = sum(runs), max(runs, default=0)


#: Fewest digits in all and in one run of them that a match of a pattern holds, and a character it can't do without.
_FEWEST = {
    "SSN": (9, 4, "-"), "CIF": (7, 7, ""), "NIG": (16, 6, "/"), "PASSPORT": (6, 6, ""), "CARD": (16, 4, ""), "ROUTING": (9, 9, ""),
    "TAX_ID": (9, 7, "-"), "MRN": (4, 4, ""), "NHC": (8, 4, ""), "EMP_ID": (4, 4, ""), "LAWYER_ID": (4, 4, ""), "SSN_ES": (14, 10, ""),
}
_IBAN_HEAD = re.compile(r"[A-Z][A-Z][0-9][0-9]")
_LONG_CODE = re.compile(r"[0-9A-Z]{18}")


def _needs(p: Pattern):
    """Return a predicate (text, Seen) -> bool that must hold for a match."""
    t, s = p.type, p.source
    if p.family == "secret":
        if s.startswith("AKIA"):
            return lambda x, seen: "AKIA" in x
        if "\\/\\/" in s:
            return lambda x, seen: "://" in x
        if s.startswith("eyJ"):
            return lambda x, seen: "eyJ" in x
        if "sk-" in s:
            return lambda x, seen: "sk-" in x
        return lambda x, seen: ("=" in x or ":" in x) and (
            "secret" in seen.lower or "key" in seen.lower or "token" in seen.lower)
    if t == "EMAIL":
        return lambda x, seen: "@" in x
    if t in _FEWEST:
        digits, run, mark = _FEWEST[t]
        words = _LOWER_WORDS.get(t, ("",))
        return lambda x, seen: seen.run >= run and seen.digits >= digits and mark in x and any(w in seen.lower for w in words)
    if t == "DNI":  # eight digits with or without points, or a letter and seven
        return lambda x, seen: seen.run >= 7 or (seen.digits >= 8 and "." in x)
    if t == "IBAN":
        return lambda x, seen: seen.digits >= 2 and _IBAN_HEAD.search(x) is not None
    if t == "PHONE":
        least = 9 if s.startswith("(?<!") else 10
        return lambda x, seen: seen.digits >= least
    if t == "DATE":
        if "/" in s:
            return lambda x, seen: seen.digits >= 4 and x.count("/") >= 2
        return lambda x, seen: seen.run >= 4 and seen.digits >= 8 and x.count("-") >= 2
    if t == "CATASTRAL":
        return lambda x, seen: _LONG_CODE.search(x) is not None
    if t == "ID":  # first alternative can be all letters (e.g. ACCOUNT)
        heads = ("APP", "BC", "ID", "BK", "ACC", "REF", "TXN", "CASE", "CLT")
        return lambda x, seen: (seen.run >= 4 and "-" in x) or any(h in x for h in heads)
    # every remaining pattern needs at least one ASCII digit
    return lambda x, seen: seen.run > 0


def literal(p: Pattern) -> str:
    """The longest run of ASCII characters, lower-cased, that every match of the pattern holds ('' if there is none)."""
    try:
        parts = parser.parse(p.python, re.ASCII)
    except re.error:                                         # the other engine's syntax
        return ""
    runs = [""]
    for op, value in parts:
        if op is parser.LITERAL and value < 128:             # others may change their length when folded
            runs[-1] += chr(value).lower()
        elif op is not parser.AT:
            runs.append("")
    return max(runs, key=len)


def _general_need(p: Pattern):
    word = literal(p)
    return lambda x, seen: word in seen.lower


@lru_cache(maxsize=8)
def compiled(patterns: tuple[Pattern, ...] | None = None) -> list[tuple[Pattern, object, object]]:
    """Patterns, their compiled forms and prefilters, once a worker; ``patterns``: a catalogue of the user's."""
    if patterns is None:
        return [(p, _compile(p), _needs(p)) for p in catalogue()]
    known = set(catalogue())
    return [(p, _compile(p), _needs(p) if p in known else _general_need(p)) for p in patterns]


def pii_spans(text: str | None, patterns: tuple[Pattern, ...] | None = None) -> list[tuple[int, str, int, int, str]]:
    """Accepted spans ``(rank, type, start, end, value)`` in pattern order."""
    if not text:
        return []
    seen = Seen(text)
    starts: list[int] = []   # accepted spans, disjoint, sorted by start
    ends: list[int] = []
    out = []
    for p, rx, need in compiled(patterns):
        if p.family != "pii" or not need(text, seen):
            continue
        for m in rx.finditer(text):
            s, e = m.start(), m.end()
            if s == e:                                       # a user's pattern may match nothing
                continue
            k = bisect.bisect_left(starts, e)  # spans starting before e
            if k and ends[k - 1] > s:
                continue
            starts.insert(k, s)
            ends.insert(k, e)
            out.append((p.rank, p.type, s, e, m.group(0)))
    return out


def secret_types(text: str | None) -> list[str]:
    """C2 in Python (used by tests and the streaming path): first-seen order."""
    if not text:
        return []
    seen = Seen(text)
    types: list[str] = []
    for p, rx, need in compiled():
        if p.family == "secret" and p.type not in types and need(text, seen) and rx.search(text):
            types.append(p.type)
    return types


def mask_text(text: str | None, ner: list[tuple[str, str]] | None = None,
              counters: dict[str, int] | None = None):
    """D1 for one text.

    Returns ``(masked, tokens)`` where tokens are ``(type, n, value)`` in
    creation order; ``n`` continues from ``counters`` (mutated in place).
    NER entities ``(type, value)`` are replaced literally, case-sensitively,
    at every occurrence, in the given order; empty values are skipped.
    """
    if counters is None:
        counters = {}
    tokens: list[tuple[str, int, str]] = []
    result = text or ""

    def make(t: str, value: str) -> str:
        n = counters.get(t, 0) + 1
        counters[t] = n
        tokens.append((t, n, value))
        return f"[{t}_{n}]"

    seen = None
    for p, rx, need in compiled():
        if not result:
            break
        if seen is None:
            seen = Seen(result)
        if not need(result, seen):
            continue
        t = p.type
        before = len(tokens)
        result = rx.sub(lambda m, t=t: make(t, m.group(0)), result)
        if len(tokens) != before:
            seen = None
    for t, value in ner or ():
        if not value or value not in result:
            continue
        tok = make(t, value)
        result = result.replace(value, tok)
    return result, tokens
