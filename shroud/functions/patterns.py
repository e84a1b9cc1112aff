"""Detector catalogue: secret and personal-data patterns in priority order.

The catalogue is data. Each entry is written once, in the JavaScript regex
syntax the detector was specified in, and translated mechanically into the three
dialects we run it under:

* Python (``re``/``regex``) for the Arrow kernels that need match offsets,
* Java (``java.util.regex``) for native ``rlike``/``regexp_extract_all``,
* RE2 for the DuckDB oracle (lookaround patterns get a documented rewrite).

Semantics pinned by the translation (see SURVEY §7.2):
  - ``\\b``, ``\\d``, ``\\w`` are ASCII (JavaScript without the ``u`` flag);
  - ``\\s`` is JavaScript's whitespace set, spelled out as a class;
  - case-insensitive flags fold ASCII letters only.
Offsets are code points (JavaScript counts UTF-16 units; they differ only on
astral characters).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

# --------------------------------------------------------------------------
# Fixed values (must equal the reference detector for identical results).
# Order is semantic: earlier patterns win overlaps and are masked first.
# (type, JavaScript pattern source, case_insensitive)
# --------------------------------------------------------------------------
SECRET_SOURCES: list[tuple[str, str, bool]] = [
    ("SECRET_CLOUD_KEY", r"AKIA[0-9A-Z]{16}", False),
    ("SECRET_DB_URI", r"postgres(?:ql)?:\/\/[^\s\"'`>]+", True),
    ("SECRET_DB_URI", r"mongodb(?:\+srv)?:\/\/[^\s\"'`>]+", True),
    ("SECRET_DB_URI", r"redis:\/\/[^\s\"'`>]+", True),
    ("SECRET_JWT", r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]+", False),
    ("SECRET_API_KEY", r"\bsk-[a-zA-Z0-9]{20,}\b", False),
    ("SECRET_API_KEY", r"(?:secret|api[_-]?key|access[_-]?token|private[_-]?key)\s*[:=]\s*['\"]?[a-zA-Z0-9_\-.]{20,}", True),
]

PII_SOURCES: list[tuple[str, str, bool]] = [
    ("EMAIL", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", False),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", False),
    ("DNI", r"\b[0-9]{2}\.[0-9]{3}\.[0-9]{3}[-\s]?[A-Z]\b|\b[0-9]{8}[-.\s]{0,2}[A-Z]\b|\b[XYZ][0-9]{7}[-.\s]{0,2}[A-Z]\b", False),
    ("CIF", r"\b[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]\b", False),
    ("NIG", r"\b\d{6}[\s]?[A-Z][\s]?\d{6}\/\d{4}\b", False),
    ("PASSPORT", r"\b(?!(?:APP|BC|ID|BK|ACC|REF|TXN|ACCT|CASE|CLT)[-#\s]?\d)[A-Z]{1,3}[-\s]?\d{6,9}\b", False),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?:[\s-]?[A-Z0-9]{4}){3,7}\b", False),
    ("CARD", r"\b\d{4}[\s.-]?\d{4}[\s.-]?\d{4}[\s.-]?\d{4}\b", False),
    ("ROUTING", r"(?<=\brouting\b[^0-9]{0,20})\d{9}\b|\b\d{9}\b(?=[^0-9]{0,20}\brouting\b)", True),
    ("TAX_ID", r"\b\d{2}-\d{7}\b", False),
    ("PHONE", r"\b(\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", False),
    ("PHONE", r"(?<!\d)(?:(?:\+|00)34[\s.-]?)?(?:[6789]\d{8}|[6789]\d{2}[\s.-]\d{3}[\s.-]\d{3}|[6789]\d{2}(?:[\s.-]\d{2}){3}|[6789]\d[\s.-]\d{3}(?:[\s.-]\d{2}){2})(?!\d)", False),
    ("DATE", r"\b\d{1,2}\/\d{1,2}\/\d{2,4}\b", False),
    ("DATE", r"\b\d{4}-\d{2}-\d{2}\b", False),
    ("MRN", r"\bMRN[-\s]?\d{4,}\b", True),
    ("NHC", r"\bNHC[-\s]?\d{4}[-\s]?\d{4,}\b", True),
    ("EMP_ID", r"\bEMP[-\s]?\d{4,}\b", True),
    ("LAWYER_ID", r"\bICA[A-Z]{1,8}\s?(?:nº|n°|n\.?º?|num\.?)?\s?\d{4,6}\b", True),
    ("SSN_ES", r"\b\d{2}\s\d{10}\s\d{2}\b", False),
    ("CATASTRAL", r"\b[0-9A-Z]{18,20}\b", False),
    ("ID", r"#?\b(?:APP|BC|ID|BK|ACC|REF|TXN|ACCT|CASE|CLT)[-#]?[A-Z0-9]{4,}(?:-\d{2,6})?\b|\b(?!(?:MRN|EMP)-)[A-Z]{2,4}-\d{4,5}\b", False),
]

# Entity types the NER step may return.
NER_TYPES = ["PERSON", "ORG", "ADDRESS"]

# account/record prefixes excluded from PASSPORT and the
# prefixes excluded from ID's second alternative (used by the RE2 rewrite).
PASSPORT_EXCLUDED = r"^(?:APP|BC|ID|BK|ACC|REF|TXN|ACCT|CASE|CLT)[-#\s]?\d"
ID_ALT2_EXCLUDED = r"^(?:MRN|EMP)-"

# JavaScript's \s (ECMAScript WhiteSpace + LineTerminator), as class contents.
_JS_WS_CODEPOINTS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                     0x3000, 0xFEFF]


def _ws_class_body(dialect: str) -> str:
    def esc(cp: int) -> str:
        if dialect == "re2":
            return "\\x{%04X}" % cp
        return "\\u%04X" % cp
    # collapse the U+2000..U+200A run into a range
    parts, cps, i = [], _JS_WS_CODEPOINTS, 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1 and cps[i] >= 0x2000:
            j += 1
        parts.append(esc(cps[i]) if j == i else f"{esc(cps[i])}-{esc(cps[j])}")
        i = j + 1
    return "".join(parts)


_ASCII_WORD = "A-Za-z0-9_"
_JAVA_BOUNDARY = (f"(?:(?<=[{_ASCII_WORD}])(?![{_ASCII_WORD}])"
                  f"|(?<![{_ASCII_WORD}])(?=[{_ASCII_WORD}]))")


def translate(src: str, dialect: str) -> str:
    """Rewrite a JavaScript pattern for ``python``, ``java`` or ``re2``.

    Only the escapes whose meaning differs between engines are touched:
    ``\\s`` everywhere, ``\\b`` for Java (Unicode-aware there before JDK 19).
    """
    ws = _ws_class_body(dialect)
    out, i, in_class = [], 0, False
    while i < len(src):
        ch = src[i]
        if ch == "\\" and i + 1 < len(src):
            nxt = src[i + 1]
            if nxt == "s":
                out.append(ws if in_class else f"[{ws}]")
            elif nxt == "b" and dialect == "java" and not in_class:
                out.append(_JAVA_BOUNDARY)
            elif nxt == "/":
                out.append("/")
            else:
                out.append(src[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Pattern:
    rank: int          # global masking order: secrets first, then PII
    family: str        # 'secret' | 'pii'
    idx: int           # position within the family (s0..s6 / p0..p20)
    type: str
    source: str        # JavaScript source (fixed value)
    ci: bool

    @property
    def python(self) -> str:
        return translate(self.source, "python")

    @property
    def java(self) -> str:
        body = translate(self.source, "java")
        return f"(?i){body}" if self.ci else body


def catalogue() -> list[Pattern]:
    pats: list[Pattern] = []
    for i, (t, s, ci) in enumerate(SECRET_SOURCES):
        pats.append(Pattern(len(pats), "secret", i, t, s, ci))
    for i, (t, s, ci) in enumerate(PII_SOURCES):
        pats.append(Pattern(len(pats), "pii", i, t, s, ci))
    return pats


def secret_patterns() -> list[Pattern]:
    return [p for p in catalogue() if p.family == "secret"]


def pii_patterns() -> list[Pattern]:
    return [p for p in catalogue() if p.family == "pii"]


ROWS = "rank int, family string, idx int, type string, source string, ci boolean"


def patterns_rows() -> list[tuple]:
    """The catalogue as rows of a table (schema :data:`ROWS`), to which a user can add patterns."""
    return [(p.rank, p.family, p.idx, p.type, p.source, p.ci) for p in catalogue()]


def from_rows(rows) -> tuple[Pattern, ...]:
    """Patterns of a table's rows, in order of rank."""
    return tuple(sorted((Pattern(r["rank"], r["family"], r["idx"], r["type"], r["source"], r["ci"]) for r in rows), key=lambda p: (p.rank, p.idx, p.type, p.source)))


# ---------------------------------------------------------------- RE2 forms
# Lookaround-free forms for DuckDB. ``group`` is the capture group holding the
# match (0 = whole match); ``exclude`` is a filter applied to extracted values.
@dataclass(frozen=True)
class Re2Form:
    pattern: str
    group: int = 0
    exclude: str | None = None
    exact: bool = True     # False: equal on inputs with >=2 non-digits between candidates


@lru_cache(maxsize=None)
def re2_form(family: str, idx: int) -> Re2Form | None:
    p = next(x for x in catalogue() if x.family == family and x.idx == idx)
    flags = "(?i)" if p.ci else ""
    if family == "pii" and p.type == "PASSPORT":
        body = translate(r"\b[A-Z]{1,3}[-\s]?\d{6,9}\b", "re2")
        return Re2Form(body, 0, translate(PASSPORT_EXCLUDED, "re2"))
    if family == "pii" and p.type == "ID":
        body = translate(r"#?\b(?:APP|BC|ID|BK|ACC|REF|TXN|ACCT|CASE|CLT)[-#]?[A-Z0-9]{4,}(?:-\d{2,6})?\b"
                         r"|\b[A-Z]{2,4}-\d{4,5}\b", "re2")
        return Re2Form(body, 0, ID_ALT2_EXCLUDED)
    if family == "pii" and p.type == "PHONE" and p.source.startswith("(?<!"):
        core = p.source[len(r"(?<!\d)"):-len(r"(?!\d)")]
        body = "(?:^|[^0-9])(" + translate(core, "re2") + ")(?:[^0-9]|$)"
        return Re2Form(body, 1, None, exact=False)
    if family == "pii" and p.type == "ROUTING":
        return None
    return Re2Form(flags + translate(p.source, "re2"))
