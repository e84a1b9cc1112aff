"""Spanish identifier generators and check-digit rules.

Generators take a namespace ``ns`` (Spark Columns or DuckDB SQL, see
:mod:`shroud.functions.pools`) and an integer key; each consumes the slot
numbers it is given, so callers keep slots distinct within a document. Check functions are Spark
Columns for data-quality use on any table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shroud.functions import pools as P
from shroud.functions.pools import pad, pick, rbool, rint


def nif_letter(ns, num):
    """Check letter = CONTROL_LETTERS[num mod 23]."""
    return ns.substr(ns.lit(P.CONTROL_LETTERS), ns.int(num % 23) + 1, 1)


def nif(ns, key, slot: int):
    """8-digit body + check letter."""
    n = ns.let(rint(ns, key, slot, 10000000, 99999999), 1)
    return ns.concat(ns.str(n), nif_letter(ns, n))


def nie(ns, key, slot: int):
    """X/Y/Z + 7 digits + letter of (prefix index * 10^7 + body)."""
    pref = P.h(ns, key, slot) % 3
    n = ns.let(rint(ns, key, slot + 1, 1000000, 9999999), 1)
    return ns.concat(ns.pick(pref, ["X", "Y", "Z"]), ns.str(n), nif_letter(ns, pref * 10000000 + n))


def cif(ns, key, slot: int):
    """Org letter + 7 digits + check digit (or letter for P,Q,S,K,W,N)."""
    org = ns.let(pick(ns, key, slot, ["A", "B", "P", "Q", "S"]), 1)
    n = ns.let(rint(ns, key, slot + 1, 1000000, 9999999), 1)
    dg = [ns.let(P.digit(ns, n, i, 7), 2) for i in range(7)]
    odd = None
    for i in (0, 2, 4, 6):
        term = ns.when(dg[i] * 2 > 9, dg[i] * 2 - 9, dg[i] * 2)
        odd = term if odd is None else odd + term
    last = ns.let((odd + dg[1] + dg[3] + dg[5]) % 10, 3)
    chk = ns.let(ns.when(last == 0, ns.lit(0), 10 - last), 4)
    check = ns.when(ns.isin(org, P.CIF_LETTER_ORGS), ns.substr(ns.lit(P.CIF_LETTERS), chk + 1, 1), ns.str(chk))
    return ns.concat(org, ns.str(n), check)


def iban(ns, key, slot: int):
    """ES + 2 digits + five 4-digit groups, space separated (mod-97 not valid)."""
    parts = ["ES", ns.str(rint(ns, key, slot, 10, 99))]
    for i in range(5):
        parts += [" ", ns.str(rint(ns, key, slot + 1 + i, 1000, 9999))]
    return ns.concat(*parts)


def phone(ns, key, slot: int):
    """Spanish phone in one of 5 formats (uses slots slot..slot+3)."""
    fmt = P.h(ns, key, slot) % 5
    d = ns.let(ns.concat(ns.when(rbool(ns, key, slot + 1), ns.lit("6"), ns.lit("7")),
                         pad(ns, rint(ns, key, slot + 2, 0, 99999999), 8)), 1)
    rest7 = ns.let(pad(ns, rint(ns, key, slot + 3, 0, 9999999), 7), 1)
    land = pick(ns, key, slot + 3, P.LANDLINE_PREFIXES)
    sub = ns.substr
    g3 = ns.concat(sub(d, 1, 3), " ", sub(d, 4, 3), " ", sub(d, 7, 3))
    g2222 = ns.concat(sub(d, 1, 3), " ", sub(d, 4, 2), " ", sub(d, 6, 2), " ", sub(d, 8, 2))
    landline = ns.concat(land, " ", sub(rest7, 1, 3), " ", sub(rest7, 4, 2), " ", sub(rest7, 6, 2))
    return ns.when(fmt == 0, d, ns.when(fmt == 1, g3, ns.when(fmt == 2, g2222, ns.when(
        fmt == 3, landline, ns.concat("+34 ", g3)))))


def ssn_es(ns, key, slot: int):
    """PP NNNNNNNNNN CC."""
    return ns.concat(pad(ns, rint(ns, key, slot, 1, 52), 2), " ",
                     pad(ns, rint(ns, key, slot + 1, 0, 9999999999), 10), " ",
                     pad(ns, rint(ns, key, slot + 2, 0, 99), 2))


def health_card(ns, key, slot: int):
    """Four 4-digit groups."""
    parts = []
    for i in range(4):
        parts += ([" "] if i else []) + [ns.str(rint(ns, key, slot + i, 1000, 9999))]
    return ns.concat(*parts)


def nhc(ns, key, slot: int):
    return ns.concat("NHC-", ns.str(rint(ns, key, slot, 2020, 2026)), "-", ns.str(rint(ns, key, slot + 1, 1000, 9999)))


def nig(ns, key, slot: int):
    """PPMMMM J NNNNNN/YYYY."""
    return ns.concat(pad(ns, rint(ns, key, slot, 1, 52), 2), pad(ns, rint(ns, key, slot + 1, 1, 999), 4), " ",
                     pick(ns, key, slot + 2, ["C", "S", "P"]), " ", pad(ns, rint(ns, key, slot + 3, 1, 999999), 6),
                     "/", ns.str(rint(ns, key, slot + 4, 2020, 2026)))


def bar_number(ns, key, slot: int):
    return ns.concat(pick(ns, key, slot, P.BAR_COLLEGES), " nº ", ns.str(rint(ns, key, slot + 1, 10000, 99999)))


_AZ = [chr(65 + i) for i in range(26)]


def cadastral(ns, key, slot: int):
    """7 digits + 2 letters + 5 digits + 4 letters-or-digits (18 chars)."""
    ctrl = [ns.when(rbool(ns, key, slot + 10 + i), pick(ns, key, slot + 20 + i, _AZ),
                    ns.str(rint(ns, key, slot + 30 + i, 0, 9))) for i in range(4)]
    return ns.concat(pad(ns, rint(ns, key, slot, 0, 9999999), 7), pick(ns, key, slot + 1, _AZ),
                     pick(ns, key, slot + 2, _AZ), pad(ns, rint(ns, key, slot + 3, 0, 99999), 5), *ctrl)


def case_ref(ns, key, slot: int):
    return ns.concat("#APP-", ns.str(rint(ns, key, slot, 2024, 2026)), "-", ns.str(rint(ns, key, slot + 1, 1000, 9999)))


def full_name(ns, key, slot: int):
    """Given name (by a coin flip on sex) + two surnames (slots slot..slot+3)."""
    given = ns.when(rbool(ns, key, slot), pick(ns, key, slot + 1, P.NAMES_F), pick(ns, key, slot + 1, P.NAMES_M))
    return ns.concat(given, " ", pick(ns, key, slot + 2, P.SURNAMES), " ", pick(ns, key, slot + 3, P.SURNAMES))


def address(ns, key, slot: int):
    """Street type + name + number + optional floor (slots slot..slot+5)."""
    floor_ = ns.when(rbool(ns, key, slot + 3),
                     ns.concat(", ", ns.str(rint(ns, key, slot + 4, 1, 8)), "º", pick(ns, key, slot + 5, P.FLOOR_DOORS)),
                     ns.lit(""))
    return ns.concat(pick(ns, key, slot, P.STREET_TYPES), " ", pick(ns, key, slot + 1, P.STREETS), " ",
                     ns.str(rint(ns, key, slot + 2, 1, 200)), floor_)


def city(ns, key, slot: int):
    """(postcode, name) picked together."""
    return (pick(ns, key, slot, [c[1] for c in P.CITIES]), pick(ns, key, slot, [c[0] for c in P.CITIES]))


# ------------------------------------------------------------------ B22 / B23
def dotted_nif(ns, v):
    """12345678Z -> 12.345.678-Z."""
    v = ns.let(v, 5)
    sub = ns.substr
    return ns.concat(sub(v, 1, 2), ".", sub(v, 3, 3), ".", sub(v, 6, 3), "-", sub(v, 9, 1))


def spaced_nie(ns, v, double: bool = False):
    """X1234567L -> X 1234567 L, or X1234567  L (double space before the letter only)."""
    v = ns.let(v, 5)
    if double:
        return ns.concat(ns.substr(v, 1, 8), "  ", ns.substr(v, 9, 1))
    return ns.concat(ns.substr(v, 1, 1), " ", ns.substr(v, 2, 7), " ", ns.substr(v, 9, 1))


def short_phone(ns, key, slot: int, digits: int):
    """Malformed phone with 8 or 10 digits."""
    return ns.concat("6", pad(ns, rint(ns, key, slot, 0, 10 ** (digits - 1) - 1), digits - 1))


def mixed_sep_phone(ns, key, slot: int):
    d = ns.let(ns.concat("6", pad(ns, rint(ns, key, slot, 0, 99999999), 8)), 1)
    return ns.concat(ns.substr(d, 1, 3), ".", ns.substr(d, 4, 3), "-", ns.substr(d, 7, 3))


def hyphen_iban(ns, v):
    return ns.replace(v, " ", "-")


def dotted_card(ns, v):
    return ns.replace(v, " ", ".")


# ------------------------------------------------------------------ B24 (Columns)
def nif_check_ok(value: Column) -> Column:
    """True when an 8-digit+letter NIF (separators ignored) has the right letter."""
    v = F.regexp_replace(F.upper(value), r"[^0-9A-Z]", "")
    body = F.substring(v, 1, 8)
    letter = F.substring(v, 9, 1)
    expect = F.substring(F.lit(P.CONTROL_LETTERS), (body.cast("long") % 23 + 1).cast("int"), 1)
    return F.when(v.rlike(r"^[0-9]{8}[A-Z]$"), letter == expect)


def nie_check_ok(value: Column) -> Column:
    v = F.regexp_replace(F.upper(value), r"[^0-9A-Z]", "")
    pref = F.when(F.substring(v, 1, 1) == "X", 0).when(F.substring(v, 1, 1) == "Y", 1).otherwise(2)
    num = pref * F.lit(10000000) + F.substring(v, 2, 7).cast("long")
    expect = F.substring(F.lit(P.CONTROL_LETTERS), (num % 23 + 1).cast("int"), 1)
    return F.when(v.rlike(r"^[XYZ][0-9]{7}[A-Z]$"), F.substring(v, 9, 1) == expect)


def cif_check_ok(value: Column) -> Column:
    v = F.regexp_replace(F.upper(value), r"[^0-9A-Z]", "")
    d = [F.substring(v, 2 + i, 1).cast("int") for i in range(7)]
    odd = sum(F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2) for x in (d[0], d[2], d[4], d[6]))
    even = d[1] + d[3] + d[5]
    last = (odd + even) % 10
    chk = F.when(last == 0, 0).otherwise(10 - last)
    org = F.substring(v, 1, 1)
    expect = F.when(org.isin(*P.CIF_LETTER_ORGS), F.substring(F.lit(P.CIF_LETTERS), chk + 1, 1)) \
        .otherwise(chk.cast("string"))
    return F.when(v.rlike(r"^[A-Z][0-9]{7}[0-9A-J]$"), F.substring(v, 9, 1) == expect)
