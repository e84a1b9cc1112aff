"""Value pools and per-row seeded picks for labelled corpus generation.

Picks are pure integer arithmetic on a row key, so a value is the same in
Spark and in DuckDB (used as the oracle), for any row, independently of
partitioning (unlike a sequential RNG).

Generators are written once against a small namespace ``ns``: :data:`SPARK`
builds PySpark Columns (what the queries run), :data:`SQL` builds DuckDB SQL
text (what the oracle runs).
"""

from __future__ import annotations


# --------------------------------------------------------------------------
# Pools for synthetic documents. People, firms, courts and hospitals are invented.
# --------------------------------------------------------------------------
NAMES_M = ["Leandro", "Octavio", "Fermín", "Gaspar", "Ulises", "Néstor", "Bruno", "Efrén", "Saúl", "Teo", "Marcial", "Íker", "Dámaso"]
NAMES_F = ["Alba", "Noelia", "Ximena", "Olalla", "Carlota", "Vera", "Martina", "Úrsula", "Jimena", "Nieves", "Candela", "Tamara"]
SURNAMES = [
    "Arribas", "Bermejo", "Calleja", "Dorado", "Escudero", "Frías", "Galindo", "Hinojosa", "Ibarra", "Jurado", "Lozano", "Mellado",
    "Nogales", "Olmedo", "Peñalver", "Quintana", "Rebollo", "Solís", "Tejada", "Urrutia", "Valverde", "Yáñez", "Zamorano",
    "del Olmo", "de la Vega", "Arribas-Solís",
]
STREET_TYPES = ["Calle", "C/", "Camino", "Avenida", "Plaza", "Rambla"]
STREETS = ["del Molino", "de los Tilos", "Fuente Nueva", "del Horno", "de las Eras", "Puerta Verde", "de la Acequia", "Cuesta Alta", "del Trigo", "Lavaderos"]
CITIES = [("Villanueva", "45810"), ("Torrealba", "50369"), ("Montesol", "21440"), ("Riofrío", "40424"), ("Peñaclara", "39550"), ("Valdeoliva", "23640"), ("Puertomar", "12594")]
HOSPITALS = ["Hospital Monte Claro", "Clínica Los Almendros", "Hospital Ribera Alta", "Centro Médico Torrealba", "Hospital Comarcal del Valle", "Clínica Santa Lía"]
COURTS = ["Juzgado Civil nº 21 de Torrealba", "Juzgado Social nº 14 de Montesol", "Audiencia de Valdeoliva", "Juzgado Mercantil nº 8 de Puertomar", "Juzgado Penal nº 17 de Riofrío"]
LAW_FIRMS = ["Olmedo y Frías Letrados", "Gabinete Cuesta Alta", "Nogales Jurídico", "Estudio Legal Puertomar", "Tejada Consultores", "Asesores del Valle S.L."]
INSURERS = ["Seguros Atalaya", "Mutua del Sur", "Previsora Encina", "Salud Norte", "Aseguradora Faro"]
BAR_COLLEGES = ["ICAM", "ICAB", "ICAV"]   # colleges that the LAWYER_ID detector knows
FLOOR_DOORS = ["1", "2", "Centro", "Ático"]
LANDLINE_PREFIXES = ["91", "93", "96", "95", "94"]
# Check-letter tables of Spanish identifiers.
CONTROL_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"
CIF_LETTER_ORGS = ["P", "Q", "S", "K", "W", "N"]

_M = 2147483647  # prime modulus of the per-row hash


class Sql:
    """DuckDB SQL text with Python operators (oracle side only)."""

    def __init__(self, s: str):
        self.s = s

    def _b(self, op: str, o, rev: bool = False) -> "Sql":
        o = o.s if isinstance(o, Sql) else repr(o)
        return Sql(f"({o} {op} {self.s})" if rev else f"({self.s} {op} {o})")

    def __add__(self, o): return self._b("+", o)
    def __radd__(self, o): return self._b("+", o, True)
    def __sub__(self, o): return self._b("-", o)
    def __rsub__(self, o): return self._b("-", o, True)
    def __mul__(self, o): return self._b("*", o)
    def __rmul__(self, o): return self._b("*", o, True)
    def __mod__(self, o): return self._b("%", o)
    def __truediv__(self, o): return self._b("/", o)
    def __gt__(self, o): return self._b(">", o)
    def __eq__(self, o): return self._b("=", o)  # type: ignore[override]
    __hash__ = object.__hash__

    def __str__(self) -> str:
        return self.s


def _sql(x) -> str:
    if isinstance(x, Sql):
        return x.s
    if isinstance(x, str):
        parts = x.split("'")
        return " || chr(39) || ".join(f"'{p}'" for p in parts) if len(parts) > 1 else f"'{x}'"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if x is None:
        return "NULL"
    return repr(x)


class _SqlNS:
    name = "duckdb"
    def let(self, expr, level: int): return expr
    def key(self, c: str) -> Sql: return Sql(c)
    def lit(self, v) -> Sql: return Sql(_sql(v))
    def concat(self, *xs) -> Sql: return Sql("(" + " || ".join(_sql(x) for x in xs) + ")")
    def str(self, x) -> Sql: return Sql(f"CAST({_sql(x)} AS STRING)")
    def long(self, x) -> Sql: return Sql(f"CAST({_sql(x)} AS BIGINT)")
    def int(self, x) -> Sql: return Sql(f"CAST({_sql(x)} AS INTEGER)")
    def floor(self, x) -> Sql: return Sql(f"floor({_sql(x)})")
    def lpad(self, x, n: int, c: str) -> Sql: return Sql(f"lpad({_sql(x)}, {n}, {_sql(c)})")
    def substr(self, x, pos, n) -> Sql: return Sql(f"substr({_sql(x)}, {_sql(pos)}, {_sql(n)})")
    def replace(self, x, a: str, b: str) -> Sql: return Sql(f"replace({_sql(x)}, {_sql(a)}, {_sql(b)})")
    def when(self, c, a, b) -> Sql: return Sql(f"(CASE WHEN {_sql(c)} THEN {_sql(a)} ELSE {_sql(b)} END)")
    def isin(self, x, vals) -> Sql: return Sql(f"({_sql(x)} IN ({', '.join(_sql(v) for v in vals)}))")
    def pick(self, idx, pool) -> Sql:
        whens = " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(pool))
        return Sql(f"(CASE {_sql(idx)} {whens} END)")


class _SparkSqlNS(_SqlNS):
    """Spark SQL text for ``selectExpr``, staged so every string stays short.

    Per-row hashes are columns ``_h<slot>``, pools are array columns
    ``_p<i>``, and values reused several times are ``let`` columns computed
    at a given projection level. Building a plan is then a few dozen JVM calls
    (one ``selectExpr`` per level) instead of tens of thousands of Column ops.
    """
    name = "spark"

    def __init__(self):
        self.used: set[int] = set()
        self.pools: dict[tuple, str] = {}
        self.lets: dict[int, list[str]] = {}
        self._n = 0

    def str(self, x) -> Sql: return Sql(f"CAST({_sql(x)} AS STRING)")

    def hash(self, key, slot: int) -> Sql:
        self.used.add(slot)
        return Sql(f"_h{slot}")

    def let(self, expr, level: int) -> Sql:
        self._n += 1
        name = f"_v{self._n}"
        self.lets.setdefault(level, []).append(f"{_sql(expr)} AS {name}")
        return Sql(name)

    def pick(self, idx, pool) -> Sql:
        name = self.pools.get(tuple(pool))
        if name is None:
            name = self.pools[tuple(pool)] = f"_p{len(self.pools)}"
        return Sql(f"element_at({name}, CAST({_sql(idx)} AS INT) + 1)")

    def base_exprs(self, key: str) -> list[str]:
        k = f"(CAST({key} AS BIGINT) % {_M})"
        hs = [f"({k} * {1000003 + 7919 * s} + {104729 * s + 17}) % {_M} AS _h{s}" for s in sorted(self.used)]
        ps = [f"array({', '.join(_sql(v) for v in pool)}) AS {name}" for pool, name in self.pools.items()]
        return hs + ps


SQL = _SqlNS()


def spark_ns() -> _SparkSqlNS:
    return _SparkSqlNS()


def h(ns, key, slot: int):
    """Seeded hash of (row key, slot) in [0, 2^31-1): bigint-safe for any key."""
    if hasattr(ns, "hash"):
        return ns.hash(key, slot)
    return ((ns.long(key) % _M) * (1000003 + 7919 * slot) + (104729 * slot + 17)) % _M


def rint(ns, key, slot: int, lo: int, hi: int):
    return lo + h(ns, key, slot) % (hi - lo + 1)


def rbool(ns, key, slot: int):
    return h(ns, key, slot) % 2 == 0


def pick(ns, key, slot: int, pool: list[str]):
    return ns.pick(h(ns, key, slot) % len(pool), pool)


def pad(ns, x, n: int):
    return ns.lpad(ns.str(x), n, "0")


def digit(ns, num, pos: int, width: int):
    """``pos``-th digit (0 = leftmost) of ``num`` zero-padded to ``width``."""
    return ns.int(ns.floor(num / (10 ** (width - 1 - pos))) % 10)
