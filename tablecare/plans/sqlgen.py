"""DuckDB SQL fragments for the oracle side of the registered queries.

The oracle restates each operator's definition in plain SQL (window functions,
``list_sort`` for order statistics, moments for skewness) so the Spark result
can be checked against an independent engine.
"""

from __future__ import annotations

from ..functions.predicates import MISSING_TOKENS

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TOKENS = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
# The cell patterns.
NUMERIC_RE = r"^-?\d+\.?\d*$"
EMAIL_RE = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PHONE_RE = r"^\+?[\d\s\-\(\)]{7,15}$"
RE = {"numeric": NUMERIC_RE, "email": EMAIL_RE, "phone": PHONE_RE}


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def missing(x: str, kind: str) -> str:
    if kind == "text":
        return f"({x} IS NULL OR lower({strip(x)}) IN ({TOKENS}))"
    if kind == "float":
        return f"({x} IS NULL OR isnan({x}))"
    return f"({x} IS NULL)"


def empty(x: str, kind: str) -> str:
    if kind == "text":
        return f"({x} IS NOT NULL AND {strip(x)} = '')"
    return "false"


def valid(x: str, kind: str) -> str:
    return f"(NOT {missing(x, kind)} AND NOT {empty(x, kind)})"


def nonblank(x: str) -> str:
    return f"({x} IS NOT NULL AND {strip(x)} <> '')"


def matches(x: str, kind: str) -> str:
    return f"regexp_matches({x}, {lit(RE[kind])})"


def numeral(x: str) -> str:
    return f"CASE WHEN {matches(x, 'numeric')} THEN CAST({x} AS DOUBLE) END"


def nearest(x: str, qv: float, n: str | None = None) -> str:
    """Element-valued quantile, rank ``floor(q*(n-1)+0.5)`` of the non-null values."""
    n = n or f"count({x})"
    return f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL AND NOT isnan({x})))[CAST(floor({qv} * ({n} - 1) + 0.5) AS BIGINT) + 1]"


def floor_n(x: str, qv: float) -> str:
    n = f"count({x})"
    return f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))[least(CAST(floor({qv} * {n}) AS BIGINT), {n} - 1) + 1]"


def bigint_counts(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(... AS BIGINT)``: DuckDB types
    ``count_if`` as HUGEINT, Spark as bigint."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "'":                       # skip string literals
                k = sql.index("'", k + 1)
            k += 1
        inner = bigint_counts(sql[j + len(key):k - 1])
        out.append(sql[i:j] + f"CAST(count_if({inner}) AS BIGINT)")
        i = k
