"""Cell predicates and string helpers shared by every operator.

Everything here returns a ``Column``: the predicates stay inside Spark's
generated code, are evaluated per row on the executors and can be combined
freely (``|``, ``&``) or aggregated with ``count_if``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- fixed values (must equal the reference's for identical results) -------
# Lower-cased, trimmed cell texts that count as "missing".
MISSING_TOKENS = ("null", "nan", "none", "na", "n/a", "#n/a", "nat", "?")
# Cell patterns.  Written for Java regex: ``\z`` instead of ``$`` (Java's ``$``
# also matches before a final newline) and ``(?U)`` so that ``\d \w \s`` are
# Unicode-aware like the reference's regex engine.
NUMERIC_PATTERN = r"(?U)^-?\d+\.?\d*\z"
EMAIL_PATTERN = r"(?U)^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\z"
PHONE_PATTERN = r"(?U)^\+?[\d\s\-\(\)]{7,15}\z"
SPECIAL_CHARS_PATTERN = r"(?U)[^\w\s\.\,\-\@\_]"
# --- end of fixed values ----------------------------------------------------

PATTERNS = {"numeric": NUMERIC_PATTERN, "email": EMAIL_PATTERN, "phone": PHONE_PATTERN}

# Unicode White_Space code points (the property both the reference's string
# strip and Java's ``(?U)\s`` use).  ``btrim`` with an explicit set is a plain
# character scan, much cheaper per cell than a regex replace.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

STRING_TYPES = (T.StringType, T.VarcharType, T.CharType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC_TYPES = INTEGRAL_TYPES + FLOAT_TYPES + (T.DecimalType,)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col_of(c) -> Column:
    return c if not isinstance(c, str) else F.col(c if c.startswith("`") else quoted(c))


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, STRING_TYPES)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOAT_TYPES)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATE_TYPES)


def strip_ws(c) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def is_missing(c, dtype: T.DataType, tokens=MISSING_TOKENS) -> Column:
    """Null, a sentinel text (trimmed, case-insensitive) or a float NaN."""
    x = col_of(c)
    if is_string(dtype):
        return x.isNull() | F.lower(strip_ws(x)).isin(*tokens)
    if is_float(dtype):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def is_empty(c, dtype: T.DataType) -> Column:
    """A non-null text that is blank after stripping whitespace."""
    x = col_of(c)
    if is_string(dtype):
        return x.isNotNull() & (strip_ws(x) == "")
    return F.lit(False)


def is_valid(c, dtype: T.DataType, tokens=MISSING_TOKENS) -> Column:
    """Neither missing nor empty."""
    return ~is_missing(c, dtype, tokens) & ~is_empty(c, dtype)


def is_blank(c, dtype: T.DataType) -> Column:
    """Null or whitespace-only text (NaN for floats); sentinels do not count."""
    x = col_of(c)
    if is_string(dtype):
        return x.isNull() | (strip_ws(x) == "")
    if is_float(dtype):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def matches(c, kind: str) -> Column:
    """Whole-cell match of one of the named patterns (numeric/email/phone)."""
    return col_of(c).rlike(PATTERNS[kind])


def as_text(c, dtype: T.DataType) -> Column:
    """Cell as text for search and display; doubles keep plain notation."""
    x = col_of(c)
    if is_string(dtype):
        return x
    return x.cast("string")


def non_null_count(exprs) -> Column:
    """Sum of boolean columns as an int (a horizontal ``count_if``)."""
    exprs = list(exprs)
    if not exprs:
        return F.lit(0)
    total = F.lit(0)
    for e in exprs:
        total = total + e.cast("int")
    return total


def flagged_names(pairs) -> Column:
    """``array<string>`` of the names whose predicate holds, in given order."""
    pairs = list(pairs)
    if not pairs:
        return F.array().cast("array<string>")
    arr = F.array(*[F.when(p, F.lit(name)) for name, p in pairs])
    return F.filter(arr, lambda x: x.isNotNull())


def quoted(name: str) -> str:
    """A column's name as an identifier: dots and blanks in it stay part of the name."""
    return "`" + name.replace("`", "``") + "`"
