"""Value-driven typing (B5) and invalid-type detection.

One aggregate over the text columns decides, per column,
* promotion to double: at least ``threshold`` of the valid cells are plain
  numerals (``NUMERIC_PATTERN``, untrimmed);
* for the columns that stay text: which pattern (numeric, then email, then
  phone) more than ``share`` of the non-blank cells follow.  Cells breaking the
  winning pattern are invalid; so are valid cells of a promoted column that are
  not numerals (they would silently turn null in the cast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P

KINDS = ("numeric", "email", "phone")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if P.is_string(f.dataType)]


def type_evidence(df: DataFrame, columns=None, threshold: float = 0.9, share: float = 0.8,
                  tokens=P.MISSING_TOKENS) -> DataFrame:
    """``(column, valid, numeric_valid, numeric_share, promoted, nonblank,
    numeric_nonblank, email_nonblank, phone_nonblank, pattern)`` per text column."""
    cols = list(columns or text_columns(df))
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, valid bigint, numeric_valid bigint, numeric_share double, promoted boolean, "
                "nonblank bigint, numeric_nonblank bigint, email_nonblank bigint, phone_nonblank bigint, pattern string")
    aggs = []
    st = df.schema
    for i, c in enumerate(cols):
        dt = st[c].dataType
        valid = P.is_valid(c, dt, tokens)
        nonblank = F.col(P.quoted(c)).isNotNull() & (P.strip_ws(c) != "")
        aggs += [F.count_if(valid).alias(f"{i}_v"), F.count_if(valid & P.matches(c, "numeric")).alias(f"{i}_vn"),
                 F.count_if(nonblank).alias(f"{i}_b")]
        aggs += [F.count_if(nonblank & P.matches(c, k)).alias(f"{i}_b{k}") for k in KINDS]
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        v, vn, b = F.col(f"{i}_v"), F.col(f"{i}_vn"), F.col(f"{i}_b")
        sh = F.when(v > 0, vn / v)
        promoted = F.coalesce(sh >= F.lit(threshold), F.lit(False))
        pattern = F.when(promoted, F.lit("numeric"))
        for k in KINDS:
            pattern = pattern.when((b > 0) & (F.col(f"{i}_b{k}") / b > F.lit(share)), F.lit(k))
        items.append(F.struct(F.lit(c).alias("column"), v.alias("valid"), vn.alias("numeric_valid"),
                              sh.alias("numeric_share"), promoted.alias("promoted"), b.alias("nonblank"),
                              *[F.col(f"{i}_b{k}").alias(f"{k}_nonblank") for k in KINDS],
                              pattern.alias("pattern")))
    return row.select(F.inline(F.array(*items)))


class TypePlan:
    """Driver copy of ``type_evidence``: which columns to promote and which
    pattern each text column is checked against (one entry per column)."""

    def __init__(self, rows):
        self.rows = {r["column"]: (r if isinstance(r, dict) else r.asDict()) for r in rows}
        self.promoted = [c for c, r in self.rows.items() if r["promoted"]]
        self.pattern = {c: r["pattern"] for c, r in self.rows.items() if r["pattern"]}

    @classmethod
    def of(cls, df: DataFrame, **kw) -> "TypePlan":
        return cls(type_evidence(df, **kw).collect())

    @classmethod
    def from_counts(cls, first: dict, columns, text_cols, threshold: float = 0.9, share: float = 0.8) -> "TypePlan":
        """The same decisions as ``type_evidence``, from ``profile.first_pass`` counts."""
        rows = []
        for i, c in enumerate(columns):
            if c not in text_cols:
                continue
            v, vn, b = first[f"{i}_v"], first[f"{i}_vn"], first[f"{i}_b"]
            sh = vn / v if v > 0 else None
            promoted = sh is not None and sh >= threshold
            pattern = "numeric" if promoted else next(
                (k for k in KINDS if b > 0 and first[f"{i}_b{k}"] / b > share), None)
            rows.append({"column": c, "valid": v, "numeric_valid": vn, "numeric_share": sh, "promoted": promoted,
                         "nonblank": b, **{f"{k}_nonblank": first[f"{i}_b{k}"] for k in KINDS}, "pattern": pattern})
        return cls(rows)


def numeral_to_double(c) -> Column:
    """Numerals become doubles; anything else (text, blanks, sentinels) null."""
    x = P.col_of(c)
    return F.when(P.matches(x, "numeric"), x.cast("double"))


def promote_numeric(df: DataFrame, plan: TypePlan | None = None, threshold: float = 0.9) -> DataFrame:
    plan = plan or TypePlan.of(df, threshold=threshold)
    return df.select(*[numeral_to_double(c).alias(c) if c in plan.promoted else F.col(P.quoted(c)) for c in df.columns])


def invalid_predicate(c: str, plan: TypePlan, dtype, tokens=P.MISSING_TOKENS) -> Column | None:
    """Invalid-type predicate on the column's original text, or None."""
    kind = plan.pattern.get(c)
    if kind is None:
        return None
    x = F.col(P.quoted(c))
    if c in plan.promoted:
        return P.is_valid(x, dtype, tokens) & ~P.matches(x, "numeric")
    nonblank = x.isNotNull() & (P.strip_ws(x) != "")
    return nonblank & ~P.is_missing(x, dtype, tokens) & ~P.matches(x, kind)
