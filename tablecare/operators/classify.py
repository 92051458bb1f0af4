"""Column classes (C1-C7) and active columns.

Rules run as ``when`` chains over the per-column profile DataFrame (one row
per column), so classification is a projection of a small table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P

# --- fixed values: name keywords used by the rules ---------------------------
IDENTIFIER_WORDS = ("id", "uuid", "code", "key", "token", "number", "serial")
HELPER_NAMES = ("temp", "index", "internal", "row_id")
GEO_WORDS = ("city", "country", "state", "region", "zip", "location", "address")
AUTO_ID_WORDS = ("id", "uuid", "key")
PLANNER_ID_WORDS = ("id", "uuid", "guid", "hash")
# --- end of fixed values ----------------------------------------------------

INT_TYPES = ("bigint", "int")
ALL_INT = ("tinyint", "smallint", "int", "bigint")
FLOATS = ("float", "double")


def _any_word(name: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(w) for w in words])


def _is_decimal(dt: Column) -> Column:
    return dt.startswith("decimal")


def _is_date(dt: Column) -> Column:
    return dt.isin("date", "timestamp", "timestamp_ntz")


#: What every text in one of the known date formats looks like: a cheap test before any parse.
DATE_SHAPE = r"^[+-]?([0-9]{2,10}[-/.][0-9]{2}[-/.][+-]?[0-9]{2,}|[0-9]{8,}|[0-9]{1,2} [^0-9]{3,} [+-]?[0-9]{4,}|[^0-9]{3,} [0-9]{1,2}, [+-]?[0-9]{4,})"


def date_counts(df: DataFrame, columns) -> DataFrame:
    """``(column, dates)`` of text columns: how many cells parse with a known date format; four-digit numbers are not
    taken as dates.  Only distinct texts of a date's shape are shuffled and parsed, each once, with their counts."""
    from .clean import unify_dates
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), P.strip_ws(F.col(P.quoted(c))).alias("v"))
                                         for i, c in enumerate(columns)])))
    texts = cells.where(F.col("v").rlike(DATE_SHAPE)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    found = texts.where(unify_dates(F.col("v")).isNotNull()).groupBy("i").agg(F.sum("n").alias("dates"))
    return found.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1).alias("column"), "dates")


def quality_classes(prof: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """First match of Identifier, Date, Numeric, Categorical, Text, Unknown."""
    p = prof if shares is None else prof.join(shares, "column", "left")
    if "date_share" not in p.columns:
        p = p.withColumn("date_share", F.lit(None).cast("double"))
    name, dt = F.lower(F.col("column")), F.col("dtype")
    ratio = F.try_divide(F.col("distinct"), F.col("rows"))
    ident = ((ratio > 0.95) & dt.isin("string", *INT_TYPES)) | _any_word(name, IDENTIFIER_WORDS)
    date = _is_date(dt) | ((dt == "string") & (F.coalesce(F.col("date_share"), F.lit(0.0)) > 0.85))
    numeric = dt.isin(*ALL_INT, *FLOATS) | _is_decimal(dt)
    cat = ((dt == "string") & ((F.col("distinct") < 100) | (ratio < 0.15))) | (dt == "boolean")
    cls = (F.when(ident, "Identifier").when(date, "Date").when(numeric, "Numeric").when(cat, "Categorical")
            .when(dt == "string", "Text").otherwise("Unknown"))
    return p.select(*prof.columns, cls.alias("class"))


def dashboard_classes(prof: DataFrame) -> DataFrame:
    """Identifier / Date / Numeric for numbers, Date for dates, Empty / Geo
    / Identifier / Categorical_LowCard / Categorical_HighCard / Text for text,
    Boolean.  Text uniques are counted over non-null values."""
    name, dt = F.lower(F.col("column")), F.col("dtype")
    nonnull = F.col("rows") - F.col("nulls")
    uniq = F.col("distinct_nonnull")
    num = dt.isin(*ALL_INT, *FLOATS)
    cls = (F.when(num & name.endswith("id"), "Identifier")
            .when(num & name.contains("year") & (F.col("min") >= 1900) & (F.col("max") <= 2100), "Date")
            .when(num, "Numeric")
            .when(_is_date(dt), "Date")
            .when((dt == "string") & (nonnull == 0), "Empty")
            .when((dt == "string") & _any_word(name, GEO_WORDS) & (uniq < 1000), "Geo")
            .when((dt == "string") & (uniq == nonnull), "Identifier")
            .when((dt == "string") & (uniq <= 20), "Categorical_LowCard")
            .when((dt == "string") & (uniq <= 1000), "Categorical_HighCard")
            .when(dt == "string", "Text")
            .when(dt == "boolean", "Boolean"))
    return prof.select(*prof.columns, cls.alias("class")).where(F.col("class").isNotNull())


def auto_classes(prof: DataFrame) -> DataFrame:
    """Id / numeric / date / boolean / categorical / text with null share,
    unique count (null counted) and unique ratio."""
    name, dt = F.lower(F.col("column")), F.col("dtype")
    ratio = F.try_divide(F.col("distinct"), F.col("rows"))
    ident = _any_word(name, AUTO_ID_WORDS) | (dt.isin("string", *INT_TYPES) & (ratio > 0.95))
    cls = (F.when(ident, "id").when(dt.isin(*ALL_INT, *FLOATS), "numeric").when(_is_date(dt), "date")
            .when(dt == "boolean", "boolean")
            .when((dt == "string") & ((F.col("distinct") < 50) | (ratio < 0.05)), "categorical")
            .when(dt == "string", "text").otherwise("unknown"))
    return prof.select(*prof.columns, cls.alias("class"),
                       F.try_divide(F.col("nulls"), F.col("rows")).alias("null_pct"),
                       F.col("distinct").alias("unique_count"), ratio.alias("unique_ratio"))


def planner_id_columns(prof: DataFrame) -> DataFrame:
    """C4: name says id/uuid/guid/hash (or is ``index``) and over 90 % of the
    rows carry distinct values."""
    name = F.lower(F.col("column"))
    named = _any_word(name, PLANNER_ID_WORDS) | (name == "index")
    many = (F.col("distinct_nonnull") == F.col("rows")) | (F.col("distinct_nonnull") > 0.9 * F.col("rows"))
    return prof.where(named & many).select("column")


def active_flag(prof: DataFrame) -> Column:
    """Not a helper column, and holds at least one usable cell."""
    name = F.lower(F.col("column"))
    helper = F.col("column").startswith("_") | name.contains("unnamed") | name.isin(*HELPER_NAMES)
    usable = F.when(F.col("dtype") == "string", F.col("valid") > 0).otherwise(F.col("nulls") < F.col("rows"))
    return ~helper & usable


def active_columns(prof: DataFrame) -> DataFrame:
    return prof.where(active_flag(prof))


def column_anomalies(prof: DataFrame) -> DataFrame:
    """Constant, high-cardinality, high-null and 'high-empty' flags and
    the missing severity, per column."""
    pct = F.col("missing") / F.col("rows") * 100
    return prof.select(
        "column",
        (F.col("distinct") == 1).alias("constant"),
        ((F.col("dtype") == "string") & (F.col("rows") > 10) & (F.col("distinct") / F.col("rows") > 0.9))
        .alias("high_cardinality"),
        (F.round(pct, 2) > 70).alias("high_null"),
        (F.round(pct, 2) > 30).alias("high_empty"),
        F.when(pct < 5, "Low").when(pct <= 20, "Medium").when(pct <= 50, "High").otherwise("Critical")
        .alias("missing_severity"))
