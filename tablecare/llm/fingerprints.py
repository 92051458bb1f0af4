"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range,
and the smallest hash whatever its size, so that no text with words has an
empty one.  Its size follows the document's, which is what makes containment
between very unequal documents measurable; the sketch of several documents
together is the union of theirs, cut by the same rule.  A fingerprint is the
sketch in text: its hashes in ascending order, 16 hex digits each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, slices
from .shingles import shingle_hashes

SHINGLE_WORDS = 5
FRACTION = 1 / 8
_LIMIT = np.uint64(int(2**64 * FRACTION))
#: Bytes of text in a range of ids that one task walks through, about, and the most ranges.
RANGE_BYTES, MOST_RANGES = 4 << 20, 100_000


def _cut(hashes: np.ndarray) -> np.ndarray:
    """Of sorted hashes: those below the limit, or the smallest."""
    return hashes[:max(int(np.searchsorted(hashes, _LIMIT)), min(1, len(hashes)))]


def sketch(text: str | None) -> np.ndarray:
    return _cut(shingle_hashes(text, SHINGLE_WORDS))


def fingerprint(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def hashes(fp: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fp or ""), ">u8").astype(np.uint64)


def merged(fps) -> str:
    """Fingerprint of several documents taken together."""
    parts = [hashes(f) for f in fps]
    return fingerprint(_cut(np.unique(np.concatenate(parts)))) if parts else ""


def _below(s: np.ndarray) -> np.ndarray:
    return s[:int(np.searchsorted(s, _LIMIT))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; of two sketches without hashes below the limit, whether they are equal."""
    x, y = _below(a), _below(b)
    if not len(x) and not len(y):
        return float(np.array_equal(a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    x = _below(a)
    if not len(x):
        return float(not len(a) or bool(np.isin(a, b).all()))
    return len(np.intersect1d(x, _below(b), assume_unique=True)) / len(x)


@F.pandas_udf(T.StringType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: fingerprint(sketch(t)))


@F.pandas_udf(T.DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(hashes(x), hashes(y)) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def containment_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([containment(hashes(x), hashes(y)) for x, y in zip(a, b)], dtype=float)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row: one scan, no shuffle."""
    text = F.col(f"`{text_col}`")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), fingerprint_of(text).alias("fingerprint"))


def merged_fingerprints(df: DataFrame, by: str, fp_col: str = "fingerprint") -> DataFrame:
    """One fingerprint for all documents of each value of ``by``.  Hashes are
    made distinct across the cluster before a group's are joined, so copies cost nothing."""
    rows = df.select(F.col(f"`{by}`").alias("by"), F.col(f"`{fp_col}`").alias("fp"))
    digits = F.expr("transform(sequence(1, length(fp) - 15, 16), i -> substring(fp, i, 16))")
    each = rows.select("by", F.explode_outer(F.when(F.length("fp") >= 16, digits)).alias("h")).distinct()
    limit = F.lit(f"{int(_LIMIT):016x}")  # equal width, so text order is number order
    kept = each.groupBy("by").agg(F.min("h").alias("least"), F.collect_set(F.when(F.col("h") < limit, F.col("h"))).alias("low"))
    joined = F.array_join(F.array_sort(F.when(F.col("least").isNull(), F.col("low")).otherwise(F.array_union("low", F.array("least")))), "")
    return kept.select(F.col("by").alias(by), joined.alias(fp_col))


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document beside its edited text, whose last third comes from the
    next document in descending order of ids (the first, after the last).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, held_by_edited (containment of the document in its
    edited text).  Texts that are null count as empty; rows without id come
    last, and rows of one id follow each other by their text.

    The ids are cut into ranges of about equal size (bounds from a sample; any
    bounds give the same rows).  A range's first document goes to the range
    before it as well, so that one shuffle of the texts puts every document
    beside its successor, and each task walks through sorted rows.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = min(MOST_RANGES, 1 + (size.bytes or 0) // RANGE_BYTES)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    sampled = rows.select(key.cast("double").alias("k")).sample(min(1.0, 20 * ranges / max(1, size.rows)), seed=42)
    found = sorted(r.k for r in sampled.collect())
    inner = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
    cut = Bucketizer(splits=[float("-inf"), *inner, 0.0 if not inner else inner[-1] + abs(inner[-1]) + 1, float("inf")],
                     inputCol="k", outputCol="range")
    placed = cut.transform(rows.withColumn("k", key.cast("double"))).withColumn("range", F.col("range").cast("int"))
    first = {r.range: r.first for r in placed.groupBy("range").agg(F.max(key).alias("first")).collect()}  # one row a range
    order = sorted(first)
    goes = [(r, first[r], order[(i + 1) % len(order)]) for i, r in enumerate(order)]
    border = df.sparkSession.createDataFrame(goes, "range int, first long, other int")
    with_copies = placed.join(F.broadcast(border), "range").select(
        "doc_id", "text", key.alias("key"), F.xxhash64("text").alias("tie"),
        F.explode(F.when(key == F.col("first"), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy")),
                                                        F.struct(F.col("other").alias("range"), F.lit(1).alias("copy"))))
                  .otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy"))))).alias("at"))
    walked = (with_copies.select(F.col("at.range").alias("range"), F.col("at.copy").alias("copy"), "doc_id", "key", "tie", "text")
              .repartition("range").sortWithinPartitions("range", "copy", F.desc("key"), "tie", "text"))

    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
              ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
              ("held_by_edited", pa.float64())]
    schema = pa.schema(fields)

    def result(doc, text, own, following, next_sketch):
        moved = len(text) // 3
        edited = text[:len(text) - moved] + following[:moved]
        changed = own if edited == text else sketch(edited)
        return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(changed),
                likeness(own, changed), likeness(own, next_sketch), containment(own, changed))

    def walk(batches):
        before = None  # range, copy, doc_id, text, sketch of the row before
        for part in slices(batches):
            out = []
            for rng, copy, doc, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 5))):
                own = sketch(text)
                if before and before[0] == rng and not before[1]:
                    out.append(result(before[2], before[3], before[4], text, own))
                before = (rng, copy, doc, text, own)
            if out:
                yield batch_of(schema, *zip(*out))

    ddl = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, held_by_edited double")
    return walked.mapInArrow(walk, ddl)
