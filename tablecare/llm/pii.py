"""Personal data by bootstrapped contextual extraction.

*Seeds* are what the base expressions find (email, ip, card, phone).  The
words around a seed are lexical *patterns*: the word before, the two words
before, the word before and the one after.  Every other string that could be
an identifier (a number with enough digits, something around an ``@``, groups
of hex digits between colons) is a *candidate* with patterns of its own.
Spark scores the graph of patterns and instances in rounds: a pattern's
confidence in a kind is the share of its distinct instances that are of that
kind so far (those that may be count a quarter against it), an instance's score joins the confidences of the trusted patterns
it occurs with, and instances that score high count for their patterns, in
confidence and in support, in the next round.  Rounds go on until no further
pattern is trusted; trust only grows, so they end.  Candidates beside a trusted pattern, or whose string has scored
high elsewhere, become new spans; seeds always stay.

A pattern needs ``support`` distinct seeds or confirmed instances and a ``trust`` of 0.9 at least, so
ordinary text, where numbers of all kinds follow the same words, adds nothing.

Null and empty texts have no spans; rows that repeat or lack an id get theirs
one by one; an empty table gives none.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices, stored
from .secret_scan import SPANS, of_kind, spans_type, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT, TRUST = 10, 0.9
#: What an instance that may be of the kind, but isn't known to be, counts against a pattern.
UNKNOWN = 0.25

# The base expressions.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Candidates: numbers in any grouping, something@something, hex groups between colons.
_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,3}[0-9]){5,}")
_AT = re.compile(r"@[^\s@]+")
_GROUPS = re.compile(r"[0-9A-Fa-f](?<![0-9A-Fa-f:]{2})[0-9A-Fa-f]{0,3}(?:::?[0-9A-Fa-f]{1,4}){3,7}")
_EDGE = ".,;:!?\"'()[]{}<>#$%&*"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """From every @: its domain to the right, then the local part to the left,
    not past the match before.  A local part holds no @, so each character is
    looked at once."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while m and start > after and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            found.append((start, m.end()))
            after = m.end()
            at = text.find("@", after)
        else:
            at = text.find("@", at + 1)
    return found


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base expressions' matches, sorted."""
    if not text:
        return []
    spans = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, bit set of possible kinds, end) of other identifier-like strings that touch no base span."""
    found = []
    for m in _AT.finditer(text):
        start = m.start()
        while start and not text[start - 1].isspace() and text[start - 1] not in "@<>()[]\"',;":
            start -= 1
        end = m.start() + len(m[0].rstrip(_EDGE))
        if start < m.start() and end > m.start() + 1:
            found.append((start, 1, end))
    found += [(m.start(), 2, m.end()) for m in _GROUPS.finditer(text)]
    for m in _NUMBER.finditer(text):
        n = len(_digits(m[0]))
        kinds = 4 * (12 <= n <= 19) + 8 * (7 <= n <= 15)
        if kinds:
            found.append((m.start(), kinds, m.end()))
    out, after, k = [], 0, 0
    for start, kinds, end in sorted(found):
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        if start >= after and all(end <= a or start >= b for a, _, b in taken[max(0, k - 3):k + 4]):
            out.append((start, kinds, end))
            after = end
    return out


def _word(s: str) -> str:
    bare = s.strip(_EDGE) or s
    return re.sub("[0-9]", "0", bare.lower())


def patterns(text: str, start: int, end: int, reach: int = 120) -> list[int]:
    """Hashes of the contexts of a slot: one word before, two words before, one on either side."""
    before = text[max(0, start - reach):start].split()[-3:]
    behind = text[end:end + reach].split()[:1]
    if start and not text[start - 1].isspace() and before:
        if before[-1].strip(_EDGE):
            before[-1] += "\0"  # a word glued to the slot
        else:
            before.pop()  # a bracket or quote
    left = [_word(w) for w in before[-2:]]
    right = _word(behind[0]) if behind else ""
    keys = []
    if left:
        keys += [f"1 {left[-1]}", f"s {left[-1]} {right}"]
    if len(left) == 2:
        keys.append(f"2 {left[0]} {left[1]}")
    return [xxhash.xxh64_intdigest(k.encode()) - (1 << 63) for k in keys]


def instance(text: str) -> int:
    """Hash of an identifier without its punctuation and case."""
    return xxhash.xxh64_intdigest("".join(c for c in text.lower() if c.isalnum() or c == "@").encode()) - (1 << 63)


_SLOT = "struct<start: long, end: long, seed: int, kinds: int, instance: long, patterns: array<long>>"


def slots(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: row (a number of its own), doc_id, text_key (md5 of
    the text), base (spans) and slots (seeds and candidates with their
    patterns).  One scan."""
    slot = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.int32()), ("kinds", pa.int32()),
                      ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.string()), ("base", spans_type()),
                        ("slots", pa.list_(slot))])

    def scan(batches):
        for part in slices(batches):
            base_rows, slot_rows = [], []
            for text in part.column(3).to_pylist():
                base = base_spans(text)
                found = [(s, e, k, 0) for s, k, e in base]
                found += [(s, e, -1, kinds) for s, kinds, e in candidates(text or "", base)]
                base_rows.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                slot_rows.append([{"start": s, "end": e, "seed": k, "kinds": kinds, "instance": instance(text[s:e]),
                                   "patterns": patterns(text, s, e)} for s, e, k, kinds in found])
            yield batch_of(schema, part.column(0), part.column(1), part.column(2), base_rows, slot_rows)

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.md5(F.col(f"`{text_col}`").cast("binary")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(scan, f"row long, doc_id long, text_key string, base {SPANS}, slots array<{_SLOT}>")


def bootstrap(found: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """New spans (row, text_key, start, kind, end) from stored ``slots``.

    Edges of the graph are distinct (pattern, instance) pairs, so a string or a
    context that fills a third of all rows is counted once for each partner,
    after partial aggregation.
    """
    every = found.select("row", "text_key", F.explode("slots").alias("s")).select("row", "text_key", "s.*")
    edges = stored(every.select("instance", "kinds", "seed", F.explode("patterns").alias("pattern"))
                   .groupBy("pattern", "instance")
                   .agg(F.bit_or("kinds").alias("kinds"),
                        *[F.max((F.col("seed") == k).cast("double")).alias(f"seed{k}") for k in range(len(KINDS))]))
    names = [f"score{k}" for k in range(len(KINDS))]
    unseeded = F.greatest(*[F.col(f"seed{k}") for k in range(len(KINDS))]) == 0

    def open_to(k):
        return unseeded & (F.col("kinds").bitwiseAND(1 << k) > 0) & (F.col(f"score{k}") == 0)

    scored = edges.select("*", *[F.col(f"seed{k}").alias(n) for k, n in enumerate(names)])
    before = -1
    while True:
        confidence = [(F.sum(n) / (F.count(F.lit(1)) - (1 - UNKNOWN) * F.sum(open_to(k).cast("double")) + 1)).alias(f"trust{k}")
                      for k, n in enumerate(names)]
        enough = [F.sum((F.col(n) > 0).cast("long")).alias(f"known{k}") for k, n in enumerate(names)]
        trusted = scored.groupBy("pattern").agg(*confidence, *enough)
        trusted = trusted.select("pattern", *[F.when((F.col(f"known{k}") >= support) & (F.col(f"trust{k}") >= trust), F.col(f"trust{k}"))
                                              .otherwise(0.0).alias(f"trust{k}") for k in range(len(KINDS))])
        trusted = stored(trusted.where(F.greatest(*[F.col(f"trust{k}") for k in range(len(KINDS))]) > 0))
        many = trusted.agg(sum(F.count_if(F.col(f"trust{k}") > 0) for k in range(len(KINDS)))).first()[0]
        # noisy or over the trusted patterns of an instance, for the kinds its form allows
        heard = (edges.where("kinds > 0").join(trusted, "pattern").groupBy("instance")
                 .agg(*[(1 - F.exp(F.sum(F.log(1 - F.least(F.lit(0.999), F.col(f"trust{k}")))))).alias(f"heard{k}")
                        for k in range(len(KINDS))], F.bit_or("kinds").alias("form")))
        heard = stored(heard.select("instance", *[F.when(F.col("form").bitwiseAND(1 << k) > 0, F.col(f"heard{k}")).otherwise(0.0)
                                                  .alias(f"heard{k}") for k in range(len(KINDS))]))
        if many in (0, before):
            break
        before = many
        scored = edges.join(heard, "instance", "left").select(
            *edges.columns, *[F.greatest(F.col(f"seed{k}"), F.when(F.col(f"heard{k}") >= trust, F.col(f"heard{k}")).otherwise(0.0))
                              .alias(n) for k, n in enumerate(names)])
    best = F.array_max(F.array(*[F.struct(F.col(f"heard{k}").alias("h"), F.lit(k).alias("kind")) for k in range(len(KINDS))]))
    known = heard.select("instance", best.alias("b")).where(F.col("b.h") >= trust).select("instance", F.col("b.kind").alias("kind"))
    return every.where("seed < 0").join(known, "instance").select("row", "text_key", "start", "kind", "end")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
                  trust: float = TRUST) -> DataFrame:
    """doc_id, base and ``found`` (base and new spans, sorted) of every row."""
    rows = stored(slots(df, id_col, text_col))
    new = bootstrap(rows, support, trust).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    none = F.array().cast(SPANS)
    return (rows.select("row", "doc_id", "base").join(new, "row", "left")
            .select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("new", none))).alias("found")))


def personal_data_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base spans, their digest, and all spans in text."""
    rows = personal_data(df, id_col, text_col)
    count = [of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *count, F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
                       written(F.col("found"), KINDS).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
           trust: float = TRUST) -> DataFrame:
    """``df`` with every span of personal data replaced by ``[kind]``.

    New spans depend only on the text, so they come back to the rows by its
    md5; rows of equal text share them, whatever their ids.
    """
    rows = stored(slots(df, id_col, text_col))
    new = (bootstrap(rows, support, trust).dropDuplicates(["text_key", "start", "kind", "end"])
           .groupBy("text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("__new")))
    columns = df.columns

    @F.pandas_udf("string")
    def mask(texts, added):
        out = []
        for text, more in zip(texts, added):
            spans = base_spans(text)
            if more is not None:
                spans = sorted(spans + [(s["start"], s["kind"], s["end"]) for s in more])
            parts, at = [], 0
            for start, kind, end in spans:
                if start >= at:
                    parts += [text[at:start], f"[{KINDS[kind]}]"]
                at = max(at, end)
            out.append("".join(parts) + text[at:] if spans else text)
        return pd.Series(out, dtype=object)

    keyed = df.withColumn("__key", F.md5(F.col(f"`{text_col}`").cast("binary")))
    both = keyed.join(new.withColumnRenamed("text_key", "__key"), "__key", "left")
    return both.withColumn(text_col, mask(F.col(f"`{text_col}`"), F.col("__new"))).select(*[f"`{c}`" for c in columns])
