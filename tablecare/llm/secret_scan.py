"""Secret scan: an Aho-Corasick pass over the keywords of all rules, anchored
expressions only where a keyword was hit, and checksums inside the tokens.

Kinds: ``assign`` (a name such as ``token`` given a value of 8 or more
characters), ``access`` (an access key id), ``hex`` (32 or more hex digits;
they have no keyword, so one linear scan finds them), and the tokens that
carry their own checksum: ``github`` and ``npm``, whose last six characters are
the CRC-32 of the thirty before them in base 62.  Null and empty texts have no
secrets.  Positions are code points; spans of one kind do not overlap.
"""

from __future__ import annotations

import functools
import re
import string
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices

BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("github", "npm")

# The rules of the kinds.
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f][0-9a-f]{31,}")
_CHECKED = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
            "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("assign", _NAMES), ("access", ("akia",)), ("npm", ("npm_",)),
                        ("github", tuple(f"gh{c}_" for c in "pousr"))):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end), in that order."""
    if not text:
        return []
    lower = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z only: positions stay
    spans, after = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in _automaton().iter(lower):
        start = last - size + 1
        if start < after[kind]:
            continue  # inside the match before it
        if kind == "assign":
            m = _ASSIGN.match(text, start)
            good = m and len(m[1]) >= 8
        elif kind == "access":
            m = _ACCESS.match(text, start)
            good = m and m.end() - start >= 16
        else:
            m = _CHECKED[kind].match(text, start)
            good = m and base62_crc(m[1]) == m[2]
        if m:
            after[kind] = m.end()
        if good:
            spans.append((start, KINDS.index(kind), m.end()))
    spans += [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


SPANS = "array<struct<start: long, kind: int, end: long>>"


def spans_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, joined by commas, of spans sorted by start and kind."""
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def of_kind(spans: str, kind: int) -> Column:
    """How many spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``, the spans of every row: one scan, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("found", spans_type())])

    def scan(batches):
        for part in slices(batches):
            yield batch_of(schema, part.column(0), [[dict(zip(("start", "kind", "end"), s)) for s in secret_spans(t)]
                                                    for t in part.column(1).to_pylist()])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, found {SPANS}")


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, a digest of their spans, and all spans in text."""
    found = secrets(df, id_col, text_col)
    base = F.filter("found", lambda s: s["kind"] < len(BASE_KINDS))
    count = [of_kind("found", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(written(base, KINDS).cast("binary"), 256).alias("base_sha256"),
                        written(F.col("found"), KINDS).alias("spans"))
