"""Packing of documents into training sequences: first-fit decreasing over a
tournament tree of bin capacities, run in randomised groups of documents.

A document longer than a sequence is cut at multiples of the sequence length;
its last piece, and every shorter document, stays in one piece.  The groups
are drawn by a seeded hash, so that each is a like sample of the corpus; their
number follows the size of the input, which bounds a group at every size.
"""

from __future__ import annotations

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import batch_of, slices
from .token_counts import DEFAULT_TOKENIZER

#: Pieces that a group holds, about; bins of a group stay below 2**32.
GROUP_PIECES = 4096


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every size, for sizes given in decreasing order.

    The leaves of the tree are the free places of the bins from left to right
    and a node holds the larger of its children, so the first bin that fits is
    found by going down, left where it can be: O(log bins) a piece.
    """
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    free = [capacity] * (2 * width)
    placed = []
    for size in sizes:
        if not 0 <= size <= capacity:
            raise ValueError(f"a piece of {size} does not fit a sequence of {capacity}")
        node = 1
        while node < width:
            node *= 2
            if free[node] < size:
                node += 1
        placed.append((node - width, capacity - free[node]))
        free[node] -= size
        node //= 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
    return placed


def cut_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
                  end_id: int = 1, tokenizer: str = DEFAULT_TOKENIZER, seed: int = 42,
                  with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, start, length, ids_crc32,
    doc_tokens, draw (a random number of the document), and with ``with_ids`` the ids.

    Every document's ids end with ``end_id``, so a null or empty text is one
    piece of one id.  Rows that repeat are documents of their own.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("draw", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        bpe = byte_bpe(public_tokenizers.path(tokenizer))
        for part in slices(batches):
            rows = []
            for doc, draw, text in zip(*(c.to_pylist() for c in part.columns)):
                ids = bpe.ids(text) + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start:4 * (start + length)]
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), total, draw)
                    rows.append(row + (piece,) if with_ids else row)
            yield batch_of(schema, *zip(*rows))
        bpe.forget()

    draw = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.monotonically_increasing_id())
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), draw.alias("draw"), F.col(f"`{text_col}`").alias("text"))
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long"
    return rows.mapInArrow(cut, ddl + ", ids binary" * with_ids)


def group_count(df: DataFrame, text_col: str = "text", length: int = 2048, group_pieces: int = GROUP_PIECES) -> int:
    """Groups for about ``group_pieces`` pieces each: a text has no more ids
    than bytes, so documents + bytes / length bounds the pieces."""
    size = df.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("bytes")).first()
    return max(1, -(-(size.docs + (size.bytes or 0) // length) // group_pieces))


def pack(pieces: DataFrame, groups: int, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, start, length, draw and any others) with
    sequence_id and offset.  Within a group, equal lengths are placed in order
    of doc_id and start, so the result depends only on the rows."""
    keep = [f for f in pieces.schema if f.name != "draw"]

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("draw", "ascending")])
        bins, offsets = zip(*first_fit_decreasing(group["length"].to_pylist(), capacity))
        base = group["group"][0].as_py() << 32
        return (group.select([f.name for f in keep])
                .append_column("sequence_id", pa.array([base + b for b in bins], pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", sequence_id long, offset long"
    return (pieces.withColumn("group", F.expr(f"pmod(draw, {int(groups)})"))
            .groupBy("group").applyInArrow(place, schema))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1,
                   tokenizer: str = DEFAULT_TOKENIZER, group_pieces: int = GROUP_PIECES, seed: int = 42,
                   with_ids: bool = False) -> DataFrame:
    """Pieces of all documents of ``df`` with their place: one row per piece."""
    pieces = cut_documents(df, id_col, text_col, length, end_id, tokenizer, seed, with_ids)
    return pack(pieces, group_count(df, text_col, length, group_pieces), length)


def sequences(packed: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from pieces packed ``with_ids``: sequence_id,
    n_ids and ids (binary, unsigned 32-bit), padded to ``length`` unless the
    ids filled are a power of two."""
    pad = pad_id.to_bytes(4, "little")

    def join(group: pa.Table) -> pa.Table:
        ids = b"".join(group.sort_by("offset")["ids"].to_pylist())
        n = len(ids) // 4
        if n & (n - 1):
            ids += pad * (length - n)
        return pa.table({"sequence_id": group["sequence_id"].slice(0, 1), "n_ids": pa.array([n], pa.int64()), "ids": [ids]})

    return packed.groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_ids long, ids binary")
