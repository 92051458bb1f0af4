"""Product codes of vectors, their nearest entries found by Orchard's search.

Vectors become integers floor(scale * x) and are cut into ``parts`` equal
parts.  The codebook of a part starts as that part of the first vectors by id;
each round assigns every part to its nearest entry and moves every entry to its
parts' mean, rounded down.

The nearest entry is found by *Orchard's search*: every entry keeps the list of
all entries sorted by distance from itself.  A search starts at some entry,
reads that entry's list from the front, and when it meets a nearer entry goes
on in the list of that one.  It stops where the list goes beyond twice the
current distance: by the triangle inequality nothing nearer, or equally near,
can follow.  Entries it has seen are marked and not compared again.  Searches
of a batch advance together: those that stand at one place of one list read its
next entries in one product.

Distances are whole numbers and exact: in doubles below 2**53, in 64-bit
integers above.  Rounds are one scan each; a task sums its own rows before the
shuffle, and only the codebooks, of fixed size, go through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, ship, stored

#: A list is read up to these places at a time, further ones four times as far; entries a search tries before its first list.
FIRST_READS, STARTS = (16, 64), 8
#: Vectors whose searches advance together.
_ROWS = 1 << 16


class Codebook:
    """Entries of one part (k, width; int64) with their sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.k = len(entries)
        most = 2 * (int(np.abs(entries).max()) if entries.size else 0)
        self.norm = (entries * entries).sum(axis=1)
        apart = self.norm[:, None] + self.norm - 2 * (entries @ entries.T)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.most = most
        self.ends = [e for e in FIRST_READS if e < self.k]
        while not self.ends or self.ends[-1] < self.k:
            self.ends.append(min(self.k, 4 * self.ends[-1] if self.ends else FIRST_READS[0]))
        # entries far from each other, to start from: each next one is the farthest from those before it
        starts, gap = [0], apart[0].copy()
        while len(starts) < min(STARTS, self.k):
            starts.append(int(gap.argmax()))
            gap = np.minimum(gap, apart[starts[-1]])
        self.starts = np.array(sorted(set(starts)))

    def distances(self, x: np.ndarray, norm: np.ndarray, some: np.ndarray) -> np.ndarray:
        e = self.entries[some].astype(x.dtype)
        return norm[:, None] + self.norm[some].astype(x.dtype) - 2 * (x @ e.T)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, the lowest of equals; squared distance; entries compared) for each row of x."""
        n, width = x.shape
        if not n or not width:
            return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        top = max(self.most, 2 * int(np.abs(x).max()))
        x = x.astype(np.float64 if top * top * width < 1 << 53 else np.int64)
        norm = (x * x).sum(axis=1)
        first = self.distances(x, norm, self.starts)
        at = first.argmin(axis=1)
        near, best = self.starts[at], first[np.arange(n), at]
        marked = np.zeros((n, self.k), bool)
        marked[:, self.starts] = True
        compared, place = first.size, np.zeros(n, np.int64)
        active = np.arange(n)
        blocks = len(self.ends)
        while len(active):
            spot = near[active] * blocks + place[active]
            by = np.argsort(spot, kind="stable")
            active, spot = active[by], spot[by]
            cuts = np.nonzero(np.diff(spot, prepend=-1))[0]
            going = np.ones(len(active), bool)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(active)]):
                who, (entry, block) = active[a:b], divmod(int(spot[a]), blocks)
                until = self.ends[block]
                some = np.sort(self.order[entry, self.ends[block - 1] if block else 0:until])  # by index, so the first of equals is the lowest
                some = some[~marked[who][:, some].all(axis=0)]  # what all of them have seen is not compared again
                better = np.zeros(b - a, bool)
                if len(some):
                    d = self.distances(x[who], norm[who], some)
                    compared += d.size
                    marked[who[:, None], some] = True
                    low = d.argmin(axis=1)
                    least, found = d[np.arange(b - a), low], some[low]
                    better = (least < best[who]) | ((least == best[who]) & (found < near[who]))
                    moved = who[better]
                    near[moved], best[moved], place[moved] = found[better], least[better], 0
                place[who[~better]] += 1
                if until == self.k:
                    going[a:b] = better
                else:  # squared: no further than twice the distance
                    going[a:b] = better | (self.apart[entry, until] <= 4 * best[who])
            active = active[going]
        return near, best.astype(np.int64), compared


def usable(vector: Column) -> Column:
    """Whether a vector has components, and all of them are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: F.coalesce(
        ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))), F.lit(False))


def _together(batches, rows: int):
    """The batches joined to ``rows`` rows or a little more: more searches stand at one place."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    whole = np.floor(flat.astype(np.float64) * scale)
    if whole.size and np.abs(whole).max() ** 2 * 4 * width >= 2.0 ** 62:
        raise ValueError("a component is too large for errors of 64 bits")
    return whole.astype(np.int64).reshape(-1, width)


def _kept(df: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    vector = F.col(f"`{vector_col}`")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    return (df.where(usable(vector)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"), label.alias("label")))


def train(kept: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """The final entries of each part.  ``kept``: vec_id, vector."""
    spark, each = kept.sparkSession, width // parts
    firsts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()  # of fixed size
    start = _matrix(pa.array([r.vector for r in firsts], pa.list_(pa.float64())), width, scale)
    books = [start[:, p * each:(p + 1) * each] for p in range(parts)]
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def assign(batches, sent=sent):
            search = [Codebook(b) for b in sent.value]
            n = np.zeros((parts, len(search[0].entries)), np.int64)
            total = np.zeros((*n.shape, each), np.int64)
            for part in _together(batches, _ROWS):
                x = _matrix(part.column(0), width, scale)
                for p, s in enumerate(search):
                    mine = x[:, p * each:(p + 1) * each]
                    code = s.nearest(mine)[0]
                    here = np.bincount(code, minlength=s.k)
                    n[p] += here
                    seen = np.nonzero(here)[0]
                    if len(seen):
                        total[p, seen] += np.add.reduceat(mine[np.argsort(code, kind="stable")], (np.cumsum(here) - here)[seen])
            used = np.nonzero(n.ravel())[0]
            yield batch_of(schema, used.astype(np.int32), n.ravel()[used], list(total.reshape(-1, each)[used]))

        sums = [F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(each)]
        found = (kept.select("vector").mapInArrow(assign, "slot int, n long, total array<long>")
                 .groupBy("slot").agg(F.sum("n").alias("n"), *sums).collect())  # parts x entries rows
        books = [b.copy() for b in books]
        for r in found:
            p, e = divmod(r.slot, len(books[0]))
            books[p][e] = [r[f"t{i}"] // r.n for i in range(each)]
        sent.unpersist()
    return books


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
                 parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector kept.

    Vectors that are null or empty, or hold a null or a number that isn't finite, are dropped; so are vectors of
    another length than the first kept one by id, which no codebook fits.  Ids may repeat or be null (null ids come
    last in the order that starts the codebooks, and repeated ids in order of their vectors).  With fewer vectors
    than ``entries``, the codebooks have as many entries as there are vectors.  The length must be a multiple of
    ``parts``, and components must be small enough for errors of 64 bits (below 2**18 at a length of 64), or a
    ValueError says so.  ``label_error`` sums over equal labels, nulls together.  An empty table gives none."""
    spark = df.sparkSession
    ship(spark)
    kept = _kept(df, id_col, vector_col, label_col)
    label_type = kept.schema["label"].dataType.simpleString()
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    ddl = f"vec_id long, code string, error long, label {label_type}"
    if not first:
        coded, digest = spark.createDataFrame([], ddl), hashlib.sha256(b"").hexdigest()
    else:
        width = len(first[0].vector)
        if width % parts:
            raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
        kept = kept.where(F.size("vector") == width)
        books = train(kept, width, parts, entries, rounds, scale)
        digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
        sent, each = spark.sparkContext.broadcast(books), width // parts

        def code(batches):
            search = [Codebook(b) for b in sent.value]
            for part in _together(batches, _ROWS):
                x = _matrix(part.column(1), width, scale)
                found = [s.nearest(x[:, p * each:(p + 1) * each])[:2] for p, s in enumerate(search)]
                codes = np.stack([c for c, _ in found], axis=1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(["".join(f"{c:02x}" for c in row) for row in codes], pa.string()),
                     pa.array(sum(e for _, e in found), pa.int64()), part.column(2)], names=["vec_id", "code", "error", "label"])

        coded = stored(kept.mapInArrow(code, ddl))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
