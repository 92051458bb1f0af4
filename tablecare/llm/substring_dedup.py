"""Exact repeats between documents, found by fixed-block anchors, and removed.

A run of ``window`` words that also starts in a document of a smaller id is a
repeat, and the words under it go from the later document.  A window of w words
always holds a whole block of (w + 1) // 2 words of every document that is cut
into such blocks from its first word on.  So:

1. *Index and probes.*  The non-overlapping blocks of every document are the
   index; its rolling windows of a block's length are the probes.  Both travel
   as hashes: documents are read in chunks of about ``CHUNK_WORDS`` words, and
   a chunk sends each distinct hash once, marked if one of its blocks has it.
   A place hits if its hash is in the index and in another chunk as well; what
   occurs more than once inside a chunk is taken as a hit there and then.
2. *Extension.*  Hits are extended on the documents' words to both sides, as
   far as a window around the block can reach, and the windows' 128-bit hashes
   (64 of them and the bucket, from another hash) decide: chunks again send
   each distinct one once, with the smallest id that has it, and learn the
   smallest id of all.  Windows that a smaller id has join to the maximal
   repeats, whose words go.

A hash that a third of all documents share costs one entry a chunk in either
step, so no document is ever paired with another.  Entries travel packed, and
so do the places found on their way back to the documents, both by their place
in the chunk, whose list of documents travels once; the number of buckets
follows the number of words.  Documents of equal
text are one in step 2: only the smallest id's words are looked at, later
copies go whole (if they hold a window).

Nulls: a null text has no words; a document with a null id keeps everything
and takes nothing from others.  Ids that repeat are equal, not smaller, so
neither takes from the other.  Every row of the input gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, marked, ship, slices, stored
from .shingles import mix

#: Words of a chunk, about (a document is never cut), and entries that a bucket holds, about.
CHUNK_WORDS, BUCKET_ENTRIES = 1 << 20, 1 << 21
#: Words whose hashes a worker remembers; a full memory is emptied.
_REMEMBERED = 150_000
# A row of entries has hashes; one of places that a chunk decided itself has only gaps; a chunk's list of documents has
# neither, but rows and starts.
_ENTRY = "bucket int, chunk long, hashes binary, flags binary, gaps binary, ids binary, rows binary, starts binary"
_ENTRIES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64())] + [(n, pa.binary()) for n in ("hashes", "flags", "gaps", "ids", "rows", "starts")])
_FOUND = pa.schema([("chunk", pa.int64()), ("gaps", pa.binary()), ("rows", pa.binary()), ("starts", pa.binary())])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORD_HASHES = _Hashes()


def words(text: str | None) -> list[bytes]:
    """The maximal runs without ASCII white space (0x20, 0x09 to 0x0D), unchanged."""
    return text.encode().split() if text else []


class _Rolling:
    """Hashes of all runs of ``k`` words of some word hashes, by prefix sums modulo 2**64."""

    def __init__(self, times: int):
        self.times, self.power, self.back = times, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, w: np.ndarray, k: int) -> np.ndarray:
        if len(self.power) < len(w):
            def powers(x):
                out = np.full(len(w), x, np.uint64)
                out[0] = 1
                return np.cumprod(out, dtype=np.uint64)
            self.power, self.back = powers(self.times), powers(pow(self.times, -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * self.power[:len(w)], dtype=np.uint64)])
        n = len(w) - k + 1
        return mix((sums[k:] - sums[:n]) * self.back[:n])


_FIRST, _SECOND = _Rolling(0x9E3779B97F4A7C15), _Rolling(0xC2B2AE3D27D4EB4F)


class _Chunk:
    """Some documents laid one after the other: ids, rows (keys of their rows), word hashes."""

    def __init__(self):
        self.ids, self.rows, self.words, self.size = [], [], [], 0

    def add(self, doc: int, row: int, found: list[bytes]) -> None:
        self.ids.append(doc)
        self.rows.append(row)
        self.words.append(np.fromiter(map(_WORD_HASHES.__getitem__, found), np.uint64, len(found)))
        self.size += len(found)

    def laid(self):
        """(ids, rows, starts, lengths, all word hashes)"""
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        return (np.array(self.ids, np.int64), np.array(self.rows, np.int64), np.cumsum(lengths) - lengths, lengths,
                np.concatenate(self.words))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all lowest ones first: small numbers leave runs of zeros, which compress to nothing."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(dtype).ravel()


def _gaps(places: np.ndarray) -> bytes:
    """Places in increasing order."""
    return _planes(np.diff(places, prepend=0).astype(np.uint32))


def _from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint32), dtype=np.int64)


def _entries(buckets: int, rows: np.ndarray, starts: np.ndarray, decided: np.ndarray, bucket, key, flag, place, ids):
    """Batches of ``_ENTRIES`` of a chunk: its documents, the places decided in it, and for each bucket its entries, in
    order of their places, with the ids of their documents if asked for."""
    chunk = xxhash.xxh3_64_intdigest(rows.tobytes()) - (1 << 63)
    home, none = chunk % buckets, None
    out = [(home, chunk, none, none, none, none, rows.tobytes(), _planes(starts.astype(np.uint64)))]
    if len(decided):
        out.append((home, chunk, none, none, _gaps(np.sort(decided)), none, none, none))
    order = np.lexsort((place, bucket))
    bucket, key, flag, place = bucket[order], key[order], flag[order], place[order]
    ids = ids[order] if ids is not None else None
    cuts = np.nonzero(np.diff(bucket, prepend=-1))[0]
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        out.append((int(bucket[a]), chunk, key[a:b].tobytes(), np.packbits(flag[a:b]).tobytes(), _gaps(place[a:b]),
                    _planes(ids[a:b]) if ids is not None else none, none, none))
    for at in range(0, len(out), 4096):
        yield batch_of(_ENTRIES, *zip(*out[at:at + 4096]))


def _unpacked(group: pa.Table, dtype):
    """(hashes, flags, number of the row, ids) of all entries of a bucket."""
    parts = []
    for i, (hashes, flags, ids) in enumerate(zip(*(group[c].to_pylist() for c in ("hashes", "flags", "ids")))):
        key = np.frombuffer(hashes, dtype)
        parts.append((key, np.unpackbits(np.frombuffer(flags, np.uint8), count=len(key)).astype(bool), np.full(len(key), i, np.int64),
                      _from_planes(ids, np.int64) if ids is not None else np.zeros(0, np.int64)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _runs_of(key: np.ndarray, second: np.ndarray | None = None):
    """Order that brings equal keys together, the first of each run, and the run of each ordered entry."""
    order = np.argsort(key, kind="stable") if second is None else np.lexsort((second, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    if second is not None:
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.nonzero(new)[0], np.cumsum(new) - 1


def anchors(docs: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """Entries of step 1 (and hits inside a chunk) of ``docs`` (doc_id, row, text)."""
    shift = np.uint64(32)

    def send(chunk: _Chunk):
        ids, rows, starts, lengths, w = chunk.laid()
        if len(w) < block:
            return
        h = _FIRST(w, block)
        doc = np.repeat(np.arange(len(ids)), lengths)[:len(h)]
        place = np.nonzero(np.arange(len(h)) + block <= (starts + lengths)[doc])[0]
        h, doc = h[place], doc[place]
        in_index = (place - starts[doc]) % block == 0
        bucket = ((h >> shift) % np.uint64(buckets)).astype(np.int32)
        low = h.astype(np.uint32)
        order, first, run = _runs_of((bucket.astype(np.uint64) << shift) | low)
        flag = np.logical_or.reduceat(in_index[order], first)
        size = np.diff(first, append=len(order))
        again = order[size[run] > 1]  # more than once in this chunk
        some = order[first]
        yield from _entries(buckets, rows, starts, place[again], bucket[some], low[some], flag, place[some], None)

    def read(batches):
        chunk = _Chunk()
        for part in slices(batches):
            for doc, row, text in zip(*(c.to_pylist() for c in part.columns)):
                found = words(text)
                if len(found) >= window:
                    chunk.add(doc, row, found)
                    if chunk.size >= CHUNK_WORDS:
                        yield from send(chunk)
                        chunk = _Chunk()
        if chunk.size:
            yield from send(chunk)

    return docs.select("doc_id", "row", "text").mapInArrow(read, _ENTRY)


def _gathered(entries: DataFrame, decide, dtype) -> DataFrame:
    """(row, places), one row a document: what ``decide`` picks in each bucket, and what chunks decided themselves."""
    def pick(group: pa.Table) -> pa.Table:
        asked = pc.is_valid(group["hashes"])
        out = [group.filter(pc.invert(asked)).select(_FOUND.names)]
        group = group.filter(asked)
        if group.num_rows:
            hashes, flags, source, ids = _unpacked(group, dtype)
            kept = decide(hashes, flags, ids)
            ends = np.cumsum(np.bincount(source, minlength=group.num_rows))
            rows = []
            for chunk, gaps, a, b in zip(group["chunk"].to_pylist(), group["gaps"].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                if kept[a:b].any():
                    rows.append((chunk, _gaps(_from_gaps(gaps)[kept[a:b]]), None, None))
            if rows:
                out.append(pa.Table.from_batches([batch_of(_FOUND, *zip(*rows))]))
        return pa.concat_tables(out)

    def bring(group: pa.Table) -> pa.Table:
        lists = [(r, s) for r, s in zip(group["rows"].to_pylist(), group["starts"].to_pylist()) if r is not None]
        rows, starts = np.frombuffer(lists[0][0], np.int64), _from_planes(lists[0][1], np.uint64).astype(np.int64)
        places = np.sort(np.concatenate([np.zeros(0, np.int64), *(_from_gaps(g) for g in group["gaps"].to_pylist() if g is not None)]))
        doc = np.searchsorted(starts, places, side="right") - 1
        cuts = np.nonzero(np.diff(doc, prepend=-1))[0]
        found = [(int(rows[doc[a]]), (places[a:b] - starts[doc[a]]).astype(np.uint32).tobytes())
                 for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)])]
        return pa.table({"row": pa.array([r for r, _ in found], pa.int64()), "places": pa.array([p for _, p in found], pa.binary())})

    found = entries.groupBy("bucket").applyInArrow(pick, "chunk long, gaps binary, rows binary, starts binary")
    # rows equal in id and text find the same places that matter
    return found.groupBy("chunk").applyInArrow(bring, "row long, places binary").dropDuplicates(["row"])


def _shared(hashes, flags, ids):
    """Entries in the index that another chunk has as well."""
    order, first, run = _runs_of(hashes)
    shared = np.logical_or.reduceat(flags[order], first) & (np.diff(first, append=len(order)) > 1)
    out = np.zeros(len(hashes), bool)
    out[order] = shared[run]
    return out


def _later(hashes, flags, ids):
    """Entries whose hash a smaller id has."""
    order, first, run = _runs_of(hashes)
    least = np.minimum.reduceat(ids[order], first)
    out = np.zeros(len(hashes), bool)
    out[order] = ids[order] > least[run]
    return out


def extensions(hits: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """Entries of step 2 (and windows decided inside a chunk) of ``hits`` (doc_id, row, text, places: packed
    places of hits)."""
    def send(chunk: _Chunk, hit: list[np.ndarray]):
        ids, rows, starts, lengths, w = chunk.laid()
        # from a hit, windows reach back over its left words and forth over its right ones
        marks = np.zeros(len(w) + 1, np.int64)
        for s, n, p in zip(starts, lengths, hit):
            np.add.at(marks, s + np.maximum(p.astype(np.int64) - (window - block), 0), 1)
            np.add.at(marks, s + np.minimum(p.astype(np.int64), n - window) + 1, -1)
        place = np.nonzero(np.cumsum(marks)[:len(w) - window + 1] > 0)[0]
        doc = np.searchsorted(starts, place, side="right") - 1
        key, other = _FIRST(w, window)[place], _SECOND(w, window)[place]
        order, first, run = _runs_of(key, other)
        least = np.minimum.reduceat(ids[doc[order]], first)
        later = order[ids[doc[order]] > least[run]]
        some = order[ids[doc[order]] == least[run]]  # of one document, as a rule
        bucket = (other[some] % np.uint64(buckets)).astype(np.int32)
        yield from _entries(buckets, rows, starts, place[later], bucket, key[some], np.zeros(len(some), bool), place[some], ids[doc[some]])

    def read(batches):
        chunk, hit = _Chunk(), []
        for part in slices(batches):
            for doc, row, text, places in zip(*(c.to_pylist() for c in part.columns)):
                chunk.add(doc, row, words(text))
                hit.append(np.frombuffer(places, np.uint32))
                if chunk.size >= CHUNK_WORDS:
                    yield from send(chunk, hit)
                    chunk, hit = _Chunk(), []
        if chunk.size:
            yield from send(chunk, hit)

    return hits.select("doc_id", "row", "text", "places").mapInArrow(read, _ENTRY)


def _buckets(words_bound: int) -> int:
    return 1 + words_bound // BUCKET_ENTRIES


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``: the union of the maximal repeats."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + window, n), -1)
    return np.cumsum(marks)[:n] > 0


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, text, whole, places): every row of ``df``, with the packed starts of the windows that a smaller id has
    (null: none), or ``whole`` where the text is a later copy of another and holds a window."""
    ship(df.sparkSession)
    block = (window + 1) // 2
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    # a word and the space after it are two bytes at least; words are about six
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _buckets(size // 6)
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    hits = stored(_gathered(anchors(known, block, window, buckets), _shared, np.uint32))
    copies = known.select("doc_id", "row", F.xxhash64("text").alias("low"), F.xxhash64(F.lit(1), "text").alias("high"))
    first = copies.groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    later = copies.join(first.where("least < most"), ["low", "high"]).where("doc_id > least").select("row").distinct()
    hit = hits.withColumn("whole", F.lit(False))
    told = stored(hit.join(later, "row", "left_anti").unionByName(
        later.select("row", F.lit(None).cast("binary").alias("places"), F.lit(True).alias("whole"))))
    near = stored(marked(docs, told, "row").join(told, "row", "left"))
    starts = stored(_gathered(extensions(near.where("places IS NOT NULL"), block, window, buckets), _later, np.uint64)
                    .withColumnRenamed("places", "starts"))
    found = near.join(starts, "row", "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), F.col("starts").alias("places"))
    return found.unionByName(marked(docs, told, "row", False).select(
        "doc_id", "text", F.lit(False).alias("whole"), F.lit(None).cast("binary").alias("places")))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and text (the words kept, joined by one space) of every row of ``df``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def cut(batches):
        for part in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, whole, places in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                found = words(text)
                n = len(found)
                if whole and n >= window:
                    found = []
                elif places:
                    gone = covered(n, np.frombuffer(places, np.uint32).astype(np.int64), window)
                    found = [w for w, g in zip(found, gone.tolist()) if not g]
                n_words.append(n)
                n_removed.append(n - len(found))
                kept.append(b" ".join(found).decode())
            yield batch_of(schema, part.column(0), n_words, n_removed, kept)

    return repeats(df, id_col, text_col, window).mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")


def substring_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every row."""
    return without_repeats(df, id_col, text_col, window).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
