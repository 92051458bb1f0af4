"""Benchmark decontamination: every training passage is a query against a BM25
inverted index of the test items, pruned by block maxima (WAND), and hits are
verified by the overlap of question and answer.

A document is cut into chunks of ``chunk`` words (at least as many as the
longest item has), and every two neighbouring chunks are a passage, so an item
lies whole in one passage at least.  A passage's score for an item is the BM25
sum over its distinct words, divided by the item's own score: 1 if it holds
all of the item's words.  All items at ``THRESHOLD`` or more are retrieved.

Bounds prune in two steps.  Words in many items are set aside: what they can
add to an item is fixed by the item.  For the other words, block maxima over
small blocks of items bound each (passage, block); this runs on numpy arrays
over a slice of documents at once, and only passages with a block whose bound
reaches the threshold are searched, by document-at-a-time WAND with block
maxima.  No bound drops an item that reaches the threshold.

Items are indexed in parts of at most ``PART_ITEMS``; each part is one pass
over the documents.  Null and empty texts hold nothing; items without words
are in no index; items or documents that repeat are handled each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, batch_of, ship, slices, stored

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.7
LEAST_CHUNK = 64
BLOCK_ITEMS = 4
PART_ITEMS = 5000

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is an item's last sentence; of one sentence alone, its last third."""
    parts = [w for w in (words(s) for s in _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = words(text)
    cut = len(w) - max(1, len(w) // 3)
    return w[:cut], w[cut:]


def _grams(w: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def overlap(part: list[str], passage: set[tuple[str, ...]]) -> float:
    """Share of the part's runs of three words (fewer, if it is shorter) that the passage has."""
    grams = _grams(part)
    return sum(g in passage for g in grams) / len(grams) if grams else 1.0


@dataclass
class Statistics:
    """Of all items: their number, mean and greatest length in words, and in how many items a word stands (at least
    the words of the index that uses this)."""
    items: int
    mean: float
    longest: int
    held: dict[str, int]

    @classmethod
    def of(cls, found: list[Counter]) -> Statistics:
        lengths = [sum(c.values()) for c in found]
        return cls(len(found), sum(lengths) / max(1, len(lengths)) or 1, max(lengths, default=0), Counter(w for c in found for w in c))


@dataclass
class Index:
    """Inverted index of some items; weights are shares of the item's own score, by the statistics of all items."""
    ids: list[int]
    texts: list[str]
    statistics: Statistics | None = None
    terms: dict[str, int] = field(init=False)

    def __post_init__(self):
        found = [Counter(words(t)) for t in self.texts]
        lengths = [sum(c.values()) for c in found]
        whole = self.statistics or Statistics.of(found)
        mean = whole.mean
        held = Counter(w for c in found for w in c)
        idf = {w: math.log(1 + (whole.items - whole.held[w] + 0.5) / (whole.held[w] + 0.5)) for w in held}
        weights = [{w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean)) for w, tf in c.items()}
                   for c, n in zip(found, lengths)]
        self.chunk = max(LEAST_CHUNK, whole.longest)
        self.parts = [question_answer(t) for t in self.texts]
        # items in order of their rarest word, so that blocks are alike; the rarer words get the lower numbers
        self.terms = {w: i for i, w in enumerate(sorted(held, key=lambda w: (held[w], w)))}
        own = [sum(w.values()) for w in weights]
        self.shares = [{self.terms[t]: x / s for t, x in w.items()} if s else {} for w, s in zip(weights, own)]
        # as many of the most widespread words are set aside as leave every item half the threshold
        aside, rest = np.zeros(len(found)), [0.0] * len(found)
        self.essential = len(self.terms)
        holders = [[] for _ in self.terms]
        for i, s in enumerate(self.shares):
            for t in s:
                holders[t].append(i)
        self.holders = holders
        for t in range(len(self.terms) - 1, -1, -1):
            if len(holders[t]) < 3 or any(aside[i] + self.shares[i][t] > THRESHOLD / 2 for i in holders[t]):
                break
            for i in holders[t]:
                aside[i] += self.shares[i][t]
            self.essential = t
        blocks = -(-len(found) // BLOCK_ITEMS)
        self.base = np.array([aside[b * BLOCK_ITEMS:(b + 1) * BLOCK_ITEMS].max() for b in range(blocks)])
        starts, block, most = [0], [], []
        for t in range(self.essential):
            tops: dict[int, float] = {}
            for i in holders[t]:
                tops[i // BLOCK_ITEMS] = max(tops.get(i // BLOCK_ITEMS, 0.0), self.shares[i][t])
            block += tops
            most += tops.values()
            starts.append(len(block))
        self.starts, self.block, self.most = np.array(starts), np.array(block, np.int64), np.array(most)
        self.top = [max((self.shares[i][t] for i in holders[t]), default=0.0) for t in range(len(self.terms))]

    def passages(self, found: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(document, chunk) of the passages whose bound reaches the threshold
        for some block, from the documents' term numbers (-1: in no item)."""
        nb = len(self.base)
        counts = [-(-len(f) // self.chunk) for f in found]
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        chunk = np.concatenate([first[d] + np.arange(len(f)) // self.chunk for d, f in enumerate(found)])
        term = np.concatenate(found)
        keep = (term >= 0) & (term < self.essential)
        pairs = np.unique(chunk[keep] * self.essential + term[keep]) if self.essential else np.empty(0, np.int64)
        chunk, term = pairs // max(1, self.essential), pairs % max(1, self.essential)
        length = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) \
            if len(term) else np.empty(0, np.int64)
        cell, bound = np.repeat(chunk, length) * nb + self.block[at], self.most[at]
        # a passage is a chunk and the one after it; a document's last chunk alone is part of the passage before
        inner = np.ones(int(first[-1]) + 1, bool)
        inner[first[:-1]] = False
        before = inner[cell // nb]
        cells, where = np.unique(np.concatenate([cell, cell[before] - nb]), return_inverse=True)
        total = np.bincount(where, np.concatenate([bound, bound[before]]), len(cells)) + self.base[cells % nb]
        for c in np.unique(cells[total >= THRESHOLD - 1e-9] // nb):
            d = int(np.searchsorted(first, c, "right")) - 1
            yield d, int(c - first[d])

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items at the threshold for a passage's distinct terms: WAND with block maxima."""
        lists = sorted((self.holders[t], t) for t in terms if self.holders[t])
        cursor = {t: 0 for _, t in lists}
        live = [(items, t) for items, t in lists]
        out = []
        while live:
            live.sort(key=lambda x: x[0][cursor[x[1]]])
            bound, pivot = 0.0, None
            for items, t in live:
                bound += self.top[t]
                if bound >= THRESHOLD - 1e-9:
                    pivot = items[cursor[t]]
                    break
            if pivot is None:
                return out
            at = [(items, t) for items, t in live if items[cursor[t]] <= pivot]
            end = (pivot // BLOCK_ITEMS + 1) * BLOCK_ITEMS
            tight = sum(self._block_top(t, pivot // BLOCK_ITEMS) for _, t in at)
            if tight < THRESHOLD - 1e-9:
                # no item before the next block, or before the next list, can reach it
                ahead = [items[cursor[t]] for items, t in live if items[cursor[t]] > pivot]
                goal = max(pivot + 1, min([end, *ahead]))
            else:
                score = sum(self.shares[pivot].get(t, 0.0) for _, t in at)
                if score >= THRESHOLD - 1e-9:
                    out.append((pivot, score))
                goal = pivot + 1
            for items, t in at:
                cursor[t] = bisect_left(items, goal, cursor[t])
            live = [(items, t) for items, t in live if cursor[t] < len(items)]
        return out

    def _block_top(self, t: int, block: int) -> float:
        lo, hi = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS
        items = self.holders[t]
        return max((self.shares[i][t] for i in items[bisect_left(items, lo):bisect_left(items, hi)]), default=0.0)

    def hits(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
        """For each text: (item number, score, overlap of question, of answer) of its verified items."""
        out: list[dict] = [{} for _ in texts]
        split = [words(t) for t in texts]
        get = self.terms.get
        found = [np.fromiter((get(w, -1) for w in s), np.int64, len(s)) for s in split]
        if not any(len(f) for f in found) or not self.terms:
            return [[] for _ in texts]
        for d, c in self.passages(found):
            lo, hi = c * self.chunk, (c + 2) * self.chunk
            items = self.search(sorted({t for t in found[d][lo:hi].tolist() if t >= 0}))
            grams = None
            for i, score in items:
                if grams is None:
                    around = split[d][lo:hi]
                    grams = {tuple(around[j:j + n]) for n in (1, 2, 3) for j in range(len(around) - n + 1)}
                question, answer = (overlap(p, grams) for p in self.parts[i])
                if question >= OVERLAP and answer >= OVERLAP and score > out[d].get(i, (0,))[0]:
                    out[d][i] = (score, question, answer)
        return [[(i, *v) for i, v in sorted(o.items())] for o in out]


def _word_rows(items: DataFrame) -> DataFrame:
    """(word, length): every distinct word of every item, and one row without word that has the item's length."""
    schema = pa.schema([("word", pa.string()), ("length", pa.int64())])

    def split(batches):
        for part in slices(batches):
            rows = []
            for text in part.column(0).to_pylist():
                found = words(text)
                if found:
                    rows += [(None, len(found)), *((w, None) for w in set(found))]
            if rows:
                yield batch_of(schema, *zip(*rows))

    return items.select("text").mapInArrow(split, "word string, length long")


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_items: int = PART_ITEMS) -> Iterator[Index]:
    """The items in indexes of about ``part_items`` each; one is on the driver at a time.  Statistics are of all items,
    whatever the parts: document frequencies are counted in Spark, and a part gets those of its own words."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    parts = -(-items.count() // part_items)
    if parts > 1:
        split = stored(_word_rows(items))
        size = split.where("length IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words"), F.max("length").alias("longest")).first()
        held = stored(split.where("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    for p in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        rows = sorted(((r.item_id, r.text) for r in part.collect() if words(r.text)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if not rows:
            continue
        whole = None
        if parts > 1:
            own = _word_rows(part).where("word IS NOT NULL").select("word").distinct()
            whole = Statistics(size.n, size.words / size.n, size.longest, {r.word: r.n for r in held.join(own, "word", "left_semi").collect()})
        yield Index([i for i, _ in rows], [t for _, t in rows], whole)


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every document and item it holds: doc_id, item_id, score, question_overlap, answer_overlap."""
    ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = df.sparkSession.createDataFrame([], ddl)
    for index in indexes(benchmark):
        out = out.unionByName(rows.mapInArrow(_finder(df.sparkSession.sparkContext.broadcast(index)), ddl))
    return out


def _finder(sent):
    """``sent``: a broadcast index, of at most PART_ITEMS items."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def find(batches):
        index = sent.value
        for part in slices(batches):
            docs, hits = part.column(0).to_pylist(), index.hits(part.column(1).to_pylist())
            found = [(doc, index.ids[i], *v) for doc, h in zip(docs, hits) for i, *v in h]
            if found:
                yield batch_of(schema, *zip(*found))
    return find


def _cleaner(sent):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        values, out = texts.tolist(), []
        for start in range(0, len(values), SLICE_ROWS):
            out += [not h for h in sent.value.hits(values[start:start + SLICE_ROWS])]
        return pd.Series(out, dtype=bool)
    return clean


def decontaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text holds a test item."""
    for index in indexes(benchmark):
        df = df.where(_cleaner(df.sparkSession.sparkContext.broadcast(index))(F.col(f"`{text_col}`")))
    return df
