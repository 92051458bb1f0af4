"""Spelling variants, found through a reduced alphabet.

Words are counted over whole texts; those of ``least_chars`` code points and
``least_count`` occurrences form the vocabulary.  Every letter is hashed to one
of ``SYMBOLS`` symbols, so that a word becomes a *reduced word*.  Words that
differ by one edit have reduced words that differ by one edit at most.  So each
word generates the full one-edit neighbourhood of its reduced word, the
neighbourhoods meet the reduced vocabulary in a join, and the pairs that meet
are verified on the original strings.

A neighbourhood is a set of 64-bit hashes, each derived from the word's prefix
sums in constant time: a word of L letters costs about 2 * SYMBOLS * L hashes
however long it is, and a collision of hashes or of symbols costs one
comparison, never a wrong pair.

Nulls: a null text has no words, a null id counts as '' for the deletion of a
code point.  Rows that repeat count each.  A table without words gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, ship, slices, stored
from .shingles import mix

#: Symbols that letters are reduced to (a letter's symbol is its code point modulo this).
SYMBOLS = 8
#: Hashes that one step of the generation holds at once.
_HASHES = 1 << 22
_TIMES = 0x9E3779B97F4A7C15
_BACK = pow(_TIMES, -1, 1 << 64)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None,
                least_chars: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the runs of letters ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z lower-cased, that have
    ``least_chars`` code points and occur ``least_count`` times over all rows.

    With ``one_in``, a run whose h, the crc32 of ``<id>:<run>``, is divisible by it first loses its code point
    h % length.  Counted on the JVM, and in part before the shuffle, so a frequent word is one row a task."""
    text = F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER)
    # greedy from the first letter of a run: what is long enough is found whole
    runs = F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]{%d,}" % least_chars), F.lit(0))
    doc = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    found = df.select(doc.alias("doc"), F.explode(runs).alias("word"))
    if one_in:
        h: Column = F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        less = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        found = found.select(F.when(h % one_in == 0, less).otherwise(F.col("word")).alias("word"))
        found = found.where(F.length("word") >= least_chars)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _TIMES, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def reduced(words: list[str]) -> np.ndarray:
    """Symbols, from 1, of some words of one length, one row a word."""
    letters = np.array([[ord(c) for c in w] for w in words] if not all(map(str.isascii, words)) else
                       [list(w.encode()) for w in words], np.uint64)
    return letters.reshape(len(words), -1) % np.uint64(SYMBOLS) + np.uint64(1)


def _keyed(hashes: np.ndarray, length: int) -> np.ndarray:
    return mix(hashes + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def own_keys(symbols: np.ndarray) -> np.ndarray:
    """The key of each reduced word."""
    n = symbols.shape[1]
    return _keyed((symbols * _powers(n)).sum(axis=1, dtype=np.uint64), n)


def neighbour_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of everything within one edit of each reduced word, itself included; a row holds a key more than once
    where several edits give the same string."""
    rows, n = symbols.shape
    power, times, back = _powers(n + 1), np.uint64(_TIMES), np.uint64(_BACK)
    before = np.zeros((rows, n + 1), np.uint64)
    np.cumsum(symbols * power[:n], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    letters = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    deleted = before[:, :-1] + (whole - before[:, 1:]) * back
    replaced = whole[:, :, None] + (letters - symbols[:, :, None]) * power[:n, None]
    inserted = (before + (whole - before) * times)[:, :, None] + letters * power[:, None]
    return np.concatenate([_keyed(deleted, n - 1), _keyed(replaced, n).reshape(rows, -1),
                           _keyed(inserted, n + 1).reshape(rows, -1)], axis=1)


def _by_length(ids: np.ndarray, words: list[str], per_letter: int):
    """(ids, symbols) of words of one length at a time, in steps of bounded size."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        here = np.nonzero(size == n)[0]
        step = max(1, _HASHES // int(n * per_letter))
        for at in range(0, len(here), step):
            some = here[at:at + step]
            yield ids[some], reduced([words[i] for i in some])


def _keys(vocabulary: DataFrame, neighbours: bool) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def generate(batches):
        for part in slices(batches, 20_000):
            ids, words = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
            for some, symbols in _by_length(ids, words, 2 * SYMBOLS + 1 if neighbours else 1):
                if neighbours:
                    keys = np.sort(neighbour_keys(symbols), axis=1)
                    first = np.ones(keys.shape, bool)
                    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    out, who = keys[first], np.repeat(some, first.sum(axis=1))
                else:
                    out, who = own_keys(symbols), some
                for at in range(0, len(out), 1 << 18):
                    yield batch_of(schema, out[at:at + (1 << 18)].view(np.int64), who[at:at + (1 << 18)])

    return vocabulary.select("id", "word").mapInArrow(generate, "key long, id long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b, word_a, n_a, word_b, n_b): every two words of ``vocabulary`` (id, word, n; words distinct and of letters
    up to U+00FF) that differ by exactly one inserted, deleted or replaced code point, once."""
    asked = _keys(vocabulary, True)
    held = _keys(vocabulary, False).withColumnRenamed("id", "b")
    met = asked.join(held.hint("shuffle_hash"), "key").where("id < b").select(F.col("id").alias("a"), "b")
    left = vocabulary.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    right = vocabulary.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    return met.join(left, "a").join(right, "b").where(F.levenshtein("word_a", "word_b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word in ``forms`` (word, form): the last word that forms lead to.  Every form is more
    frequent than its word, so there are no circles; steps double, so a few rounds reach every end."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                F.col("further").isNotNull().alias("moved")))
        now = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return now


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None,
                      least_chars: int = 6, least_count: int = 5, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary (see ``word_counts``).

    ``n_near`` counts the words one edit away.  ``form`` is the most frequent of them (ties: the smallest in
    code-point order) if it occurs ``factor`` times as often as the word, else null; ``root`` is where forms lead,
    the word itself without one."""
    ship(df.sparkSession)
    counts = word_counts(df, id_col, text_col, one_in, least_chars, least_count)
    vocabulary = stored(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pairs = stored(near_pairs(vocabulary))
    both = (pairs.select(F.col("a").alias("id"), F.col("word_b").alias("near"), F.col("n_b").alias("m"))
            .unionByName(pairs.select(F.col("b").alias("id"), F.col("word_a").alias("near"), F.col("n_a").alias("m"))))
    best = both.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("top"))
    is_form = -F.col("top.less") >= factor * F.col("n")
    formed = stored(vocabulary.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("top.near")).alias("form"), F.when(is_form, -F.col("top.less")).cast("long").alias("form_n")))
    ends = roots(formed.where("form IS NOT NULL"))
    return (formed.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
