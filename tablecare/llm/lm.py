"""LM scoring: a causal self-attention model over subword ids (``attention``),
with corpus counts in its output layer, scores every document.

Text is lower-cased (A-Z) and split into words, then one end; a word's
subwords are those of a public byte-level BPE vocabulary, after a space.  The
attention model predicts a class for every subword.  Counts over all training
documents say the rest:

* which subword it is: for a word's first, its share of the class; for a
  later one, how often it follows the subword before it inside words;
* which word it is, once the class of its first subword is known: the word's
  discounted share of that class, and what the discount leaves goes to the
  subwords' product.  Between this and the pure subword product the score
  mixes by how well each has done in the document so far.

So each word's probability is one of a proper distribution given the words
before it, known words profit from counts that grow with the corpus, and
unseen words are spelled out.

Counts, classes, embeddings and weights are of all training documents, whole.
The weights are fitted in ``ROUNDS`` rounds: documents are dealt into shards,
each shard goes on from the common weights with its next documents, and what
it moved them by is averaged over the shards, a subword's rows by how often
each shard has it.  Together the rounds read every document once, however many
there are.  What follows each subword, by class, is counted and not fitted.  Texts are cut into blocks of about ``BLOCK_BYTES`` by a hash
of id, text and the part of the input a row lies in, so that neither a hot id nor a row repeated without end makes a
large block.  A block's distinct words meet the corpus counts in a join on
the word, so the most frequent word costs one row a block, and come back as
the block's own dictionary: no task holds the corpus vocabulary.  Pairs of
subwords stay a table too: the distinct words of all rows, in parts, meet the
counts of all pairs and keep of them one number a word.

Null and empty texts are one end.  A null id counts as '' for the fold.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import BY_ROW, COUNTED, HEAD, RATE, TAIL, Attention, add_company, fit, following, marks_of, pairs_of, windows_of
from .bpe import ByteBpe, byte_bpe
from .common import batch_of, dropped, fold, slices, spread_id, stored
from .token_counts import DEFAULT_TOKENIZER

#: Bytes of text in a shard of the fit, and its rounds.
SHARD_BYTES, ROUNDS = 16 << 20, 3
BLOCK_BYTES = 8 << 20
#: Bytes of words that a task counts at once.
COUNT_BYTES = 16 << 20
#: Bytes of subword ids in a part of the distinct words.
PART_BYTES = 1 << 20
DISCOUNT, BACK = 0.75, 5.0
#: The end of a text, as a word (no word holds white space) and as a subword (the vocabulary's own end).
END_WORD, END_ID, VOCABULARY = "\n", 50256, 50257
#: Session setting by which a query's shuffle files go when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Odds of the pure subword product before a document begins, and the least weight of either part.
PRIOR, FLOOR = -1.0, 0.05


def _subwords(bpe: ByteBpe, words: list[str]) -> pa.Array:
    """Each word's subwords, two bytes each."""
    size, ids = bpe.laid(words)
    if END_WORD in words:
        at = words.index(END_WORD)
        lo = size[:at].sum()
        ids = np.concatenate([ids[:lo], [END_ID], ids[lo + size[at]:]])
        size[at] = 1
    ends = np.append(0, 2 * np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(np.uint16))])


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist


def _kept(df: DataFrame) -> DataFrame:
    """``stored``; its shuffle files go when it is written, and not whenever the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, "false")
    conf.set(CLEANED, "true")
    try:
        return stored(df)
    finally:
        conf.set(CLEANED, before)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one after the other, and how many each text has: runs without ASCII white space, A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    found, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(found), 0)
    return found.filter(full), np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(texts))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): every word, with its count over the rows not held out (0: in no such row); one scan, tasks count
    before the shuffle."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def counted(parts):
        found = pa.chunked_array([p for p, _ in parts], pa.string()).combine_chunks().dictionary_encode()
        n = np.bincount(found.indices.to_numpy(), np.concatenate([t for _, t in parts]), len(found.dictionary))
        return batch_of(schema, found.dictionary, n.astype(np.int64))

    def count(batches):
        parts, held, ends = [], 0, None
        for part in slices(batches):
            found, sizes = split_words(part.column(0))
            learned = ~part.column(1).to_numpy(zero_copy_only=False)
            ends = (ends or 0) + int(learned.sum())
            parts.append((found, np.repeat(learned, sizes)))
            held += found.nbytes
            if held > COUNT_BYTES:
                yield counted(parts)
                parts, held = [], 0
        if parts:
            yield counted(parts)
        if ends is not None:
            yield batch_of(schema, [END_WORD], [ends])
        parts, found = [], None
        pa.default_memory_pool().release_unused()  # the worker goes on to tasks of other stages

    return (rows.select("text", "held_out").mapInArrow(count, "word string, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


def spelled_counts(counts: DataFrame, tokenizer: str) -> DataFrame:
    """``counts`` with every word's subwords: each distinct word is spelled once."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("ids", pa.binary())])

    def spell(batches):
        bpe = byte_bpe(public_tokenizers.path(tokenizer))
        for part in slices(batches, 50_000):
            yield batch_of(schema, part.column(0), part.column(1), _subwords(bpe, _strings(part.column(0))))

    return counts.mapInArrow(spell, "word string, c long, ids binary")


def _laid(spelled: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """Subwords of some words one after the other, as they lie in Arrow's memory: (their numbers by word, ids, starts of
    words, places of later subwords)."""
    parts = spelled.chunks if isinstance(spelled, pa.ChunkedArray) else [spelled]
    size = [np.zeros(0, np.int64)]
    ids = [np.zeros(0, np.int64)]
    for part in parts:
        if len(part):
            part = part.cast(pa.large_binary())
            _, ends, data = part.buffers()
            ends = np.frombuffer(ends, np.int64)[part.offset:part.offset + len(part) + 1]
            size.append(np.diff(ends) // 2)
            if ends[-1] > ends[0]:
                ids.append(np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(np.uint16).astype(np.int64))
    return _by_word(np.concatenate(size), np.concatenate(ids))


def _by_word(size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    starts = np.cumsum(size) - size
    later = np.ones(len(ids), bool)
    later[starts] = False
    return size, ids, starts, np.nonzero(later)[0]


def _places(word: np.ndarray, size: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the subwords of some words in turn lie among the laid ones, and where each word's end in the stream of them."""
    n = size[word]
    ends = np.cumsum(n)
    return np.repeat(starts[word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), ends


def _subword_counts(counts: DataFrame) -> np.ndarray:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches):
        n = np.zeros(VOCABULARY)
        for part in slices(batches, 50_000):
            size, ids, _, _ = _laid(part.column(1))
            n += np.bincount(ids, np.repeat(part.column(0).to_numpy(zero_copy_only=False), size), VOCABULARY)
        seen = np.nonzero(n)[0]
        yield batch_of(schema, seen, np.rint(n[seen]).astype(np.int64))

    out = np.zeros(VOCABULARY, np.int64)
    for r in counts.select("c", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def _streams(rows: DataFrame, tokenizer: str, shards: int, seed: int) -> DataFrame:
    """(shard, sizes, ids): the subwords of the training documents, one row a shard."""
    schema = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("ids", pa.binary())])
    place = F.xxhash64(F.lit(seed), spread_id(F.col("doc_id")), "text")

    def spell(batches):
        bpe = byte_bpe(public_tokenizers.path(tokenizer))
        end = np.array([END_ID], np.uint16).tobytes()
        for part in slices(batches, 512):
            found, sizes = split_words(part.column(2))
            found = found.dictionary_encode()  # a slice's distinct words are looked up once
            spelled = bpe.spelled(_strings(found.dictionary))
            size = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
            size, ids, starts, _ = _by_word(size, np.frombuffer(b"".join(spelled), np.uint32))
            place, ends = _places(found.indices.to_numpy(), size, starts)
            cuts = np.append(0, ends)[np.cumsum(sizes)]
            texts = np.split(ids[place].astype(np.uint16), cuts[:-1])
            yield batch_of(schema, part.column(0), part.column(1), [t.tobytes() + end for t in texts])
        bpe.forget()
        pa.default_memory_pool().release_unused()

    def pack(group: pa.Table) -> pa.Table:
        ids = [i for _, i in sorted(zip(group["place"].to_pylist(), group["ids"].to_pylist()))]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 2
        return pa.table({"shard": group["shard"].slice(0, 1), "sizes": [sizes.astype(np.int32).tobytes()], "ids": [b"".join(ids)]})

    each = (rows.where("NOT held_out").select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place"), "text")
            .mapInArrow(spell, "shard int, place long, ids binary"))
    # a file each: the rounds' tasks have one shard
    return each.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(pack, "shard int, sizes binary, ids binary")


def _documents(sizes: bytes, ids: bytes, turn: int) -> list[np.ndarray]:
    """The documents of a shard that a round reads."""
    return np.split(np.frombuffer(ids, np.uint16), np.cumsum(np.frombuffer(sizes, np.int32))[:-1])[turn::ROUNDS]


def _neighbours(streams: DataFrame) -> DataFrame:
    """(before, after, n): every pair of neighbouring subwords, with its count over the training documents."""
    schema = pa.schema([("before", pa.int64()), ("after", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for part in slices(batches, 1):
            ids = np.frombuffer(part.column(0)[0].as_py(), np.uint16)
            for at in range(0, len(ids), 1 << 19):  # every document follows an end
                before, after, n = pairs_of(np.append(ids[at - 1] if at else END_ID, ids[at:at + (1 << 19)]).astype(np.int64), VOCABULARY)
                yield batch_of(schema, before, after, n)

    return streams.select("ids").mapInArrow(count, "before long, after long, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))


def _row_sums(pairs: DataFrame, size: int, width: int, add) -> np.ndarray:
    """``size`` rows of ``width`` numbers, to which ``add(rows, before, after, n)`` adds what a batch of pairs gives: tasks
    add up their own, one row of the result for each that is not zero, and parts of the rows are added up."""
    parts = 32
    schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("row", pa.binary())])

    def gather(batches):
        own = np.zeros((size, width))
        for part in slices(batches, 100_000):
            add(own, *(part.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        seen = np.nonzero(own.any(axis=1))[0]
        yield batch_of(schema, (seen % parts).astype(np.int32), seen, [v.tobytes() for v in own[seen].astype(np.float32)])

    def merge(group: pa.Table) -> pa.Table:
        ids, where = np.unique(group["id"].to_numpy(), return_inverse=True)
        total = np.zeros((len(ids), width))
        np.add.at(total, where, np.frombuffer(b"".join(group["row"].to_pylist()), np.float32).reshape(-1, width))
        return pa.table({"id": ids, "row": [v.tobytes() for v in total.astype(np.float32)]},
                        schema=pa.schema([("id", pa.int64()), ("row", pa.binary())]))

    out = np.zeros((size, width), np.float32)
    for r in pairs.mapInArrow(gather, "part int, id long, row binary").groupBy("part").applyInArrow(merge, "id long, row binary").collect():
        out[r.id] = np.frombuffer(r.row, np.float32)
    return out


def fitted(streams: DataFrame, count: np.ndarray, shards: int, seed: int) -> Attention:
    """The attention model of all streams (see the module's head)."""
    spark = streams.sparkSession
    pairs, marks = _kept(_neighbours(streams)), marks_of(count, seed)
    model = Attention.of_counts(count, _row_sums(pairs, VOCABULARY, 96, lambda own, *of: add_company(own, *of, marks)), seed)
    model.set_counts(count)
    row, cls, rows = model.row, model.cls, len(model.p["x"])

    def follow(own, before, after, n):
        own += following(row[before], cls[after], n, rows)

    model.set_following(_row_sums(pairs, rows, HEAD + TAIL, follow))
    dropped(pairs)
    by_row = [k for k in BY_ROW if k not in COUNTED]
    small = [k for k in model.p if k not in BY_ROW and k not in COUNTED]
    parts = 16 + shards // 8
    ddl = "part int, shard long, rows binary, times binary, moved binary"
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("rows", pa.binary()), ("times", pa.binary()), ("moved", pa.binary())])
    width = sum(model.p[k].shape[1] for k in by_row)

    def merge(group: pa.Table) -> pa.Table:
        got = sorted(zip(*(group[c].to_pylist() for c in ("shard", "rows", "times", "moved"))))
        part = group["part"][0].as_py()
        times = [np.frombuffer(t, np.float64) for _, _, t, _ in got]
        if part < 0:  # the weights that have no rows
            rows = np.zeros(1, np.int64)
            moved = sum(t[0] * np.frombuffer(m, np.float32).astype(float) for t, (*_, m) in zip(times, got)) / sum(t[0] for t in times)
        else:
            rows, where = np.unique(np.concatenate([np.frombuffer(r, np.int64) for _, r, _, _ in got]), return_inverse=True)
            moved, weight, at = np.zeros((len(rows), width)), np.zeros(len(rows)), 0
            for t, (*_, m) in zip(times, got):
                here = where[at:at + len(t)]
                moved[here] += t[:, None] * np.frombuffer(m, np.float16).reshape(-1, width)
                weight[here] += t
                at += len(t)
            moved /= weight[:, None]
        return pa.table({"part": group["part"].slice(0, 1), "rows": [rows.tobytes()], "moved": [moved.astype(np.float32).tobytes()]})

    for r in range(ROUNDS):
        rates = tuple(RATE * (1 - 0.95 * x / ROUNDS) for x in (r, r + 1))
        sent = spark.sparkContext.broadcast(model)  # bounded: the vocabulary and the weights

        def go_on(batches, sent=sent, r=r, rates=rates):
            for batch in slices(batches, 1):
                shard, sizes, ids = (batch.column(i)[0].as_py() for i in range(3))
                docs = _documents(sizes, ids, r)
                if not docs:
                    continue
                read = np.concatenate(docs)
                start = sent.value
                here, used = start.part(np.append(read, END_ID))
                fit(here, [docs], END_ID, rates, seed=seed + shard % 1_000_003)
                times = np.bincount(here.row[read], minlength=len(used)) + 1.0
                moved = np.concatenate([here.p[k] - start.p[k][used] for k in by_row], axis=1).astype(np.float16)
                out = [(-1, shard, b"", np.array([float(len(read))]).tobytes(),
                        np.concatenate([(here.p[k] - start.p[k]).ravel() for k in small]).astype(np.float32).tobytes())]
                for part in range(parts):
                    at = used % parts == part
                    if at.any():
                        out.append((part, shard, used[at].tobytes(), times[at].tobytes(), moved[at].tobytes()))
                yield batch_of(schema, *zip(*out))

        found = (streams.mapInArrow(go_on, ddl).groupBy("part").applyInArrow(merge, "part int, rows binary, moved binary")).collect()
        p = {k: v.copy() for k, v in model.p.items()}
        for f in found:
            moved = np.frombuffer(f.moved, np.float32)
            if f.part < 0:
                at = 0
                for k in small:
                    p[k] += moved[at:at + p[k].size].reshape(p[k].shape)
                    at += p[k].size
            else:
                at = 0
                for k in by_row:
                    p[k][np.frombuffer(f.rows, np.int64)] += moved.reshape(-1, width)[:, at:at + p[k].shape[1]]
                    at += p[k].shape[1]
        model = Attention(model.row, model.cls, p, model.log_within)
        sent.unpersist()
    return model


def _pair_counts(counts: DataFrame, cls: np.ndarray) -> DataFrame:
    """(kind, a, b, n): pairs inside words (1, before, id), by class of a word's first subword the words' tokens (2, class, 0) and distinct words (3, class, 0), and pairs by the class of the later
    subword (4, before, class)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def spell(batches):
        for part in slices(batches, 50_000):
            c = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            size, ids, starts, later = _laid(part.column(2))
            times = np.repeat(c, size)
            of, before = cls[ids[starts]], ids[later - 1] * VOCABULARY
            for kind, keys, n in ((1, before + ids[later], times[later]), (2, of * VOCABULARY, c),
                                  (3, of * VOCABULARY, np.ones_like(c)), (4, before + cls[ids[later]], times[later])):
                found, where = np.unique(keys, return_inverse=True)
                if len(found):
                    n = np.rint(np.bincount(where, n)).astype(np.int64)
                    yield batch_of(schema, np.full(len(found), kind, np.int32), found // VOCABULARY, found % VOCABULARY, n)

    return counts.where("c > 0").mapInArrow(spell, "kind int, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def with_log_within(counts: DataFrame, pairs: DataFrame, cls: np.ndarray, log_within: np.ndarray, parts: int) -> DataFrame:
    """``counts`` with every word's ``within``: the log probability of its subwords in their classes, each given the one
    before it inside the word, by the counts of all pairs.  Words go in ``parts`` by hash; a part asks for each of its
    distinct pairs once, so the most frequent pair costs one row a part."""
    keyed = counts.select(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part"), "word", "c", "ids")

    def keys_of(ids, later):
        before = ids[later - 1] * VOCABULARY
        return before + ids[later], before + cls[ids[later]]

    def ask(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        _, ids, _, later = _laid(group["ids"])
        pair, after = (np.unique(k) for k in keys_of(ids, later))
        asked, kind = np.concatenate([pair, after]), np.repeat(np.array([1, 4], np.int32), [len(pair), len(after)])
        return pa.table({"part": pa.array(np.full(len(asked), key[0].as_py()), pa.int64()), "kind": kind,
                         "a": asked // VOCABULARY, "b": asked % VOCABULARY})

    def add(key: tuple[pa.Scalar, ...], group: pa.Table, found: pa.Table) -> pa.Table:
        size, ids, starts, later = _laid(group["ids"])
        kind, a, b, n = (found[c].to_numpy() for c in ("kind", "a", "b", "n"))
        keys = a * VOCABULARY + b
        each = log_within[ids]
        if len(later):
            held = []
            for k, wanted in zip((1, 4), keys_of(ids, later)):
                by = np.argsort(keys[kind == k])
                held.append(_find(keys[kind == k][by], n[kind == k][by], wanted))
            each[later] = np.log((held[0] + BACK * np.exp(each[later])) / (held[1] + BACK))
        within = np.add.reduceat(each, starts) if len(starts) else each
        return pa.table({"word": group["word"], "c": group["c"], "ids": group["ids"], "within": pa.array(within, pa.float64())})

    asked = keyed.groupBy("part").applyInArrow(ask, "part long, kind int, a long, b long")
    found = asked.join(pairs, ["kind", "a", "b"]).select("part", "kind", "a", "b", "n")
    return keyed.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(add, "word string, c long, ids binary, within double")


def _find(keys, counts, wanted):
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0.0)


class Corpus:
    """What the scores take from the corpus beside its words: bounded tables (subwords, classes) and totals."""

    def __init__(self, model: Attention, total: int, distinct: int, ends: int, rows: list):
        self.model, self.total, self.distinct, self.ends = model, total, distinct, ends
        self.of_class, self.kinds = np.zeros(HEAD + TAIL), np.zeros(HEAD + TAIL)
        for r in rows:
            (self.of_class if r.kind == 2 else self.kinds)[r.a] = r.n


def _block_scores(corpus: Corpus, texts: pa.Array, names: pa.Array, counts: np.ndarray, spelled: pa.ChunkedArray, within: np.ndarray):
    """(n_tokens, n_known, base, score, subword score) in log10 of each text; the block's words with their counts,
    subwords and ``within``."""
    end = len(names)
    count = np.append(counts, corpus.ends).astype(float)
    found, sizes = split_words(texts)
    number = np.split(pc.index_in(found, names.cast(pa.string())).to_numpy(), np.cumsum(sizes)[:-1])
    size, ids, _, _ = _laid(spelled)
    size, ids, starts, _ = _by_word(np.append(size, 1), np.append(ids, END_ID))
    within = np.append(within, corpus.model.log_within[END_ID])
    cls = corpus.model.cls[ids[starts]]
    of_class = corpus.of_class[cls]
    known = np.where(count > 0, np.maximum(count - DISCOUNT, 0) / np.maximum(of_class, 1), 0.0)
    left = np.where(of_class > 0, DISCOUNT * corpus.kinds[cls] / np.maximum(of_class, 1), 1.0)
    base = np.log10((count + 1) / (corpus.total + corpus.distinct + 1))
    out = []
    for at in range(0, len(texts), 128):
        docs = [np.append(x, end) for x in number[at:at + 128]]
        word = np.concatenate(docs)
        n = size[word]
        place, ends = _places(word, size, starts)
        lengths = np.array([len(d) for d in docs])
        last = np.cumsum(lengths) - 1
        cuts = ends[last]
        stream = ids[place]
        windows, begins, targets, real = windows_of(np.split(stream, cuts[:-1]), END_ID)
        log_class = corpus.model.log_probabilities(windows, begins, targets)[real]
        log_first = log_class[ends - n]
        spelled_out = np.add.reduceat(log_class, ends - n) - log_first + within[word]
        counted = np.log(known[word] + left[word] * np.exp(spelled_out) + 1e-300)
        lead = np.cumsum(spelled_out - counted)
        lead = np.concatenate([[0], lead[:-1]])
        begin = last - lengths + 1
        lead -= np.repeat(lead[begin], lengths)
        weight = np.clip(1 / (1 + np.exp(-np.clip(lead + PRIOR, -40, 40))), FLOOR, 1 - FLOOR)
        score = log_first + np.logaddexp(np.log(weight) + spelled_out, np.log1p(-weight) + counted)
        sums = [np.add.reduceat(x, begin) for x in ((count[word] > 0).astype(np.int64), base[word], score / np.log(10),
                                                    (log_first + spelled_out) / np.log(10))]
        out += zip(lengths.tolist(), *(s.tolist() for s in sums))
    return out


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
              tokenizer: str = DEFAULT_TOKENIZER, seed: int = 42) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and attention_score (all in log10)."""
    spark = df.sparkSession
    doc: Column = F.col(f"`{id_col}`").cast("long")
    rows = df.select(doc.alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), (fold(doc, folds) == held).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = _kept(spelled_counts(word_counts(rows), tokenizer))
    totals = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"),
                        F.max(F.when(F.col("word") == END_WORD, F.col("c"))).alias("ends"), F.sum(F.length("ids")).alias("bytes")).first()
    shards = 1 + size // SHARD_BYTES
    streams = _kept(_streams(rows, tokenizer, shards, seed))
    model = fitted(streams, _subword_counts(counts.where("c > 0")), shards, seed)
    dropped(streams)
    pairs = _kept(_pair_counts(counts, model.cls))
    corpus = Corpus(model, totals.n or 0, totals.v or 0, totals.ends or 0, pairs.where("kind IN (2, 3)").collect())
    spelled, counts = counts, _kept(with_log_within(counts, pairs.where("kind IN (1, 4)"), model.cls, model.log_within, 1 + (totals.bytes or 0) // PART_BYTES))
    dropped(spelled)
    dropped(pairs)
    sent = spark.sparkContext.broadcast(corpus)  # bounded: the vocabulary and the weights
    blocks = 1 + size // BLOCK_BYTES
    placed = rows.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).alias("block"), "doc_id", "held_out", "text")

    def distinct(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = split_words(group["text"].combine_chunks())[0].unique()
        return pa.table({"block": pa.array(np.full(len(found), key[0].as_py()), pa.int64()), "word": found})

    def score(key: tuple[pa.Scalar, ...], docs: pa.Table, lookup: pa.Table) -> pa.Table:
        block = lookup["c"].to_numpy(), lookup["ids"], lookup["within"].to_numpy()
        found = _block_scores(sent.value, docs["text"].combine_chunks(), lookup["word"].combine_chunks(), *block) if docs.num_rows else []
        columns = list(zip(*found)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([docs["doc_id"], docs["held_out"], *(pa.array(c, t) for c, t in zip(columns, types))],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "attention_score"])

    by_block = placed.groupBy("block")
    named = by_block.applyInArrow(distinct, "block long, word string")
    lookup = named.join(counts, "word").select("block", "word", "c", "ids", "within")
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, attention_score double"
    return (by_block.cogroup(lookup.groupBy("block")).applyInArrow(score, ddl)
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.total).cast("long").alias("train_tokens"), "base_score", "score", "attention_score"))
