import math
import os
import re
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from tablecare.llm import attention, decontam, lm, pii, quality
from tablecare.llm.bpe import ByteBpe
from tablecare.llm.common import fold, table
from tablecare.session import checkpoint_dir
from tablecare.llm.near_dup import near_duplicates

SF = "/root/testdata/sf0.001"


def tokens(text):
    return (text or "").encode().lower().split() + ["end"]


def check_contract(rows, texts):
    held = {d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d in texts}
    count = Counter(w for d, t in texts.items() if not held[d] for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in count for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score) and math.isfinite(r.attention_score)


def test_scores_of_the_table(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = lm.lm_scores(documents).collect()
    check_contract(rows, texts)
    new = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in new)
    # far better than guessing letters, and better than the subword product alone, on texts not learned from
    assert sum(r.score for r in new) / n > -5.5 and sum(r.score for r in new) > sum(r.attention_score for r in new)


def test_split_words_as_bytes_are_split():
    """White space of ASCII alone cuts, whatever stands around it; only A-Z are lower-cased."""
    texts = ["", " ", "One two", "  lead\t\ntrail \r\n", "a\x0bb\x0cc", "\u00c4B\u00a0C \u0130 \u2003x", *(f"A{chr(c)}b{chr(c)}" for c in range(300))]
    found, sizes = lm.split_words(pa.array(texts))
    want = [t.encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert [w.encode() for w in found.to_pylist()] == [w for ws in want for w in ws]
    none, sizes = lm.split_words(pa.array([], pa.string()))
    assert len(none) == 0 and len(sizes) == 0


def test_counts_in_many_parts(documents, monkeypatch):
    rows = documents.select("text", (documents.doc_id % 3 == 0).alias("held_out"))
    monkeypatch.setattr(lm, "COUNT_BYTES", 5_000, raising=False)
    got = {r.word: r.c for r in lm.word_counts(rows).collect()}
    want: Counter = Counter()
    for r in rows.collect():
        for w in tokens(r.text)[:-1]:
            want[w.decode()] += not r.held_out
        want[lm.END_WORD] += not r.held_out
    assert got == dict(want)


def test_words_spelled_together():
    """Words that the library gets as one text have the subwords that they have alone, in whichever order they come and
    however little the table of chunks holds."""
    odd = ["plain", "don't", "x'll'", "'s", "Äb", "İx", "中文", "🙂", "<|endoftext|>", "a<|endoftext|>b", "_", "\x1c", "a\x00b",
           "é́", "\u2003x", "\xa0", "a\xa0b", "\xad", "123,456", "--", "!!!", "ª", "x’s", "ɐ", "ɏ×", "wor" * 400]
    words = [w + tail for tail in ("", ".", "7", "è", "\xa0") for w in odd] + [f"{a}{b}{c}" for a in "tqz" for b in odd[:9] for c in range(20)]
    words = [words[i] for i in np.random.default_rng(7).permutation(len(words))]
    bpe = ByteBpe(public_tokenizers.path(lm.DEFAULT_TOKENIZER))
    want = [bpe.word_ids(w) for w in words]
    size, ids = bpe.laid(words)
    assert size.tolist() == [len(w) // 4 for w in want] and ids.tobytes() == b"".join(want)
    bpe.chunk_ids.most = bpe.chunk_ids.room = 20_000
    assert [bpe.spelled(words[at:at + 90]) for at in range(0, len(words), 90)] == [want[at:at + 90] for at in range(0, len(words), 90)]
    assert bpe.laid([])[0].tolist() == [] and bpe.laid(["中", "\x1c"])[1].tobytes() == bpe.word_ids("中") + bpe.word_ids("\x1c")


def test_subwords_as_they_lie_in_arrow():
    """Also of slices, of chunks, and of none."""
    spelled = [np.arange(n, dtype=np.uint16).tobytes() for n in (3, 1, 2, 5, 1)]
    for some in (pa.array(spelled), pa.array(spelled).slice(1, 3), pa.chunked_array([spelled[:2], [], spelled[2:]], pa.binary()),
                 pa.array([], pa.binary()), pa.chunked_array([], pa.binary())):
        want = [np.frombuffer(x, np.uint16) for x in some.to_pylist()]
        size, ids, starts, later = lm._laid(some)
        assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert starts.tolist() == (np.cumsum(size) - size).tolist() and sorted([*starts, *later]) == list(range(len(ids)))


def test_tables_go_when_they_are_read(spark, documents):
    """The scores read one kept table; those of the steps before are deleted, and the session's setting is as it was."""
    folder, setting = urlparse(checkpoint_dir(spark)).path, spark.conf.get(lm.CLEANED)
    before = set(os.listdir(folder))
    scores = lm.lm_scores(documents)
    assert len(set(os.listdir(folder)) - before) == 1 and spark.conf.get(lm.CLEANED) == setting
    assert scores.count() == documents.count()


def test_streams_are_shuffled_once(documents):
    rows = documents.select("doc_id", "text", (fold(documents.doc_id, 7) == 2).alias("held_out"))
    streams = lm._streams(rows, lm.DEFAULT_TOKENIZER, 5, 42)
    assert str(streams._jdf.queryExecution().executedPlan()).count("Exchange ") == 1
    assert streams.rdd.getNumPartitions() == 5 and {r.shard for r in streams.select("shard").collect()} == set(range(5))


def test_blocks_do_not_change_scores(documents, monkeypatch):
    some = documents.limit(60)
    one = {r.doc_id: r.score for r in lm.lm_scores(some).collect()}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    many = {r.doc_id: r.score for r in lm.lm_scores(some).collect()}
    assert one.keys() == many.keys()
    for d in one:
        assert many[d] == pytest.approx(one[d], rel=1e-4)


def test_all_pairs_count(documents, monkeypatch):
    """Every pair of subwords counts, however rare and however many there are, and parts don't matter."""
    some = documents.limit(60)
    one = {r.doc_id: r.score for r in lm.lm_scores(some).collect()}
    monkeypatch.setattr(lm, "MOST_PAIRS", 100, raising=False)
    monkeypatch.setattr(lm, "PART_BYTES", 5_000, raising=False)
    many = {r.doc_id: r.score for r in lm.lm_scores(some).collect()}
    assert many == pytest.approx(one, rel=1e-6)


def test_model_learns_from_whole_documents(spark, monkeypatch):
    """What comes late in the documents is learned, from all shards."""
    cycle = "zebra quartz violin marble copper walnut saddle ribbon " * 80
    docs = spark.createDataFrame([(i, ("plain words again " * 200 if i % 9 else "") + cycle) for i in range(90)], "doc_id long, text string")
    monkeypatch.setattr(lm, "SHARD_BYTES", 100_000, raising=False)
    rows = [r for r in lm.lm_scores(docs).collect() if r.held_out]
    assert rows and all(r.attention_score / r.n_tokens > -0.5 for r in rows)


def test_lm_edge_cases(odd_documents, no_documents):
    ids = odd_documents.where("doc_id is not null")
    check_contract(lm.lm_scores(ids).collect(), {r.doc_id: r.text for r in ids.collect()})
    assert len(lm.lm_scores(odd_documents).collect()) == odd_documents.count()
    assert lm.lm_scores(no_documents).collect() == []


def small_stream(seed=0, n=40):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 60, rng.integers(1, 90)) for _ in range(n)]


def test_windows_score_each_subword_once():
    docs = small_stream()
    windows, first, targets, real = attention.windows_of(docs, 50)
    assert np.array_equal(targets[real], np.concatenate(docs)) and first.sum() == len(docs)
    assert windows.shape == (len(first) + 1, attention.WINDOW)


def test_model_is_causal_and_documents_are_apart():
    model = attention.Attention.fresh(np.concatenate(small_stream()), 60)
    rng = np.random.default_rng(1)
    for v in model.p.values():
        v += (rng.normal(size=v.shape) * 0.3).astype(np.float32)
    doc, other = np.arange(50) % 60, np.arange(50)[::-1] % 60
    windows, first, targets, real = attention.windows_of([other, doc], 50)
    alone = model.log_probabilities(*attention.windows_of([doc], 50)[:3])[attention.windows_of([doc], 50)[3]]
    after = model.log_probabilities(windows, first, targets)[real][50:]
    assert np.allclose(alone, after, atol=1e-4)
    changed = doc.copy()
    changed[40:] = 7
    w, f, t, r = attention.windows_of([changed], 50)
    assert np.allclose(alone[:40], model.log_probabilities(w, f, t)[r][:40], atol=1e-4)
    assert np.allclose(model.log_probabilities(w, f, t), model.log_probabilities(w, f, t, shift=True), atol=1e-4)


def test_gradients_match_differences():
    ids = np.concatenate(small_stream(2, 8))
    model = attention.Attention.fresh(ids, 60)
    rng = np.random.default_rng(3)
    model.p = {k: v.astype(np.float64) + rng.normal(size=v.shape) * 0.3 for k, v in model.p.items()}
    windows, first, targets, real = attention.windows_of(small_stream(2, 8), 50)
    rows, cls, weight = model.row[windows], model.cls[targets], real.astype(np.float64)
    loss, grads = model.gradients(rows, first, cls, weight)
    for name, g in grads.items():
        p = model.p[name]
        at = tuple(rng.integers(0, s) for s in p.shape)
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape) if g[at] == 0 else at
        kept, eps = p[at], 1e-4
        p[at] = kept + eps
        up = model.gradients(rows, first, cls, weight)[0]
        p[at] = kept - eps
        down = model.gradients(rows, first, cls, weight)[0]
        p[at] = kept
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=2e-2, abs=2e-6), name


def test_windows_after_the_one_before_are_a_view():
    stream = np.arange(5 * attention.WINDOW * 3.0).reshape(5, attention.WINDOW, 3)
    both = attention.with_before(stream)
    assert np.shares_memory(both, stream)
    assert np.array_equal(both, np.concatenate([stream[:-1], stream[1:]], axis=1))


def test_fit_takes_plain_adam_steps_without_sorting(monkeypatch):
    """Every parameter moves as by Adam alone, a step's embeddings only; a step's subwords are found without a sort."""
    docs = small_stream(4, 30)
    model = attention.Attention.fresh(np.concatenate(docs), 60)
    rng = np.random.default_rng(5)
    for v in model.p.values():
        v += (rng.normal(size=v.shape) * 0.1).astype(np.float32)
    plain = attention.Attention(model.row, model.cls, {k: v.copy() for k, v in model.p.items()})
    fitted = [k for k in plain.p if k not in attention.COUNTED]
    m, s = ({k: np.zeros_like(plain.p[k]) for k in fitted} for _ in range(2))
    windows, first, targets, real = attention.windows_of(docs, 50)
    blocks, order = -(-len(first) // 8), np.random.default_rng(6)
    for j, b in enumerate(order.permutation(blocks)):
        lo, hi = b * 8, min(len(first), (b + 1) * 8)
        at = slice(lo * attention.WINDOW, hi * attention.WINDOW)
        rows = model.row[windows[lo:hi + 1]]
        _, g = plain.gradients(rows, first[lo:hi], model.cls[targets[at]], real[at].astype(np.float32))
        rate = (0.02 - 0.01 * (j + 1) / blocks) / (1 - 0.9 ** (j + 1))
        for k in fitted:
            own = np.unique(rows) if k in attention.BY_ROW else slice(None)
            m[k][own] = 0.9 * m[k][own] + 0.1 * g[k][own]
            s[k][own] = 0.995 * s[k][own] + 0.005 * g[k][own] ** 2
            plain.p[k][own] -= rate * m[k][own] / (np.sqrt(s[k][own] / (1 - 0.995 ** (j + 1))) + 1e-8)

    def sorts(*_, **__):
        raise AssertionError("a step sorts")

    with monkeypatch.context() as patch:
        for name in ("unique", "argsort", "sort"):
            patch.setattr(np, name, sorts)
        attention.fit(model, [docs], 50, (0.02, 0.01), batch=8, seed=6)
    for k in plain.p:
        assert np.allclose(model.p[k], plain.p[k], atol=2e-3), k


def test_training_learns_context():
    """A stream whose next subword follows from the last one."""
    docs = [np.arange(i, i + 70) % 40 for i in range(60)]
    model = attention.train(docs, 60, 50, epochs=30)
    w, f, t, r = attention.windows_of(docs[:5], 50)
    got = (model.log_probabilities(w, f, t) + model.log_within[t])[r]
    assert got.mean() > -0.5


def test_pipeline_equals_its_parts(spark):
    """Every stage's decisions, by the operators' own brute-force checks."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    start = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, table(spark, SF, "labels"), learn=quality.fold(quality.F.col("doc_id"), 4) != 2)
    one = stages["quality"](spark, docs, SF)
    want = {d for d, t in start.items() if model.score(quality.difference(t, model.good, model.bad) if t else 0.0) >= 0.7}
    assert {r.doc_id for r in one.collect()} == want and one.columns == columns
    two = stages["near_duplicates"](spark, one, SF)
    kept = {r.doc_id for r in near_duplicates(one).collect() if r.kept}
    assert {r.doc_id for r in two.collect()} == kept and two.columns == columns and len(kept) < len(want)
    three = stages["decontamination"](spark, two, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    index = decontam.Index([i for i, _ in items], [t for _, t in items])
    assert {r.doc_id for r in three.collect()} == {d for d in kept if not index.hits([start[d]])[0]} and three.columns == columns
    four = stages["personal_data"](spark, three, SF)
    assert four.columns == columns
    for r in four.collect():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
        assert len(re.findall(r"\[(?:email|ip|card|phone)\]", r.text)) <= len(pii.base_spans(start[r.doc_id]))
    five = stages["packing"](spark, four, SF)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}
    assert corpus_pipeline.ORACLE_SQL is None
    last = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in last} == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in five.collect()}


def test_stages_take_odd_rows(spark, odd_documents, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        docs = odd_documents if name != "personal_data" else odd_documents.withColumn("n_chars", odd_documents.length)
        stage(spark, docs, SF).collect()
        assert stage(spark, no_documents, SF).collect() == []
