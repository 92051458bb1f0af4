import hashlib
import random
import re

import numpy as np
import pytest

from tablecare.llm import substring_dedup as sd

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    """(n_words, n_removed, sha256) of every row, window by window."""
    least = {}
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in docs:
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s:s + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(df, window):
    got = sorted(map(tuple, sd.substring_report(df, window=window).collect()), key=str)
    assert got == sorted(brute([(r.doc_id, r.text) for r in df.collect()], window), key=str)
    return got


def test_table_equals_brute_force(documents):
    assert sum(r[2] for r in check(documents, 50)) > 0


@pytest.mark.parametrize("window,chunk", [(8, 1 << 20), (8, 40), (9, 300), (2, 100)])
def test_invented_repeats(spark, monkeypatch, window, chunk):
    """Few words, so that repeats overlap, nest, lie at every offset and reach the ends; over chunks of every size."""
    monkeypatch.setattr(sd, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(sd, "_buckets", lambda n: 7)
    rnd = random.Random(window + chunk)
    passages = [[f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(window - 1, 3 * window))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rnd.randrange(4)):
            text += [f"w{rnd.randrange(12)}" for _ in range(rnd.randrange(12))] + rnd.choice(passages)
        rows.append((rnd.choice([i, i, i, 7, -i, None]), " \n".join(text)))
    rows += [(200 + i, " ".join(passages[i % 3] * 3)) for i in range(40)] + [(40, rows[3][1]), (41, rows[3][1])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sum(r[2] for r in check(df, window)) > 0


def test_hot_passage(spark, monkeypatch):
    """One passage in nearly all documents, at many offsets: one entry a chunk."""
    monkeypatch.setattr(sd, "CHUNK_WORDS", 2000)
    passage = " ".join(f"hot{i}" for i in range(60))
    rows = [(i, " ".join(f"a{i}_{j}" for j in range(i % 31)) + " " + passage + " " + " ".join(f"z{i}_{j}" for j in range(i % 7))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = check(df, 50)
    assert sum(r[2] == 60 for r in got) == 599
    docs = df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS row")
    sent = [r for r in sd.anchors(docs, 25, 50, 1).collect() if r.hashes is not None]
    assert sum(len(r.hashes) // 4 for r in sent) < 2 * 36 * len(sent) + sum(len(WORD.findall(t)) - 60 + 25 for _, t in rows)


def test_whole_copies_go(spark):
    text = " ".join(f"c{i}" for i in range(55))
    short = " ".join(f"s{i}" for i in range(49))
    rows = [(i, text) for i in range(5, 25)] + [(i, short) for i in range(30, 50)] + [(5, text), (None, text)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), 50)
    assert sum(r[2] == 55 for r in got) == 19 and sum(r[2] for r in got) == 19 * 55


def test_edge_cases(odd_documents, no_documents):
    check(odd_documents, 50)
    check(odd_documents.unionByName(odd_documents), 3)
    assert sd.substring_report(no_documents).collect() == []
    assert sd.substring_report(no_documents).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_kept_text(spark):
    w = [f"x{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (2, "before\t" + "  ".join(w) + "\nafter")]
    got = {r.doc_id: r.text for r in sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: " ".join(w), 2: "before after"}


def test_rolling_and_planes():
    w = np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64)
    h = sd._Rolling(0x9E3779B97F4A7C15)(w, 7)
    again = sd._Rolling(0x9E3779B97F4A7C15)(w[13:], 7)
    assert len(h) == 94 and np.array_equal(h[13:], again) and len(set(h.tolist())) == 94
    x = np.array([0, 5, 70_000, 2**32 - 1], np.uint32)
    assert np.array_equal(sd._from_planes(sd._planes(x), np.uint32), x)
