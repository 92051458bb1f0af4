import hashlib

import numpy as np
import pytest

from tablecare.llm import fingerprints as fp
from tablecare.llm.shingles import shingle_hashes, words


def text_of(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def expected(rows):
    """doc_id -> (n_chars, sha of the edited text) by a plain walk in descending order."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        moved = len(text) // 3
        out[doc] = (len(text), hashlib.sha256((text[:len(text) - moved] + following[:moved]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("range_bytes", [4 << 20, 20_000])
def test_edits_of_the_table(documents, monkeypatch, range_bytes):
    monkeypatch.setattr(fp, "RANGE_BYTES", range_bytes)  # one range, and many
    want = expected([(r.doc_id, r.text) for r in documents.collect()])
    got = fp.with_edits(documents).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(want)
    by_text = {}
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_sketch_rule():
    s = shingle_hashes(text_of(5000), 5)
    k = fp.sketch(text_of(5000))
    assert len(s) == 4996 and np.array_equal(k, s[s < fp._LIMIT]) and abs(len(k) / len(s) - 1 / 8) < 0.02
    assert len(fp.sketch("a b")) == 1 and len(fp.sketch("")) == len(fp.sketch(None)) == 0
    assert np.array_equal(fp.hashes(fp.fingerprint(k)), k)


def test_estimates_follow_the_sets():
    a, b = text_of(8000), text_of(8000, 4000)
    x, y = fp.sketch(a), fp.sketch(b)
    assert abs(fp.likeness(x, y) - 1 / 3) < 0.04 and abs(fp.containment(x, y) - 0.5) < 0.05
    part = fp.sketch(text_of(400))  # very unequal documents
    assert fp.containment(part, x) == 1.0 and fp.containment(x, part) < 0.1
    assert fp.likeness(fp.sketch(""), fp.sketch("")) == 1.0 and fp.likeness(fp.sketch("a"), fp.sketch("")) == 0.0


def test_merging_equals_the_sketch_of_all(spark):
    a, b = text_of(300), text_of(300, 200)
    both = np.unique(np.concatenate([shingle_hashes(a, 5), shingle_hashes(b, 5)]))
    want = fp.fingerprint(fp._cut(both))
    assert fp.merged([fp.fingerprint(fp.sketch(a)), fp.fingerprint(fp.sketch(b))]) == want
    df = spark.createDataFrame([("g", 1, a), ("g", 2, b), ("h", 3, ""), ("h", 4, None), ("g", 5, a)], "source string, doc_id long, text string")
    prints = df.select("source", fp.fingerprint_of("text").alias("fingerprint"))
    assert {r.source: r.fingerprint for r in fp.merged_fingerprints(prints, "source").collect()} == {"g": want, "h": ""}


def test_edge_cases(odd_documents, no_documents, spark):
    rows = fp.with_edits(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert fp.with_edits(no_documents).collect() == []
    ids = odd_documents.where("doc_id is not null")
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in fp.with_edits(ids).collect()} == expected([(r.doc_id, r.text) for r in ids.collect()])
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in fp.with_edits(one).collect()} == expected([(5, "abcdef")])
    twice = spark.createDataFrame([(5, "abcdef"), (5, "abcdef"), (4, "x y z")], "doc_id long, text string")
    assert len(fp.with_edits(twice).collect()) == 3
    assert len(fp.fingerprints(odd_documents).collect()) == odd_documents.count()


def test_words():
    assert words(" A\tb\x0bC\x1cd É ") == ["a".encode(), b"b", b"c\x1cd", "É".encode()]
    assert words(None) == words(" \n") == []
