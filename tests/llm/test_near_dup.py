import random

import numpy as np
import pytest

from tablecare.llm import near_dup
from tablecare.llm.graphs import components
from tablecare.llm.shingles import words


def brute(rows, k, percent=80):
    """doc_id -> (set size, smallest id reachable), over all pairs of full sets."""
    sets = {}
    for doc, text in rows:
        w = words(text)
        sets[doc] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    label[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def family(seed, n, size, changes, base_id=0):
    """Near copies of one text: each with some words changed."""
    rnd = random.Random(seed)
    first = [f"t{seed}x{rnd.randint(0, 10**6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        w = list(first)
        for _ in range(rnd.randint(0, changes)):
            w[rnd.randrange(size)] = f"c{rnd.randint(0, 10**9)}"
        rows.append((base_id + i, " ".join(w)))
    return rows


def as_map(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_table_equals_brute_force(documents):
    for k in (4, 5):
        assert as_map(near_dup.near_duplicates(documents, k=k)) == brute([(r.doc_id, r.text) for r in documents.collect()], k)


@pytest.mark.parametrize("most", [1000, 25])
def test_families_of_near_copies(spark, monkeypatch, most):
    """Large families, with members that only reach others through a third; in one task, and in blocks."""
    monkeypatch.setattr(near_dup, "GROUP_CLASSES", most)
    rows = family(1, 120, 60, 5, 1000) + family(2, 60, 200, 12, 5000) + family(3, 30, 12, 1, 9000)
    common = "this passage stands in very many documents of the table and says nothing about them at all"
    rows += [(20_000 + i, f"{common} {' '.join(f'o{i}w{j}' for j in range(6))}") for i in range(60)]
    rows += [(30_000 + i, rows[i % 7][1]) for i in range(50)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_map(near_dup.near_duplicates(df, k=4)) == brute(rows, 4)


def test_pairs_at_the_threshold(spark):
    """Exactly 80 of 100 shingles in common is a link, 79 is none."""
    base = [f"b{i}" for i in range(93)]  # 90 shingles of four words
    rows = []
    for n in range(40):
        own = [f"d{n}_{w}" for w in base]
        rows += [(4 * n, " ".join(own)), (4 * n + 1, " ".join(own[:83] + [f"e{n}_{i}" for i in range(10)]))]  # 80 of 100
        rows += [(4 * n + 2, " ".join([f"f{n}_{i}" for i in range(93)]))]
    got = as_map(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4))
    assert got == brute(rows, 4) and got[1] == (90, 0)


def test_edge_cases(odd_documents, no_documents):
    got = near_dup.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[5].component_id, by[6].component_id, by[6].kept) == (5, 5, False)
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (1, 2, 7))
    assert near_dup.near_duplicates(no_documents).collect() == []
    kept = near_dup.deduplicated(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert kept.where("doc_id is null").count() == 2
    assert near_dup.deduplicated(odd_documents.unionByName(odd_documents).where("doc_id is not null")).count() == 8


def test_half_keys_are_few():
    keys = near_dup.half_keys([np.arange(1, 50, dtype=np.uint64), np.arange(1, 50, dtype=np.uint64)])
    assert keys.shape == (2, 2 * near_dup.HALVES) and np.array_equal(keys[0], keys[1])


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        label[max(p, q)] = min(p, q)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(label) if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
