import hashlib
import math

import numpy as np
import pytest

from tablecare.llm import vector_codes as vc

SF = "/root/testdata/sf0.001"


def brute(rows, parts=4, entries=256, rounds=4):
    """rows (vec_id, vector, label): every part against every entry, in whole numbers."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([[math.floor(1024 * v) for v in r[1]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].copy()

    def assign():
        d = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(len(books)):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    books[e, p] = [s // len(mine) for s in mine.sum(axis=0).tolist()]
    code, d = assign()
    error = d.sum(axis=1).tolist()
    digest = hashlib.sha256(",".join(str(v) for p in range(parts) for e in books[:, p].tolist() for v in e).encode()).hexdigest()
    total = {}
    for r, e in zip(kept, error):
        total[r[2]] = total.get(r[2], 0) + e
    return [(r[0], "".join(f"{c:02x}" for c in cs), e, total[r[2]], digest) for r, cs, e in zip(kept, code.tolist(), error)]


def check(df):
    got = sorted(map(tuple, vc.vector_codes(df).collect()), key=str)
    assert got == sorted(brute([(r.vec_id, r.embedding, r.label) for r in df.collect()]), key=str)
    return got


def test_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert len(check(df)) == 500


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    rows = [(int(i), [float(v) for v in np.round(rng.normal(size=8) * 3) / 4], None if i % 3 else int(i % 2), "x") for i in rng.permutation(700)]
    rows += [(1, [0.0] * 8, 1, "y"), (1, [0.0] * 8, 1, "y"), (None, [0.25] * 8, None, None), (2000, None, 1, None), (2001, [nan] * 8, 1, ""),
             (2002, [0.0] * 7 + [inf], 1, ""), (2003, [0.0] * 7 + [None], 1, ""), (2004, [], 1, ""), (2005, [1.0] * 12, 1, ""), (-5, [-1.0] * 8, 2, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string").repartition(4)
    assert len(check(df)) == 704


def test_few_equal_or_no_vectors(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    check(spark.createDataFrame([(i, [0.5, -0.5, 0.1, i % 2.0], None) for i in range(9)], ddl))
    assert vc.vector_codes(spark.createDataFrame([], ddl)).collect() == []
    assert vc.vector_codes(spark.createDataFrame([(1, None, 2)], ddl)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vc.vector_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 2)], ddl))


@pytest.mark.parametrize("seed,width,scale", [(0, 16, 400), (1, 2, 5), (2, 3, 40), (3, 16, 1 << 27), (4, 1, 3)])
def test_search_is_exact(seed, width, scale):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-scale, scale + 1, (20, width))
    def points(n):
        return centres[rng.integers(0, 20, n)] + rng.integers(-max(1, scale // 10), max(2, scale // 10), (n, width))
    for k in (1, 7, 31, 32, 33, 256):
        book = points(k)
        book[rng.integers(0, k, k // 4)] = book[0]  # entries that are equal
        x = np.concatenate([points(500), book])
        near, d, _ = vc.Codebook(book).nearest(x)
        all_d = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2).astype(np.int64)
        assert np.array_equal(near, all_d.argmin(axis=1)) and np.array_equal(d, all_d.min(axis=1))


def test_search_prunes():
    rng = np.random.default_rng(9)
    centres = rng.integers(-5000, 5000, (256, 8))
    x = centres[rng.integers(0, 256, 4000)] + rng.integers(-50, 50, (4000, 8))
    assert vc.Codebook(centres).nearest(x)[2] < 0.3 * 256 * len(x)
