import random
import re
import zlib
from collections import Counter

import numpy as np

from tablecare.llm import spelling


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(rows, one_in=None):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if one_in and h % one_in == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    by_gap = {}
    for w in n:  # words one edit apart share a string with one place left out
        for s in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_gap.setdefault(s, set()).add(w)
    near = {w: set() for w in n}
    for group in by_gap.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda b: (-n[b], b))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def check(df, one_in=None):
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(df, one_in=one_in).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], one_in)
    return got


def test_table_equals_brute_force(documents):
    got = check(documents, 199)
    assert any(v[0] for v in got.values())


def test_invented_words(spark):
    """Chains of forms, ties, words that share their reduced word, and letters outside ASCII."""
    rnd = random.Random(2)
    n = Counter({"kitten": 3000, "kittem": 600, "kitteem": 100, "kitteeem": 12, "sittem": 600, "aaaaaa": 50, "aaaaaaa": 500, "aaaaaaaa": 9,
                 "iiiiii": 9, "aaaaai": 9, "façade": 40, "facade": 8, "fàçade": 6, "ÀÉÎÕÜ": 10, "naïveté": 30, "naïvete": 6, "×÷×÷×÷": 6})
    for _ in range(800):
        n["".join(rnd.choice("aiqb") for _ in range(rnd.randint(5, 8)))] += rnd.choice([4, 5, 6, 30, 200])
    words = [w if rnd.random() < .7 else w.upper() if w.isascii() else w for w, c in n.items() for _ in range(c)]
    rnd.shuffle(words)
    rows = [(i, rnd.choice(["-", " ", "1", ", "]).join(words[i::90])) for i in range(90)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got["kitteeem"][:2] == ("kitteem", "kitten") and got["façade"][0] is None and got["facade"][0] == "façade"


def test_long_words_cost_their_length(spark):
    long = "abcdefgh" * 2000
    rows = [(i, f"{long} {long[:-1]} {'x' * 300}") for i in range(6)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[long][3] == 1 and len(got) == 3


def test_edge_cases(spark, odd_documents, no_documents):
    check(odd_documents, 199)
    check(odd_documents.unionByName(odd_documents), 1)
    assert spelling.spelling_variants(no_documents).collect() == []


def test_neighbourhoods_are_full():
    words = ["abcabc", "aaaaaa", "üßðœx".replace("œ", "a") + "yz"]
    for w in words:
        symbols = spelling.reduced([w])
        n = symbols.shape[1]
        got = set(spelling.neighbour_keys(symbols)[0].tolist())
        s = symbols[0].tolist()
        want = [s] + [s[:i] + s[i + 1:] for i in range(n)] + [s[:i] + [c] + s[i + 1:] for i in range(n) for c in range(1, 9)] + [
            s[:i] + [c] + s[i:] for i in range(n + 1) for c in range(1, 9)]
        assert got == {int(spelling.own_keys(np.array([x], np.uint64))[0]) for x in want}
