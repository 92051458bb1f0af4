import hashlib
import random
import re

import pytest

from tablecare.llm import pii, secret_scan
from tablecare.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def in_text(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def plain_pii(text):
    """The contract's expressions as they stand."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def soup(seed, parts, n=4000):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_base_pii_spans_equal_the_expressions(documents):
    parts = ["a", "b.", "@", ".", "-", "x@y.z", "12", "1.2.3.4", "255", "256", ".", " ", "4111 1111 1111 1111", "4111111111111111", "+1",
             "(771)", "555-1655", "é", "0", "000000000000", "\n", "7"]
    for t in soup(1, parts) + [r.text for r in documents.collect()]:
        assert pii.base_spans(t) == plain_pii(t), repr(t)


def test_base_secret_spans_equal_the_expressions(documents):
    parts = ["password", "PassWord", "token", "tok", "en", "api_key", "apikey", "secret", "ſecret", "apiKey", "=", ":", " ", '"', "'", "abcdefgh",
             "AKIA", "AKIAABCDEFGH1234", "ABCD1234", "akia", "0123456789abcdef", "f", "İ", "x"]
    for t in soup(2, parts) + [r.text for r in documents.collect()]:
        got = [s for s in secret_scan.secret_spans(t) if s[1] < 3]
        assert got == plain_secrets(t), repr(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "token " * 50_000, "f" * 300_000):
        pii.candidates(t, pii.base_spans(t))
        secret_scan.secret_spans(t)


def test_checksummed_tokens():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good, bad = "ghp_" + body + secret_scan.base62_crc(body), "ghp_" + body + "AAAAAA"
    spans = secret_scan.secret_spans(f"x {good} {bad} npm_{body}{secret_scan.base62_crc(body)}")
    assert [(secret_scan.KINDS[k], e - s) for s, k, e in spans] == [("github", 40), ("npm", 40)]


def test_reports_over_the_table(spark, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for name, plain, kinds, n in (("op6_personal_data", plain_pii, pii.KINDS, 4), ("op7_secrets", plain_secrets, secret_scan.KINDS, 3)):
        rows = QUERIES[name][0](spark, SF).collect()
        assert sorted(r.doc_id for r in rows) == sorted(texts)
        for r in rows:
            base = plain(texts[r.doc_id])
            want = in_text(base, kinds)
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
            assert [r[f"n_{k}"] for k in kinds[:n]] == [sum(s[1] == i for s in base) for i in range(n)]


@pytest.fixture()
def contacts(spark):
    """Twelve known phone numbers after 'call me at', two written without +,
    and the same words for numbers of all kinds elsewhere."""
    rows = [(i, f"Hello there, call me at +1 (2{i:02d}) 555-01{i:02d} tomorrow") for i in range(12)]
    rows += [(100, "Hi, call me at (212) 555-0198 today"), (101, "the number (212) 555 0198 again"), (102, "Hi, call me at home please")]
    rows += [(200 + i, f"of the {n} is") for i, n in enumerate(["1.2.3.4", "4111111111111111", "+1 202 555 0100", "1234567890"])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_bootstrap_finds_unseen_identifiers(contacts):
    rows = {r.doc_id: r for r in pii.personal_data_report(contacts).collect()}
    assert rows[100].spans == "phone:15:29"  # "(212) 555-0198" beside the trusted pattern
    assert rows[101].spans == "phone:11:25"  # the same number elsewhere
    assert rows[102].spans == "" and rows[203].spans == ""
    assert all(rows[i].spans.startswith("phone:") and "," not in rows[i].spans for i in range(12))


def test_bootstrap_goes_on_until_nothing_changes(spark):
    """Numbers without + lead from one context to the next; the last is beside a context that no seed has."""
    contexts = ["please call me at {} tomorrow", "my mobile no {} thanks", "then reach desk {} always", "or dial line {} soon"]
    number = iter(f"({200 + i // 1000}) 555-{i % 1000:04d}" for i in range(10_000)).__next__
    texts = [contexts[0].format("+1 " + number()) for _ in range(900)]
    for here, size in enumerate((300, 80, 20)):
        for n in [number() for _ in range(size)]:
            texts += [contexts[here].format(n), contexts[here + 1].format(n)]
    texts.append(contexts[3].format("(719) 555-7777"))
    rows = pii.personal_data_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in rows}[len(texts) - 1] == "phone:13:27"
    assert all(r.spans.startswith("phone:") for r in rows)


def test_redaction(contacts, odd_documents, no_documents):
    got = {r.doc_id: r.text for r in pii.redact(contacts).collect()}
    assert got[0] == "Hello there, call me at [phone] tomorrow" and got[100] == "Hi, call me at [phone] today"
    assert got[102] == "Hi, call me at home please"
    same = pii.redact(odd_documents)
    assert same.columns == odd_documents.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, odd_documents.collect()))
    assert pii.redact(no_documents).collect() == []


def test_scan_edge_cases(odd_documents, no_documents):
    for report in (pii.personal_data_report, secret_scan.secret_report):
        rows = report(odd_documents).collect()
        assert len(rows) == odd_documents.count() and all(r.spans == "" for r in rows)
        assert report(no_documents).collect() == []
