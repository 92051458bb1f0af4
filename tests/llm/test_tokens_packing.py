import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablecare.llm.bpe import byte_bpe
from tablecare.llm.packing import first_fit_decreasing, pack_documents, sequences
from tablecare.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library, documents):
    rnd = random.Random(5)
    alphabet = ["a", "B", "é", "1", "23", " ", "  ", "\n", "\t", "'s", "'", "!", "…", "ß", " ", "\x1c", "\x85", "中", "<|endoftext|>", "don't", "12.5%"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += [r.text for r in documents.select("text").collect()]
    bpe = byte_bpe(PATH)
    for t in texts:
        want = library_ids(library, t)
        assert np.frombuffer(bpe.ids(t), np.uint32).tolist() == want, repr(t)
        assert bpe.count(t) == len(want)


def test_whole_tokens_are_proved(library):
    whole = byte_bpe(PATH).whole
    assert 40_000 < len(whole) <= 50_257
    for s in random.Random(1).sample(sorted(whole), 500):
        assert library_ids(library, s) == [whole[s]]


def test_token_counts_edge_cases(odd_documents, no_documents, library):
    rows = odd_documents.collect()
    got = token_counts(odd_documents).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library_ids(library, r.text))) for r in rows]
    assert sorted(((g.doc_id, g.n_bytes, g.n_tokens) for g in got), key=str) == sorted(want, key=str)
    assert all(g.over_limit == (g.n_tokens > 512) for g in got)
    assert token_counts(no_documents).collect() == []


def plain_first_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        for i, used in enumerate(bins):
            if used + s <= capacity:
                break
        else:
            bins.append(0)
            i = len(bins) - 1
        out.append((i, bins[i]))
        bins[i] += s
    return out


def test_tournament_tree_is_first_fit():
    rnd = random.Random(2)
    for _ in range(200):
        sizes = sorted((rnd.randint(1, 64) for _ in range(rnd.randint(0, 80))), reverse=True)
        assert first_fit_decreasing(sizes, 64) == plain_first_fit(sizes, 64)
    with pytest.raises(ValueError):
        first_fit_decreasing([65], 64)


def check_packing(rows, texts, library, length):
    """Every id in exactly one piece, gapless sequences within the length, right checksums."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = library_ids(library, texts[doc]) + [1], 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    return {k: sum(r.length for r in v) for k, v in by_seq.items()}


def test_packing_of_documents(documents, library):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    filled = check_packing(pack_documents(documents).collect(), texts, library, 2048)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in filled.values())
    assert padding <= 0.03 * sum(filled.values())
    small = check_packing(pack_documents(documents, length=64, group_pieces=500).collect(), texts, library, 64)
    assert len({k >> 32 for k in small}) > 1


def test_packing_edge_cases(odd_documents, no_documents, library):
    ids = odd_documents.where("doc_id is not null")
    check_packing(pack_documents(ids).collect(), {r.doc_id: r.text for r in ids.collect()}, library, 2048)
    both = pack_documents(odd_documents).collect()
    assert sum(r.length for r in both if r.doc_id is None) == len(library_ids(library, "no id at all here")) + 2
    assert pack_documents(no_documents).collect() == []


def test_sequences_hold_the_ids(documents, library):
    packed = pack_documents(documents.limit(40), with_ids=True)
    pieces = {(r.sequence_id, r.offset): r for r in packed.collect()}
    seqs = {r.sequence_id: r for r in sequences(packed).collect()}
    assert set(seqs) == {k for k, _ in pieces}
    for (seq, offset), r in pieces.items():
        assert seqs[seq].ids[4 * offset:4 * (offset + r.length)] == r.ids
    for s in seqs.values():
        assert len(s.ids) == 4 * (s.n_ids if s.n_ids & (s.n_ids - 1) == 0 else 2048)
