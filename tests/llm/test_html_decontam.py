import html
import random
import re

import pytest

from tablecare.llm import decontam
from tablecare.llm.html_text import events, main_text, main_texts, own_main, templates
from tablecare.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def article(page):
    """The blocks of the only <article>, by plain substitution."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", m[1]))
    return "\n\n".join(p for p in parts if p)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    rows = QUERIES["op5_main_text"][0](spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


PAGE = """<!doctype html><html><head><title>t</title></head><body><div class="top-nav menu"><a href=/>Home</a></div>
<div id=wrap><div class=post><h1>{title}</h1>{body}</div><div class="box">Read more from us</div>
<section class="comments"><p>{comment}</p></section></div><script>if (a < b) document.write("<p>no</p>")</script></body></html>"""


def test_template_of_a_host(spark):
    """A host without article elements: the main element comes from the classes of its tokens."""
    rnd = random.Random(1)
    rows = []
    for i in range(12):
        body = "".join(f"<p>{' '.join(rnd.choice(['alpha', 'beta', 'gamma &amp; delta', 'eps']) + str(rnd.random()) for _ in range(30))}</p>"
                       for _ in range(rnd.randint(1, 4)))
        rows.append((i, "http://host.example/p", PAGE.format(title=f"Title {i}", body=body, comment="long comment " * 40)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = templates(df).collect()
    assert len(found) == 1 and found[0].pages == 12 and found[0].classes > 1 and found[0].main
    for r in main_texts(df).collect():
        blocks = r.text.split("\n\n")
        assert blocks[0] == f"Title {r.page_id}" and len(blocks) == 1 + rows[r.page_id][2].count("<p>") - 2
        assert "comment" not in r.text and "Read more" not in r.text and "& delta" in r.text or "gamma" not in r.text


def test_template_text_inside_the_main_element(spark):
    """Text that a host's template fixes is left out wherever it stands; a page of nothing else keeps its text."""
    legal = "All rights in this text remain with the people who wrote it, and nobody else may print it anywhere at all."
    page = "<body><div class=post><h1>Title {}</h1><p>{}</p><div class=tail>Tell a friend</div><p class=small>" + legal + "</p></div></body>"
    rows = [(i, "http://one.example/p", page.format(i, " ".join(f"word{i}x{j}" for j in range(40)))) for i in range(9)]
    rows += [(100 + i, "http://copies.example/p", page.format(0, "same words")) for i in range(9)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\n" + " ".join(f"word{i}x{j}" for j in range(40)) for i in range(9))
    assert all("same words" in got[100 + i] for i in range(9))


def test_odd_markup():
    assert list(events('a<b c="x>y">t</b><!-- <p> -->')) == [("text", "a"), ("open", "b", []), ("text", "t"), ("close", "b")]
    page = '<body><article><p>one &lt; two<p>three<br>four <b>five</article><footer>no</footer><p class="unclosed'
    assert main_text(page, own_main(page)) == "one < two\n\nthree four five"
    for junk in ("<" * 50_000, "<a \"" * 20_000, "<div>" * 3_000 + "x", "&am", "<script>" + "x" * 100_000, "<p" * 30_000, "</p>" * 30_000):
        main_text(junk, own_main(junk))
    assert main_text("plain words", own_main("plain words")) == "plain words"
    assert main_text(None, 0) == ""


def test_page_edge_cases(spark):
    rows = [(1, None, None, 1), (2, "http://a.example/x", "", 2), (None, "no url", "<p>text</p>", 3), (3, "http://a.example/y", "<article><p>one</p></article>", 4),
            (3, "http://a.example/y", "<article><p>one</p></article>", 4), (4, "http://b.example", "<p>" + "long " * 100_000 + "</p>", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host long")
    got = sorted(((r.page_id or 0, r.text[:9], r.n_chars) for r in main_texts(df).collect()))
    assert got == [(0, "text", 4), (1, "", 0), (2, "", 0), (3, "one", 3), (3, "one", 3), (4, "long long", 499_999)]
    assert main_texts(df.limit(0)).collect() == []


def brute_leaks(docs, items, least=0.9):
    """(doc, item) where nearly all of an item's runs of three words occur in the document."""
    out = set()
    for doc, text in docs:
        w = decontam.words(text)
        grams = {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
        for item, t in items:
            v = decontam.words(t)
            own = [tuple(v[i:i + 3]) for i in range(len(v) - 2)]
            if own and sum(g in grams for g in own) >= least * len(own):
                out.add((doc, item))
    return out


def test_leaks_of_the_table(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = QUERIES["op8_decontamination"][0](spark, SF).collect()
    want = brute_leaks([(r.doc_id, r.text) for r in documents.collect()], items)
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) and want


def test_search_equals_all_scores():
    """WAND with block maxima gives what scoring every item gives, and the array bounds never lose a passage."""
    rnd = random.Random(6)
    vocab = [f"v{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    items = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 50))) for _ in range(83)]
    index = decontam.Index(list(range(len(items))), items)
    texts = []
    for _ in range(60):
        w = [rnd.choice(vocab + ["other"] * 100) for _ in range(rnd.randint(0, 400))]
        if rnd.random() < 0.6:
            at = rnd.randint(0, len(w))
            w[at:at] = items[rnd.randrange(len(items))].split()
        texts.append(" ".join(w))
    found = [__import__("numpy").array([index.terms.get(w, -1) for w in t.split()], "int64") for t in texts]
    passed = set(index.passages(found))
    for d, terms in enumerate(found):
        for c in range(-(-len(terms) // index.chunk)):
            here = sorted({t for t in terms[c * index.chunk:(c + 2) * index.chunk].tolist() if t >= 0})
            want = {i for i, s in enumerate(index.shares) if sum(s.get(t, 0) for t in here) >= decontam.THRESHOLD}
            assert {i for i, _ in index.search(here)} == want
            last = c == -(-len(terms) // index.chunk) - 1
            assert not want or (d, c) in passed or (last and c)


def test_leak_edge_cases(spark, odd_documents, no_documents):
    item = "What is the answer to this long and odd question about things? It is forty two and nothing else."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "zzz yyy xxx www vvv"), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " * 300 + item.upper().replace(" ", "%%% ") + " after" * 200), (2, item[:62] + " unlike that"), (None, item),
                                  (3, "the answer to the question is long"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted({(r.doc_id or 0, r.item_id) for r in decontam.leaks(docs, bench).collect()}) == [(0, 1), (1, 1)]
    kept = decontam.decontaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == docs.columns
    assert decontam.leaks(no_documents, bench).collect() == decontam.leaks(docs, bench.limit(0)).collect() == []
    assert decontam.decontaminated(odd_documents, bench).count() == odd_documents.count()


def test_items_in_parts(spark, documents, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {(r.doc_id, r.item_id) for r in decontam.leaks(documents, bench).collect()}
    parts = list(decontam.indexes(bench, part_items=9))
    assert len(parts) > 2 and sum(len(p.ids) for p in parts) == bench.count()
    whole = next(decontam.indexes(bench))
    assert all((p.chunk, p.statistics.items) == (whole.chunk, bench.count()) for p in parts)
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    rows = sorted(map(tuple, decontam.leaks(documents, bench).collect()))
    monkeypatch.setattr(decontam, "indexes", lambda b: iter(parts))
    again = sorted(map(tuple, decontam.leaks(documents, bench).collect()))
    assert len(rows) == len(again) > 0
    for a, b in zip(rows, again):  # equal, whatever the parts
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)
    assert one <= {(d, p.ids[i]) for p in parts for (d, _), h in zip(texts, p.hits([t for _, t in texts])) for i, *_ in h}


def texts_of(spark, rows):
    return {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_near_copies_on_a_host_keep_their_article(spark):
    """Text that pages share is theirs, not the template's, where it is most of what they say."""
    article = "\n".join(f"<p>{' '.join(f'same{b}word{j}' for j in range(30))}</p>" for b in range(4))
    page = "<body><nav>Menu</nav><article><p>Posted on day {}.</p>{}<p>Tell a friend</p></article><footer>f</footer></body>"
    plain = "\n\n".join(" ".join(f"same{b}word{j}" for j in range(30)) for b in range(4))
    rows = [(i, "http://copies.example/a", page.format(i, article)) for i in range(4)]
    got = texts_of(spark, rows)
    assert got == {i: f"Posted on day {i}.\n\n{plain}\n\nTell a friend" for i in range(4)}
    # syndicated: four copies, of a class of their own, beside three other articles
    other = [" ".join(f"other{i}x{j}" for j in range(100)) for i in range(3)]
    rows += [(10 + i, "http://copies.example/a", page.format(i, f"<p>{o}</p>")) for i, o in enumerate(other)]
    rows = [(k, "http://syndicated.example/" + str(k), h) for k, _, h in rows]
    got = texts_of(spark, rows)
    assert all(got[i].startswith(f"Posted on day {i}.\n\n{plain}") for i in range(4))
    assert all(got[10 + i].startswith(f"Posted on day {i}.\n\n{o}") for i, o in enumerate(other))


def test_names_only_confirm(spark):
    """What an article stands in, and all that a page has, is no aside, whatever its classes say; on hosts of any number of pages."""
    article = "<article><h1>T{0}</h1><p>" + " ".join(f"w{{0}}x{j}" for j in range(60)) + "</p></article>"
    bare = "<h1>T{0}</h1><p>" + " ".join(f"w{{0}}x{j}" for j in range(60)) + "</p>"
    about = '<ul class="comments"><li><article class="comment"><p>I say {0}</p></article></ul>'
    text = "T{0}\n\n" + " ".join(f"w{{0}}x{j}" for j in range(60))
    rows, want = [], {}
    for h, name in enumerate(("has-sidebar", "layout has-sidebar no-comments", "related", "notice", "page header", "comment", "ad")):
        for pages in (1, 2, 3, 9):
            for kind, body in (("a", f'<div class="{name}">{article}</div>{about}'), ("b", f'<div class="{name}">{bare}</div>')):
                for i in range(pages):
                    want[len(rows)] = (name, pages, kind, text.format(i))
                    rows.append((len(rows), f"http://{kind}{h}x{pages}.example/", f"<body>{body}</body>".format(i)))
    got = texts_of(spark, rows)
    assert [w for i, w in want.items() if got[i] != w[-1]] == []


def test_paths_of_their_own_stay_out_of_the_deduction(spark):
    """Generated class names: what goes to a host's task doesn't grow with its pages, and their text counts."""
    page = '<body><div class="top menu">m</div><div class=post><div id="{0}x{0}"><p>{1}</p></div></div><div class=tail>read on</div></body>'
    rows = [(i, "http://hot.example/", page.format("".join(chr(97 + int(d)) for d in str(i)), " ".join(f"v{i}y{j}" for j in range(20)))) for i in range(40)]
    got = texts_of(spark, rows)
    assert all(got[i] == " ".join(f"v{i}y{j}" for j in range(20)) for i in range(40))


def test_deep_nesting():
    deep = "<div>" * 900 + "<p>" + "deep words " * 30 + "</p>"
    assert main_text("<body><div class=a>short</div>" + deep, own_main("<body><div class=a>short</div>" + deep)) == ("deep words " * 30).strip()
