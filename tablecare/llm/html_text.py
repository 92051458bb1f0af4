"""Main text of web pages by equivalence-class template deduction.

A page is a row of tokens: the element openings, each told apart by the path
of structural elements it opens under, and the text nodes under each path.  A token's *occurrence vector* holds how often it occurs in every page
of its host.  Tokens with equal vectors form an equivalence class.  A class
that occurs in at least half of the host's pages is valid, and the classes
nest by their paths: those that occur once a page are the template's skeleton,
those that occur any number of times (paragraphs, list items) repeat inside
it, and text in the class of an element (of at least two pages) may be part
of the template.  What the template doesn't fix are its slots.  The main element of a host is found on the skeleton: from
the root downwards, as long as one container holds most of its parent's slot
text.  A page's main text is the text of the slots in that element, without
elements that name themselves as menus, adverts, comments and the like.

Text counts as the template's only beside an article of the page's own: where
what the host repeats is more than ``_OWN`` of the text in a page's main
element, the page is a copy or a near copy of others and keeps it all.  Names
only confirm: what a ``main`` element, or else the page's first article, stands
in is no aside whatever its classes say; classes that tell of other elements
(``has-sidebar``, ``no-header``) are not names; and a page that names would
leave without text is read again without its classes.

Vectors are never held: equal vectors are recognised by two sums of hashes of
(page, count), which aggregate partially before the shuffle, so a host with a
third of all pages costs one row a task and token.  Every page adds up the text
below each of its elements itself, so a host's deduction sees only tokens of at
least half of its pages: no more than twice those of a page, however many rare
paths there are.  The templates, a row a host, meet the pages in a join whose
form Spark picks by their size.

A null or empty page, or one without text, has the empty text.  Pages without
a host in their url are taken as one host; a page that lacks its host's main
element gets the one that its own tokens give.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices, stored

# Element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style noscript textarea title template iframe svg math".split())
_CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
_CLOSED_BY_NEXT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                   "th": {"td", "th"}, "option": {"option"}}
# Names by which elements say that they aren't the article.
_ASIDE_TAGS = frozenset("head nav header footer aside form button select dialog menu object audio video canvas fieldset".split())
_ASIDE_WORDS = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert advertisement
adverts banner promo promotion sponsor sponsored cookie cookies consent notice notices alert popup modal newsletter subscribe subscription
signup login share sharing social related recommended comment comments respond replies disqus pagination pager toolbar widget""".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\s*/?\s*([^\s=>"'/][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_SHARE, _MOST, _OWN = 0.5, 0.6, 0.5
#: Pages that a class needs before its text counts as the template's: one page repeats nothing.
_LEAST = 2
#: Beginnings of classes that tell what stands elsewhere.
_ABOUT = ("has", "no", "with", "without", "hide", "show", "is", "not")


def _named(value: str) -> list[str]:
    """The words of the names in an attribute."""
    out = []
    for name in value.split():
        found = re.findall("[a-z]+", name)
        if found and (len(found) == 1 or found[0] not in _ABOUT):
            out += found
    return out


def events(page: str):
    """('text', text), ('open', name, words of class and id) and ('close', name); one pass from left to right."""
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        closing = page.startswith("/", lt + 1)
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            yield "text", "<"
            at = lt + 1
            continue
        name, at, words = m[0].lower(), m.end(), []
        while at < end and page[at] != ">":
            a = _ATTRIBUTE.match(page, at)
            if a:
                at = a.end()
                if a[1].lower() in ("class", "id", "role"):
                    words += _named((a[2] or a[3] or a[4] or "").lower())
            elif page[at] in "\"'":  # a quote that nothing closes takes the rest
                close = page.find(page[at], at + 1)
                at = end if close < 0 else close + 1
            else:
                at += 1
        at += 1
        if closing:
            yield "close", name
            continue
        yield "open", name, words
        if name in _RAW:  # its content isn't markup
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            at = close.start() if close else end


def _hash(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent} {label}".encode()) - (1 << 63)


def _text_token(path: int, text: str) -> int:
    return _hash(path, "text " + " ".join(text.split()))


def _is_aside(name: str, words: list[str], names: bool = True) -> bool:
    if name in _RAW or name in _ASIDE_TAGS:
        return True
    return names and name not in ("html", "body", "main", "article") and not _ASIDE_WORDS.isdisjoint(words)


_ANCHOR = re.compile(r"<(?:main|article)[\s/>]", re.I)


class _Walk:
    """Walks a page; calls ``opened(path, parent, name, aside)`` and ``text(path, text, in_link, aside)``, and
    ``broken()`` where a block ends.  Without ``names``, classes make no asides."""

    def __init__(self, opened=None, text=None, broken=None, names: bool = True):
        self.opened, self.text, self.broken, self.names = opened, text, broken, names

    @staticmethod
    def _nested(found: list, k: int, stack: list) -> bool:
        """Follows element event ``k`` on a stack of (name, event, ...): whether it opened an element there."""
        event = found[k]
        kind, name = event[0], event[1]
        if kind == "close":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            return False
        if stack[-1][0] == "p" or stack[-1][0] in _CLOSED_BY_NEXT.get(name, ()):
            stack.pop()
        return name not in _VOID

    def _around(self, found: list) -> frozenset[int]:
        """The events that open what the page's first main element, or else its first article, stands in."""
        stack, article = [("", -1)], None
        for k, event in enumerate(found):
            if event[0] == "text" or event[1] in _INLINE or not self._nested(found, k, stack):
                continue
            name = event[1]
            if name in ("main", "article"):
                outer = frozenset(i for _, i in stack if i >= 0)
                closed = any(found[i][1] in _RAW or found[i][1] in _ASIDE_TAGS - {"form"} for i in outer)
                if name == "main" and not closed:
                    return outer
                if article is None and not closed and _ASIDE_WORDS.isdisjoint(event[2]):
                    article = outer
            stack.append((name, k))
        return article or frozenset()

    def run(self, page: str) -> None:
        found = list(events(page))
        around = self._around(found) if _ANCHOR.search(page) else frozenset()
        stack, links = [("", 0, False)], 0  # name, path, aside
        for k, event in enumerate(found):
            kind, name = event[0], event[1]
            if kind == "text":
                self.text(stack[-1][1], name, links > 0, stack[-1][2])
                continue
            if name == "a":
                links = 1 if kind == "open" else 0
            if name in _INLINE:
                if name == "br":
                    self.text(stack[-1][1], " ", False, stack[-1][2])
                continue
            self.broken()
            if not self._nested(found, k, stack):
                continue
            words = event[2]
            aside = stack[-1][2] or (k not in around and _is_aside(name, words, self.names))
            path = _hash(stack[-1][1], f"{name} {' '.join(sorted(words))}")
            self.opened(path, stack[-1][1], name, aside)
            stack.append((name, path, aside))
            links = 0


def page_tokens(page: str) -> list[tuple]:
    """(token, parent, container, aside, count, chars) of a page's elements, with the text below them, and of its texts
    with container -1."""
    count, facts, chars = Counter(), {0: (0, 0, False)}, Counter()

    def opened(path, parent, name, aside):
        count[path] += 1
        facts[path] = (parent, int(name in _CONTAINERS) + (name in ("article", "main")), aside)

    def text(path, t, in_link, aside):
        if t.isspace() or aside:
            return
        n = len(t.strip())
        if not in_link:
            chars[path] += n
        token = _text_token(path, t)
        count[token] += 1
        facts[token] = (path, -1, aside)
        if not in_link:
            chars[token] += n

    _Walk(opened, text, lambda: None).run(page)
    count[0] = 1
    for path in reversed(facts):  # an element is met before what it holds
        parent, container, _ = facts[path]
        if path and container >= 0:
            chars[parent] += chars[path]
    return [(token, *facts[token], n, chars[token]) for token, n in count.items()]


def main_element(tokens, pages: int) -> int:
    """The path of the main element of ``pages`` pages, from those of their tokens that are in half of the pages:
    (token, parent, container, aside, n_pages, total, chars, vector)."""
    valid = [t for t in tokens if t[4] >= _SHARE * pages]
    parent = {t[0]: t[1] for t in valid if t[2] >= 0 and not t[3] and t[0]}
    holds = Counter({t[0]: t[6] for t in valid if t[2] >= 0 and not t[3]})
    fixed = set(template_texts(valid, pages))
    depth = {0: 0}
    for path in parent:
        way = []
        while path in parent and path not in depth:
            way.append(path)
            path = parent[path]
        base = depth.get(path, 0)
        for i, p in enumerate(reversed(way)):
            depth[p] = base + i + 1
    taken = Counter()
    for t in valid:
        if t[0] in fixed:  # text of the template is no slot's, wherever it counts
            taken[t[1]] += t[6]
    for path in sorted(parent, key=lambda p: (-depth[p], p)):
        taken[parent[path]] += taken[path]
    own = Counter({p: n - taken[p] for p, n in holds.items()})
    if own[0] > (1 - _OWN) * holds[0]:
        holds = own  # else these pages are copies of each other: all of their text counts
    children = defaultdict(list)
    skeleton = {t[0]: t[2] for t in valid if t[2] >= 1 and not t[3] and (t[5] == t[4] or t[2] == 2)}
    for path in skeleton:
        if path in parent:
            children[parent[path]].append(path)
    at, stop = 0, False
    while not stop and children[at]:
        best = max(children[at], key=lambda p: (holds[p], p))
        if holds[best] < _MOST * holds[at] or holds[best] <= 0:
            break
        at, stop = best, skeleton[best] == 2
    return at


def template_texts(tokens, pages: int) -> list[int]:
    """The text tokens that are in a valid class with an element, from tokens as in ``main_element``."""
    valid = [t for t in tokens if t[4] >= max(_LEAST, _SHARE * pages)]
    elements = {t[7] for t in valid if t[2] >= 0}
    return sorted(t[0] for t in valid if t[2] < 0 and t[7] in elements)


def main_text(page: str | None, main: int, fixed: frozenset[int] = frozenset(), names: bool = True) -> str:
    """Text under the path ``main`` (0: anywhere), block by block, without the text tokens ``fixed`` unless they are
    more than ``_OWN`` of it."""
    blocks, under, held = [], {0: main == 0}, [0, 0]
    block: list[tuple[str, bool]] = []

    def opened(path, parent, name, aside):
        under[path] = path == main or under.get(parent, False)

    def text(path, t, in_link, aside):
        if not aside and under.get(path, False):
            again = bool(fixed) and not t.isspace() and _text_token(path, t) in fixed
            held[again] += len(t.strip())
            block.append((t, again))

    def broken():
        if block:
            blocks.append(block.copy())
            block.clear()

    _Walk(opened, text, broken, names).run(page or "")
    broken()
    whole = held[1] > _OWN * sum(held)
    texts = (" ".join(html.unescape("".join(t for t, again in b if whole or not again)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def own_main(page: str) -> int:
    return main_element([(t, p, c, a, 1, n, ch, n) for t, p, c, a, n, ch in page_tokens(page)], 1)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


_TOKEN = "host string, token long, parent long, container int, aside boolean, low long, high long, count long, chars long"


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, pages, classes (valid equivalence classes), main (path of the main element) and fixed (the template's text
    tokens, no more than twice those of a page) of every host."""
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("parent", pa.int64()), ("container", pa.int32()),
                        ("aside", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("count", pa.int64()), ("chars", pa.int64())])

    def tokens(batches):
        for part in slices(batches, 64):
            rows = []
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                key = xxhash.xxh64_intdigest((page or "").encode())
                for token, parent, container, aside, n, chars in page_tokens(page or ""):
                    h = xxhash.xxh64_intdigest(f"{key} {n}".encode())
                    rows.append((host, token, parent, container, aside, h & 0xFFFFFFFF, h >> 32, n, chars))
            if rows:
                yield batch_of(schema, *zip(*rows))

    each = pages.select(_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html")).mapInArrow(tokens, _TOKEN)
    vectors = each.groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.max("container").alias("container"), F.max("aside").alias("aside"),
        F.count(F.lit(1)).alias("pages"), F.sum("count").alias("total"), F.sum("chars").alias("chars"),
        F.sum("low").alias("low"), F.sum("high").alias("high"))
    # a host's page count stands on its token 0; what is in less than half of the pages is slots, and goes here
    counts = vectors.where("token = 0").select("host", F.col("pages").alias("n"))
    kept = vectors.join(counts, "host").where(F.col("pages") >= _SHARE * F.col("n"))

    def deduce(group: pa.Table) -> pa.Table:
        cols = [group[c].to_pylist() for c in ("token", "parent", "container", "aside", "pages", "total", "chars", "low", "high")]
        rows = [(*r[:7], r[4:6] + r[7:]) for r in zip(*cols)]
        n = group["n"][0].as_py()
        classes = len({r[7] for r in rows if r[4] >= _SHARE * n})
        return pa.table({"host": group["host"].slice(0, 1), "pages": pa.array([n], pa.int64()),
                         "classes": pa.array([classes], pa.int64()), "main": pa.array([main_element(rows, n)], pa.int64()),
                         "fixed": pa.array([template_texts(rows, n)], pa.list_(pa.int64()))})

    return kept.groupBy("host").applyInArrow(deduce, "host string, pages long, classes long, main long, fixed array<long>")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = stored(templates(pages, url_col, html_col)).select("host", "main", "fixed")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches):
        for part in slices(batches, 64):
            texts = []
            for page, main, fixed in zip(*(part.column(i).to_pylist() for i in (2, 3, 4))):
                text = main_text(page, main or 0, frozenset(fixed or ()))
                if not text and page:
                    text = main_text(page, own_main(page)) or main_text(page, 0, names=False)
                texts.append(text)
            yield batch_of(schema, part.column(0), part.column(1), texts, [len(t) for t in texts])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.col(f"`{html_col}`").alias("html"), _host(F.col(f"`{url_col}`")).alias("host"))
    return (rows.join(found, "host", "left").select("page_id", "url", "html", "main", "fixed")
            .mapInArrow(extract, "page_id long, url string, text string, n_chars long"))
