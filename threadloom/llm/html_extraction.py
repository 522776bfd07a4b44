"""HTML extraction by union-free regular expressions inferred per host.

A page is a stream of tags and texts. Streams of one host are aligned one after
the other with the host's wrapper so far, element by element: what both have
stays; an element that only one side has becomes optional; alike neighbours
become a repeated group; texts that are equal on all pages stay constants of
the template, texts that differ become slots. The wrapper is a regular
expression without alternatives:

    html body nav ( ul ( li # /li )+ /ul )? /nav div.story h1 # /h1 ( p # /p )+ ( div.rail =1f0c /div.rail )? /div.story

Each of its elements carries sums over all pages: on how many it stands, how
many letters of prose and of link text it holds. Wrappers of tasks merge as
those of pages do, so a host that holds a third of all pages meets as one
wrapper per task.

The wrapper decides what a page's article is. From the root on, the element
goes on to the one child, not repeated, whose slots hold most of the prose
that the children on this page hold on a page of the host; where no child
does, the article is found. In it, constants of the template and groups of
links are left out, and what HTML itself or, where structure cannot tell, a
class name says is no article (forms, adverts, comments).
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._store import dropped, lean, written

#: Bytes of wrappers that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Share of its parent's prose that an element needs to be gone into, and the likeness by which elements of one name are the same.
DOMINANT, ALIKE = 0.7, 0.3
#: A text that so many unlike pages of a host hold at the same place is a constant of the template; a group with so large a share of link text is one of links.
TEMPLATE_PAGES, LINKED = 5, 0.8
#: Elements deeper than this are read as parts of the one above.
DEEPEST = 100

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "noscript", "template", "title", "svg", "iframe")}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_OUTSIDE = frozenset("head nav header footer aside form button select dialog menu label input object".split()) | set(_RAW)
#: Names that say what structure cannot tell from prose, as a whole word of a class or a whole id or role, never as a part of one.
_OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored comments comment-list commentlist replies disqus navigation navbar sidebar breadcrumb breadcrumbs "
    "cookie-banner cookie-notice cookie-consent newsletter newsletter-signup popup modal share-bar share-buttons social-share searchbox search-form login-form "
    "search complementary contentinfo banner dialog alertdialog menubar".split()
)


#: Elements that hold others; prose itself stands in the other blocks.
_HOLDERS = frozenset("html body div section article main center td table tbody tr ul ol dl fieldset".split())
EMPTY: frozenset = frozenset()
_FLOW = frozenset(("p", "li", "td", "th", "tr", "dd", "dt"))
#: Blocks of prose: inside an article they stay even where all pages have the same.
_PROSE = _FLOW | {"pre", "blockquote"}


def _label(tag: str, attributes: str) -> str:
    """Tag and class, id or role, numbers left out."""
    m = _ATTRIBUTE.search(attributes) if attributes else None
    name = re.sub(r"[\s()?+#=]+|\d+", "-", (m[2] or m[3] or m[4] or "").strip().lower()) if m else ""
    return f"{tag}.{name}" if name else tag


@lru_cache(maxsize=65536)
def _named_outside(attributes: str) -> bool:
    """Whether a class, id or role names what is no article."""
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if any(x in _OUTSIDE_NAMES for x in (value.split() if m[1].lower() != "id" else [value.strip()])):
            return True
    return False


class Node:
    """An element of a page or of a wrapper. ``common``: hashes of own texts that all its pages have; ``slot``: whether some have others."""

    __slots__ = ("label", "pages", "repeated", "prose", "links", "slot", "common", "kids", "named")

    def __init__(self, label, pages=1, repeated=False, prose=0, links=0, slot=False, common=(), kids=None):
        self.label, self.pages, self.repeated, self.prose, self.links, self.slot, self.common = label, pages, repeated, prose, links, slot, frozenset(common)
        self.kids: list[Node] = [] if kids is None else kids
        self.named = False

    @property
    def tag(self) -> str:
        return self.label.partition(".")[0]

    def total(self) -> tuple[int, int]:
        """Letters of prose and of link text in it and below."""
        prose, links = self.prose, self.links
        for kid in self.kids:
            p, n = kid.total()
            prose, links = prose + p, links + n
        return prose, links

    def inside(self) -> frozenset:
        """Labels of what it holds, two levels deep."""
        return frozenset(x.label for kid in self.kids for x in (kid, *kid.kids))


def _alike(a: Node, b: Node) -> float:
    """Likeness of two elements of one label: 1 for blocks of prose, else the share of common content; menus are never like prose."""
    if a.tag not in _HOLDERS or a.tag in ("html", "body"):
        return 1.0
    (p, n), (q, m) = a.total(), b.total()
    if min(p + n, q + m) >= 20 and (n > p) != (m > q):
        return 0.0
    x, y = a.inside(), b.inside()
    return len(x & y) / len(x | y) if x or y else 1.0


def _find(kids: list[Node], kid: Node, taken: set[int]) -> int:
    """Place of the element among ``kids`` that this one aligns with, or -1: the most alike of its label that is not taken."""
    best, at = ALIKE, -1
    for i, other in enumerate(kids):
        if other.label == kid.label and i not in taken and (like := _alike(other, kid)) > (best if at >= 0 else ALIKE - 1e-9):
            best, at = like, i
    return at


def folded(node: Node) -> Node:
    """A page's element with alike children as one repeated group each."""
    kids: list[Node] = []
    for kid in map(folded, node.kids):
        at = _find(kids, kid, set())
        if at < 0:
            kids.append(kid)
        else:
            _joined(kids[at], kid)
            kids[at].repeated = True
    node.kids = kids
    return node


def _joined(a: Node, b: Node) -> None:
    """Take ``b``, which follows on the same page, into ``a``."""
    a.prose, a.links, a.common, a.repeated = a.prose + b.prose, a.links + b.links, a.common | b.common, a.repeated or b.repeated
    for kid in b.kids:
        at = _find(a.kids, kid, set())
        if at < 0:
            a.kids.append(kid)
        else:
            _joined(a.kids[at], kid)


def aligned(a: Node, b: Node) -> Node:
    """The wrapper ``a`` with that of another page, or of other pages, of the host: one that matches both."""
    a.pages, a.prose, a.links, a.repeated = a.pages + b.pages, a.prose + b.prose, a.links + b.links, a.repeated or b.repeated
    a.slot, a.common = a.slot or b.slot or a.common != b.common, a.common & b.common
    taken: set[int] = set()
    last = -1
    for kid in b.kids:
        at = _find(a.kids, kid, taken)
        if at < 0:
            at = last + 1
            a.kids.insert(at, kid)
            taken = {i + (i >= at) for i in taken}
        else:
            aligned(a.kids[at], kid)
        taken.add(at)
        last = at
    return a


def expression(node: Node, pages: int | None = None) -> str:
    """The wrapper as a regular expression over tags: # is a slot, = a constant with its hash."""
    inner = [x for x in (*(f"={x[:4]}" for x in sorted(node.common)), "#" * node.slot, *(expression(kid, node.pages) for kid in node.kids)) if x]
    out = " ".join([node.label, *inner, f"/{node.label}"])
    optional = pages is not None and node.pages < pages
    return f"( {out} ){'*' if optional and node.repeated else '?' if optional else '+'}" if optional or node.repeated else out


def written_wrapper(node: Node) -> str:
    pack = lambda x: [x.label, x.pages, int(x.repeated), x.prose, x.links, int(x.slot), sorted(x.common), [pack(kid) for kid in x.kids]]
    return json.dumps(pack(node), separators=(",", ":"))


def read_wrapper(text: str) -> Node:
    """The wrapper that ``written_wrapper`` wrote."""
    unpack = lambda x: Node(x[0], x[1], bool(x[2]), x[3], x[4], bool(x[5]), x[6], [unpack(kid) for kid in x[7]])
    return unpack(json.loads(text))


def tokens(page: str):
    """(kind, tag, attributes or text): kinds are open, close and text. Comments, declarations and what scripts hold are left out."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                yield "close", tag, ""
            else:
                yield "open", tag, m[3]
                if tag in _RAW and not m[3].endswith("/"):
                    at = _RAW[tag].search(page, at).start()
        elif m.end() <= m.start():
            return


class Page:
    """A page's elements, and its stream: ("open" | "close", element, whether it is a block) and ("text", element, words)."""

    def __init__(self, page: str):
        self.root = Node("html")
        self.stream: list[tuple] = []
        self.texts: dict[int, frozenset] = {}
        own: dict[int, list[str]] = {}
        stack: list[tuple[str, Node | None]] = [("html", self.root)]
        path = [self.root]
        linked = 0

        def close():
            nonlocal linked
            tag, node = stack.pop()
            linked -= tag == "a"
            if node is not None:
                path.pop()
                self.stream.append(("close", node, tag in _BLOCK))

        def end(tag):
            """Close the innermost block if it is a ``tag``, with the inline marks left open in it."""
            k = len(stack) - 1
            while k and stack[k][1] is None and stack[k][0] not in _BLOCK:
                k -= 1
            if k and stack[k][0] == tag:
                while len(stack) > k:
                    close()

        for kind, tag, rest in tokens(page):
            if kind == "text":
                self.stream.append(("text", path[-1], rest))
                if n := sum(map(len, rest.split())):
                    node = path[-1]
                    own.setdefault(id(node), []).extend(html.unescape(rest).split())
                    if linked:
                        node.links += n
                    else:
                        node.prose += n
                continue
            if tag == "br":
                self.stream.append(("text", path[-1], " "))
            if tag in _BLOCK and not (kind == "close" and tag == "p"):
                end("p")  # a paragraph ends where a block begins or ends
            if kind == "open":
                if tag == "html" or tag in _VOID or rest.endswith("/") and tag not in _BLOCK:
                    continue
                if tag in _FLOW:
                    end(tag)
                node = None
                if (tag in _BLOCK or tag in _OUTSIDE) and len(path) < DEEPEST:
                    node = Node(_label(tag, rest))
                    node.named = bool(rest) and tag not in ("body", "article", "main", "header") and _named_outside(rest)
                    path[-1].kids.append(node)
                    path.append(node)
                    self.stream.append(("open", node, tag in _BLOCK))
                elif tag in _BLOCK:
                    self.stream.append(("open", None, True))
                linked += tag == "a"
                stack.append((tag, node))
            elif any(s[0] == tag for s in stack[1:]):
                while stack[-1][0] != tag:
                    close()
                close()
        while len(stack) > 1:
            close()
        for node in [self.root, *(x[1] for x in self.stream if x[0] == "open" and x[1])]:
            if id(node) in own:
                node.common = frozenset([hashlib.blake2b(" ".join(own[id(node)]).encode(errors="replace"), digest_size=8).hexdigest()])
                self.texts[id(node)] = node.common


def inferred(page: str) -> Node:
    """The wrapper of one page."""
    return folded(Page(page).root)


def _slots(node: Node, varies: bool) -> int:
    """Letters of prose in slots of the element and below; constants count where the host's pages have nothing else (``varies`` is false)."""
    if node.tag in _OUTSIDE:
        return 0
    own = 0 if varies and not node.slot else node.prose
    return own + sum(_slots(kid, varies) for kid in node.kids)


def _varies(node: Node) -> bool:
    return node.tag not in _OUTSIDE and (node.slot and node.prose > 0 or any(map(_varies, node.kids)))


def _paired(page: Node, wrapper: Node, out: dict[int, Node]) -> None:
    """Which element of the wrapper each element of the page is; alike children of a page are one of the wrapper's."""
    out[id(page)] = wrapper
    for kid in page.kids:
        at = _find(wrapper.kids, kid, set())
        if at >= 0:
            _paired(kid, wrapper.kids[at], out)


def _article(page: Node, of: dict[int, Node], varies: bool) -> Node:
    """The page's element that holds its article, by the wrapper."""
    while True:
        wrapper = of[id(page)]
        weights: dict[int, float] = {}
        for kid in page.kids:
            w = of.get(id(kid))
            if w is not None:
                weights[id(w)] = _slots(w, varies) / w.pages
        own = 0 if varies and not wrapper.slot else wrapper.prose / wrapper.pages
        whole = own + sum(weights.values())
        best = max((kid for kid in page.kids if id(kid) in of and of[id(kid)].tag in _HOLDERS and not of[id(kid)].repeated), key=lambda kid: weights[id(of[id(kid)])], default=None)
        if best is None or not whole or weights[id(of[id(best)])] < DOMINANT * whole:
            return page
        page = best


def _left_out(node: Node, whole: bool) -> bool:
    """Whether an element in the article is none of it: by HTML (the article's own header holds its title) or by its name."""
    return node.tag in _OUTSIDE and (node.tag != "header" or whole) or node.named


def _any_slot(node: Node) -> bool:
    return node.slot or any(map(_any_slot, node.kids))


def _menu(node: Node, wrapper: Node | None) -> tuple[bool, bool]:
    """Whether a group of links goes where it begins the article, and where it ends it: if all pages of the host have the same."""
    if wrapper is None or node.tag not in _HOLDERS or node.tag in ("html", "body") or not wrapper.kids:
        return False, False
    prose, links = wrapper.total()
    if not links or links < LINKED * (prose + links):
        return False, False
    alone = wrapper.pages == 1
    fixed = not alone and not _any_slot(wrapper)
    return alone or fixed, fixed


def main_text(page: str, wrapper: Node | None = None) -> str:
    """Blocks of the page's article, one per line, by its host's wrapper (the page's own without one)."""
    if not page:
        return ""
    read = Page(page)
    wrapper = wrapper or inferred(page)
    of: dict[int, Node] = {}
    _paired(read.root, wrapper, of)
    varies = wrapper.pages > 1 and _varies(wrapper)
    chosen = _article(read.root, of, varies)
    constants = varies and wrapper.pages >= TEMPLATE_PAGES and _varies(of[id(chosen)])
    for article in (chosen, read.root):
        text = _read(read, article, of, constants)
        if text:
            return text
    return ""


def _read(read: Page, article: Node, of: dict[int, Node], constants: bool) -> str:
    """Text of the article's blocks. What the template puts at its edges goes: groups of links and texts that all pages of the host have; between prose, all stays."""
    blocks: list[tuple[str, bool, bool]] = []  # a text, and whether it goes at the beginning and at the end
    now: list[str] = []
    fixed: list[bool] = []
    whole, texts = article.tag in ("html", "body"), read.texts
    out: list[bool] = []  # of the open elements inside the article
    menus: list[tuple[bool, bool]] = [(False, False)]

    def flush():
        text = " ".join(html.unescape("".join(now)).split())
        now.clear()
        if text:
            constant = all(fixed)
            first, last = menus[-1]
            blocks.append((text, constant or first, constant or last and whole))
        fixed.clear()

    def is_fixed(node: Node) -> bool:
        w = of.get(id(node))
        if not constants or w is None or w.pages < TEMPLATE_PAGES or not texts.get(id(node), EMPTY) & w.common:
            return False
        return whole or not (w.slot or node.tag in _PROSE)

    within = article is read.root
    for kind, node, rest in read.stream:
        if kind == "text":
            if within and not (out and out[-1]):
                now.append(rest)
                if rest.strip():
                    fixed.append(is_fixed(node))
            continue
        if within and rest and not (out and out[-1]):
            flush()
        if node is article:
            within = kind == "open"
        elif within and node is not None:
            if kind == "open":
                out.append(bool(out and out[-1]) or _left_out(node, whole))
                menus.append(tuple(a or b for a, b in zip(menus[-1], _menu(node, of.get(id(node))))))
            elif out:
                out.pop()
                menus.pop()
    flush()
    start, end = 0, len(blocks)
    while start < end and blocks[start][1]:
        start += 1
    while end > start and blocks[end - 1][2]:
        end -= 1
    return "\n".join(text for text, *_ in blocks[start:end])


def _inferred(batches):
    """A task's wrapper of each host; pages that are equal as a whole count once."""
    wrappers: dict[str, Node] = {}
    seen: set[bytes] = set()
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key = hashlib.blake2b(f"{host}\n{page}".encode(errors="replace"), digest_size=12).digest()
            if key not in seen:
                seen.add(key)
                found = inferred(page)
                wrappers[host] = aligned(wrappers[host], found) if host in wrappers else found
        if len(wrappers) > 20_000:
            yield _batch(wrappers)
            wrappers, seen = {}, set()
    yield _batch(wrappers)


def _batch(wrappers):
    return pa.RecordBatch.from_arrays([pa.array(list(wrappers), pa.string()), pa.array([written_wrapper(w) for w in wrappers.values()], pa.string())], names=["host", "wrapper"])


def _merged(batches):
    """The wrappers of tasks, sorted by host, as one each."""
    host = whole = None
    for batch in batches:
        done = {}
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == host:
                whole = aligned(whole, read_wrapper(text))
                continue
            if host is not None:
                done[host] = whole
            host, whole = name, read_wrapper(text)
        if done:
            yield _batch(done)
    if host is not None:
        yield _batch({host: whole})


def _host(url):
    """The host in a url, lower case; '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, ...) -> (host, wrapper), from all pages of each host; ``read_wrapper`` and ``expression`` show a wrapper."""
    slim = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("html <> ''")
    partial = slim.mapInArrow(lean(_inferred), "host string, wrapper string")
    return partial.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merged, "host string, wrapper string")


def _extracted(shared):
    """From rows (page_id, url, html, host or wrapper): their texts. ``shared``: wrappers by host, if they were broadcast."""

    def rows(batches):
        known = lru_cache(maxsize=256)(lambda text: read_wrapper(text) if text else None)
        for batch in batches:
            texts = [main_text(page, known(shared.value.get(x) if shared else x)) if page else "" for page, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, ...) -> (page_id, url, text, n_chars), a row for each input row.

    ``text`` is the page's article without anything around it, character
    references decoded, white space inside a block as one space, blocks joined
    by \\n; empty for null or empty html, or a page without text. A null url
    has the host ''. Rows that repeat a page_id stay apart. No rows: none.
    Other columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    slim = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("page_host"))
    found = written(wrappers(pages), "wrappers")
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    shared = None
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in found.collect()})
        dropped(found)
        rows = slim
    else:
        rows = slim.join(found, F.col("page_host") == F.col("host"), "left").select("page_id", "url", "html", "wrapper")
    return rows.mapInArrow(lean(_extracted(shared)), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
