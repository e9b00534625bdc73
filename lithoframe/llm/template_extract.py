"""Main text of web pages by deducing each host's template from token equivalence classes.

A page is a sequence of tokens: each start and end tag in its context (the path of tags, classes and ids above it) and
each text block in its context. The template of a host is found from the token sequences of its pages, of which those of one block
sequence have one vote:

* Classes. The occurrence vector of a token is how often it stands on each page; it is kept as the number of those pages
  and a commutative hash over (page, count), so vectors are aggregated before any shuffle and no host's pages ever meet
  in one task. Tokens of equal vectors on enough pages are an equivalence class; an end tag is in its start tag's class.
* Tree. On each page a class must be ordered (its tokens repeat in one order, the same on all pages) and nested (its runs
  open in one slot of one class, the same on all pages, and are closed before that slot ends). Classes that are, and that
  hold a tag, are the nodes of the template tree; text of their own is template text, and what stands between two
  neighbouring tokens of a class is a slot. The main slot is the deepest one whose subtree holds nearly all (``NEARLY_ALL``)
  of the text that pages without ``article`` or ``main`` have in slots.

Extraction parses a page with the tree, which puts each text block in its slot. Template text is left out (in an article
only while it is less than half of the article, so that mirrors of one article keep it). The article is what ``article``
(else ``main``) marks; without either it is the main slot, or on hosts without one the deepest container that holds
nearly all of the page's text. No vector tells an advert that changes with each page from the article, so elements whose
tag, role or name mark menus, headers, footers, sidebars, notices, adverts, forms or reader comments go with all they
hold; a name is such a mark only if each of its words is in ``CHROME`` or in ``PLAIN`` and one at least in ``CHROME``.
White space inside a block becomes one space; blocks are joined by two line feeds.

Defined results: null and empty html give the empty text; broken markup never fails and takes linear time (a tag without
``>`` is text, an open quote in a tag ends with the tag; tags close as in browsers, as far as blocks are concerned); a
host of fewer than ``least_pages`` distinct pages has no template, as equal vectors say nothing there; urls that are null
or can't be read are one host, named by the empty string; repeated rows each get their own result; pages of any length
and depth are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.components import drop, written
from lithoframe.llm.textarr import BROADCAST_BYTES, settle

NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
SKIPPED = frozenset("head svg math object select button canvas audio video map datalist dialog form nav footer aside menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset(("div", "section", "td", "article", "main", "body", ""))
CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
#: Words that mark what isn't the article.
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "side sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar foot footer legal comment comments commentlist disqus reply replies respond "
    "related recommended recommendations share sharing social subscribe subscription newsletter signup login search form widget widgets toolbar pagination pager skip copyright".split()
)
#: Words that say nothing of the content beside one of those.
PLAIN = frozenset(
    "a area article articles author avatar b bar block blog body bottom box btn button buttons cat col column container content count cta date email entry fixed global group head header "
    "holder i icon icons info inner inline item items label law left lg link links list main manager md media message meta middle mobile more name news now outer page pages panel policy post posts "
    "primary reader readers reading region right row secondary section site slot sm stories story sub sticky tabs tertiary text this thread title top topics trail unit user users warning wrap wrapper x xs".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
KEEP, HEADING_ONLY, DROP = 0, 1, 2
#: Tokens from here on are text; below are start tags, and end tags are their start tags' tokens, negative.
TEXTS = 1 << 62
#: The part of the text that the main slot, or a page's main container, must hold where no article or main marks it.
NEARLY_ALL = 0.9
#: The class and slot of what stands in no class.
ROOT = (0, 0)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): htmllib.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _words(attrs: dict[str, str], known: frozenset[str]) -> set[str]:
    """The words of those classes and of that id which hold nothing but known words."""
    out: set[str] = set()
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        parts = {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)}
        if parts <= known:
            out |= parts
    return out


def _kind(tag: str, attrs: dict[str, str]) -> int:
    """Whether an element's text is kept, only its headings are, or it is dropped."""
    if tag in SKIPPED or "hidden" in attrs or attrs.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return DROP
    if tag == "header":
        return HEADING_ONLY
    if not attrs or tag in ("html", "body", "main"):
        return KEEP
    marks = _words(attrs, CHROME | PLAIN) & CHROME
    if tag == "article":
        return DROP if marks & COMMENTS else KEEP
    if marks:
        return DROP
    return HEADING_ONLY if "header" in _words(attrs, PLAIN) else KEEP


def _hash(path: int, text: str) -> int:
    """A path's number: a positive 62-bit hash over its parent's and its own label."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), path) >> 2 or 1


def text_token(path: int, text: str) -> int:
    return _hash(path, "\x00" + text) | TEXTS


_known: dict[tuple[int, str, str], tuple[int, int, bool]] = {}


def _element(above: int, tag: str, raw: str) -> tuple[int, int, bool]:
    """Path, kind and whether it is main, of a start tag; kept, as a site's pages repeat them."""
    if (got := _known.get((above, tag, raw))) is None:
        attrs = _attributes(raw)
        label = tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").split())) + (f"#{attrs['id']}" if attrs.get("id") else "")
        got = _hash(above, label), DROP if tag in RAW else _kind(tag, attrs), tag == "main" or attrs.get("role", "") == "main"
        if len(_known) > 50_000:
            _known.clear()
        if len(raw) < 200:
            _known[above, tag, raw] = got
    return got


class Walk:
    """Tokens and text blocks of one page. A path is a hash over its parent's and its own label."""

    def __init__(self, page: str):
        #: tag, kind, in article, in main, path, in a heading, container's path, block's path, places of the open block and paragraph
        self.stack: list[tuple] = [("", KEEP, False, False, 1, False, 1, 1, 0, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        #: the container around each container, outer ones first
        self.around: dict[int, int] = {1: 0}
        #: block's path, kept, in article, in main, container, text
        self.blocks: list[tuple[int, bool, bool, bool, int, str]] = []
        #: the page's tokens in order, and those of its blocks
        self.sequence: list[int] = []
        self.block_tokens: list[int] = []
        self.text: list[str] = []
        self.page, self.loose, self.closable = page, False, True
        self._read()
        self._flush()
        self._pop_to(1)

    def _read(self) -> None:
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            lt = page.find("<", at)
            if lt != at:
                self.text.append(page[at : lt if lt >= 0 else end])
                if lt < 0:
                    return
                at = lt
            if page.startswith("<!--", at):
                gt = page.find("-->", at + 4)
                at = gt + 3 if gt >= 0 else end
                continue
            if page.startswith("<![CDATA[", at):
                gt = page.find("]]>", at + 9)
                self.text.append(page[at + 9 : gt if gt >= 0 else end].replace("&", "&amp;"))
                at = gt + 3 if gt >= 0 else end
                continue
            closing = page.startswith("</", at)
            name = NAME.match(page, at + 1 + closing)
            if name is None and not page.startswith(("<!", "<?"), at):
                gt = -1
            else:
                gt = self._tag_end(name.end() if name else at + 2, quoted=name is not None)
            if gt < 0:
                self.text.append("<")
                at += 1
                continue
            at = gt + 1
            if name is None:
                continue
            tag = name[0].lower()
            if closing:
                self._close(tag)
                continue
            self._open(tag, page[name.end() : gt])
            if tag in RAW:
                m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = m.start() if m else end

    def _tag_end(self, at: int, quoted: bool) -> int:
        """Where the tag's ``>`` is, or -1. What is found out once for the rest of the page isn't sought again."""
        page, first = self.page, at
        while self.closable:
            m = STOP.search(page, at) if quoted and not self.loose else None
            if m is None or m[0] == ">":
                gt = m.start() if m else page.find(">", first)
                self.closable = gt >= 0
                # a quote that is never closed, or closed behind the last '>', is no quote from here on
                self.loose |= m is None and quoted and gt >= 0
                return gt
            to = page.find(m[0], m.end())
            if to < 0:
                self.loose = True
            at = to + 1
        return -1

    def _flush(self) -> None:
        if not self.text:
            return
        t = " ".join(htmllib.unescape("".join(self.text)).split())
        self.text = []
        if not t:
            return
        _, kind, art, main, _, heading, container, block, _, _ = self.stack[-1]
        token = text_token(block, t)
        self.sequence.append(token)
        self.block_tokens.append(token)
        self.blocks.append((block, kind == KEEP or (kind == HEADING_ONLY and heading), art, main, container, t))

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _, _, _, path, *_ = self.stack.pop()
            self.places[tag].pop()
            self.sequence.append(-path)

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def _open(self, tag: str, raw: str) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCK:
            self._flush()
            if self.stack[-1][9]:  # an open paragraph ends where a block begins
                self._pop_to(self.stack[-1][9])
            if tag in CLOSES:
                while (k := self._last(CLOSES[tag])) > self._last(HOLDS[tag]):
                    self._pop_to(k)
        elif tag in CLOSES and (k := self._last(CLOSES[tag])) > self._last(HOLDS[tag]):
            self._pop_to(k)
        _, kind, art, main, above, heading, container, block, block_at, p_at = self.stack[-1]
        path, own, is_main = _element(above, tag, raw)
        self.sequence.append(path)
        if tag in VOID:
            return
        if tag in CONTAINERS:
            self.around.setdefault(path, container)
            container = path
        at = len(self.stack)
        if tag in BLOCK:
            block, block_at, p_at = path, at, at if tag == "p" else 0
        self.places[tag].append(at)
        self.stack.append((tag, max(kind, own), art or tag == "article", main or is_main, path, heading or tag in HEADINGS, container, block, block_at, p_at))

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        # an inline end tag doesn't close blocks
        if (k := self._last((tag,))) and (tag in BLOCK or k > self.stack[-1][8]):
            self._pop_to(k)


def page_tokens(walk: Walk) -> Counter[int]:
    """Counts of a page's start tags and texts; 0 stands for the page itself."""
    return Counter([0, *(t for t in walk.sequence if t > 0)])


def is_tag(token: int) -> bool:
    return token < TEXTS


def _orders(sequence: list[int], classes: dict[int, int]) -> dict[int, tuple[int, ...]]:
    """Of each class on a page: the order in which its tokens repeat, or () if they don't repeat in one order."""
    seen: dict[int, list[int]] = defaultdict(list)
    for token in sequence:
        if c := classes.get(abs(token), 0):
            seen[c].append(token)
    out = {}
    for c, tokens in seen.items():
        run = tuple(tokens[: len(set(tokens))])
        out[c] = run if len(set(run)) == len(run) and len(tokens) % len(run) == 0 and run * (len(tokens) // len(run)) == tuple(tokens) else ()
    return out


class Parse:
    """A page parsed with ordered classes: in which slot each block stands, and where each class opens."""

    def __init__(self, sequence: list[int], classes: dict[int, int], sizes: dict[int, int]):
        #: open runs, inner ones last: class and slot
        stack: list[tuple[int, int]] = []
        held: set[int] = set()
        self.parent: dict[int, tuple[int, int]] = {}
        self.broken: set[int] = set()
        #: the open slots of each block in no class of its own, inner ones last
        self.slots: dict[int, tuple[tuple[int, int], ...]] = {}
        turn: Counter[int] = Counter()
        block = -1
        for token in sequence:
            c = classes.get(abs(token), 0)
            block += token >= TEXTS
            if c not in sizes:
                if token >= TEXTS:
                    self.slots[block] = tuple(stack)
                continue
            k = turn[c] % sizes[c]
            turn[c] += 1
            if k == 0:
                opens = stack[-1] if stack else ROOT
                if self.parent.setdefault(c, opens) != opens:
                    self.broken.add(c)
            elif c not in held:
                self.broken.add(c)
                continue
            else:
                while stack[-1][0] != c:
                    self.broken.add(stack[-1][0])
                    held.discard(stack.pop()[0])
                stack.pop()
                held.discard(c)
            if k < sizes[c] - 1 and c not in held:
                stack.append((c, k))
                held.add(c)
        self.broken |= held


def free_text(walk: Walk) -> list[int]:
    """The length of each block as far as it is kept, on a page without a kept block in article or main; else 0."""
    free = not any(kept and (art or main) for _, kept, art, main, _, _ in walk.blocks)
    return [len(t) if free and kept else 0 for _, kept, _, _, _, t in walk.blocks]


def page_shape(sequence: list[int], lengths: list[int], classes: dict[int, int]) -> tuple[list[tuple[int, int, int, int, bool, int]], list[tuple[int, int, int]]]:
    """(class, hash of its order, parent class, parent slot, nested, width) and (class, slot, length of its text) of one page."""
    orders = _orders(sequence, classes)
    parse = Parse(sequence, classes, {c: len(o) for c, o in orders.items() if o})
    shape = [(c, xxhash.xxh64_intdigest(repr(o).encode(), 5) >> 1, *parse.parent[c], c not in parse.broken, len(o)) if o else (c, 0, 0, 0, False, 0) for c, o in orders.items()]
    held: Counter[tuple[int, int]] = Counter()
    for b, open_ in parse.slots.items():
        if lengths[b]:
            held[open_[-1] if open_ else ROOT] += lengths[b]
    return shape, [(c, k, n) for (c, k), n in held.items()]


def main_slot(tree: dict[int, tuple[bool, int, int]], held: dict[tuple[int, int], int]) -> tuple[int, int]:
    """The deepest slot whose subtree holds nearly all text; ROOT if only the page does. ``tree``: valid, parent, its slot of each class."""

    def up(slot: tuple[int, int]) -> list[tuple[int, int]]:
        """The slots of valid classes around a slot and itself, inner ones first."""
        out, seen = [], set()
        while slot[0] and slot[0] in tree and slot[0] not in seen:
            seen.add(slot[0])
            valid, *above = tree[slot[0]]
            if valid:
                out.append(slot)
            slot = tuple(above)
        return out

    below: Counter[tuple[int, int]] = Counter()
    depth: dict[tuple[int, int], int] = {}
    for slot, n in held.items():
        chain = up(slot)
        for k, s in enumerate(chain):
            below[s] += n
            depth[s] = len(chain) - k
    total = sum(held.values())
    return max((s for s, n in below.items() if n >= NEARLY_ALL * total and n), key=lambda s: (depth[s], s), default=ROOT)


class Template:
    """What extraction needs of a host's template: the class of each token of a valid class, their sizes, the main slot."""

    def __init__(self, tokens: list[int] = (), classes: list[int] = (), sizes: dict[int, int] | None = None, main: tuple[int, int] = ROOT):
        self.of, self.sizes, self.main = dict(zip(tokens, classes)), sizes or {}, main


def main_text(walk: Walk, template: Template | None = None, full: bool = True) -> str:
    """The main text of a page by its host's template, if it has one. ``full``: template text goes from articles as well."""
    template, blocks = template or Template(), walk.blocks
    fixed = [t in template.of for t in walk.block_tokens]
    size = common = 0
    for (_, kept, art, main, _, t), f in zip(blocks, fixed):
        if kept and (art or main):
            size += len(t)
            common += len(t) * f
    full = full and 2 * common < size
    left = [k for k, ((_, kept, art, main, _, _), f) in enumerate(zip(blocks, fixed)) if kept and not (f and (full or not (art or main)))]
    for place in (2, 3):
        if any(blocks[k][place] for k in left):
            return "\n\n".join(blocks[k][5] for k in left if blocks[k][place])
    if template.main != ROOT:
        slots = Parse(walk.sequence, template.of, template.sizes).slots
        if inside := [k for k in left if template.main in slots.get(k, ())]:
            return "\n\n".join(blocks[k][5] for k in inside)
    # The deepest container that holds nearly all of the text, with what is below it.
    below: Counter[int] = Counter()
    for k in left:
        below[blocks[k][4]] += len(blocks[k][5])
    total, inside = sum(below.values()), set()
    for c in reversed(walk.around):
        below[walk.around[c]] += below[c]
    depth = {0: 0}
    for c, above in walk.around.items():
        depth[c] = depth[above] + 1
    best = max((c for c in walk.around if below[c] >= NEARLY_ALL * total), key=depth.__getitem__)
    for c, above in walk.around.items():
        if c == best or above in inside:
            inside.add(c)
    return "\n\n".join(blocks[k][5] for k in left if blocks[k][4] in inside)


def _vote(walk: Walk) -> int:
    """A hash of a page's block sequence: pages of one host that share it have one vote."""
    return xxhash.xxh64_intdigest(np.array(walk.block_tokens, np.int64).tobytes(), 3) >> 1


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], at_once: int) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most so many."""
    while part := list(islice(rows, at_once)):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part), kinds)], names=names)


def _by_host(batches: Iterator, own: int, make) -> Iterator[tuple]:
    """(own columns, host, make(the columns after it)) of each row; what is made is kept for up to 1,000 hosts."""
    held: dict = {}
    for columns in batches:
        settle()
        for at in range(0, len(columns[0]), 64):
            part = [x.slice(at, 64) for x in columns]
            for j, (*mine, name) in enumerate(zip(*(x.to_pylist() for x in part[: own + 1]))):
                if name not in held:
                    if len(held) > 1000:
                        held.clear()
                    held[name] = make(*(x[j].as_py() for x in part[own + 1 :]))
                yield mine, name, held[name]


def sequences(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, page, sequence, lengths, tokens, ns) of one page of each distinct block sequence of a host, written."""
    names = ["host", "page", "sequence", "lengths", "tokens", "ns"]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            for part in (batch.slice(at, 64) for at in range(0, len(batch), 64)):
                for u, h in zip(part.column("u").to_pylist(), part.column("h").to_pylist()):
                    walk = Walk(h or "")
                    got = page_tokens(walk)
                    yield host_of(u), _vote(walk), walk.sequence, free_text(walk), list(got.keys()), list(got.values())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(it), names, kinds, 128)

    seen = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInArrow(run, "host string, page long, sequence array<long>, lengths array<int>, tokens array<long>, ns array<long>")
    return written(seen.dropDuplicates(["host", "page"]), "sequences")


def deduce(pages: DataFrame, url_col: str = "url", html_col: str = "html", support: float = 0.6, least_pages: int = 3) -> DataFrame:
    """(host, host_pages, class, class_pages, tokens): each host's equivalence classes of at least two tokens."""
    return classes_of(sequences(pages, url_col, html_col), support, least_pages)


def classes_of(seen: DataFrame, support: float = 0.6, least_pages: int = 3) -> DataFrame:
    flat = seen.select("host", "page", F.explode(F.arrays_zip("tokens", "ns")).alias("z")).select("host", "page", F.col("z.tokens").alias("token"), F.col("z.ns").alias("n"))
    vectors = flat.groupBy("host", "token").agg(F.count(F.lit(1)).alias("on_pages"), F.expr("bit_xor(xxhash64(page, n))").alias("x"), F.expr("sum(cast(pmod(xxhash64(n, page), 4294967296) as decimal(20,0)))").alias("s"))
    vectors = written(vectors.where(f"on_pages >= {least_pages}"), "vectors")
    hosts = vectors.where("token = 0").select("host", F.col("on_pages").alias("host_pages"))
    frequent = vectors.where("token <> 0").join(hosts, "host").where(F.col("on_pages") >= F.lit(support) * F.col("host_pages"))
    # A class has fewer tokens than one page has, as each is on most pages.
    return frequent.groupBy("host", "host_pages", F.xxhash64("x", "s", "on_pages").alias("class")).agg(F.max("on_pages").alias("class_pages"), F.sort_array(F.collect_list("token")).alias("tokens")).where(F.size("tokens") >= 2)


def _met(rows: DataFrame, by_host: DataFrame, broadcast_bytes: int, how: str) -> DataFrame:
    """Rows with what is known of their host, which is broadcast where its size allows."""
    size = by_host.agg(F.coalesce(F.sum(F.size("tokens") * 20 + F.length("host") + 64), F.lit(0))).first()[0]
    return rows.join(F.broadcast(by_host) if size <= broadcast_bytes else by_host, "host", how)


def tree(seen: DataFrame, classes: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, class, valid, width, parent, parent_slot, held): the classes of each host's template tree.

    Width is how many tokens a run has, held the slots of the class with the text they have on pages without article or
    main (class 0: in no slot). A class is valid if it holds a tag and is ordered and nested alike on all of its pages.
    """
    flat = classes.select("host", "class", F.explode("tokens").alias("token"))
    by_host = written(flat.groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes")), "classes")

    one = pa.struct([("c", pa.int64()), ("o", pa.int64()), ("p", pa.int64()), ("s", pa.int32()), ("ok", pa.bool_()), ("w", pa.int32())])
    two = pa.struct([("c", pa.int64()), ("s", pa.int32()), ("n", pa.int64())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (sequence, lengths), host, of in _by_host((b.columns for b in it), 2, lambda tokens, classes: dict(zip(tokens, classes))):
            shape, held = page_shape(sequence, lengths, of)
            yield host, [dict(zip(one.names, x)) for x in shape], [dict(zip(two.names, x)) for x in held]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(it), ["host", "shape", "held"], [pa.string(), pa.list_(one), pa.list_(two)], 128)

    met = _met(seen.select("host", "sequence", "lengths"), by_host, broadcast_bytes, "inner").select("sequence", "lengths", "host", "tokens", "classes")
    got = written(met.mapInArrow(run, "host string, shape array<struct<c:long,o:long,p:long,s:int,ok:boolean,w:int>>, held array<struct<c:long,s:int,n:long>>"), "shapes")
    shapes = got.select("host", F.explode("shape").alias("z")).select("host", "z.*").groupBy("host", F.col("c").alias("class"))
    same = (F.min("o") == F.max("o")) & (F.min("o") != 0) & F.min("ok") & (F.min(F.struct("p", "s")) == F.max(F.struct("p", "s")))
    shapes = shapes.agg(same.alias("same"), F.max("w").alias("width"), F.when(same, F.max("p")).otherwise(0).alias("parent"), F.when(same, F.max("s")).otherwise(0).alias("parent_slot"))
    held = got.select("host", F.explode("held").alias("z")).select("host", "z.*").groupBy("host", F.col("c").alias("class"), "s").agg(F.sum("n").alias("n"))
    held = held.groupBy("host", "class").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("held"))
    tagged = classes.select("host", "class", F.exists("tokens", lambda t: t < TEXTS).alias("tagged"))
    none = F.array().cast("array<struct<s:int,n:bigint>>")
    named = shapes.join(tagged, ["host", "class"]).join(held, ["host", "class"], "full")
    return named.select("host", "class", F.coalesce(F.col("same") & F.col("tagged"), F.lit(False)).alias("valid"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("parent", F.lit(0)).alias("parent"), F.coalesce("parent_slot", F.lit(0)).alias("parent_slot"), F.coalesce("held", none).alias("held"))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", support: float = 0.6, least_pages: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, tokens, classes, widths, main_class, main_slot): each host's template; widths are those of the tokens' classes."""
    seen = sequences(pages, url_col, html_col)
    classes = written(classes_of(seen, support, least_pages), "deduced")
    nodes = written(tree(seen, classes, broadcast_bytes), "tree")

    @F.arrow_udf("struct<main_class:long,main_slot:int>")
    def main(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            got = []
            for rows in arr.to_pylist():
                got.append(main_slot({r["class"]: (r["valid"], r["parent"], r["parent_slot"]) for r in rows}, {(r["class"], h["s"]): h["n"] for r in rows for h in r["held"]}))
            yield pa.StructArray.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.array([k for _, k in got], pa.int32())], names=["main_class", "main_slot"])

    # A host's classes are fewer than the tokens of its largest page.
    mains = nodes.groupBy("host").agg(F.collect_list(F.struct("class", "valid", "parent", "parent_slot", "held")).alias("rows")).select("host", main("rows").alias("m")).select("host", "m.*")
    valid = nodes.where("valid").select("host", "class", "width").join(classes.select("host", "class", "tokens"), ["host", "class"])
    flat = valid.select("host", "class", "width", F.explode("tokens").alias("token")).groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes"), F.collect_list("width").alias("widths"))
    out = written(flat.join(mains, "host"), "templates")
    drop(seen, classes, nodes)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.6, least_pages: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, url, text, n_chars."""
    known = templates(pages, url_col, html_col, support, least_pages, broadcast_bytes)

    @F.arrow_udf("string")
    def host(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            yield pa.array([host_of(u) for u in arr.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def text(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        def make(tokens, classes, widths, c, k):
            return Template(tokens, classes, dict(zip(classes, widths)), (c, k)) if tokens else Template()

        for columns in it:
            yield pa.array((main_text(Walk(page or ""), template) for (page,), _, template in _by_host([columns], 1, make)), pa.string())

    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"), host(F.col(url_col)).alias("host"))
    met = _met(rows, known, broadcast_bytes, "left")
    done = met.select(F.col("i").alias(id_col), F.col("u").alias(url_col), text("h", "host", "tokens", "classes", "widths", "main_class", "main_slot").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
