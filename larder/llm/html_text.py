"""Main text of web pages, with site templates removed.

A subtree (tag, class, id, text and children) gets a hash; Spark counts on how many pages of a host each hash
occurs, and a subtree that recurs on many pages of its host is a site template and is deleted from them, on pages
with an article (or main) element as on those without. What is no article by its markup (navigation, site
header, footer, sidebar, notice, advert, form, script, style, reader comments) is never text. Inside the article
the article's own prose is guarded: only containers (BOXES) are counted, so a paragraph that many pages share stays;
a container with more than half of the article's text stays; and so does all of an article that would lose more
than half of its text. Pages with equal articles count once, so a copied page is no template of its copies.

Counting combines before the shuffle, so a host with a third of all pages is no hot key; the join back carries
page ids and hashes, and the pages' text blocks.

Defined cases: null or empty html and pages without text give ''; unclosed and misnested tags are repaired as
browsers do, and after a quote that never ends tags end at the next >; markup of any depth is walked without
recursion; all articles of a page that aren't comments count; repeated pages each get their row; a very long page is
held whole by its task; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut_lineage

#: A subtree is a template if it is on at least MIN_PAGES pages and on MIN_SHARE of its host's pages.
MIN_PAGES, MIN_SHARE = 4, 0.05
#: Pages that are enough on a host of any size.
MANY_PAGES = 100

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_TAG_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_REST = re.compile(r"([^>]*+)>")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_KNOWN = frozenset("class id role hidden aria-hidden itemprop style".split())
_SPACE = re.compile(r"\s+")

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt summary legend figcaption".split())
BOXES = frozenset("center details dir div dl fieldset figure ol section table ul".split())
NOT_TEXT = frozenset("nav footer aside form button select menu head dialog object svg canvas audio video map search".split())
NAMED = BOXES | frozenset("span p".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead comment comments commentlist disqus respond replies share sharing social related recommended newsletter subscribe subscription signup login widget widgets pagination pager toolbar skip".split()
)

#: Words that only say what kind of box it is: a compound of them and of NOT_TEXT_WORDS names no text ("comment-list"); else its last word counts ("share-price", "cookie-notice").
BOX_WORDS = frozenset("area bar block box button buttons card cell container content form group holder icon icons inner item items link links list outer panel row section slot strip unit user wrap wrapper zone".split())


class Element:
    """A node: children are elements, or text between tags; size, digest and has_text are set by ``_measure``."""

    __slots__ = ("attrs", "children", "digest", "has_text", "size", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def tokens(self) -> set[str]:
        """Whole words of class and id."""
        return {w for k in ("class", "id") if k in self.attrs for w in self.attrs[k].lower().split()}

    def words(self) -> set[str]:
        """Words of class and id and their parts."""
        return {w for k in ("class", "id") if k in self.attrs for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", self.attrs[k]).lower())}

    def compound_of_no_text(self) -> bool:
        """Whether a compound class or id word says that this box holds no main text, by its last word or by all of its words."""
        for token in self.tokens():
            parts = [p for p in re.split(r"[^a-z]+", token) if p]
            if parts and (parts[-1] in NOT_TEXT_WORDS or set(parts) & NOT_TEXT_WORDS and set(parts) <= NOT_TEXT_WORDS | BOX_WORDS):
                return True
        return False

    def is_text(self, in_article: bool) -> bool:
        """Whether the markup allows main text in this element; inside an article only whole class words of named elements, and compounds of boxes, count."""
        if self.tag in NOT_TEXT or (self.tag == "header" and not in_article):
            return False
        if not self.attrs:
            return True
        if "hidden" in self.attrs or self.attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", self.attrs.get("style", ""), re.I):
            return False
        if self.tag in ("body", "html", "main") or self.attrs.get("role", "").lower() in NOT_TEXT_ROLES:
            return self.tag in ("body", "html", "main")
        if not in_article:
            return not self.words() & NOT_TEXT_WORDS
        return not (self.tag in NAMED and self.tokens() & NOT_TEXT_WORDS or self.tag in BOXES and self.compound_of_no_text())


def parse(page: str) -> Element:
    root = Element("html", {})
    stack, open_tags = [root], Counter()

    def close(tags: set[str], until: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                open_tags.subtract(e.tag for e in stack[k:])
                for e in stack[k:]:
                    if not open_tags[e.tag]:
                        del open_tags[e.tag]
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    at, n, rest = 0, len(page), _TAG_REST
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        inner = rest.match(page, at)
        if not inner and rest is _TAG_REST:  # a quote that never ends: from here on tags end at the next >
            rest = _PLAIN_REST
            inner = rest.match(page, at)
        if not inner:
            stack[-1].children.append(page[m.start() :])
            break
        at = inner.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and "p" not in open_tags:
                stack[-1].children.append(Element("p", {}))
            elif tag not in ("html", "body") and tag in open_tags:
                close({tag}, ("article", "main", "body") if tag not in BLOCK else ())
            continue
        attrs = {k: v.strip("\"'") for name, v in _ATTR.findall(inner[1]) if (k := name.lower()) in _KNOWN} if inner[1] else {}
        if tag in ("html", "body"):
            root.attrs |= attrs if tag == "body" else {}
            continue
        if tag in ENDS_P and "p" in open_tags:
            close({"p"}, ("article", "section", "div", "td", "th", "li", "button", "object"))
        if tag in CLOSES:
            tags, until = CLOSES[tag]
            if any(t in open_tags for t in tags.split()):
                close(set(tags.split()), until)
        element = Element(tag, attrs)
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not inner[1].endswith("/"):
            stack.append(element)
            open_tags[tag] += 1
    return root


def _elements(root: Element, into: Callable[[Element], bool]) -> list[Element]:
    """root and all elements below it, parents first, not below those that ``into`` refuses."""
    out = [root]
    for e in out:
        if e is root or into(e):
            out.extend(c for c in e.children if isinstance(c, Element))
    return out


def _measure(root: Element, mains: list[Element]) -> None:
    """Text size and hash of every subtree; a main element counts as an empty mark in those around it."""
    inside = {id(e) for e in mains}
    for e in reversed(_elements(root, lambda _: True)):
        h = xxhash.xxh64(f"{e.tag}|{e.attrs.get('class', '')}|{e.attrs.get('id', '')}".encode("utf-8", "surrogatepass"))
        e.size, e.has_text = 0, False
        for c in e.children:
            if isinstance(c, str):
                e.size += len(c)
                if not c.isspace():
                    e.has_text = True
                    h.update(_SPACE.sub(" ", c).strip().encode("utf-8", "surrogatepass") + b"|")
            elif id(c) in inside:
                h.update(b"<main>")
            else:
                e.size += c.size
                e.has_text |= c.has_text
                h.update(c.digest.to_bytes(8, "little"))
        e.digest = h.intdigest()


class _Page:
    """Main-text blocks of one page; each names its innermost candidate subtree, each of those the one around it."""

    def __init__(self, page: str):
        self.blocks: list[str] = []
        self.box_of: list[int] = []  # of each block, -1 outside all
        self.hashes: list[int] = []
        self.parents: list[int] = []
        root = parse(page)
        seen = _elements(root, lambda e: e.is_text(False) and e.tag != "article")
        text = [e for e in seen if e.is_text(False)]
        mains = [e for e in text if e.tag == "article"] or [e for e in text if e.tag == "main"][:1]
        _measure(root, mains)
        self.settled = bool(mains)
        self.counted = {e.digest - (1 << 63) for e in _elements(root, lambda e: e not in mains) if e.has_text and e not in mains and e.tag not in ("html", "body")}
        size = sum(e.size for e in mains)
        order = {id(e): k for k, e in enumerate(mains)}
        for main in sorted(mains, key=lambda e: order[id(e)]) or [root]:
            self._walk(main, size)
        self.counted |= set(self.hashes)

    def _box(self, e: Element, around: int) -> int:
        self.hashes.append(e.digest - (1 << 63))
        self.parents.append(around)
        return len(self.hashes) - 1

    def _walk(self, top: Element, size: int) -> None:
        parts: list[str] = []

        def flush(box: int) -> None:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                self.blocks.append(text)
                self.box_of.append(box)

        stack = [(top, iter(top.children), -1)]
        while stack:
            e, children, box = stack[-1]
            c = next(children, None)
            if c is None:
                stack.pop()
                if e.tag in BLOCK:
                    flush(box)
            elif isinstance(c, str):
                parts.append(c)
            elif c.tag == "br":
                parts.append(" ")
            elif c.tag in RAW or not c.is_text(self.settled):
                if c.tag in BLOCK:
                    flush(box)
            elif c.tag in BLOCK:
                flush(box)
                candidate = c.has_text if not self.settled else c.tag in BOXES and c.has_text and 2 * c.size <= size
                stack.append((c, iter(c.children), self._box(c, box) if candidate else box))
            else:
                stack.append((c, iter(c.children), box))
        flush(-1)


def host_of(url: str | None) -> str:
    return re.sub(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?", "", (url or "").lower()).partition("/")[0].partition("?")[0].partition("#")[0].partition(":")[0]


def parsed_pages(pages: DataFrame) -> DataFrame:
    """One row a page: its text blocks, the candidate subtree of each, and these subtrees' hashes and parents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_Page(html or "") for html in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "settled": [p.settled for p in found], "blocks": [p.blocks for p in found], "box_of": [p.box_of for p in found], "hashes": [p.hashes for p in found], "parents": [p.parents for p in found]})

    lean = pages.select("page_id", "url", "html")
    return lean.mapInPandas(run, f"page_id {dict(lean.dtypes)['page_id']}, url string, settled boolean, blocks array<string>, box_of array<int>, hashes array<bigint>, parents array<int>")


def counted_subtrees(pages: DataFrame) -> DataFrame:
    """page_id, host, article (a hash of the article's text, null without one) and the hashes of all counted subtrees of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
                p = _Page(html or "")
                rows.append((page_id, host_of(url), xxhash.xxh64_intdigest("\n".join(p.blocks).encode("utf-8", "surrogatepass")) - (1 << 63) if p.settled else None, sorted(p.counted)))
            out = pd.DataFrame(rows, columns=["page_id", "host", "article", "counted"])
            yield out.astype({"article": "Int64"})

    lean = pages.select("page_id", "url", "html")
    return lean.mapInPandas(run, f"page_id {dict(lean.dtypes)['page_id']}, host string, article bigint, counted array<bigint>")


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that recur across many pages of their host."""
    counts = parsed.select("host", "article", F.explode("counted").alias("hash")).groupBy("host", "hash", "article").agg(F.when(F.col("article").isNull(), F.count("*")).otherwise(1).alias("n")).groupBy("host", "hash").agg(F.sum("n").alias("n"))
    hosts = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    return counts.filter(F.col("n") >= min_pages).join(hosts, "host").filter((F.col("n") >= MANY_PAGES) | (F.col("n") >= F.col("pages") * min_share)).select("host", "hash")


def _without(row: tuple) -> tuple[str, int]:
    """A page's text without the blocks in dropped subtrees, and how many those are."""
    settled, blocks, box_of, hashes, parents, drop = row
    gone = [False]  # the last entry answers for -1, outside all subtrees
    if drop is not None and len(drop):
        gone = [False] * (len(hashes) + 1)
        drop = set(drop.tolist())
        for k, h in enumerate(hashes.tolist()):  # a parent comes before its children
            gone[k] = h in drop or gone[parents[k]]
        kept = [t for t, k in zip(blocks, box_of, strict=True) if not gone[k]]
        if not (settled and 2 * sum(map(len, kept)) < sum(map(len, blocks))):
            return "\n".join(kept), len(blocks) - len(kept)
    return "\n".join(blocks), 0


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars and the number of deleted template blocks for every page."""
    counted = cut_lineage(counted_subtrees(pages))
    held = counted.select("page_id", "host", F.explode("counted").alias("hash"))
    drop = held.join(templates(counted, min_pages, min_share), ["host", "hash"], "left_semi").groupBy("page_id").agg(F.collect_set("hash").alias("drop"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_without(row) for row in zip(*(b[c] for c in ("settled", "blocks", "box_of", "hashes", "parents", "drop")), strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [t for t, _ in out], "n_template_blocks": [n for _, n in out]})

    rows = parsed_pages(pages).join(drop.hint("merge"), "page_id", "left")
    out = rows.mapInPandas(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_template_blocks bigint")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template_blocks")
