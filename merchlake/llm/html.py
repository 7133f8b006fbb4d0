"""Main text of HTML pages: templates are found by hashing element subtrees and counting them per host.

A page's text is read from its articles (every outermost `article`, else every `main`, else the longest element named like one, else the
body), without elements that are never main text by their tag, role or class names. Every other element's subtree in there is hashed over its
tag, class and content. Hashes that occur on many pages of one host are its template, and such subtrees are deleted.

In explicit articles (`article` or `main`), only containers (COUNTED) are counted: a paragraph, heading, quotation, list item or
inline element that many articles of a host share is still their text. So is a container that holds half of the page's articles or more,
on the average of the pages that have it: that is the article's own body, shared by its near copies.

A class or id drops an element only if every word of it speaks of page furniture (`cookie-notice`, not `notice-of-intent`). Words that
articles use as well (WEAK: discussion, share, related, ...) drop it only if most of its text is links; otherwise its count on the host decides.

A page is parsed once, into the text of its articles and the ranges of that text that could be template. Pages of a host that have the same
text before templates are deleted count as one, so copies of a page do not make it a template. Counts go by (host, hash) with partial sums,
and only pages with such ranges are joined with their template hashes, so a host with a third of all pages is spread over all tasks.

Parsing takes time in proportion to the page, also if its tags, quotes or comments are never closed; unclosed tags are text, a quote that
is never closed ends with its tag. Null html is empty and gives an empty text; a page without `://` in its url belongs to the empty host;
elements of equal length named like an article: the first; equal rows give equal rows; an empty table gives an empty table; extra columns of any name stay.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, materialize, packed, unpacked
from .urls import host_of

#: A subtree is template if it occurs on so many pages of a host and on this share of them, or on SURE_PAGES, however large the host is;
#: pages with the same text count once.
MIN_PAGES, MIN_SHARE, SURE_PAGES = 5, 0.1, 50
#: A container that holds this share of explicit articles on average is their body.
BODY_SHARE = 0.5
#: An element of a WEAK name is dropped if this share of its text is links.
LINK_SHARE = 0.5

_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"""[>]|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[a-z]{2,}")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
_ENDS_P = _BLOCK - frozenset("br body html caption dd dt legend tbody td tfoot th thead tr li".split())
#: Elements of an explicit article that can be template.
COUNTED = frozenset("address center details dir div dl fieldset figure menu ol section table ul".split())
#: Elements whose start ends an open one of the given kinds, up to the given boundary.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
_SCOPE = frozenset("html body article main section aside div td th table ul ol nav header footer form blockquote".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Never main text: by tag, role, or the words of a class or id.
_NEVER = frozenset("nav aside footer form script style noscript iframe template svg math button select textarea input dialog menu head title object canvas audio video label".split())
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter subscribe signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside"
    " footer masthead topbar comment comments commentlist respond disqus replies".split()
)
WEAK = frozenset("alert copyright disclaimer discussion notification pager pagination reactions recommended related search share sharing social toolbar widget widgets".split())
#: Words that say nothing beside the others.
_PLAIN = frozenset(
    "area article bar block body bottom box col column container content entry global group inner item items js left link links list main module"
    " outer page panel post primary right row secondary section site text title top user wrap wrapper".split()
)
#: A header of these is no article's.
_WHOLE = frozenset("site page global".split())
#: Names of elements that hold the main text where a page has neither an article nor a main element.
_HOLDERS = frozenset("article content main post story entry".split())


_KNOWN = _FURNITURE | WEAK | _PLAIN


class Node:
    """An element; `never` is whether it is no main text, None while that depends on its links."""

    __slots__ = ("tag", "names", "role", "never", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag = tag
        self.names = self.role = ""
        self.never: bool | None = tag in _NEVER
        self.children: list[Node | str] = []
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or "").strip("\"'").lower()
            match m[1].lower():
                case "class" | "id":
                    self.names += " " + value
                case "role":
                    self.role = value
                    self.never = self.never or value in _NEVER_ROLES
                case "hidden":
                    self.never = True
                case "aria-hidden":
                    self.never = self.never or value == "true"
        for name in self.names.split():
            words = set(_NAME.findall(name))
            if "header" in words and not words.isdisjoint(_WHOLE):
                self.never = True
            elif not self.never and words <= _KNOWN and not words <= _PLAIN:
                self.never = None if words.isdisjoint(_FURNITURE) else True


class _Open:
    """The open elements, with where each kind was opened last, so that closing costs no search."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def last(self, kinds: set[str]) -> int:
        return max((self.at[k][-1] for k in kinds if self.at.get(k)), default=0)

    def close(self, k: int) -> None:
        """Closes the k-th element and all in it."""
        while len(self.stack) > k:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in _SCOPE:
                self.scopes.pop()


def parse(page: str) -> Node:
    """A tree of the page's elements; tags that are not closed end where HTML ends them, stray ends are ignored."""
    root = Node("#root")
    opened = _Open(root)
    at = start = 0  # of the text not yet taken, and of the search
    last, quoted = page.rfind(">"), True

    def tag_end(i: int) -> int:
        """Where the tag ends whose attributes begin at i."""
        nonlocal quoted
        k = i
        while quoted:
            stop = _STOP.search(page, k)
            if stop and stop[0] == ">":
                return stop.start()
            k = page.find(stop[1], stop.end()) + 1 if stop else 0
            quoted = k > 0  # one quote that is never closed, and quotes count no more
        return page.find(">", i)

    while m := _MARKUP.search(page, start):
        comment = m[0] == "<!--"
        if not comment and m.end() > last:
            start = m.end()  # no tag, as nothing ends it
            continue
        if m.start() > at:
            opened.stack[-1].children.append(page[at : m.start()])
        if comment:
            end = page.find("-->", m.end())
            at = start = len(page) if end < 0 else end + 3
            continue
        end = page.find(">", m.end()) if m[2] is None else tag_end(m.end())
        at = start = end + 1
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if own := opened.at.get(tag):
                if tag in _SCOPE or opened.scopes[-1] < own[-1]:
                    opened.close(own[-1])
            continue
        if tag in _ENDS_P and (k := opened.last({"p"})) > opened.scopes[-1]:
            opened.close(k)
        if tag in _ENDS:
            kinds, boundary = _ENDS[tag]
            if (k := opened.last(kinds)) > opened.last(boundary - kinds):
                opened.close(k)
        attributes = page[m.end() : end]
        node = Node(tag, attributes)
        opened.stack[-1].children.append(node)
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            node.children.append(page[at : stop.start() if stop else len(page)])
            end = page.find(">", stop.end()) if stop else -1
            at = start = len(page) if end < 0 else end + 1
        elif tag not in _VOID and not (attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\r\f\"'")):
            opened.push(node)
    if at < len(page):
        opened.stack[-1].children.append(page[at:])
    return root


def _upward(root: Node) -> list[Node]:
    """All elements, children before their parents."""
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo += [c for c in node.children if isinstance(c, Node)]
    return out[::-1]


def settle(root: Node) -> Node:
    """Decides on the elements that are no main text if they are mostly links."""
    order = _upward(root)
    if any(node.never is None for node in order):
        sizes: dict[Node, tuple[int, int]] = {}
        for node in order:
            own = [(len(c), 0) if isinstance(c, str) else sizes[c] for c in node.children]
            total, links = (sum(x) for x in zip(*own, strict=True)) if own else (0, 0)
            sizes[node] = total, total if node.tag == "a" else links
            if node.never is None:
                node.never = links >= LINK_SHARE * total
    return root


def lengths(root: Node) -> dict[Node, int]:
    """Characters of main text in each element."""
    out: dict[Node, int] = {}
    for node in _upward(root):
        out[node] = 0 if node.never else sum(len(c) if isinstance(c, str) else out[c] for c in node.children)
    return out


def articles(root: Node) -> tuple[list[Node], bool]:
    """The outermost articles that are main text, else such main elements, else the longest element named like an article, else the root; and
    whether they are explicit, so that only containers in them can be template."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
    todo = [(root, False)]
    while todo:
        node, in_main = todo.pop()
        for c in node.children[::-1]:
            if isinstance(c, Node) and not c.never:
                is_main = c.tag == "main" or c.role == "main"
                if c.tag == "article":
                    found["article"].append(c)
                    continue
                if is_main and not in_main:
                    found["main"].append(c)
                elif c.tag in ("div", "section", "td") and not _HOLDERS.isdisjoint(_NAME.findall(c.names)):
                    found["named"].append(c)
                todo.append((c, in_main or is_main))
    for kind in ("article", "main"):
        if found[kind]:
            return found[kind][::-1], True
    if found["named"]:
        sizes = lengths(root)
        return [max(found["named"][::-1], key=sizes.__getitem__)], False
    return [root], False


class Parsed(NamedTuple):
    """The raw text of a page's articles, with spaces between blocks, and the ranges (hash, start, end, share of the text) that can be template."""

    text: str
    ranges: list[tuple[int, int, int, float]]


def read(page: str | None) -> Parsed:
    tops, explicit = articles(settle(parse(page or "")))
    chosen = set(tops)
    parts: list[str] = []
    at, ranges = 0, []
    inner: list[tuple[list[str], int]] = [([], 0)]  # of each open element: what its hash is made of, and where its text starts
    letters = [0]

    def put(text: str) -> None:
        nonlocal at
        parts.append(text)
        at += len(text)

    todo: list[tuple[Node | str, bool]] = [(t, False) for t in tops[::-1]]
    while todo:
        node, done = todo.pop()
        if isinstance(node, str):
            text = entities.unescape(node)
            put(text)
            inner[-1][0].append(" ".join(text.split()))
            letters[-1] += len(inner[-1][0][-1])
        elif done:
            own, start = inner.pop()
            n = letters.pop()
            letters[-1] += n
            number = xxhash.xxh64_intdigest("\x00".join(own).encode("utf-8", "surrogatepass")) - (1 << 63)
            inner[-1][0].append(str(number))
            if n and node not in chosen and (not explicit or node.tag in COUNTED):
                ranges.append((number, start, at, float(n)))
            if node.tag in _BLOCK:
                put(" ")
        elif node in chosen or not (node.never or not explicit and "header" in _NAME.findall(node.names)):
            if node.tag in _BLOCK:
                put(" ")
            inner.append(([node.tag, node.names], at))
            letters.append(0)
            todo.append((node, True))
            inside = node.children
            if node.tag == "header":  # an article's holds its headings, a page's does not
                inside = [c for c in inside if explicit and isinstance(c, Node) and c.tag in _HEADINGS]
            todo += [(c, False) for c in inside[::-1]]
    total = max(1, letters[0])
    return Parsed("".join(parts), [(h, a, b, n / total if explicit else 0.0) for h, a, b, n in ranges])


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the ranges, with white space as single spaces."""
    parts, at = [], 0
    for a, b in sorted(ranges):
        if a >= at:
            parts.append(text[at:a])
        at = max(at, b)
    return " ".join(("".join(parts) + text[at:]).split())


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    found = read(page)
    return cut(found.text, [(a, b) for h, a, b, _ in found.ranges if h in templates])


def parsed(pages: DataFrame) -> DataFrame:
    """pages (row, key, host, html) with html read: text, its content's hash, and ranges."""
    kind = "array<struct<hash:bigint,start:int,end:int,share:double>>"

    def run(batch: pa.RecordBatch) -> dict:
        texts, contents, ranges = [], [], []
        for page in batch.column(3):
            found = read(page.as_py())
            if not found.ranges:
                found = found._replace(text=cut(found.text, []))
            texts.append(found.text)
            contents.append(xxhash.xxh64_intdigest(cut(found.text, []).encode("utf-8", "surrogatepass")) - (1 << 63))
            ranges.append([dict(zip(("hash", "start", "end", "share"), r, strict=True)) for r in found.ranges])
        return {"row": batch.column(0), "key": batch.column(1), "host": batch.column(2), "text": texts, "content": contents, "ranges": ranges}

    return by_batch(pages.select("row", "key", "host", "html"), run, f"row {dict(pages.dtypes)['row']}, key bigint, host bigint, text string, content bigint, ranges {kind}")


def template_hashes(found: DataFrame) -> DataFrame:
    """(key, hashes) of the pages that hold template subtrees of their host; found is what parsed() gives."""
    # The hash 0 stands for the page.
    entries = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("hash"), F.lit(0.0).alias("share"))), F.transform("ranges", lambda r: F.struct(r["hash"].alias("hash"), r["share"].alias("share"))))
    distinct = found.select("host", "content", F.explode(entries).alias("e")).groupBy("host", "e.hash", "content").agg(F.max("e.share").alias("share"))
    counts = distinct.groupBy("host", "hash").agg(F.count("*").alias("n"), F.avg("share").alias("share"))
    hosts = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    often = counts.where((F.col("hash") != 0) & (F.col("n") >= MIN_PAGES) & (F.col("share") < BODY_SHARE))
    templates = often.join(hosts, "host").where(F.col("n") >= F.least(MIN_SHARE * F.col("pages"), F.lit(SURE_PAGES))).select("host", "hash")
    templates = materialize(templates, "templates")  # so that a hash on a third of all pages can be split in the join
    held = found.select("key", "host", F.explode("ranges.hash").alias("hash"))
    return held.join(templates, ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("hashes"))


def extract(df: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """df with the main text of each page in the column `out`, without the column html."""
    kept = [c for c in df.columns if c not in (html, out)]
    key = F.xxhash64(F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit("")))
    found = materialize(parsed(packed(df, key.alias("key"), F.xxhash64(host_of(url)).alias("host"), F.col(html).alias("html")).withColumn("row", F.struct(*(F.col(f"row.`{c}`").alias(c) for c in kept)))), "parsed")
    some = found.where(F.size("ranges") > 0)
    marked = some.join(template_hashes(found), "key", "left").select("row", "text", "ranges", "hashes")

    def run(batch: pa.RecordBatch) -> dict:
        texts = []
        for text, ranges, hashes in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            gone = set(hashes or ())
            texts.append(cut(text, [(r["start"], r["end"]) for r in ranges.as_py() if r["hash"] in gone] if gone else []))
        return {"row": batch.column(0), "text": texts}

    done = by_batch(marked, run, f"row {dict(found.dtypes)['row']}, text string")
    return unpacked(found.where(F.size("ranges") == 0).select("row", "text").unionByName(done), kept, F.col("text").alias(out))


def op9_html(pages: DataFrame) -> DataFrame:
    """Every page's main text and its length in code points."""
    done = extract(pages.select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
