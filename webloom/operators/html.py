"""HTML to nested page records.

A small tree is built with the standard library's tokenizer; implied end tags are closed as far as the extractors can
tell. The whole record is made in one Arrow-batched pass; extractors that fail leave their field empty and touch no
other.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from webloom.functions.columns import SKIPPED
from webloom.schema import EMPTY_PAGE_ERROR, PAGE

# Elements without content, and what a start tag implicitly ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": frozenset("p"), "li": frozenset(["li"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]), "thead": frozenset(["tr", "td", "th"]), "tfoot": frozenset(["tr", "td", "th", "tbody"]),
}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
FENCE = {"li": frozenset(["ul", "ol"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "tbody": frozenset(["table"]), "thead": frozenset(["table"]), "tfoot": frozenset(["table"])}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find_all(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags and n is not self)

    def find(self, *tags: str) -> Node | None:
        return next(self.find_all(*tags), None)

    def strings(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return out

    def text(self, separator: str = "", strip: bool = False) -> str:
        parts = self.strings()
        if strip:
            parts = [p.strip() for p in parts if p.strip()]
        return separator.join(parts)

    def remove(self, *tags: str) -> None:
        for node in [*self.walk()]:
            node.children = [c for c in node.children if not (isinstance(c, Node) and c.tag in tags)]

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, frozenset(["td", "th", "li", "div", "table", "body"]))
        if tag in CLOSES:
            self._close(CLOSES[tag], FENCE.get(tag, frozenset()))
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _close(self, tags, fence):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
            elif self.open[k].tag in fence or self.open[k].tag in ("table", "body"):
                return


def parse_tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def valid_url(url: str) -> bool:
    try:
        parts = urlparse(url)
        return parts.scheme in ("http", "https") and bool(parts.netloc)
    except ValueError:
        return False


def links(tree: Node, base: str) -> list[str]:
    """Resolved http(s) targets of ``a[href]``, first occurrences, in order. A malformed href raises."""
    found = {}
    for a in tree.find_all("a"):
        href = a.attrs.get("href", "").strip()
        if href and not href.startswith(SKIPPED):
            url = urljoin(base, href)
            if valid_url(url):
                found[url] = None
    return [*found]


def page_text(tree: Node, selector: str | None = None) -> str:
    """Visible text with white space collapsed; scripts, styles and noscript leave the tree."""
    part = select(tree, selector) if selector else None
    tree.remove("script", "style", "noscript")
    return " ".join((part or tree).text(" ").split())


def select(tree: Node, selector: str) -> Node | None:
    """First match of a simple CSS selector: descendants of tag, .class, #id or their combinations."""
    scope = [tree]
    for step in selector.split():
        tag, classes, ident = step, [], None
        for sign in "#.":
            tag = tag.split(sign)[0]
        for piece in step[len(tag) :].replace("#", " #").replace(".", " .").split():
            if piece[0] == "#":
                ident = piece[1:]
            else:
                classes.append(piece[1:])
        scope = [n for s in scope for n in s.walk() if n is not s and (not tag or tag == "*" or n.tag == tag) and all(map(n.has_class, classes)) and (ident is None or n.attrs.get("id") == ident)]
        if not scope:
            return None
    return scope[0]


def metadata(tree: Node) -> dict:
    first = {}
    for m in tree.find_all("meta"):
        for attr in ("name", "property"):
            first.setdefault((attr, m.attrs.get(attr)), m)

    def content(attr: str, name: str) -> str | None:
        m = first.get((attr, name))
        return (m.attrs.get("content") or "").strip() or None if m else None

    title = tree.find("title")
    text = title.children[0] if title is not None and len(title.children) == 1 and isinstance(title.children[0], str) else None
    return {
        "title": text.strip() if text else content("property", "og:title"),
        "description": content("name", "description") or content("property", "og:description"),
        "keywords": content("name", "keywords"),
    }


def images(tree: Node, base: str) -> list[dict]:
    out = []
    for img in tree.find_all("img"):
        src = img.attrs.get("src", "").strip()
        if src and valid_url(url := urljoin(base, src)):
            out.append({"src": url, "alt": img.attrs.get("alt", "").strip()})
    return out


def headings(tree: Node) -> dict:
    return {h: [t for n in tree.find_all(h) if (t := n.text(" ").strip())] for h in ("h1", "h2", "h3")}


def tables(tree: Node) -> list[dict]:
    """Header cells of the first row that has any, and the data cells of all other rows; nested rows show in both."""
    out = []
    for table in tree.find_all("table"):
        header: list[str] = []
        rows = []
        for row in table.find_all("tr"):
            head = [c.text(strip=True) for c in row.find_all("th")]
            if head and not header:
                header = head
                continue
            cells = [c.text(strip=True) for c in row.find_all("td")]
            if cells:
                rows.append(cells)
        if header or rows:
            out.append({"headers": header, "rows": rows})
    return out


def lists(tree: Node) -> list[dict]:
    out = []
    for group in tree.find_all("ul", "ol"):
        items = [t for li in group.children if isinstance(li, Node) and li.tag == "li" and (t := li.text(" ", strip=True))]
        if items:
            out.append({"tag": group.tag, "items": items})
    return out


def empty_page(url: str | None) -> dict:
    return {
        "url": url, "title": None, "text": "", "text_length": 0, "links": [], "links_count": 0, "images": [], "images_count": 0, "headings": {"h1": [], "h2": [], "h3": []},
        "metadata": {"title": None, "description": None, "keywords": None}, "tables_count": 0, "lists_count": 0, "tables": [], "lists": [], "error": None,
    }


def parse_html(html: str | None, url: str | None) -> dict:
    """The page record of an HTML text; an empty or missing text gives an error record, a broken part an empty field."""
    page = empty_page(url)
    if not html:
        return page | {"error": EMPTY_PAGE_ERROR}
    try:
        tree = parse_tree(html)
    except Exception as e:  # noqa: BLE001
        return page | {"error": f"BeautifulSoup init error: {e}"}

    def attempt(name: str, f, count: str | None = None) -> None:
        try:
            page[name] = f()
            if count:
                page[count] = len(page[name])
        except Exception:  # noqa: BLE001 - an extractor that fails leaves its empty value
            pass

    attempt("metadata", lambda: metadata(tree))
    page["title"] = page["metadata"]["title"]
    attempt("text", lambda: page_text(tree), "text_length")
    attempt("links", lambda: links(tree, url or ""), "links_count")
    attempt("images", lambda: images(tree, url or ""), "images_count")
    attempt("headings", lambda: headings(tree))
    attempt("tables", lambda: tables(tree), "tables_count")
    attempt("lists", lambda: lists(tree), "lists_count")
    return page


def page_record(html: Column, url: Column) -> Column:
    """The nested page record as a struct column; rows are parsed in Arrow batches."""

    @F.pandas_udf(StructType.fromDDL(PAGE))
    def parse(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_html(h, u) for h, u in zip(html, url)], columns=[*empty_page(None)])

    return parse(html, url)


def parse_pages(corpus: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One page record per row of a corpus of (url, html)."""
    return corpus.select(page_record(F.col(html), F.col(url)).alias("p")).select("p.*")


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` against ``base``; null for null and for a malformed reference."""

    def one(b, h):
        try:
            return None if h is None else urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    from html import unescape as decode

    return text.map(decode, na_action="ignore")
