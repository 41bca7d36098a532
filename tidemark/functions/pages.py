"""Structure of HTML pages by a tag stack: site, author, date, icon, main text by selectors, and tables that may nest."""

from __future__ import annotations

import json
import re
from datetime import datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What holds no text of the page, where its main text is looked for (in this order, from over so many
# characters on), where its icon and author are, and the longest text that is kept.
NOISE = frozenset("script style nav footer header aside iframe form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Cells and rows that end where the next one of their table begins.
ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
SELECTORS = ("article", ".article-content", ".post-content", ".entry-content", '[itemprop="articleBody"]', ".story-content", "main")
ICONS = (("apple-touch-icon", None), ("icon", "32x32"), ("icon", None), ("shortcut icon", None))
AUTHORS = (("property", "article:author"), ("name", "author"))
LEAST, MOST = 100, 5000
# A reference without its semicolon, and what stands for its & where only closed ones count; scripts, which are not decoded, get it back.
UNCLOSED, BARE = re.compile(r"&(?=#?[A-Za-z0-9]++(?!;))"), "&#00000038;"
SCHEMA = "title string, site string, author string, published string, icon string, selector string, content string, tables array<array<array<string>>>"


class Page(HTMLParser):
    """Elements in document order as (tag, attributes, first text, end of texts, parent, inside noise); texts without noise.

    closed: references without a semicolon, which HTML decodes too, stay as they are.
    """

    def __init__(self, html: str, closed: bool = False):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.noise = 0
        self.scripts: list[str] = []
        self.titles: list[str] = []
        self.feed(UNCLOSED.sub(BARE, html) if closed else html)
        self.close()
        while self.open:
            self._end()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(reversed([(k, v or "") for k, v in attrs]))  # the first of repeated ones counts
        for k in range(len(self.open) - 1, -1, -1) if tag in ENDS else ():
            before = self.elements[self.open[k]][0]
            if before == "table" or before == "tr" and tag != "tr":
                break
            if before in ENDS[tag]:
                while len(self.open) > k:
                    self._end()
        self.elements.append([tag, known, len(self.texts), len(self.texts), self.open[-1] if self.open else -1, self.noise > 0])
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)
            self.noise += tag in NOISE

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.elements[self.open[k]][0] == tag), None)
        while at is not None and len(self.open) > at:
            self._end()

    def handle_data(self, data: str) -> None:
        inside = self.elements[self.open[-1]] if self.open else ["", {}]
        if inside[0] == "script" and inside[1].get("type", "").lower() == "application/ld+json":
            self.scripts.append(data.replace(BARE, "&"))
        elif inside[0] == "title" and not self.noise:
            self.titles.append(" ".join(data.split()))
        if not self.noise and (text := data.strip()):
            self.texts.append(text)

    def _end(self) -> None:
        element = self.elements[self.open.pop()]
        element[3] = len(self.texts)
        self.noise -= element[0] in NOISE

    def text(self, element: list) -> str:
        return " ".join(self.texts[element[2] : element[3]])

    def first(self, selector: str) -> list | None:
        """The first element outside noise that fits a selector: a tag, .class or [attribute="value"]."""
        if selector[0] == ".":
            fits = lambda e: selector[1:] in e[1].get("class", "").split()
        elif selector[0] == "[":
            name, value = selector[1:-1].split("=")
            fits = lambda e: e[1].get(name) == value.strip('"')
        else:
            fits = lambda e: e[0] == selector
        return next((e for e in self.elements if not e[5] and e[0] not in NOISE and fits(e)), None)

    def attribute(self, tag: str, name: str, known: dict[str, str]) -> str | None:
        """A non-empty attribute of the first element with the tag and the known attributes."""
        found = next((e for e in self.elements if e[0] == tag and all(e[1].get(k) == v for k, v in known.items())), None)
        return (found and found[1].get(name)) or None

    def tables(self) -> list[list[list[str]]]:
        """Rows of cells of each table, in the order of their start; a cell belongs to its nearest table, and its text has what is nested in it."""
        out: dict[int, list[list[str]]] = {}
        rows: dict[int, list[str]] = {}
        owner: list[tuple[int, int]] = []  # nearest table and row of each element's inside
        for k, (tag, _, _, _, parent, noise) in enumerate(self.elements):
            table, row = owner[parent] if parent >= 0 else (-1, -1)
            if not noise:
                if tag == "table":
                    table, row, out[k] = k, -1, []
                elif tag == "tr" and table >= 0:
                    row, rows[k] = k, []
                    out[table].append(rows[k])
                elif tag in ("td", "th") and row >= 0:
                    rows[row].append(self.text(self.elements[k]))
            owner.append((table, row))
        return [[r for r in found if r] for found in out.values()]


def _origin(url: str) -> tuple[str, str]:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)", url)
    return (m[1].lower(), m[2]) if m else ("", "")


def _cleaned(text: str) -> str:
    text = re.sub(r"[^\w\s.,!?\-:$%]", "", re.sub(r"\s+", " ", text))
    return re.sub(r"http\S+|www\S+", "", text).strip()


def structure(url: str | None, html: str | None, closed: bool = False) -> tuple:
    """(title, site, author, published, icon, selector, content, tables) of a page; a null page has its address's parts alone."""
    page = Page(html or "", closed)
    scheme, host = _origin(url or "")
    site = page.attribute("meta", "content", {"property": "og:site_name"})
    author = next((a for k, v in AUTHORS if (a := page.attribute("meta", "content", {k: v}))), None)
    published = page.attribute("meta", "content", {"property": "article:published_time"})
    if published:
        try:
            published = datetime.fromisoformat(published.replace("Z", "+00:00")).isoformat()
        except ValueError:
            pass
    for script in page.scripts if not published else ():
        try:
            found = json.loads(script)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict) and found.get("datePublished"):
            published = str(found["datePublished"])
            break
    icon = None
    for rel, sizes in ICONS:
        icon = icon or page.attribute("link", "href", {"rel": rel} | ({"sizes": sizes} if sizes else {}))
    if icon and icon.startswith("//"):
        icon = f"{scheme}:{icon}"
    elif icon and icon.startswith("/"):
        icon = f"{scheme}://{host}{icon}"
    selector = content = None
    for s in SELECTORS:
        if (element := page.first(s)) and len(text := page.text(element)) > LEAST:
            selector, content = s, text
            break
    if content is None and (body := page.first("body")):
        selector, content = "body", page.text(body)
    content = _cleaned(content)[:MOST] if content else None
    return page.titles[0] if page.titles else None, site.strip() if site else host.replace("www.", ""), author and author.strip(), published, icon or f"{scheme}://{host}/favicon.ico", selector, content, page.tables()


def with_structure(pages: DataFrame, url: str = "url", html: str = "html", out: str = "page", closed: bool = False) -> DataFrame:
    """pages with a struct of title, site, author, published, icon, selector, content and tables.

    The main text is that of the first selector of over 100 characters, else the body's, cleaned and cut to 5,000. Pages are
    parsed one by one in Arrow batches; tags that don't close end with what surrounds them. With `closed`, only references
    that end with a semicolon are decoded.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(SCHEMA))
    names = [field.name for field in kind]

    @F.arrow_udf(SCHEMA)
    def parse(urls: pa.Array, htmls: pa.Array) -> pa.Array:
        rows = [dict(zip(names, structure(u.as_py(), h.as_py(), closed), strict=True)) for u, h in zip(urls, htmls, strict=True)]
        return pa.array(rows, kind)

    return pages.withColumn(out, parse(F.col(url), F.col(html)))


def find_table(tables: Column, *words: str) -> Column:
    """The first table whose header row has, without regard to case, a cell with each of the words; null for none."""
    header = lambda t: F.transform(F.get(t, F.lit(0)), lambda c: F.lower(c))

    has = lambda w: lambda c: c.contains(w)

    def fits(t: Column) -> Column:
        found = F.size(t) > 0
        for w in words:
            found = found & F.exists(header(t), has(w.lower()))
        return found

    return F.get(F.filter(tables, fits), F.lit(0))
