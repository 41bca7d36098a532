"""Text, URL and HTML expressions for news articles; native columns, but for the similarity ratio."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, keywords of events, and the alerts and signals that follow from them.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "cid", "soc_src", "src", "ig_cid")
EVENTS: dict[str, tuple[str, ...]] = {
    "earnings": ("earnings", "quarterly report", "Q1", "Q2", "Q3", "Q4", "revenue", "profit"),
    "merger_acquisition": ("merger", "acquisition", "buyout", "takeover", "M&A"),
    "lawsuit": ("lawsuit", "legal action", "sued", "court", "litigation"),
    "product_launch": ("launch", "unveil", "announce", "new product", "release"),
    "executive_change": ("CEO", "CFO", "CTO", "resign", "appointed", "steps down", "retire"),
    "regulatory_action": ("SEC", "regulation", "regulatory", "compliance", "fine", "penalty"),
    "dividend": ("dividend", "payout", "shareholder return"),
    "stock_split": ("stock split", "share split"),
    "guidance": ("guidance", "outlook", "forecast", "projection"),
    "rating_change": ("upgrade", "downgrade", "rating", "analyst"),
    "partnership": ("partnership", "collaboration", "joint venture", "alliance"),
    "restructuring": ("restructuring", "layoff", "cost cutting", "reorganization"),
}
ALERTS = {"earnings": "EARNINGS_ALERT", "merger_acquisition": "M&A_ALERT", "lawsuit": "RISK_ALERT", "regulatory_action": "REGULATORY_ALERT"}
FACTORS = {"political": "POLITICAL_FACTOR", "regulatory": "REGULATORY_FACTOR", "economic": "ECONOMIC_FACTOR"}


def normal_url(url: Column) -> Column:
    """Scheme (https if none), host in lower case, path without a closing slash, and the query without tracking and blank parameters.

    Parameters keep their order, those of one name together; the fragment goes. Values stay as they are encoded.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (F.split_part(p, F.lit("="), F.lit(2)) != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    names = F.transform(kept, lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    placed = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.array_position(names, F.split_part(p, F.lit("="), F.lit(1))).alias("a"), i.alias("b"), p.alias("p"))))
    tail = F.array_join(placed["p"], "&")
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def content_hash(text: Column) -> Column:
    """MD5 of the first 1,000 characters; empty under 100 characters."""
    return F.when(F.char_length(text) >= 100, F.md5(F.left(text, F.lit(1000)))).otherwise("")


def normal_title(title: Column) -> Column:
    """Lower case, punctuation to spaces, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def cluster_id(company: Column, factor: Column, day: Column, title: Column) -> Column:
    return F.concat_ws("_", F.lit("cluster"), company, factor, day, F.left(F.md5(F.left(title, F.lit(50))), F.lit(8)))


def clean(text: Column) -> Column:
    """Without links, with word characters and .,!?-:$% alone, spaces squeezed."""
    text = F.regexp_replace(text, r"https?://\S+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s.,!?:$%-]", ""), r"\s+", " "))


def events(low: Column) -> Column:
    """Names of the events of which a keyword is in the lower-case text, a column of its own, in their order."""
    return F.array_compact(F.array(*(F.when(_any(low, words), F.lit(name)) for name, words in EVENTS.items())))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w.lower())
    return out


def liquidity_impact(label: Column, score: Column) -> Column:
    size = F.when(score > 0.8, "HIGH_").otherwise("MODERATE_")
    return F.when(label == "positive", F.concat(size, F.lit("POSITIVE"))).when(label == "negative", F.concat(size, F.lit("NEGATIVE"))).otherwise("NEUTRAL")


def decisions(label: Column, score: Column, impact: Column, found: Column, factor: Column) -> Column:
    """Decision signals in their order: stance, volatility, alerts of events, the factor."""
    stance = F.when((label == "positive") & (score > 0.7), "CONSIDER_BUY").when((label == "negative") & (score > 0.7), "CONSIDER_SELL").otherwise("HOLD_MONITOR")
    alerts = (F.when(F.array_contains(found, e), F.lit(a)) for e, a in ALERTS.items())
    signals = (F.when(factor == f, F.lit(s)) for f, s in FACTORS.items())
    return F.array_compact(F.array(stance, F.when(impact.contains("HIGH"), F.lit("HIGH_VOLATILITY_EXPECTED")), *alerts, *signals))


def sentences_with(text: Column, word: str, most: int = 5) -> Column:
    """Up to `most` sentences of over 20 characters that hold the word, each cut at 512 characters."""
    found = F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.lower(s).contains(word.lower()) & (F.char_length(s) > 20))
    return F.transform(F.slice(found, 1, most), lambda s: F.left(s, F.lit(512)))


def valid_article(text: Column, title: Column) -> Column:
    """100 characters and 50 words or more, and no page of an error."""
    wrong = r"(?i)(404 not found|access denied|page not found|enable javascript|captcha)"
    return (F.char_length(text) >= 100) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= 50) & ~text.rlike(wrong) & ~F.coalesce(title, F.lit("")).rlike(wrong)


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def html_text(html: Column, most: int | None = None) -> Column:
    """Visible text: without scripts, styles, navigation, headers, footers, comments and tags; common entities decoded; spaces squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|noscript|form|head)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.left(t, F.lit(most)) if most else t


def decoded(text: Column) -> Column:
    """Without CDATA marks; common entities decoded; trimmed."""
    text = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return F.trim(text)


def html_meta(html: Column, *names: str) -> Column:
    """The content of the first meta tag that has one of the names, tried in order, as its name or property; null for none."""
    found = []
    for name in names:
        key = rf"""(?:name|property)\s*=\s*["']{re.escape(name)}["']"""
        content = r"""content\s*=\s*["']([^"']*)["']"""
        found += [F.regexp_extract(html, rf"(?is)<meta\b[^>]*{key}[^>]*{content}", 1), F.regexp_extract(html, rf"(?is)<meta\b[^>]*{content}[^>]*{key}", 1)]
    return F.coalesce(*(F.when(x != "", decoded(x)) for x in found))


def html_published(html: Column) -> Column:
    """When a page was published, as text: of a meta tag, of JSON-LD, or of a time tag."""
    first = html_meta(html, "article:published_time", "publishdate", "pubdate", "date", "DC.date.issued")
    others = (F.regexp_extract(html, r, 1) for r in (r'(?is)"datePublished"\s*:\s*"([^"]*)"', r"""(?is)<time\b[^>]*datetime\s*=\s*["']([^"']*)["']"""))
    return F.coalesce(first, *(F.when(x != "", x) for x in others))


def html_author(html: Column) -> Column:
    """A page's author, of a meta tag or of JSON-LD."""
    x = F.regexp_extract(html, r'(?is)"author"\s*:\s*[\[{\s]*[^}\]]*?"name"\s*:\s*"([^"]*)"', 1)
    return F.coalesce(html_meta(html, "author", "article:author", "byl"), F.when(x != "", x))


def html_icon(html: Column) -> Column:
    """The address of a page's icon, as it is written."""
    tag = F.regexp_extract(html, r"""(?is)(<link\b[^>]*rel\s*=\s*["'][^"']*icon[^"']*["'][^>]*>)""", 1)
    x = F.regexp_extract(tag, r"""(?is)href\s*=\s*["']([^"']*)["']""", 1)
    return F.when(x != "", x)


def html_rows(html: Column) -> Column:
    """The rows of a page's tables, each an array of its cells' text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.filter(F.transform(rows, lambda row: F.transform(cells(row), lambda c: html_text(c))), lambda row: F.size(row) > 0)


def rss_items(xml: Column) -> Column:
    """array<struct<title, link, published, source>> of a feed's items that have a title and an http link, in their order."""
    part = lambda item, tag: decoded(F.regexp_extract(item, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    published = lambda item: F.try_to_timestamp(F.regexp_extract(part(item, "pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    items = F.transform(
        F.regexp_extract_all(xml, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1)),
        lambda i: F.struct(part(i, "title").alias("title"), part(i, "link").alias("link"), published(i).alias("published"), part(i, "source").alias("source")),
    )
    return F.filter(items, lambda i: (i["title"] != "") & i["link"].rlike("^https?://"))


def number(text: Column) -> Column:
    """'1,234.5%' as 1234.5; null if it is no number."""
    return F.regexp_replace(text, "[,% ]", "").try_cast("double")


def pair_label(pair: Column) -> Column:
    return F.concat_ws("/", F.left(pair, F.lit(3)), F.substring(pair, 4, 3))


def boolean_query(names: Column, theme: Column, level: Column) -> Column:
    """Names joined by OR, and the theme by AND up to level 2 and by OR above."""
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), " OR ")
    return F.concat(F.lit("("), quoted, F.when(level <= 2, F.lit(") AND ")).otherwise(F.lit(") OR ")), theme)


def json_or(text: Column, schema: str, default: Column) -> Column:
    """The JSON of a text, also inside a fence of back quotes; `default` where it is none."""
    return F.coalesce(F.from_json(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", ""), schema), default)


def chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Pieces of `size` characters that start every size - overlap characters and cover the text."""
    n, step = F.char_length(text), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1), F.lit(1))
    return F.transform(starts, lambda k: F.substring(text, k * step + 1, F.lit(size)))


def parts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes or of one row, so that memory follows the longest text and not the number of rows."""
    if batch.num_rows <= 1 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from parts(batch.slice(0, half), most)
    yield from parts(batch.slice(half), most)


def split_recursive(text: str, size: int = 2000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ")) -> list[str]:
    """Stripped pieces of up to `size` characters, cut before the first separator that the text has, longer parts at the next ones.

    Whole parts of up to `overlap` characters are repeated at the start of the next piece. A part without separators stays whole.
    """
    at = next((k for k, s in enumerate(separators) if s in text), len(separators))
    rest = separators[at + 1 :]
    parts = [text]
    if at < len(separators):
        first, *others = text.split(separators[at])
        parts = [p for p in (first, *(separators[at] + o for o in others)) if p]
    out: list[str] = []
    good: list[str] = []
    for part in parts:
        if len(part) < size:
            good.append(part)
            continue
        out += merged(good, size, overlap)
        good = []
        out += split_recursive(part, size, overlap, rest) if rest else [part]
    return out + merged(good, size, overlap)


def merged(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to `size` characters, with whole parts of up to `overlap` repeated; stripped, none empty."""
    out, total = [], 0
    now: deque[str] = deque()
    for part in parts:
        if now and total + len(part) > size:
            out.append("".join(now))
            while total > overlap or (total and total + len(part) > size):
                total -= len(now.popleft())
        now.append(part)
        total += len(part)
    return [p for p in (x.strip() for x in (*out, "".join(now))) if p]


def sentiment_parts(text: Column) -> Column:
    """The first 450 characters and as many from the middle, for a model with a short input."""
    n = F.char_length(text)
    return F.when(n > 900, F.array(F.left(text, F.lit(450)), F.substring(text, (n / 2).cast("int") - 224, F.lit(450)))).otherwise(F.array(F.left(text, F.lit(450))))


def similarity(a: str, b: str) -> float:
    """1 - (insertions and deletions) / (length of both): twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 1.0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for k, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        m = masks.get(c, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    return 2 * (len(b) - v.bit_count()) / (len(a) + len(b))
