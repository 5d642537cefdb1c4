"""Operator 3, HTML extraction by two-pass block rules.

Pass 0 cuts a page into blocks at block tags and leaves out what is never article text: scripts, styles, forms,
navigation, headers, footers, asides and elements whose class, id or role names a menu, advert, notice, comment area or
the like.  Pass 1 classifies the blocks by link density, length and stop-word density; pass 2 lets ambiguous short
blocks inherit the labels of the nearest decided neighbours.  If a page marks an ``article`` or ``main`` element, blocks
outside are boilerplate; blocks inside are decided text if they are long, or of middle length and of stop words, and else follow
their neighbours, the good one before the bad.

Every page is handled alone inside an Arrow batch, so there is no shuffle at all.

Defined results: a null or empty page, and a page without article text, give the empty text; unclosed and stray tags
are accepted; repeated pages each get a row; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .registry import query

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                 r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)", re.S)
HINT = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=\s|/|$)""", re.S | re.I)

RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "xmp", "noembed", "noframes"}
NEVER = {"nav", "header", "footer", "aside", "form", "svg", "math", "select", "button", "head", "menu", "dialog",
         "object", "canvas", "audio", "video", "map", "fieldset", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li",
         "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
         "tr", "ul", "caption", "dialog", "button", "select", "option"}
MAIN = {"article", "main"}
BAD_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
             "promoted", "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "topnav", "footer",
             "masthead", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "cookie", "cookies",
             "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter",
             "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended",
             "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar", "copyright", "disclaimer", "search",
             "skip", "hidden", "sr-only", "toc", "outbrain", "taboola"}
BAD_NAMES = {"header", "site-header", "page-header", "siteheader", "pageheader", "top-header", "global-header"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu",
             "menubar", "alertdialog"}
STOP = frozenset("""the of and to in a is that it as for was on are be by with he at from his not this but or an have they which
you were her all their there been one so if will would what can has more who no out do than them its our we him some
le la les de des du un une et est en que qui dans pour sur par pas au aux ce il elle ne se plus avec son sa
der die das und ist ein eine von zu mit den dem des im nicht sich auf für als auch es an werden aus er hat dass sie nach bei
el los las y del al lo con una su para por como más o pero sus ha me sin sobre este ya entre cuando todo esta""".split())

# nouns that make a compound name of a bad word a page's part ("share-buttons"), where others do not ("related-work")
PARTS = {"area", "article", "articles", "bar", "block", "box", "btn", "button", "buttons", "container", "content", "form", "group",
         "icon", "icons", "inner", "inline", "item", "items", "link", "links", "list", "module", "news", "outer", "panel", "post",
         "posts", "row", "section", "slot", "stories", "story", "text", "thread", "unit", "us", "wrap", "wrapper", "zone",
         "top", "bottom", "left", "right", "main", "site", "page"}
OWNER = re.compile(r"©\s*.{0,60}$|(?:©|\(c\)\s)\s*(?:copyright\b|(?:19|20)\d\d\b|.{0,120}\brights reserved)", re.I | re.S)
LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.4, 70, 200, 0.18, 0.28


def _names_part(token: str, inside: bool) -> bool:
    """Does a class or id name a menu, advert, notice or the like?  Inside a marked element a compound only does if all of its
    parts are such words or plain nouns for a part of a page."""
    if token in BAD_NAMES or token in BAD_WORDS:
        return True
    parts = re.split(r"[-_:]+", token)
    bad = [w in BAD_WORDS for w in parts]
    return any(bad) and (not inside or all(b or w in PARTS or w.isdigit() for b, w in zip(bad, parts)))


def _left_out(attrs: str, inside: bool) -> bool:
    for m in HINT.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.strip() in BAD_ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                if _names_part(token, inside):
                    return True
    return False


class Block:
    __slots__ = ("text", "linked", "main")

    def __init__(self, text: str, linked: int, main: bool):
        self.text, self.linked, self.main = text, linked, main


def blocks(page: str) -> list[Block]:
    """Pass 0: the text blocks outside left-out elements, white space joined, references decoded."""
    out: list[Block] = []
    parts: list[str] = []
    linked = link_depth = 0
    stack: list[tuple[str, bool, bool]] = []      # (tag, left out, inside article or main)
    at, n = 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, bool(stack) and stack[-1][2]))
        parts, linked = [], 0

    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not (stack and stack[-1][1]):
            piece = page[at:end]
            parts.append(piece)
            if link_depth:
                linked += len(" ".join(html.unescape(piece).split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        attrs = m[3] or m[6] or ""
        if name in RAW:
            if not closing:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if close:
                    at = close.end()
                elif name in ("script", "style"):
                    at = n
            continue
        if name == "a":
            link_depth = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        is_block = name in BLOCK
        if is_block:
            flush()
            link_depth = 0 if closing else link_depth
        if name in VOID:
            continue
        if closing:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if attrs.endswith("/") and name in ("svg", "math", "canvas"):
            continue
        out_now, in_main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()                            # a paragraph ends where the next begins
            out_now, in_main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in MAIN:
            stack.append((name, out_now or _hidden(attrs), True))
        elif name not in ("html", "body") and (name in NEVER and not (name == "header" and in_main) or (attrs and _left_out(attrs, in_main))):
            stack.append((name, True, in_main))
        elif is_block or (stack and stack[-1][1]):
            stack.append((name, out_now, in_main))
    flush()
    return out


def _hidden(attrs: str) -> bool:
    words = {w for m in HINT.finditer(attrs) if m[1].lower() in ("class", "id")
             for w in re.split(r"[\s_-]+", (m[2] or "").strip("\"'").lower())}
    return bool(words & {"comment", "comments", "reply", "respond", "related", "sponsored", "promo", "teaser"})


def classify(found: list[Block]) -> list[str]:
    """Pass 1: good, bad or short by density rules."""
    marked = any(b.main for b in found)
    labels = []
    for b in found:
        size = len(b.text)
        links = b.linked / size
        words = [w.strip(".,;:!?\"'()").lower() for w in b.text.split()]
        stop = sum(w in STOP for w in words) / len(words)
        if marked and not b.main:
            labels.append("bad")
        elif links > LINKS or (OWNER.match(b.text) and size < LONG):
            labels.append("bad")
        elif marked:
            labels.append("good" if size >= LONG or (size >= SHORT and stop >= STOP_LOW) else "short")
        elif size < SHORT:
            labels.append("bad" if links > 0 else "short")
        elif stop >= STOP_HIGH or (stop >= STOP_LOW and size >= LONG):
            labels.append("good")
        elif stop >= STOP_LOW:
            labels.append("short")
        else:
            labels.append("bad")
    return labels


def inherit(found: list[Block], labels: list[str]) -> list[bool]:
    """Pass 2: a short block follows its nearest decided neighbours; if they differ, the nearer one (good on a tie),
    and inside a marked element the good one."""
    n = len(found)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        last = i if labels[i] != "short" else last
    last = None
    for i in reversed(range(n)):
        after[i] = last
        last = i if labels[i] != "short" else last
    keep = []
    for i, b in enumerate(found):
        if labels[i] != "short":
            keep.append(labels[i] == "good")
            continue
        near = [(abs(j - i), labels[j] == "good") for j in (before[i], after[i]) if j is not None]
        if not near:
            keep.append(b.main)
        elif b.main:
            keep.append(any(g for _, g in near) or all(not found[j].main for j in (before[i], after[i]) if j is not None))
        else:
            least = min(d for d, _ in near)
            keep.append(any(g for d, g in near if d == least) and len(near) == 2 or all(g for _, g in near))
    return keep


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = inherit(found, classify(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` of every page, main text only."""

    def run(batches):
        for batch in C.small_batches(batches, "_html"):
            text = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())],
                                             names=["_id", "_url", "text"])

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"),
                        F.col(html_col).cast("string").alias("_html"))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(run, f"_id {kind}, _url string, text string")


@query("op3_html_extraction")
def op3_html_extraction(spark, sf_dir):
    out = extract(C.table(spark, sf_dir, "pages"))
    return out.select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "text",
                      F.char_length("text").cast("long").alias("n_chars"))
