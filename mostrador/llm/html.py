"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block; what scripts, styles, comments and containers of another purpose (by
element, role, class or id: menus, page headers, footers, sidebars, notices, adverts, forms, reader comments) held
goes, and what stood around the text becomes blank lines, unless its container goes on with text. Over windows of neighbouring lines the lengths of unlinked text are summed. Text surges where a sum
exceeds the limit and dives where sums are zero; lines between are kept, down to the last short one. Where no sum exceeds
it, the part with most unlinked text is kept if that is more than a word. Marks of the page weigh the lines: where its
article or main part holds at least half of all unlinked text, each line there weighs more than the limit, linked ones
too, and lines elsewhere nothing.

Null and empty pages give an empty text, and so do pages without unlinked text of two words. Every row gives one row, also with null or
repeated ids. An empty table gives no rows; other columns are not read. Elements of another purpose that are never closed
end with their parent, or before the next paragraph, heading or part of the page beside their content.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import columns, emit

WINDOW = 3
SURGE = 80

TAG = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
INVISIBLE = re.compile(r"(?i)display\s*:\s*none")
# A tag that the page ends in.
UNCLOSED = re.compile(r"(?s)<[a-zA-Z/!?].*")
SPACE = re.compile(r"\s+")

# Elements whose content is not text, or of another purpose.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "select", "button"}
OTHER = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source", "ruby", "rb", "rt", "rp"}
# Of these the content is no markup, so that only their own end ends them.
RAW_TEXT = {"script", "style", "textarea", "title", "noscript", "iframe"}
# Elements that end where another such begins beside them, and those that a block ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# Where a box that is never closed ends, at the latest.
BEGINNINGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main", "section", "blockquote"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MAIN = {"article", "main"}
# Elements that hold a text's lines; what holds them is a container.
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
         "caption", "figure", "figcaption", "address", "center", "hgroup"}
# Words of classes, ids and roles that name another purpose.
PURPOSES = {"nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "topbar", "footer",
            "contentinfo", "sidebar", "aside", "complementary", "widget", "notice", "notification", "alert", "banner", "cookie", "cookies", "consent", "gdpr",
            "popup", "modal", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment",
            "comments", "commentlist", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter",
            "subscribe", "subscription", "signup", "login", "search", "searchbox", "form", "toolbar", "copyright", "skip"}
# Words that may stand beside those; with any other word a name is the text's own, such as ``social-history``.
BESIDE = {"list", "box", "bar", "section", "area", "block", "site", "top", "bottom", "left", "right", "inner", "outer", "wrap", "item", "items", "link", "links", "post",
          "posts", "global", "primary", "secondary", "module", "panel", "group", "button", "buttons", "icons", "media", "text", "overlay", "js", "is", "the", "to", "us"}
LAYOUT = {"has", "with", "no", "without", "content", "main", "body", "article", "layout", "page", "wrapper", "container"}


def other_purpose(name: str, attributes: str, inside_main: bool) -> bool:
    if name in OTHER:
        return not (name == "header" and inside_main)
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" and value != "false" or key == "style" and INVISIBLE.search(value):
            return True
        for name_of in value.split() if key in ("class", "id", "role") else ():
            words = re.findall(r"[a-z]+", name_of)
            if not LAYOUT.intersection(words) and PURPOSES.intersection(words) and PURPOSES.union(BESIDE).issuperset(words):
                return not (inside_main and words[-1] == "header")
    return False


def page_lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, length of its unlinked part, whether in a marked main part) of each block; blank lines where something was left out."""
    end = html.rfind(">") + 1
    html = html[:end] + UNCLOSED.sub("", html[end:])
    lines: list[tuple[str, int, bool]] = []
    # Open block elements (name, number); of each line the container's number.
    opened: list[tuple[str, int]] = [("", 0)]
    inside: list[int] = []
    boxes: list[int] = []
    number = 0
    parts: list[str] = []
    linked: list[str] = []
    at, main, anchors = 0, 0, 0
    gap = [("", 0, False)] * WINDOW

    def container() -> int:
        return next(k for name, k in reversed(opened) if name not in LINES)

    def close() -> None:
        text = SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            links = SPACE.sub(" ", unescape("".join(linked))).strip()
            lines.append((text, max(0, len(text) - len(links)), main > 0))
            inside.append(container())
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if anchors:
            linked.append(text)

    while m := TAG.search(html, at):
        add(html[at: m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "a":
            anchors = 0 if closing else 1
        if not closing and name in RAW and not attributes.endswith("/"):
            if name in RAW_TEXT:
                end = re.compile(rf"(?i)</{re.escape(name)}(?![\w-])[^>]*>").search(html, at)
                at = end.end() if end else len(html)
            else:
                at = after_element(html, at, name, {n for n, _ in opened})
            add(" ")
            continue
        if not closing and name not in VOID and other_purpose(name, attributes, main > 0):
            close()
            at = after_element(html, at, name, {n for n, _ in opened})
            # A box inside the text, such as an advert, is skipped; a part of the page around it parts the text.
            if name in OTHER:
                boxes.append(len(lines))
                inside.extend([container()] * WINDOW)
                lines.extend(gap)
            continue
        if name not in INLINE:
            close()
            if closing:
                at_name = next((k for k in range(len(opened) - 1, max(0, len(opened) - 200), -1) if opened[k][0] == name), 0)
                if at_name:
                    del opened[at_name:]
            elif name not in VOID and not attributes.endswith("/"):
                if opened[-1][0] == "p":
                    opened.pop()
                number += 1
                opened.append((name, number))
        if name in MAIN:
            main = max(0, main + (-1 if closing else 1))
    add(html[at:])
    close()
    # Text of the same container before and after a box: the box stands inside the text.
    first, last = {}, {}
    for k, (_, n, _) in enumerate(lines):
        if n:
            first.setdefault(inside[k], k)
            last[inside[k]] = k
    left_out = {k + j for k in boxes if first.get(inside[k], k) < k < last.get(inside[k], k) for j in range(WINDOW)}
    return [line for k, line in enumerate(lines) if k not in left_out]


def after_element(html: str, at: int, name: str, around: set[str]) -> int:
    """Where the element opened before ``at`` ends, with the elements ``around`` it open; scripts and comments hide tags."""
    inside = [name]
    early = None
    closed = re.compile(rf"(?i)</{re.escape(name)}(?![\w-])").search(html, at)
    while m := TAG.search(html, at):
        found = (m[2] or m[5] or "").lower()
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if found in inside:
                while inside.pop() != found:
                    pass
                if not inside:
                    return m.end()
            elif found in around:
                return early or m.start()
        elif found:
            if len(inside) == 1:
                if found in SIBLINGS.get(name, ()) or name == "p" and found not in INLINE | VOID | RAW:
                    return m.start()
                if found in BEGINNINGS:
                    early = early or m.start()
                    if not closed:
                        return early
            if found in RAW_TEXT:
                end = re.compile(rf"(?i)</{found}(?![\w-])[^>]*>").search(html, m.end())
                at = end.end() if end else len(html)
                continue
            if found not in VOID and found not in INLINE and not attributes.endswith("/"):
                inside.append(found)
        at = m.end()
    return early or len(html)


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = page_lines(html or "")
    marked = any(main for _, _, main in lines) and 2 * sum(n for _, n, main in lines if main) >= sum(n for _, n, _ in lines)
    lengths = [(len(text) + surge + 1 if main and text else 0) if marked else n for text, n, main in lines]
    sums = [sum(lengths[i: i + window]) for i in range(len(lines))]
    kept: list[str] = []
    densest: tuple[int, list[str]] = (0, [])
    i = 0
    while i < len(lines):
        if not sums[i]:
            i += 1
            continue
        end = i
        while end < len(lines) and sums[end]:
            end += 1
        texts = [text for text, _, main in lines[i:end] if text and (main or not marked)]
        if max(sums[i:end]) > surge:
            kept += texts
        densest = max(densest, (sum(lengths[i:end]), texts), key=lambda d: d[0])
        i = end
    found = " ".join(kept or densest[1])
    return found if kept or " " in found else ""


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(((i, u, main_text(h)) for i, u, h in columns(batches)), schema, 1000)

    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
                        F.col(html_column).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
