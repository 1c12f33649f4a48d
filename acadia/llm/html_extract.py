"""HTML extraction by line-block distribution.

The page is cut into blocks at block-level tags, one line of text each; what stands inside
scripts, styles, forms, navigation, headers, footers, sidebars, notices, adverts and reader
comments leaves an empty line.  Text lengths are summed over sliding windows of lines.
A window surges if its sum reaches ``SURGE`` of the page's usual line, in which half of its
text stands, or ``SURGE_CHARS``.  The lines of surging windows are the main text, with what
stands between two surges if the sums do not fall to nothing there.  Short lines at the end
of a stretch that are part of a longer run of short lines (a menu) are not.  Link lists
count as empty.  A part that the page marks as its article is taken at its word.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3  # lines in a block
SURGE = 0.5  # share of the page's usual line in a block from which text begins,
SURGE_CHARS = 86  # and the characters that always suffice
LINK_SHARE = 0.7  # of a line's characters; from there on it is a list of links

# Fixed values of HTML.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "textarea", "select", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "wbr", "label"}
# Elements that hold no article text; an article's own header is judged by what is in it.
CHROME = {"head", "nav", "aside", "footer", "form", "button", "fieldset", "dialog", "menu", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
         "menubar", "toolbar", "note"}
# Names in class and id attributes that mark such parts, as whole hyphenated words.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notices?|"
    r"notifications?|alerts?|popup|modal|overlay|sidebars?|side|widgets?|nav|navbar|navigation|menus?|breadcrumbs?|header|masthead|"
    r"topbar|footer|foot|copyright|comments?|respond|replies|reply|disqus|discussion|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|skip|legal|disclaimer|tags)(?=$|[\s_-])", re.I)

# Inside an article only names that no part of a text has, in class attributes of containers.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "p"}
MARKED_INSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|cookies?|consent|gdpr|popup|"
    r"sidebars?|widgets?|nav|navbar|navigation|menus?|breadcrumbs?|comments?|disqus|sharing|social|related|recommended|"
    r"newsletter|subscribe|signup|pagination|pager|toolbar)(?=$|[\s_-])", re.I)
# Whole class names of article elements that are not the page's article.
SIDE_ARTICLE = re.compile(r"(?:^|\s)(?:comments?|reply|replies|teasers?|related|recommended|promo)(?=$|\s)", re.I)
ARTICLE_SHARE = 0.25  # of the page's text; articles that hold less are teasers or comments

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_MAIN = re.compile(r"<(article|main)[\s>]", re.I)


def _is_chrome(name: str, attrs: str, in_article: bool) -> bool:
    if name in CHROME or (name == "header" and not in_article):
        return True
    if not attrs:
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if name == "article":
            named = key == "class" and SIDE_ARTICLE.search(value)
        elif in_article:
            named = key == "class" and name in CONTAINERS and MARKED_INSIDE.search(value)
        else:
            named = key in ("class", "id") and name not in ("body", "html", "main") and MARKED.search(value)
        if named:
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _left_open(page: str, at: int, name: str, depth: int) -> bool:
    """Whether ``depth`` open elements lack an end tag in the rest of the page."""
    ends = [bool(m.group(2)) for m in _TOKEN.finditer(page, at) if m.group(3) and m.group(3).lower() == name]
    return sum(ends) - (len(ends) - sum(ends)) < depth


def text_lines(page: str, marked: bool) -> tuple[list[tuple[str, int]], int, bool]:
    """The page's lines in order: (text, characters of it inside links); the number of
    article elements with text, and whether there is a main part with text.

    Blocks that hold no article text leave an empty line.  If ``marked``, text outside of
    article and main parts counts as such a block.
    """
    articles, main, told, kinds = 0, False, True, []
    open_skip = None  # whether the part that is left out lacks its end tag
    lines: list[tuple[str, int]] = []
    words: list[str] = []
    in_link = link_chars = inside = 0
    skip: list[str] = []  # the open element that is left out, and elements of its name inside it

    def close_line():
        nonlocal words, link_chars
        lines.append((" ".join(_html.unescape("".join(words)).split()), link_chars))
        words, link_chars = [], 0

    def text(raw: str):
        nonlocal link_chars, articles, main, told
        if raw and not skip and (inside or not marked):
            words.append(raw)
            if inside and raw.strip():
                main = main or "main" in kinds
                articles, told = articles + (not told), True
            if in_link and not marked:  # a marked article is taken at its word
                link_chars += len(raw.strip())

    at, raw_end = 0, None
    while True:
        if raw_end is not None:  # in a script or the like: nothing but its end tag counts
            found = re.compile(rf"</{raw_end}[\s/>]", re.I).search(page, at)
            if not found:
                break
            at, raw_end = found.start(), None
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m.group(1) is not None:
            text(_html.escape(m.group(1)))
        if m.group(3) is None:
            continue
        closing, name, attrs = bool(m.group(2)), m.group(3).lower(), m.group(4) or ""
        if name in ("article", "main") and not closing and skip and skip[0] not in ("article", "main"):
            if open_skip is None:
                open_skip = _left_open(page, m.start(), skip[0], len(skip))
            if not inside and open_skip:  # a part that was left open ends where the article begins
                skip.clear()
        block = name not in INLINE and name not in RAW and name != "br"
        if skip and (skip[0] == "p" and block or skip == ["li"] and name in ("li", "ul", "ol")):
            skip.clear()  # these end without an end tag
            if name in ("p", "li") and closing:
                continue
        if skip:
            if name == skip[0]:
                skip.pop() if closing else skip.append(name)
            if name in RAW and not closing and not attrs.rstrip().endswith("/"):
                raw_end = name
            continue
        if name in RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                raw_end = name
            continue
        if name in ("article", "main"):
            close_line()
            if not closing and _is_chrome(name, attrs, bool(inside)):
                skip.append(name)
                open_skip = None
                continue
            if closing:
                inside = max(0, inside - 1)
                del kinds[inside:]
            else:
                inside += 1
                kinds.append(name)
                told = name != "article" and told
            continue
        if not closing and name not in VOID and _is_chrome(name, attrs, bool(inside)):
            close_line()
            skip.append(name)
            open_skip = None
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            words.append("\n")
        elif name not in INLINE:
            close_line()
    close_line()
    return lines, articles, main


def page_lines(page: str) -> tuple[list[tuple[str, int]], bool]:
    """The page's lines, and whether it marks an article or a main part that holds its text."""
    if _MAIN.search(page):
        lines, articles, main = text_lines(page, True)
        held = sum(len(t) for t, _ in lines)
        if main:
            return lines, True
        if articles:
            whole = text_lines(page, False)[0]
            if held >= ARTICLE_SHARE * sum(len(t) for t, _ in whole):
                return lines, True
            return whole, False
    return text_lines(page, False)[0], False


def _surge(size: list[int]) -> float:
    """Characters of a surging block: from the line that half of the page's text reaches."""
    above, half = 0, sum(size) / 2
    for usual in sorted(size, reverse=True):
        above += usual
        if above >= half:
            break
    return max(1, min(SURGE_CHARS, SURGE * usual))


def _stretches(size: list[int]) -> list[tuple[int, int]]:
    """Runs of lines (start, end) that hold the main text."""
    n = len(size)
    blocks, surge = [sum(size[j:j + WINDOW]) for j in range(n)], _surge(size)
    found: list[list[int]] = []
    for i in (j for j in range(n) if blocks[j] >= surge):
        if found and (i <= found[-1][1] or all(blocks[j] for j in range(found[-1][1], i))):
            found[-1][1] = min(n, i + WINDOW)
        else:
            found.append([i, min(n, i + WINDOW)])
    out = []
    for a, b in found:
        long = [k for k in range(a, b) if size[k] >= surge]
        first, last = (next(k for k in r if size[k]) for r in (range(a, b), range(b - 1, a - 1, -1)))
        if long and any(size[max(0, first - WINDOW + 1):first]):  # no dive before the stretch: a run goes on there
            a = long[0]
        if long and any(size[last + 1:last + WINDOW]):
            b = long[-1] + 1
        out.append((a, b))
    return out


def main_text(page: str | None) -> str:
    """Text between the surges and dives of the page's line-block distribution."""
    lines, marked = page_lines(page or "")
    size = [0 if links >= LINK_SHARE * len(t) and links else len(t) for t, links in lines]
    if not any(size):
        return ""
    if marked:
        return " ".join(t for t, s in zip((t for t, _ in lines), size) if s)
    return " ".join(lines[k][0] for a, b in _stretches(size) for k in range(a, b) if size[k])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    ``text`` is the main text of the whole html: character references decoded, white space
    inside a block one space, blocks in page order joined by one space; empty if there is
    none (null, empty or textless html).  Rows are read one by one, so repeated rows and null
    ids do no harm; other columns are ignored; an empty table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
