"""Main text of web pages by composite text density.

A page is read into a flat tree of nodes in document order. For each node the characters and tags below it, and those of
links among them, give its density: characters per tag, adjusted by how much of them are links,

    density = C / T * log_b(C / LC * T / LT),   b = e - 1 + ln(C / (C - LC) * LC + page's LC / C * C + e)

(the smallest base is e, so that a page without links has finite densities). Tags that only format their text don't
count, and a run of text directly in a node is a child of its own. The sum of the children's densities is largest at the
node that holds the most and densest blocks; the least density on the path from it to the body is the threshold that
other subtrees must reach to belong to the text as well. Where the page says what its article is, the subtree grows to
that element. What is known not to be main text (navigation, forms, scripts, notices, adverts, comments) goes before.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.runtime import small_batches

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(script|style|textarea|title|noscript|iframe|template|svg|xmp)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)"""
    r"""|<(/?)([a-z][^\s/><]*+)((?:[^<>="']++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Tags that format text within a block; they don't count as tags.
_FORMAT = frozenset("abbr b bdi bdo big br cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag that ends an open one, up to an element that holds it back.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "a": ("a", "td th table")}
_ENDS = {tag: (frozenset(ends.split()), frozenset(stops.split())) for tag, (ends, stops) in _ENDS.items()}
_NEVER = frozenset("nav footer aside form button select search dialog menu object audio video canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:ads?|adbox|adslot|adsbygoogle|adverts?|advert\w+|sponsor\w*|promos?|promot\w+|banners?|cookies?|cookie(?:bar|banner|notice|consent)|consent|gdpr|notices?|alerts?|popups?|modal|overlay"
    r"|newsletters?|subscri\w+|signup|login|paywall|comments?|commentlist|respond|responses|replies|disqus\w*|discussion|sidebars?|aside|nav|navs?|navbar|navigation|menus?|breadcrumbs?"
    r"|footers?|masthead|topbar|share|sharing|social|related|recommend\w*|widgets?|toolbar|pagination|pager|skip)\Z"
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Page:
    """Nodes in document order; children come after their parent. A text run is a node of tag ``."""

    def __init__(self, html: str):
        self.tag, self.parent, self.text, self.attributes = ["body"], [-1], [""], [""]
        self._read(html)

    def _add(self, tag: str, parent: int, text: str, attributes: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.attributes.append(attributes)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack, open_ = [0], {"body": 1}

        def pop() -> str:
            tag = self.tag[stack.pop()]
            open_[tag] -= 1
            return tag

        def close(tags, stops=frozenset()) -> None:
            if not any(open_.get(t) for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                here = self.tag[stack[k]]
                if here in stops:
                    return
                if here in tags:
                    while len(stack) > k:
                        pop()
                    return

        at, head = 0, False
        for m in _TOKEN.finditer(html):
            if m.start() > at and not head:
                run = html[at : m.start()]
                if run.strip():
                    self._add("", stack[-1], unescape(run) if "&" in run else run, "")
                elif run:
                    self._add("", stack[-1], " ", "")
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag or tag in ("html", "body"):
                head = head and tag != "body"
                continue
            if tag == "head":
                head = not m[2]
                continue
            if head and (tag in _VOID or m[2]):
                continue
            head = False
            if m[2]:
                if tag == "p" or open_.get(tag):
                    close((tag,), _BLOCK if tag in _FORMAT else frozenset() if tag in _BLOCK else frozenset(("td", "th", "table")))
                continue
            if tag in _BLOCK and open_.get("p") and tag != "option":
                close(("p",), frozenset(("button", "td", "th", "table")))
            if tag in _ENDS:
                close(*_ENDS[tag])
            node = self._add(tag, stack[-1], "", m[4])
            if tag not in _VOID and not (m[4].endswith("/") and tag not in _BLOCK and tag not in _FORMAT and tag != "a"):
                stack.append(node)
                open_[tag] = open_.get(tag, 0) + 1
        run = html[at:]
        if run.strip() and not head:
            self._add("", stack[-1], unescape(run) if "&" in run else run, "")

    def within(self, tags) -> list[bool]:
        """Whether each node is, or is inside, one of `tags`."""
        out = []
        for tag, parent in zip(self.tag, self.parent, strict=True):
            out.append(tag in tags or (parent >= 0 and out[parent]))
        return out

    def holds(self, tags) -> list[bool]:
        """Whether each node is, or has below it, one of `tags`."""
        out = [tag in tags for tag in self.tag]
        for k in range(len(out) - 1, 0, -1):
            if out[k]:
                out[self.parent[k]] = True
        return out


def _apart(page: _Page, names: bool) -> list[bool]:
    """Whether each node is, or is inside, something that isn't main text."""
    inside, holding = page.within(("article", "main")), page.holds(("article", "main"))
    out = [False]
    for k in range(1, len(page.tag)):
        tag, parent, raw = page.tag[k], page.parent[k], page.attributes[k]
        away = out[parent]
        if not away and tag in _NEVER or tag == "header" and not inside[k]:
            away = not holding[k]
        if not away and raw and tag and tag not in ("main", "html"):
            found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
            if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
                away = True
            elif found.get("role", "").lower() in _ROLES:
                away = not holding[k] or tag == "article"
            elif names and ("class" in found or "id" in found):
                words = [w.lower() for w in _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}")]
                if any(_NAMES.match(w) for w in words) or "header" in words and not inside[k] and tag not in _HEADINGS:
                    away = not holding[k] or tag == "article"
        out.append(away)
    return out


def densities(page: _Page, apart: list[bool]) -> tuple[list[float], list[float]]:
    """(density, sum of the children's densities) of each node; nodes apart count for nothing but the page's share of links."""
    n = len(page.tag)
    linked = page.within(("a",))
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    page_chars = page_links = 0
    for k in range(n - 1, -1, -1):
        tag, parent = page.tag[k], page.parent[k]
        if not tag:
            size = len(page.text[k].strip())
            page_chars += size
            page_links += size if linked[k] else 0
            chars[k], link_chars[k] = size, size if linked[k] else 0
        elif tag not in _FORMAT and k:
            tags[k] += 1
            link_tags[k] += tag == "a"
        if parent >= 0 and not apart[k]:
            chars[parent] += chars[k]
            tags[parent] += tags[k]
            link_chars[parent] += link_chars[k]
            link_tags[parent] += link_tags[k]
    share = page_links / page_chars if page_chars else 0.0
    density, total = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        c, t, lc, lt = chars[k], max(tags[k], 1), link_chars[k], link_tags[k]
        if c and not apart[k]:
            base = math.e - 1 + math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[k] = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0) + 0.1) / math.log(base)
            if page.parent[k] >= 0:
                total[page.parent[k]] += density[k]
    return density, total


def _chosen(page: _Page, apart: list[bool]) -> list[bool]:
    """Whether each node is in, or on the way down to nothing but, what is chosen."""
    n = len(page.tag)
    density, total = densities(page, apart)
    best = max(range(n), key=lambda k: (total[k], -k))
    if not total[best]:
        return [False] * n
    path = [best]
    while path[-1]:
        path.append(page.parent[path[-1]])
    for sectioning in ("article", "main"):
        if own := [k for k in path if page.tag[k] == sectioning]:
            roots = {own[0]}
            break
    else:
        threshold = min(density[k] for k in path)
        top = list(range(n))  # the node of the largest sum in each subtree
        for k in range(n - 1, 0, -1):
            a, b = top[k], top[page.parent[k]]
            if not apart[k] and (total[a], -a) > (total[b], -b):
                top[page.parent[k]] = a
        dense = [page.tag[k] != "" and not apart[k] and density[k] >= threshold and total[top[k]] > 0 for k in range(n)]
        roots = {top[k] for k in range(n) if dense[k] and (k == 0 or dense[page.parent[k]])}
        ways = []
        for k in roots:
            way = [k]
            while way[-1]:
                way.append(page.parent[way[-1]])
            ways.append(way[::-1])
        shared = 0
        for step in zip(*ways, strict=False):
            if len(set(step)) > 1:
                break
            shared = step[0]
        if shared:
            roots = {shared}  # what lies between the parts belongs to them
        elif titles := [k for k in range(n) if page.tag[k] == "h1" and not apart[k]]:
            roots |= {titles[0]} if len(titles) == 1 else set()
    out = []
    for k in range(n):
        out.append((k in roots or (k > 0 and out[page.parent[k]])) and not apart[k])
    return out


def _blocks(page: _Page, chosen: list[bool]) -> str:
    """Text of the chosen nodes: blocks in page order, one line each."""
    owner, lines, run, last = [0] * len(page.tag), [], [], None

    def end() -> None:
        if line := " ".join("".join(run).split()):
            lines.append(line)
        run.clear()

    for k in range(len(page.tag)):
        tag = page.tag[k]
        parent = page.parent[k]
        owner[k] = k if tag in _BLOCK or parent < 0 else owner[parent]
        if tag in _BLOCK and not chosen[k]:
            last = None  # a block that goes still parts what is around it
        if not chosen[k]:
            continue
        if owner[k] != last:
            end()
            last = owner[k]
        if not tag:
            run.append(page.text[k])
        elif tag == "br":
            run.append(" ")
    end()
    return "\n".join(lines)


def main_text(html: str | None) -> str:
    """The main text of a page; empty where there is none."""
    if not html:
        return ""
    page = _Page(html)
    for names in (True, False):
        chosen = _chosen(page, _apart(page, names))
        if any(chosen):
            return _blocks(page, chosen)
    return ""


@F.pandas_udf(T.StringType())
def main_text_column(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row, from the whole html.

    A null or empty html has an empty text, as has a page of boilerplate alone; a text without any tag is one block.
    Unclosed and misnested tags are closed as a browser would; an unclosed comment or script reaches to the end. Repeated
    rows are read each for itself; other columns aren't read. The time is in proportion to the html.
    """
    small_batches(pages.sparkSession)
    out = pages.select(F.col(id_col), F.col(url_col), main_text_column(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
