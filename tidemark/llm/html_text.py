"""Main text of web pages by composite text density (operator 1).

For every DOM node: characters per tag, adjusted by its share of link text; for every node the sum of its
children's densities.  The node with the largest sum is the centre of the content; the smallest density on the
path from the body to it is the threshold for whatever lies beside that path.  An article or main element around
the centre is kept whole; it bounds nothing, so what lies beside it still meets the threshold.  Elements that never hold
content (menus, adverts, comments and the like, by tag, role or class) are not part of the tree.  Threads of reader comments go by their
name whatever they hold, sidebars unless they hold the page's only article; another class or id removes nothing that holds an article or
most of the text, and a form goes unless it does (some servers wrap the whole page in one).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("table td th caption button object template html".split())
# Elements without content: tags, roles, and words of a class or id.
NOISE_TAGS = set("nav footer aside head button select dialog menu svg canvas object audio video math".split()) | RAW
NOISE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead comment comments disqus respond reply replies related recommended recommendations share sharing social newsletter subscribe signup login search pagination pager toolbar skip".split()
)
# Words that name a thread of comments or a sidebar, and words that only say that a page has one.
THREADS = re.compile(r"comments?(?:s?(?:list|area|form|section|thread|box|wrap|wrapper|container|block))?|disqus|respond|replies")
SIDES = set("sidebar sidebars rail aside".split())
STATES = set("has with without no hide show open closed enabled disabled is".split())
CONTAINERS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: The share of a page's text that has to lie outside of a comment thread or sidebar for it to go.
LEAST_REST = 0.02

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")


def is_noise(tag: str, attributes: str, inside_content: bool) -> bool:
    """Whether an element never holds content by its tag, role or hiding.  A header is noise outside of an article only."""
    if tag in NOISE_TAGS or (tag == "header" and not inside_content):
        return True
    if not attributes or tag in ("body", "html") or tag in CONTAINERS:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in NOISE_ROLES:
            return True
    return False


def named_noise(tag: str, attributes: str) -> int:
    """How far class and id name an element without content.

    4 a thread of comments, 3 a sidebar, 2 another whole name does (ad, cookie-notice), 1 a word of one (promo-free), 0 none.  A
    name that says a page has something (has-sidebar, page-with-comments) counts as 1.
    """
    if not attributes or tag in ("body", "html", "main"):
        return 0
    level = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for x in (a or b or c).lower().split():
                words = {w for w in _PARTS.split(x) if w}
                if any(THREADS.fullmatch(w) for w in words):
                    level = max(level, 1 if words & STATES else 4)
                elif tag in CONTAINERS:
                    continue
                elif words & SIDES:
                    level = max(level, 1 if words & STATES else 3)
                elif words & NOISE_WORDS:
                    level = max(level, 2 if words <= NOISE_WORDS else 1)
    return level


class Page:
    """A tolerant DOM as parallel lists: children come after their parent."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise, self.named, self.inside, self.runs = ["body"], [-1], [False], [0], [False], []
        self.places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
        stack, at, last = [0], 0, source.rfind(">")
        while at < len(source):
            m = _TOKEN.search(source, at) if at <= last else None
            if m is None:
                self._text(stack[-1], source[at:].partition("<!--")[0])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._end(stack, tag)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in ("html", "body"):
                continue
            self._start(stack, tag, m[3])
        self._drop_named()

    def _text(self, node: int, text: str) -> None:
        if not self.noise[node]:
            self.runs.append((node, html.unescape(text)))

    def _start(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._close(stack, {"p"})
        if tag in CLOSED_BY:
            self._close(stack, CLOSED_BY[tag], SCOPES - CLOSED_BY[tag] | {"ul", "ol", "dl"})
        parent = stack[-1]
        self.tag.append(tag)
        self.parent.append(parent)
        self.noise.append(self.noise[parent] or is_noise(tag, attributes, self.inside[parent]))
        self.named.append(0 if self.noise[-1] else named_noise(tag, attributes))
        self.inside.append(self.inside[parent] or tag in CONTAINERS)
        node = len(self.tag) - 1
        if tag in ("br", "hr"):
            self._text(parent, " ")
        if tag not in VOID and not attributes.endswith("/"):
            self.places.setdefault(tag, []).append(len(stack))
            stack.append(node)

    def _innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, stack: list[int], at: int) -> None:
        """Close the element at a place of the stack and all inside; every element is closed once, so time is linear."""
        if at:
            for node in stack[at:]:
                self.places[self.tag[node]].pop()
            del stack[at:]

    def _close(self, stack: list[int], tags: set[str], stop: set[str] = SCOPES) -> None:
        at = self._innermost(tags)
        if at > self._innermost(stop - tags):
            self._cut(stack, at)

    def _end(self, stack: list[int], tag: str) -> None:
        self._cut(stack, self._innermost((tag,)))

    def _drop_named(self) -> None:
        """Elements named as noise go, unless they hold an article or main element or most of the text: then density decides.

        A whole name (class="ad") beside an article or main element goes whatever its size.  A thread of comments goes, articles inside
        included, where at least LEAST_REST of the text lies elsewhere; so does a sidebar that does not hold all articles of the page.
        """
        n = len(self.tag)
        chars, named = [0] * n, [4 <= v for v in self.named]
        for i in range(1, n):  # an article inside a thread is a comment
            named[i] = named[i] or named[self.parent[i]]
        articles = [int(self.tag[i] in CONTAINERS and not self.noise[i] and not named[i]) for i in range(n)]
        link = [0] * n
        for node, text in self.runs:
            chars[node] += len(text.strip())
            link[node] += len(text.strip()) * (self.tag[node] == "a")
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            link[p] += chars[i] if self.tag[i] == "a" else link[i]
            articles[p] += articles[i]
        for i in range(1, n):
            level, rest = self.named[i], chars[0] - chars[i]
            if level >= 3:
                goes = rest > LEAST_REST * chars[0] and (level == 4 or not articles[i] or articles[i] < articles[0])
            else:
                goes = level and not articles[i] and (2 * chars[i] <= chars[0] or (level == 2 and articles[0]))
            if self.tag[i] == "form" and not articles[i]:
                goes = goes or 2 * (chars[i] - link[i]) <= chars[0] - link[0]
            self.noise[i] = self.noise[i] or self.noise[self.parent[i]] or bool(goes)
        self.runs = [r for r in self.runs if not self.noise[r[0]]]

    def densities(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """Composite density, sum of the children's, characters and characters of links of every node."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.runs:
            size = len(text.strip())
            chars[node] += size
            if self.tag[node] == "a":
                link_chars[node] += size
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if self.noise[i]:
                continue
            if self.tag[i] == "a":
                link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
        body_share = link_chars[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c = chars[i]
            if c and not self.noise[i]:
                t, lc, lt = max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
                base = log(c / max(c - link_chars[i], 1) * link_chars[i] + body_share * c + e)
                density[i] = c / t * log(max(c / lc * t / lt, 1.0)) / log(base + 1e-9) if base > 1 + 1e-9 else c / t * log(max(c / lc * t / lt, 1.0) + 1)
            if i:
                total[self.parent[i]] += density[i]
        return density, total, chars, link_chars

    def kept_nodes(self) -> list[bool]:
        """Which nodes' own text belongs to the content."""
        density, total, chars, links = self.densities()
        n = len(self.tag)
        centre = max(range(n), key=lambda i: total[i]) if n else 0
        path = [centre]
        while path[-1]:
            path.append(self.parent[path[-1]])
        threshold = min(density[i] for i in path)
        # An innermost article or main element around the centre belongs to the content as a whole (its title is often sparse).
        roots = {centre, next((i for i in path if self.tag[i] in CONTAINERS), centre)}
        beside = self.parent[centre]  # headings and paragraphs next to the centre are too short for the threshold, yet its own
        prose = [self.tag[i] in HEADINGS or self.tag[i] == "p" for i in range(n)]
        for i in range(n - 1, 0, -1):
            prose[self.parent[i]] = prose[self.parent[i]] or (prose[i] and not self.noise[i])
        path = set(path)
        keep = [False] * n
        for i in range(n):
            p = self.parent[i]
            near = p == beside > 0 and prose[i] and not links[i]
            keep[i] = not self.noise[i] and (i in roots or (p >= 0 and keep[p]) or (p in path and i not in path and (density[i] >= threshold or near)))
        return keep

    def blocks(self) -> list[str]:
        """The content's blocks in page order, white space made one space."""
        keep, block = self.kept_nodes(), [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            block[i] = i if self.tag[i] in BLOCK else block[self.parent[i]]
        out, last = [], None
        for node, text in self.runs:
            if not keep[node]:
                continue
            if block[node] != last:
                out.append([])
                last = block[node]
            out[-1].append(text)
        return [b for b in (" ".join("".join(x).split()) for x in out) if b]


def main_text(source: str | None) -> list[str]:
    """Blocks of the main text of one page; none for null, empty or text-free pages."""
    return Page(source).blocks() if source else []


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, n_blocks)`` for every row of ``pages(page_id, url, html)``.

    A null or empty page, or one without content, has the text "" and no blocks.  Pages of any length are read
    whole; unclosed tags and comments end where their parent or the page ends.  Repeated rows stay repeated, null
    ids and urls stay null; other columns are not read.  Of equally dense nodes the outer one wins.
    """
    names = ["page_id", "url", "text", "n_chars", "n_blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column("html")]
            texts = [" ".join(b) for b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64())], names
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_blocks long"
    )
