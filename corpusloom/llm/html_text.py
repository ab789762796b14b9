"""Main text of web pages by composite text density.

A page becomes a tree. What is never part of an article goes first: scripts, styles, forms, menus,
page headers, footers, sidebars, adverts, notices and reader comments, by element, role, or the
words of class and id. Ids made from heading texts are no such names: those of headings and of what
is in them are not looked at, and those of sections and of all that is inside an article or main
part only for words that tell it anywhere. A form that holds the article, the main part or, where
the page marks neither, most of its text is the frame of the page and stays. On what is left every node gets its composite density, the characters per
tag adjusted by how many of them are links; nodes are ranked by the sum of the densities of their
children. The subtree of the largest sum is the article's core; the smallest density on its path
to the body is the threshold that neighbours of that path must reach to belong to it as well. If
the page marks an article, the core is sought inside the marked ones, and the one that holds it is
taken whole.

Text: character references decoded, white space inside a block one space, trimmed, blocks in page
order joined by one line feed. A line break inside a block is white space.

Defined cases: null and empty pages, and pages without text, give an empty text; broken markup is
closed as browsers do (unclosed paragraphs, list items, cells; stray end tags are ignored); an
unclosed script, style or comment reaches to the end; depth and length are not limited; repeated
rows and null identifiers keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_words = lambda text: frozenset(text.split())

VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp iframe noframes noembed")
BLOCKS = _words(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead "
    "tr ul caption"
)
SPACED = _words("br td th wbr img")
HEADINGS = _words("h1 h2 h3 h4 h5 h6 hgroup")
#: An opening tag ends open elements of these kinds, up to the boundary elements.
ENDS = {
    "li": (_words("li"), _words("ul ol menu dir")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "tr": (_words("tr td th"), _words("table")),
    "td": (_words("td th"), _words("tr table")),
    "th": (_words("td th"), _words("tr table")),
    "option": (_words("option"), _words("select")),
}
NEVER = _words(
    "script style noscript template nav footer aside form iframe object embed svg canvas annotation annotation-xml audio video button "
    "select option textarea input datalist dialog menu head title map noframes noembed xmp"
)
ROLES = _words(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status"
)
#: Words of class and id names of what does not belong to an article.
NAMES = _words(
    "ad ads adbox advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer colophon copyright "
    "sidebar sidenav rail aside widget widgets related recommended recommendations popular trending "
    "share sharing social follow newsletter subscribe subscription signup login "
    "cookie cookies consent gdpr notice notices notification banner alert disclaimer paywall popup modal overlay "
    "comment comments commentlist respond reply replies discussion disqus form search hidden"
)
#: Of these, the ones that tell it wherever they stand in a name; others must begin or end it.
ANYWHERE = _words("ad ads advert adverts advertisement advertising sponsored sidebar cookie cookies comments newsletter disqus")
#: A name with one of these words tells how a container looks, not what it is.
LOOKS = _words("has with no without open enabled layout")
#: The header of one of these is the article's own.
OWN_HEADER = _words("article post entry story content")

#: Attributes with paired quotes first, without going back over them; a tag whose quotes do not pair
#: ends at the next angle bracket.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?=>)|[^>]*+)>|<[!?/][^>]*+>", re.S
)
_ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I
)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """The tree as parallel lists, parents before children, and its text in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#root"], [-1], [""]
        #: (node, text); text None at the start and end of a block, " " at a space.
        self.events: list[tuple[int, str | None]] = []
        #: How many elements of a name are open, so that a name without any is not looked for.
        self.open: Counter[str] = Counter()
        stack = [0]
        at, end = 0, len(source)
        last = source.rfind(">")
        search = _TAG.search
        while at < end:
            found = search(source, at) if at <= last or "<!--" in source[at:] else None
            if found is None:
                self.events.append((stack[-1], source[at:]))
                break
            if found.start() > at:
                self.events.append((stack[-1], source[at : found.start()]))
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                self._close(stack, name)
                continue
            if name in BLOCKS and name != "body" and name != "html":
                self._end_paragraph(stack)
            if name in ENDS:
                self._end_siblings(stack, *ENDS[name])
            self.tags.append(name)
            self.parents.append(stack[-1])
            self.attributes.append(found[3])
            node = len(self.tags) - 1
            if name in BLOCKS:
                self.events.append((node, None))
            elif name in SPACED:
                self.events.append((stack[-1], " "))
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
            elif name not in VOID:
                stack.append(node)
                self.open[name] += 1

    def _pop(self, stack: list[int]) -> None:
        node = stack.pop()
        self.open[self.tags[node]] -= 1
        if self.tags[node] in BLOCKS:
            self.events.append((node, None))

    def _close(self, stack: list[int], name: str) -> None:
        if name in ("html", "body") or not self.open[name]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag == name:
                while len(stack) > depth:
                    self._pop(stack)
                return
            # An inline end tag does not reach out of its block.
            if tag in BLOCKS and name not in BLOCKS and name not in ("td", "th"):
                return

    def _end_paragraph(self, stack: list[int]) -> None:
        if not self.open["p"]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag == "p":
                while len(stack) > depth:
                    self._pop(stack)
                return
            if tag in BLOCKS or tag in ("td", "th", "button", "object"):
                return

    def _end_siblings(self, stack: list[int], kinds: frozenset, bounds: frozenset) -> None:
        if not any(self.open[kind] for kind in kinds):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag in bounds:
                return
            if tag in kinds:
                while len(stack) > depth:
                    self._pop(stack)
                if kinds != ENDS["tr"][0]:
                    return


def _named_foreign(name: str, in_article: bool, anywhere_only: bool = False) -> bool:
    """Whether a class or an id names what is not part of an article."""
    parts = [p for p in re.split(r"[^a-z]+", _CAMEL.sub("-", name).lower()) if p]
    if not parts or LOOKS.intersection(parts):
        return False
    if ANYWHERE.intersection(parts):
        return True
    if anywhere_only:
        return False
    if parts[-1] in ("header", "banner") and (in_article or parts[0] in OWN_HEADER):
        return False
    return parts[0] in NAMES or parts[-1] in NAMES


def _foreign(tag: str, attributes: str, in_article: bool, in_part: bool, in_heading: bool, holds_article: bool) -> bool:
    """Whether an element is not part of an article. One that holds the article is never foreign
    by its names. ``in_part``: inside of an article or main part."""
    if tag in NEVER and not (tag == "form" and holds_article) or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main", "a"):
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        name = found[1].lower()
        value = next((v for v in found.groups()[1:] if v is not None), "")
        if name == "hidden" or (name == "style" and _HIDING.search(value)):
            return True
        if holds_article:
            continue
        if name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "class" and any(_named_foreign(one, in_article) for one in value.split()):
            return True
        if name == "id" and not in_heading:
            titled = in_part or tag == "section"
            if any(_named_foreign(one, in_article, titled) for one in value.split()):
                return True
    return False


def _frames(page: Page) -> list[int]:
    """Forms that hold over half of the text of a page, and what these lie in."""
    count = len(page.tags)
    size, read = [0] * count, [True] * count
    for node in range(1, count):
        read[node] = read[page.parents[node]] and (page.tags[node] == "form" or page.tags[node] not in NEVER)
    for node, text in page.events:
        if text is not None and read[node]:
            size[node] += len("".join(text.split()))
    for node in range(count - 1, 0, -1):
        size[page.parents[node]] += size[node]
    frames = set()
    for node in range(1, count):
        if page.tags[node] == "form" and 2 * size[node] > size[0]:
            while node > 0 and node not in frames:
                frames.add(node)
                node = page.parents[node]
    return sorted(frames)


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    tags, parents, count = page.tags, page.parents, len(page.tags)

    holds = [False] * count  # an article or main part is inside
    for node in range(count - 1, 0, -1):
        if holds[node] or tags[node] in ("article", "main"):
            holds[parents[node]] = True
    if "form" in tags and not holds[0]:
        for node in _frames(page):
            holds[node] = True
    inside = [False] * count  # of an article
    part = [False] * count  # inside of an article or main part
    heading = [False] * count  # a heading or inside of one
    keep = [True] * count
    for node in range(1, count):
        parent, tag = parents[node], tags[node]
        inside[node] = inside[parent] or tag == "article"
        part[node] = part[parent] or tag in ("article", "main")
        heading[node] = heading[parent] or tag in HEADINGS
        keep[node] = keep[parent] and not _foreign(
            tag, page.attributes[node], inside[parent], part[parent], heading[node], holds[node]
        )

    chars, links = [0] * count, [0] * count
    linked = [False] * count
    for node in range(1, count):
        linked[node] = linked[parents[node]] or tags[node] == "a"
    for node, text in page.events:
        if text is not None and keep[node]:
            size = len(text) - text.count(" ")
            chars[node] += size
            if linked[node]:
                links[node] += size
    tag_count, link_count = [0] * count, [0] * count
    for node in range(count - 1, 0, -1):
        if keep[node]:
            parent = parents[node]
            chars[parent] += chars[node]
            links[parent] += links[node]
            tag_count[parent] += 1 if tags[node] == "math" else tag_count[node] + 1  # a formula is one tag
            link_count[parent] += link_count[node] + (tags[node] == "a")
    if not chars[0]:
        return ""

    body = next((n for n in range(1, count) if tags[n] == "body" and keep[n]), 0)
    ratio = links[body] / max(chars[body], 1)
    density = [0.0] * count
    sums = [0.0] * count
    for node in range(count - 1, -1, -1):
        c = chars[node]
        if keep[node] and c:
            t, lc, lt = max(tag_count[node], 1), max(links[node], 1), max(link_count[node], 1)
            base = math.log(c / max(c - links[node], 1) * links[node] + ratio * c + math.e)
            density[node] = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(base, 1e-9)
            if node:
                sums[parents[node]] += density[node]

    def under(node: int, kind: str) -> int:
        while node > 0 and tags[node] != kind:
            node = parents[node]
        return node

    marked = [n for n in range(1, count) if keep[n] and chars[n] and tags[n] == "article"]
    marked = marked or [n for n in range(1, count) if keep[n] and chars[n] and tags[n] == "main"]
    in_marked = [False] * count
    for node in marked:
        in_marked[node] = True
    for node in range(1, count):
        in_marked[node] = in_marked[node] or in_marked[parents[node]]
    candidates = [n for n in range(count) if keep[n] and chars[n] and (in_marked[n] or not marked)]
    core = max(candidates, key=lambda n: (sums[n], density[n], -n))

    chosen = [False] * count
    article = under(core, "article")
    if article:
        while under(parents[article], "article"):
            article = under(parents[article], "article")
        chosen[article] = True
    else:
        top = under(core, "main") or body
        path = [core]
        while path[-1] != top and parents[path[-1]] >= 0:
            path.append(parents[path[-1]])
        least = min(density[n] for n in path)
        on_path = set(path)
        chosen[core] = True
        for node in range(1, count):
            if parents[node] in on_path and node not in on_path and keep[node] and chars[node]:
                dense = density[node] >= least and links[node] * 3 <= chars[node]
                chosen[node] = parents[node] != core and (dense or (tags[node] in HEADINGS and links[node] * 2 <= chars[node]))
        for node in path[1:]:  # text that stands beside the core, outside of any element
            chosen[node] = False
    for node in range(1, count):
        chosen[node] = keep[node] and (chosen[node] or (chosen[parents[node]]))
    if core == 0:
        chosen[0] = True
        for node in range(1, count):
            chosen[node] = keep[node] and chosen[parents[node]]

    blocks, line = [], []
    for node, text in page.events:
        if text is None:
            if line:
                blocks.append("".join(line))
                line = []
        elif chosen[node]:
            line.append(text)
    if line:
        blocks.append("".join(line))
    cleaned = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n".join(b for b in cleaned if b)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col(source).alias("_html")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
