"""HTML extraction by tree scoring.

A tolerant parser builds the tree and cuts its text into blocks.  Menus, headers,
footers, sidebars, notices, adverts, forms, scripts and comments are set aside by
tag, role, visibility and class words.  Each remaining block gives points for its
length and commas to its ancestors, less with each level; a container's points are
discounted by its link density.  The best container wins (its enclosing article, if
there is one), and siblings that score a fifth of it, paragraphs, headings, and divs,
sections and articles with few links beside it are kept (beside an article, only articles); when all siblings are, the parent is the container and
its siblings are judged in turn.  If nothing is left, the class words are disregarded.

Lists of links count as menus only before the container's first other text; after it they are references and stay.

Text: character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by an empty line; nothing else is dropped.

Cases: null, empty or text-less html gives the empty string; plain text is one block;
unclosed, misnested and very deep markup is accepted (no recursion; time grows in proportion to a page's length); a tag
without an end goes up to the next ``>``, whatever its quotes, or to the end of the page; pages are read
whole; of equally good containers the last one counts; repeated rows and null ids are judged row by row;
an empty table gives no rows; other columns are passed on if asked for, whatever their names.  One pass, no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKUP = re.compile(r"<!--|<(?=[A-Za-z]|/[A-Za-z])|<[!?/]")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*+)")
#: Attributes up to the end of a tag. A quote opens a value only after an equals sign; nothing is tried twice.
_ATTRS = re.compile(r"(?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+(?=>)")
_ATTR = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?>\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

# Kinds of elements in HTML, and class words of boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object embed applet svg math canvas audio video button select option textarea input dialog menu title map".split())
PASSIVE = frozenset("p pre li dt dd td th tr thead tbody tfoot caption h1 h2 h3 h4 h5 h6 blockquote address ul ol dl table figcaption summary center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promotion recommend recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription taboola toolbar widget".split())
#: Those of them that articles use for their own text too: they alone drop no prose inside an article.
DOUBTFUL_WORDS = frozenset("discussion header login menu navigation notice notices notification related reply respond search share sharing social skip".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


class _Page:
    """Nodes in document order, and blocks of text that belong to them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.certain, self.by_class, self.doubtful = ["#root"], [-1], [False], [False], [False]
        self.blocks: list[tuple[int, str, int, int]] = []  # owner, text, characters in links, links
        self._open, self._text, self._linked, self._links = [0], [], 0, 0
        self._places: dict[str, list[int]] = {}  # places in the stack of open elements, by tag
        self._solid = [0]  # places of those that are not inline
        self._parse(source)
        n = len(self.tag)
        self.last = list(range(n))
        for i in range(n - 1, 0, -1):
            self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])

    def _top(self, tags) -> int:
        """Greatest place of an open element with one of the tags, or 0."""
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._open[self._solid[-1]], text, min(self._linked, len(text)), self._links))
        self._text, self._linked, self._links = [], 0, 0

    def _add(self, text: str) -> None:
        if text:
            text = entities.unescape(text) if "&" in text else text
            self._text.append(text)
            if self._places.get("a"):
                self._linked += len(" ".join(text.split()))

    def _push(self, node: int) -> None:
        tag = self.tag[node]
        self._places.setdefault(tag, []).append(len(self._open))
        if tag not in INLINE:
            self._solid.append(len(self._open))
        self._open.append(node)

    def _pop(self, to: int) -> None:
        """Close open elements from the end, down to place ``to`` of the stack."""
        if self._solid[-1] >= to:
            self._flush()
        while len(self._open) > to:
            tag = self.tag[self._open.pop()]
            self._places[tag].pop()
            if tag not in INLINE:
                self._solid.pop()

    def _close(self, tags, limits) -> None:
        at = self._top(tags)
        if at and at > self._top(limits):
            self._pop(at)

    def _parse(self, source: str) -> None:
        at, size, quoted = 0, len(source), True
        while at < size:
            m = _MARKUP.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            self._add(source[at : m.start()])
            at = m.end()
            if m[0] != "<":
                end = source.find("-->" if m[0] == "<!--" else ">", at)
                at = size if end < 0 else end + (3 if m[0] == "<!--" else 1)
                continue
            name = _NAME.match(source, at)
            at = name.end()
            rest = _ATTRS.match(source, at) if quoted else None
            if rest is None:  # quotes do not match up from here on
                quoted = False
                end = source.find(">", at)
                end = size if end < 0 else end
            else:
                end = rest.end()
            attrs, ending, tag = source[at:end], name[0][0] == "/", name[1].lower()
            at = end + 1
            if ending:
                self._end(tag)
            else:
                at = self._start(tag, attrs, source, at)
        self._pop(1)
        self._flush()

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        at = self._top((tag,))
        if at and (tag not in INLINE or self._solid[-1] < at):
            self._pop(at)

    def _start(self, tag: str, attrs: str, source: str, at: int) -> int:
        """Handle a start tag; gives the place to go on from."""
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                self._text.append(" ")
            return at
        if tag in ENDS_PARAGRAPH:
            self._close(("p",), ("table", "td", "th", "button", "caption", "object"))
        if tag == "hr":
            self._flush()
            return at
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag == "a":
            self._close(("a",), ("table", "td", "th"))
        if tag not in INLINE:
            self._flush()
        elif tag == "a":
            self._links += 1
        node = self._node(tag, attrs)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path", "use"):
            return at
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            return end.end() if end else len(source)
        self._push(node)
        return at

    def _node(self, tag: str, attrs: str) -> int:
        parent = self._open[-1]
        certain, by_class, doubtful = tag in DROPPED, False, False
        if tag == "header" and not self._top(("article", "main")):
            certain = True
        if attrs and not certain and not attrs.isspace() and tag not in ("html", "body"):
            a = _attributes(attrs)
            role = a.get("role", "").lower()
            certain = role in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "").lower()))
            if "class" in a or "id" in a:
                words = set(_WORD.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))
                by_class = tag not in INLINE | HEADINGS | {"article", "main"} and bool(words & BAD_WORDS) and not words & GOOD_WORDS
                doubtful = by_class and words & BAD_WORDS <= DOUBTFUL_WORDS
                by_class = by_class or tag == "article" and bool(words & {"comment", "comments", "reply", "ad", "promo", "related"}) or bool(tag in INLINE and words & {"ad", "ads", "advert", "sponsored"})
        self.tag.append(tag)
        self.parent.append(parent)
        self.certain.append(certain)
        self.by_class.append(by_class)
        self.doubtful.append(doubtful)
        return len(self.tag) - 1


#: Share of a block's points that reaches each ancestor in turn.
SHARES = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)


def _points(text: str, linked: int) -> float:
    n = len(text)
    own = (1 + min(n / 100, 3) if n >= 25 else n / 25) + sum(map(text.count, ",，、;"))
    return own * (1 - linked / n)


def _belongs(tag: str, size: int, linked: int) -> bool:
    """Whether an element beside the article's container is text of the article, by link density and text."""
    if tag in HEADINGS:
        return linked < 0.25 * size
    if tag in PASSIVE or tag in ("div", "section", "article"):
        return linked < 0.25 * size and size >= 80 or tag in ("p", "div", "section", "article") and not linked
    return False


def main_blocks(source: str) -> list[str]:
    """The blocks of a page's main text."""
    page = _Page(source)
    return _chosen(page, True) or _chosen(page, False)


def _prose(page: _Page) -> list[bool]:
    """Elements of doubtful classes inside an article whose text is a paragraph or more, with few links."""
    n = len(page.tag)
    within, size, linked = [False] * n, [0] * n, [0] * n
    for owner, text, in_links, _ in page.blocks:
        size[owner] += len(text)
        linked[owner] += in_links
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        linked[page.parent[i]] += linked[i]
    for i in range(1, n):
        within[i] = within[page.parent[i]] or page.tag[i] in ("article", "main")
    return [page.doubtful[i] and within[i] and size[i] >= 80 and linked[i] < 0.25 * size[i] for i in range(n)]


def _chosen(page: _Page, classes: bool) -> list[str]:
    n, tag, parent = len(page.tag), page.tag, page.parent
    prose = _prose(page) if classes and any(page.doubtful) else [False] * n
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[parent[i]] or page.certain[i] or (classes and page.by_class[i] and not prose[i])
    blocks = [b for b in page.blocks if not gone[b[0]]]
    if not blocks:
        return []
    size, linked, links, score = [0] * n, [0] * n, [0] * n, [0.0] * n
    holder, children = list(range(n)), [[] for _ in range(n)]
    for i in range(1, n):
        children[parent[i]].append(i)
        if tag[i] in PASSIVE:
            holder[i] = holder[parent[i]]
    for owner, text, in_links, n_links in blocks:
        size[owner] += len(text)
        linked[owner] += in_links
        links[owner] += n_links
        at = holder[owner]
        points = _points(text, in_links)
        for share in SHARES:
            score[at] += points * share
            at = parent[at]
            if at < 0:
                break
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        linked[parent[i]] += linked[i]
        links[parent[i]] += links[i]
    density = lambda i: linked[i] / size[i] if size[i] else 0.0
    total = [score[i] * (1 - density(i)) * (1.25 if tag[i] in ("article", "main") else 1.0) for i in range(n)]
    best = max(range(n), key=lambda i: (total[i], i))
    up = best
    while up > 0 and tag[up] != "article":
        up = parent[up]
    best = up if up > 0 else best
    bar = 0.2 * total[best]
    kept = [best]
    titled = [0] * n  # characters in headings
    for owner, text, _, _ in blocks:
        if tag[owner] in HEADINGS:
            titled[owner] += len(text)
    for i in range(n - 1, 0, -1):
        titled[parent[i]] += titled[i]
    own_title = any(tag[i] == "h1" and size[i] for i in range(best, page.last[best] + 1))
    if tag[best] == "article" and not own_title:  # its title may stand before it
        kept += [i for i in children[parent[best]] if i < best and not gone[i] and size[i] and titled[i] == size[i] and linked[i] < 0.25 * size[i]]
    while best:
        up = parent[best]
        alone = tag[best] == "article"
        beside = [i for i in children[up] if i != best and not gone[i] and size[i] and (not alone or tag[i] == "article")]
        own = [i for i in beside if _belongs(tag[i], size[i], linked[i]) or total[i] >= bar]
        if alone or len(own) < len(beside) or density(up) >= 0.25:
            kept += own
            break
        best = up  # all of the parent is text of the article
        kept = [best]
    inside = [0] * (n + 1)
    for i in kept:
        inside[i] += 1
        inside[page.last[i] + 1] -= 1
    menu, top = [False] * n, set(kept)
    for i in range(1, n):
        inside[i] += inside[i - 1]
        menu[i] = menu[parent[i]] or (i not in top and tag[i] in ("ul", "ol", "div", "section", "table", "p") and links[i] >= 3 and density(i) > 0.66)
    out, begun = [], False
    for owner, text, _, _ in blocks:
        if inside[owner] and (begun or not menu[owner]):  # lists of links before any other text are menus
            begun = True
            out.append(text)
    return out


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of every row of ``pages`` and ``text``, the main text."""
    rows = pages.select(*keep, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())])
    names = schema.names

    def of(batches):
        for b in batches:
            texts = ["\n\n".join(main_blocks(x.as_py())) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(of, schema)
