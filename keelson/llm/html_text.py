"""Main text of web pages by composite text density.

Every page becomes a small DOM. For each node, characters per tag are adjusted by the share of
link text; a node's density sum is the sum over its children. The subtree with the largest density
sum is the core of the article, and the least density on its path to the body is the threshold
that tells article blocks around the core from page furniture. Blocks anywhere in the body that are
as dense as that, or as the usual block of the core, belong to the article, and so do the headings
before them.
"""

from __future__ import annotations

import html
import math
import re
from statistics import median_low

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import replace_columns, small_batches, texts_of

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*?)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
    re.I,
)
#: Elements whose content is not markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements that never hold article text.
_FURNITURE = set(
    "head script style noscript template iframe object embed svg math canvas audio video nav "
    "footer aside menu form button select option textarea input label fieldset dialog title "
    "noembed noframes xmp datalist".split()
)
#: Start tags that end an open element of the same family, up to the enclosing list or table.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements whose name may mark them as page furniture; headings, paragraphs, list items, cells and
#: inline elements are never judged by a name.
_NAMED = set("div section article ul ol dl dir table center details header hgroup figure".split())
#: Words that mark a name of class, id or role as one of page furniture, perhaps.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:ads?|advert\w*|adsense|adslot|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|"
    r"notices?|alert|newsletter|subscri\w+|signup|paywall|popup|modal|overlay|sidebar|side-bar|"
    r"rail|menu|nav|navbar|navigation|breadcrumbs?|toolbar|pagination|pager|share|sharing|social|"
    r"related|recommend\w*|comments?|commentlist|replies|respond|disqus|footer|masthead|"
    r"site-header|page-header|top-bar|topbar|search|login|complementary|contentinfo|"
    r"skip-link)(?:$|[\s_-])",
    re.I,
)
#: Whole class, id or role names (one or more of them) that mean nothing but page furniture.
_CERTAIN = re.compile(
    r"(?:\s*(?:ads?|advert|advertisement|adsense|adslot|banner|ad-banner|cookie-?(?:notice|banner|bar|consent)|"
    r"newsletter|newsletter-signup|paywall|popup|modal|overlay|sidebar|side-bar|menu|main-menu|nav|navbar|"
    r"navigation|main-nav|breadcrumbs?|toolbar|pagination|pager|comments?|comment-list|commentlist|"
    r"disqus_thread|footer|site-footer|page-footer|masthead|site-header|top-bar|topbar|complementary|contentinfo|"
    r"skip-link)(?:\s+|$))+",
    re.I,
)
#: Parts of names that mean page furniture, mostly; that may mean it; and that say nothing. Fixed values.
_STRONG = set(
    "ad adsense advert advertisement ads breadcrumb breadcrumbs comment commentlist comments consent "
    "cookie cookies disqus footer gdpr masthead modal navbar navigation newsletter overlay pager "
    "pagination paywall popup respond sidebar signup subscribe subscription".split()
)
_WEAK = set(
    "alert banner login menu nav notice notices promo rail recommendations recommended related "
    "replies search share sharing social sponsor sponsored toolbar".split()
)
_GENERIC = set(
    "area bar block bottom box buttons column container dialog fixed form global inner items left "
    "links list outer panel policy posts primary reader readers right secondary section site "
    "sticky thread top user users widget widgets wrap wrapper".split()
)
#: A container goes if its name, place, shape, links and density add up to this.
_FURNITURE_SCORE = 3
#: So much text outside of what names call furniture, and the article is looked for there only.
_OUTSIDE_CHARS, _OUTSIDE_SHARE = 200, 0.2
#: Density sums inside a perhaps marked container count by this share when the core is chosen.
_MARKED_SHARE = 0.5
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Containers that may go if they are links mostly; a single paragraph never does.
_CONTAINERS = set("div ul ol dl table section".split())


class _Page:
    """Nodes in page order (parents first) and the text and break events between them."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.dropped = ["#page"], [0], [False]
        #: By name: perhaps furniture, and certainly so.
        self.marked, self.certain = [False], [False]
        #: How much a container's name speaks for furniture, from 0 to 3, and its tag and class.
        self.priors, self.shapes = [0], [("", "")]
        #: Ids of sections that speak for furniture.
        self.section_ids: dict[int, str] = {}
        self.events: list[tuple[int, str | None]] = []
        self._open = [0]
        self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = _MARKUP.search(source, at)
            self._text(source[at : found.start() if found else size])
            if not found:
                return
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                self._close(tag)
            else:
                self._start(tag, found[3])
                if tag in _RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    self._text(source[at : end.start() if end else size])
                    at = end.start() if end else size

    def _text(self, text: str) -> None:
        if text:
            self.events.append((self._open[-1], html.unescape(text)))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS:
            family, limit = _ENDS[tag]
            for depth in range(len(self._open) - 1, 0, -1):
                name = self.tags[self._open[depth]]
                if name in family:
                    self._cut(depth)
                    break
                if name in limit:
                    break
        if tag in _BLOCK:
            # A block ends an open paragraph.
            for depth in range(len(self._open) - 1, 0, -1):
                name = self.tags[self._open[depth]]
                if name == "p":
                    self._cut(depth)
                    break
                if name in _BLOCK:
                    break
        parent = self._open[-1]
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.dropped.append(self._is_furniture(tag, attributes))
        marked, certain = self._named_as_furniture(tag, attributes)
        self.marked.append(marked)
        self.certain.append(certain)
        prior, shape, slug = _name_prior(tag, attributes)
        if slug:
            self.section_ids[node] = slug
        self.priors.append(prior)
        self.shapes.append((tag, shape))
        if tag == "main":  # a container of the main element is no furniture, whatever its name
            for above in self._open:
                self.certain[above] = False
        if tag in _BLOCK:
            self.events.append((node, None))
        elif tag in ("br", "td", "th", "img", "wbr"):
            self.events.append((node, "" if tag == "wbr" else " "))
        if tag not in _VOID:
            self._open.append(node)

    def _is_furniture(self, tag: str, attributes: str) -> bool:
        if tag in _FURNITURE:
            return True
        if tag == "header" and not any(
            self.tags[node] in ("article", "main") for node in self._open
        ):
            return True
        if not attributes or tag in ("html", "body", "main"):
            return False
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
            if name == "style" and _HIDDEN.search(value):
                return True
        return False

    def _named_as_furniture(self, tag: str, attributes: str) -> tuple[bool, bool]:
        """Whether class, id or role hold a word of page furniture, and whether one is such a name."""
        marked = certain = False
        if attributes and tag in _NAMED:
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id", "role") and _MARKED.search(value):
                    marked = True
                    # Ids of sections are often made from their headings.
                    slug = name == "id" and tag == "section"
                    certain = certain or not slug and _CERTAIN.fullmatch(value) is not None
        return marked, certain

    def _close(self, tag: str) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[depth]] == tag:
                self._cut(depth)
                return

    def _cut(self, depth: int) -> None:
        for node in reversed(self._open[depth:]):
            if self.tags[node] in _BLOCK:
                self.events.append((node, None))
            elif self.tags[node] in ("td", "th"):
                self.events.append((node, " "))
        del self._open[depth:]


def _name_prior(tag: str, attributes: str) -> tuple[int, str, str]:
    """How much the names of a container speak for page furniture, its class, a section's id that
    does.

    3 if one name consists of words for furniture and words that say nothing, and one of the
    former hardly means anything else; 2 if it may; 1 if such a word is but a part of a name. An
    id of a section counts one less: it is often made from a heading.
    """
    prior, shape, slug_id = 0, "", ""
    if not attributes or tag not in _NAMED and tag != "li":
        return prior, shape, slug_id
    for attribute, *values in _ATTRIBUTE.findall(attributes):
        attribute, value = attribute.lower(), "".join(values).lower()
        if attribute == "class":
            shape = " ".join(value.split()[:1])
        if attribute not in ("class", "id", "role") or tag not in _NAMED:
            continue
        slug = attribute == "id" and tag == "section"
        for name in value.split():
            parts = set(re.split("[-_]+", name.strip("-_")))
            if not parts & (_STRONG | _WEAK) or parts & {"has", "with", "no"}:
                continue
            if parts <= _STRONG | _WEAK | _GENERIC:
                prior = max(prior, (3 if parts & _STRONG else 2) - slug)
                slug_id = name if slug else slug_id
            else:
                prior = max(prior, 1)
    return prior, shape, slug_id


def _forgive_slugs(page: _Page) -> None:
    """An id that a section has from its own heading says little about it."""
    if not page.section_ids:
        return
    size = len(page.tags)
    heading, words = [0] * size, {}
    for node in range(1, size):
        heading[node] = node if page.tags[node] in _HEADINGS else heading[page.parents[node]]
    for node, text in page.events:
        if text and heading[node]:
            words.setdefault(heading[node], []).append(text)
    first = [node if page.tags[node] in _HEADINGS else size for node in range(size)]
    for node in range(size - 1, 0, -1):
        first[page.parents[node]] = min(first[page.parents[node]], first[node])
    for node, name in page.section_ids.items():
        title = "".join(words.get(first[node], ())).lower()
        if "-".join(re.findall(r"\w+", title)) == name.strip("-_").replace("_", "-"):
            page.priors[node] = min(page.priors[node], 1)


def _furniture_score(
    page: _Page, node: int, last: list[int], blocks: list[int], repeated: list[bool], thin: bool, linked: bool
) -> int:
    """The name's part, plus one each for: no article block on one of the two sides; several
    children of one shape, as in a list of comments; few characters per tag; links mostly.

    ``blocks`` are the paragraphs and items outside of all named containers, in page order.
    """
    edge = not blocks or blocks[-1] < node or blocks[0] > last[node]
    return page.priors[node] + edge + repeated[node] + thin + linked


def _composite(chars: int, links: int, tags: int, link_tags: int, overall: float) -> float:
    """Characters per tag, weighted by how few of them are links."""
    base = math.log(chars / max(chars - links, 1) * links + overall * chars + math.e)
    ratio = chars / max(links, 1) * tags / link_tags
    return chars / tags * math.log(max(ratio, 1.0)) / max(base, 1.0)


def _densities(
    page: _Page, hidden: list[bool]
) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite density, sum of the children's densities, characters and link characters of
    every node."""
    size = len(page.tags)
    chars, links, tags, link_tags = [0] * size, [0] * size, [0] * size, [0] * size
    in_link = [False] * size
    for node in range(1, size):
        in_link[node] = in_link[page.parents[node]] or page.tags[node] == "a"
    for node, text in page.events:
        if text and not hidden[node]:
            length = len(" ".join(text.split()))
            chars[node] += length
            if in_link[node]:
                links[node] += length
    for node in range(size - 1, 0, -1):
        if hidden[node]:
            continue
        parent = page.parents[node]
        chars[parent] += chars[node]
        links[parent] += links[node]
        tags[parent] += tags[node] + 1
        link_tags[parent] += link_tags[node] + (page.tags[node] == "a")
    overall = links[0] / max(chars[0], 1)
    density, sums = [0.0] * size, [0.0] * size
    for node in range(size - 1, -1, -1):
        if chars[node] and not hidden[node]:
            density[node] = _composite(
                chars[node], links[node], max(tags[node], 1), max(link_tags[node], 1), overall
            )
        if node:
            sums[page.parents[node]] += density[node]
    return density, sums, chars, links


def main_text(source: str) -> str:
    """The article text of one page: blocks in page order, one per line; empty if there is none."""
    page = _Page(source)
    _forgive_slugs(page)
    size = len(page.tags)

    def below(roots: list[bool]) -> list[bool]:
        found = roots[:]
        for node in range(1, size):
            found[node] = found[node] or found[page.parents[node]]
        return found

    hidden = below([a or b for a, b in zip(page.dropped, page.certain, strict=True)])
    density, sums, chars, links = _densities(page, hidden)
    if not chars[0] and any(page.certain):  # nothing else on the page
        hidden = below(page.dropped)
        density, sums, chars, links = _densities(page, hidden)
    # Last node below each one; what holds the page's title or main element is no furniture.
    last, holds_title, seen, repeated = list(range(size)), [False] * size, set(), [False] * size
    for node in range(size - 1, 0, -1):
        parent = page.parents[node]
        holds_title[node] = holds_title[node] or page.tags[node] in ("h1", "main") and not hidden[node]
        holds_title[parent] = holds_title[parent] or holds_title[node]
        last[parent] = max(last[parent], last[node])
        if page.shapes[node][1]:
            key = (parent, page.shapes[node])
            repeated[parent] = repeated[parent] or key in seen
            seen.add(key)
        if page.tags[node] in ("ul", "ol", "div"):
            repeated[parent] = repeated[parent] or repeated[node]
    judged = [p > 0 and not holds_title[i] and not hidden[i] for i, p in enumerate(page.priors)]
    strong = below([j and page.priors[i] + repeated[i] >= 2 for i, j in enumerate(judged)])
    # A name lowers the score only; a wrapper around the whole page lowers all scores alike. With
    # enough text elsewhere, the core is not looked for in what names call furniture.
    own_chars = [0] * size
    for node, text in page.events:
        if text and not hidden[node]:
            own_chars[node] += len(" ".join(text.split()))
    outside = sum(n for n, inside in zip(own_chars, strong, strict=True) if not inside)
    elsewhere = outside >= min(_OUTSIDE_CHARS, _OUTSIDE_SHARE * max(chars[0], 1))
    lowered = below(page.marked)
    scores = [
        0.0 if inside and elsewhere else x * _MARKED_SHARE if low else x
        for x, low, inside in zip(sums, lowered, strong, strict=True)
    ]
    core = max(range(size), key=lambda i: (scores[i], -i))
    if sums[core] == 0:  # text without any element around it
        core = 0
    path = [core]
    while path[-1] and page.tags[path[-1]] != "body":
        path.append(page.parents[path[-1]])
    threshold = min(density[i] for i in path)
    # The whole article: up to the outermost article or main element on the path, else up to
    # the child of the body; further blocks of the body by their density.
    named = [i for i in path if page.tags[i] in ("article", "main")]
    inner = [i for i in path if i and page.tags[i] not in ("body", "html")]
    root = named[-1] if named else inner[-1] if inner else path[-1]
    on_path = set(path)
    above = set(path[path.index(root) + 1 :])
    # Larger blocks are denser by the logarithm alone; a block as dense as the core's usual one
    # is article text too.
    usual = [density[i] for i in range(size) if page.parents[i] == core and density[i] > 0]
    enough = min(threshold, median_low(usual)) if usual else threshold
    # What is perhaps furniture by name is so if it is thin, too.
    thin = [m and i not in on_path and density[i] < enough for i, m in enumerate(page.marked)]
    named_parts = below(judged)
    blocks = [
        node
        for node in range(size)
        if page.tags[node] in ("p", "li", "blockquote", "pre")
        and not hidden[node]
        and not named_parts[node]
        and chars[node]
        and density[node] >= enough
    ]
    scored = [
        judged[i]
        and i not in on_path
        and chars[i] > 0
        and _furniture_score(
            page, i, last, blocks, repeated, density[i] < enough, links[i] > 0.5 * chars[i]
        )
        >= _FURNITURE_SCORE
        for i in range(size)
    ]
    hidden = below([any(three) for three in zip(hidden, thin, scored, strict=True)])
    in_body = [False] * size
    shown = [False] * size
    for node in range(size):
        parent = page.parents[node]
        in_body[node] = node == path[-1] or node > 0 and in_body[parent]
        inside = node == root or node > 0 and shown[parent]
        beside = in_body[node] and node not in above and density[node] >= enough > 0
        furniture = (
            node not in on_path
            and page.tags[node] in _CONTAINERS
            and density[node] < threshold
            and links[node] > 0.5 * chars[node]
        )
        shown[node] = (inside or beside) and not hidden[node] and not furniture
    _show_headings(page, shown, hidden, in_body, above, chars)
    overall = links[0] / max(chars[0], 1)
    lines = []
    block: list[tuple[int, str]] = []
    for node, text in [*page.events, (0, None)]:
        if text is not None:
            if not hidden[node]:
                block.append((node, text))
            continue
        if any(shown[i] for i, _ in block) or _is_loose_text(page, block, above, overall, enough):
            lines.append(" ".join("".join(own for _, own in block).split()))
        block = []
    return "\n".join(line for line in lines if line)


def _show_headings(page: _Page, shown, hidden, in_body, above, chars) -> None:
    """Show the headings, alone or in a wrapper of their own, that come before a shown block."""
    size = len(page.tags)
    titles = [0] * size
    for node in range(size - 1, 0, -1):
        if not hidden[node]:
            if page.tags[node] in _HEADINGS:
                titles[node] = chars[node]
            titles[page.parents[node]] += titles[node]
    followed = [False] * size  # by a shown block, among the later children of the same parent
    for node in range(size - 1, 0, -1):
        parent = page.parents[node]
        if shown[node] or node in above:
            followed[parent] = True
        elif followed[parent] and in_body[node] and 0 < chars[node] == titles[node]:
            shown[node] = True
    for node in range(1, size):
        # What a heading or its wrapper holds.
        if shown[page.parents[node]] and chars[page.parents[node]] == titles[page.parents[node]]:
            shown[node] = shown[node] or not hidden[node]


def _is_loose_text(page: _Page, block, above: set[int], overall: float, enough: float) -> bool:
    """Whether a run of text directly in an ancestor of the article is as dense as its blocks."""
    inline, links = set(), 0
    length = 0
    for node, text in block:
        size = len(" ".join(text.split()))
        length += size
        linked = False
        while node not in above:
            if page.tags[node] in _BLOCK or not node:
                return False
            inline.add(node)
            linked = linked or page.tags[node] == "a"
            node = page.parents[node]
        links += size * linked
    if not length or enough <= 0:
        return False
    link_tags = sum(page.tags[node] == "a" for node in inline)
    return _composite(length, links, max(len(inline), 1), max(link_tags, 1), overall) >= enough


def extract_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """All columns plus ``text`` (the main text) and ``n_chars`` (its code points).

    Whole pages are read; null or empty html and pages without an article give the empty text.
    White space inside a block becomes one blank, blocks are joined by one line feed. Repeated
    rows are extracted each; input columns named like the results are replaced; an empty table
    stays empty.
    """
    small_batches(pages.sparkSession)

    def extract(array: pa.Array) -> pa.Array:
        return pa.array([main_text(value) for value in texts_of(array)], pa.string())

    found = pages.select("*", arrow_udf(extract, "string").asNondeterministic()(F.col(source)).alias("_main"))
    return replace_columns(found, text=F.col("_main"), n_chars=F.length("_main").cast("long")).drop(
        "_main"
    )
