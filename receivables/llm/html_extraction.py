"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each under a path of block-level tags from the root.
Parts that are never content by what they are (scripts, forms, navigation, page headers
and footers) are left out while reading, and parts named after adverts, notices, menus or
comments if they are small against the page (``_left_out``). Text length and punctuation are summed per path over the whole page, taken
relative to the largest path and fused into one ratio, to which paths in marked articles
(article, main) add their ratio among these. Ratios are smoothed over the paths of the same
parent or marked article and over all that the element around the content holds, but for
lists of links; what is at or above ``THRESHOLD`` of the best is content.

Results by case: a NULL page counts as empty; an empty page or one without content has
the empty text and 0 characters; unclosed and wrongly nested tags are closed as browsers
do in the common cases, a page cut off inside a tag ends there; copies and repeated rows
are extracted alike; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame

from receivables.llm.common import map_rows, type_of

THRESHOLD = 0.15
SHARED = 0.25

# Element names and the words that name parts around an article.
SKIPPED = frozenset(
    "script style noscript template svg head title iframe object embed canvas audio video "
    "nav aside button select textarea input label menu dialog footer option datalist map "
    "annotation annotation-xml".split()
)
FORMS = frozenset("form fieldset".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover "
    "munderover mtable mtr mtd mmultiscripts mprescripts mpadded mphantom merror menclose".split()
)
ARTICLE = frozenset("article main".split())
LISTS = frozenset("ul ol dl table".split())
WHOLE = frozenset(["", "html", "body"])
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure details center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag on the left ends an open element on the right.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "body": {"head"},
}
AROUND = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|"
    r"popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|share|sharing|social|related|recommended|comments?|replies|reply|disqus|"
    r"commentlist|discussion|respond|"
    r"footer|masthead|toolbar|topbar|site-header|page-header|pagination|pager|widget",
    re.IGNORECASE,
)
HEADERS = ("site-header", "page-header")
# Words behind which a name still means what stands before them, and words that turn it round.
PLACES = frozenset(
    "area bar block box button buttons container content form group icon icons inner items left "
    "link links list outer panel post posts right section title top bottom widgets wrap wrapper".split()
)
NOT_SELF = frozenset("with has no".split())
COMMENTS = frozenset("comment comments reply replies disqus commentlist discussion respond".split())
REMAINS = 60  # characters and a mark of punctuation: what is a text of its own beside comments
MOST = 0.5  # of a page's text and punctuation; what holds more is not left out by its name
ONLY_LINKS = 0.8  # share of links in the text of a list that is one of links
LINKED = 0.5  # share of links in the text of a part whose name only holds a telling word
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    # A quote counts behind an equals sign alone.
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())


def _attributes(text: str) -> dict[str, str]:
    """Names in lower case with their values; the first of a repeated name counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape("".join(values)))
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    """Whether browsers show nothing of the element, or readers are told to skip it."""
    if attributes.get("hidden", "until-found").strip().lower() != "until-found":
        return True
    if attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    style: dict[str, tuple[bool, str]] = {}
    for declaration in attributes.get("style", "").lower().split(";"):
        name, _, value = declaration.partition(":")
        value, important, _ = value.partition("!")
        name, given = name.strip(), (bool(important), value.strip())
        if given[0] or not style.get(name, given)[0]:
            style[name] = given
    return style.get("display", (False, ""))[1] == "none" or (
        style.get("visibility", (False, ""))[1] == "hidden"
    )


def _out(tag: str, attributes: dict[str, str], in_article: bool, in_quote: bool) -> bool:
    """Whether the element is never content by what it is, with all it holds. A quote's footer
    names its author."""
    if tag in SKIPPED and not (tag == "footer" and in_quote) or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    return _hidden(attributes) or attributes.get("role", "").strip().lower() in ROLES


class Named(NamedTuple):
    """What an element's class and id say of it; of a form, that it is one."""

    words: frozenset[str]  # that tell of parts around an article
    sure: bool  # a name means such a part, instead of only holding its word
    alone: bool  # no name says anything else


def _named(tag: str, attributes: dict[str, str]) -> Named | None:
    if tag in FORMS or attributes.get("role", "").strip().lower() == "form":
        return Named(frozenset(["form"]), True, False)
    if not attributes or tag in ("html", "body", "article", "main"):
        return None
    names = " ".join(attributes.get(name, "") for name in ("class", "id")).lower().split()
    sure, held, alone = set(), set(), True
    for name in names:
        parts = re.split(r"[_-]+", name)
        pairs = {f"{one}-{two}" for one, two in zip(parts, parts[1:])}
        telling = {
            part
            for before, part in zip(["", *parts], parts)
            if before not in NOT_SELF and AROUND.fullmatch(part)
        } | (pairs & set(HEADERS))
        held |= telling
        while len(parts) > 1 and (parts[-1] in PLACES or not parts[-1]):
            parts.pop()
        last = next((p for p in (parts[-1], "-".join(parts[-2:])) if p in telling), None)
        if last:
            sure.add(last)
        alone &= name == last
    if not held:
        return None
    return Named(frozenset(sure or held), bool(sure), alone)


class Element(NamedTuple):
    parent: int  # its place among the elements
    tag: str
    marked: int  # the outermost article or main around it, or -1
    link: int  # the link around it, or -1
    named: Named | None


class Paths:
    """Paths of block-level tags by number, each one tag longer than another; 0 is the empty one."""

    def __init__(self):
        self.above, self.tags, self.articles = [0], [""], [-1]
        self.steps: dict[tuple[int, str], int] = {}

    def step(self, path: int, tag: str) -> int:
        place = self.steps.get((path, tag))
        if place is None:
            place = self.steps[path, tag] = len(self.tags)
            self.above.append(path)
            self.tags.append(tag)
            inside = self.articles[path]
            self.articles.append(inside if inside >= 0 or tag not in ARTICLE else place)
        return place

    def article(self, path: int) -> int:
        """The path down to the outermost marked article, or the path itself."""
        return self.articles[path] if self.articles[path] >= 0 else path

    def spelt(self, path: int) -> tuple[str, ...]:
        tags = []
        while path:
            tags.append(self.tags[path])
            path = self.above[path]
        return tuple(reversed(tags))


class Block(NamedTuple):
    path: int  # of block-level tags
    element: int
    pieces: list[tuple[int, str]]  # the element that holds each, and its text


def read(page: str) -> tuple[Paths, list[Element], list[Block]]:
    """The paths, the elements in page order, after the page itself, and the blocks of text."""
    known = Paths()
    elements = [Element(0, "", -1, -1, None)]
    found: list[Block] = []
    paths = [0]  # of the open block-level elements
    places = [0]  # of the open block-level elements
    open_: list[tuple[str, bool, bool, int]] = []  # tag, whether a block, whether left out, place
    names: Counter[str] = Counter()  # of the open elements
    out = 0  # how many open elements are left out
    pieces: list[tuple[int, str]] = []

    def add(text: str) -> None:
        pieces.append((open_[-1][3] if open_ else 0, text))

    def end_block() -> None:
        if pieces:
            if any(not text.isspace() for _, text in pieces):
                found.append(Block(paths[-1], places[-1], pieces.copy()))
            pieces.clear()

    def close(until: int) -> None:
        nonlocal out
        while len(open_) > until:
            name, block, left_out, _ = open_[-1]
            names[name] -= 1
            out -= left_out
            if block:
                end_block()
                paths.pop()
                places.pop()
            open_.pop()

    at, n = 0, len(page)
    while at < n:
        token = TOKEN.search(page, at)
        start = token.start() if token else n
        if start > at and not out:
            add(page[at:start])
        if token is None:
            break
        at = token.end()
        if token.group(2) is None:
            if not out and token.group().startswith("<![CDATA["):
                add(token.group()[9:].removesuffix("]]>"))
            continue
        tag = token.group(2).lower()
        if token.group(1):
            if names[tag]:
                place = len(open_) - 1
                while open_[place][0] != tag:
                    place -= 1
                close(place)
            continue
        block = tag not in INLINE
        if tag in VOID:
            if not out:
                add("\n")
                if tag == "hr":
                    end_block()
            continue
        if block:
            ended = ENDS.get(tag, frozenset()) | ({"p"} if tag not in RAW else frozenset())
            if any(names[name] for name in ended):
                for place in range(len(open_) - 1, -1, -1):
                    if open_[place][0] in ended:
                        close(place)
                        break
                    if open_[place][1]:
                        break
            end_block()
        in_article = any(names[name] for name in ARTICLE)
        attributes = _attributes(token.group(3)) if token.group(3) and not out else {}
        left_out = _out(tag, attributes, in_article, names["blockquote"] > 0)
        if out or left_out:
            place = open_[-1][3] if open_ else 0  # holds no text
        else:
            place = len(elements)
            parent = open_[-1][3] if open_ else 0
            above = elements[parent]
            marked = above.marked if above.marked >= 0 or tag not in ARTICLE else place
            link = place if tag == "a" else above.link
            elements.append(Element(parent, tag, marked, link, _named(tag, attributes)))
        open_.append((tag, block, left_out, place))
        names[tag] += 1
        out += left_out
        if block:
            paths.append(known.step(paths[-1], tag))
            places.append(place)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
    close(0)
    end_block()
    return known, elements, found


def _text(pieces: Iterable[tuple[int, str]]) -> str:
    return " ".join(unescape("".join(text for _, text in pieces)).split())


def _left_out(elements: list[Element], found: list[Block]) -> list[bool]:
    """For each element whether its name, or that of one around it, leaves it out.

    A name is evidence for parts that are small against the page. What holds most of its
    text and punctuation is not left out, be it one element or all those of a word together;
    unless the page marks an article elsewhere and the name says nothing else. A name that
    only holds a telling word ('social-impact') needs most of the text to be links as well.
    Readers' comments may outweigh the story: whatever their share, they are left out if a text
    of its own remains beside them.
    """
    if not any(element.named for element in elements):
        return [False] * len(elements)
    # Characters, punctuation, characters in links, and characters in marked articles.
    sums = [[0, 0, 0, 0] for _ in elements]
    for block in found:
        for place, text in block.pieces:
            n, own = len(" ".join(text.split())), sums[place]
            own[0] += n
            own[1] += len(PUNCTUATION.findall(text))
            own[2] += n * (elements[place].link >= 0)
            own[3] += n * (elements[place].marked >= 0)
    for place in range(len(elements) - 1, 0, -1):
        above = sums[elements[place].parent]
        for i, value in enumerate(sums[place]):
            above[i] += value
    page = sums[0]

    def weight(place: int) -> float:
        chars = sums[place][0] / max(page[0], 1)
        return (chars + sums[place][1] / page[1]) / 2 if page[1] else chars

    likely = [False] * len(elements)
    counted: list[frozenset[str]] = [frozenset()] * len(elements)
    together: dict[str, float] = defaultdict(float)
    for place, element in enumerate(elements):
        named, around = element.named, counted[element.parent]
        if named:
            small = weight(place) <= MOST
            elsewhere = named.sure and named.alone and page[3] > sums[place][3]
            if named.sure:
                likely[place] = small or elsewhere
            else:
                likely[place] = small and sums[place][2] >= LINKED * max(sums[place][0], 1)
            if likely[place] and not elsewhere:
                for word in named.words - around:
                    together[word] += weight(place)
                around |= named.words
        counted[place] = around
    left_out = [False] * len(elements)
    for place, element in enumerate(elements):
        if likely[place]:
            elsewhere = element.named.sure and element.named.alone and page[3] > sums[place][3]
            likely[place] = elsewhere or any(together[word] <= MOST for word in element.named.words)
        left_out[place] = likely[place] or place > 0 and left_out[element.parent]

    def comments(element: Element) -> bool:
        return element.named is not None and element.named.sure and bool(element.named.words & COMMENTS)

    # What remains beside what is left out and all comments.
    remains, outside = [page[0], page[1]], [False] * len(elements)
    for place, element in enumerate(elements):
        outside[place] = left_out[place] or comments(element)
        if place and outside[element.parent]:
            outside[place] = True
        elif outside[place]:
            remains = [remains[i] - sums[place][i] for i in (0, 1)]
    return outside if remains[0] >= REMAINS and remains[1] else left_out


def parts(page: str) -> tuple[Paths, list[Element], list[tuple[Block, str]]]:
    """The paths and elements, and the blocks that no name leaves out, with their texts."""
    paths, elements, found = read(page)
    left_out = _left_out(elements, found)
    kept = []
    for block in found:
        pieces = [piece for piece in block.pieces if not left_out[piece[0]]]
        text = _text(pieces)
        if text:
            kept.append((block._replace(pieces=pieces), text))
    return paths, elements, kept


def blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """The blocks of text in page order, each with its path of block-level tags."""
    paths, _, kept = parts(page)
    return [(paths.spelt(block.path), text) for block, text in kept]


def _link_lists(paths: Paths, elements: list[Element], kept: list[tuple[Block, str]]) -> list[bool]:
    """For each block whether it lies in a list, or is a run, of nothing much but links."""
    lists = [0] * len(elements)  # the innermost list around each element
    for place, element in enumerate(elements):
        lists[place] = place if element.tag in LISTS else lists[element.parent]
    chars: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    links: dict[int, set[int]] = defaultdict(set)
    groups = [lists[block.element] or block.element for block, _ in kept]
    for group, (block, _) in zip(groups, kept):
        for place, text in block.pieces:
            n = len("".join(text.split()))
            chars[group] += n
            if n and elements[place].link >= 0:
                linked[group] += n
                links[group].add(elements[place].link)
    return [
        len(links[group]) > 1
        and linked[group] >= ONLY_LINKS * chars[group]
        and paths.tags[block.path] not in HEADINGS
        for group, (block, _) in zip(groups, kept)
    ]


def _ratios(sums: dict[int, tuple[int, int]]) -> dict[int, float]:
    """For each path its characters and punctuation against the most of any, 1 at best."""
    longest = max(n for n, _ in sums.values())
    most = max(max(m for _, m in sums.values()), 1)
    ratio = {path: n / longest + m / most for path, (n, m) in sums.items()}
    best = max(ratio.values())
    return {path: own / best for path, own in ratio.items()}


def content(paths: Paths, elements: list[Element], kept: list[tuple[Block, str]]) -> list[str]:
    """The texts of the blocks that are content."""
    if not kept:
        return []
    length: Counter[int] = Counter()
    marks: Counter[int] = Counter()
    for block, text in kept:
        length[block.path] += len(text)
        marks[block.path] += len(PUNCTUATION.findall(text))
    sums = {path: (length[path], marks[path]) for path in length}
    ratio = _ratios(sums)
    # What a page marks as its article counts once more, by its part of all that is marked.
    marked = {path: own for path, own in sums.items() if paths.articles[path] >= 0}
    if marked:
        for path, own in _ratios(marked).items():
            ratio[path] += own
    # What belongs together shares its ratio: a heading with the paragraphs beside it, and
    # lists, quotes and tables with what holds the content; lists of links stand alone.
    around: dict[int, float] = defaultdict(float)
    beside = {path: {path, paths.above[path], paths.article(path)} for path in ratio}
    for path, own in ratio.items():
        for near in beside[path]:
            around[near] = max(around[near], own)
    shares = {path: max(around[near] for near in places) for path, places in beside.items()}
    inside = _inside(elements, kept, ratio)
    least = THRESHOLD * max(ratio.values())
    texts = []
    for (block, text), within, alone in zip(kept, inside, _link_lists(paths, elements, kept)):
        shared = SHARED * max(shares[block.path], within)
        if ratio[block.path] >= least or not alone and shared >= least:
            texts.append(text)
    return texts


def _inside(
    elements: list[Element], kept: list[tuple[Block, str]], ratio: dict[int, float]
) -> list[float]:
    """For each block the best ratio of what lies right in an element around it; between the
    first and the last block of the best path, also that of the element around these two.

    The body holds all there is and not only content, so of its parts only lists, quotes and
    the like have its ratio, not divisions.
    """
    holds = [0.0] * len(elements)
    for block, _ in kept:
        place = block.element
        holds[place] = max(holds[place], ratio[block.path])
        place = elements[place].parent
        while elements[place].tag in INLINE:
            place = elements[place].parent
        holds[place] = max(holds[place], ratio[block.path])
    shared = [0.0] * len(elements)
    for place, element in enumerate(elements):
        if element.tag in WHOLE:
            continue
        above = element.parent
        given = shared[above]
        if elements[above].tag in WHOLE and (element.tag in FLOW or element.tag in INLINE):
            given = holds[above]
        shared[place] = max(holds[place], given)
    best = max(ratio.values())
    won = [i for i, (block, _) in enumerate(kept) if ratio[block.path] == best]
    one, other = (kept[i][0].element for i in (won[0], won[-1]))
    while one != other:  # parents come first
        one, other = min(one, other), elements[max(one, other)].parent
    between = range(won[0], won[-1]) if elements[one].tag not in WHOLE else range(0)
    return [best if i in between else shared[block.element] for i, (block, _) in enumerate(kept)]


def extract(page: str | None) -> str:
    return " ".join(content(*parts(page or "")))


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` for each page."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[list]:
        for batch in batches:
            texts = [extract(page) for page in batch[html_col]]
            yield [batch[id_col], batch[url_col], texts, list(map(len, texts))]

    fields = ", ".join(f"`{name}` {type_of(pages, name)}" for name in (id_col, url_col))
    return map_rows(
        pages.select(id_col, url_col, html_col), f"{fields}, text string, n_chars long", work
    )
