"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  Blocks in menus, footers,
forms and the like, by element or by class, are never text.  The first pass
classifies each other block by the share of its characters in links, its length
and its density of stop words; blocks too short, or too much alike to both
kinds, stay open.  In the second pass an open block inherits the label of its
nearest decided neighbours: where both agree, theirs; where they differ, the
label of the nearer one; at equal distance, headings and paragraphs are text.
The same rules hold inside and outside a marked article; where a page marks its
article, what stands around that does not take part.

A class or id counts as a mark only as a whole: every word of it must be a mark
or a word of layout, so ``site-footer`` is one and ``form-factor`` is not.  Inside
an article, words that articles themselves may use for a section (``legal``,
``search``) count only together with links or a lack of stop words.

Cases: a null, empty or unclosed page gives what text there is, else an empty
text.  Text in scripts, styles, comments, page titles and attributes never
counts.  Unclosed and misnested tags are taken as browsers take them: a block
ends where the next begins.  Time is linear in the page's length, however deep
its tags.  Repeated rows are treated row by row; ids of any size and null ids
pass through as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for was on are as with he be by at from this or an not have his they which you but had were her all she there would their we him been has when who will more no if out so what up said its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei
    de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont aux avec son ou cette ont ses mais comme on tout nous sa fait été aussi leur bien peut ces y deux ils même être
    el los se del las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde
    """.split()
)
#: Elements whose text never shows, those that are never main text, and those that begin a block.
HIDDEN = frozenset("script style noscript template head title svg iframe object canvas textarea select option button audio video map".split())
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption title".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
#: Elements of which an open one ends where the next of its kind begins.
ENDING = frozenset("p li dt dd tr td th".split())
#: Words in class, id and role that mark what stands around the main text, those of them that sections
#: of an article may carry too, those that mark reader comments, and words of layout that may stand beside a mark.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adblock banner sponsor sponsored promo promotion promoted nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr "
    "notice notices popup comment comments disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription login pagination pager widget complementary contentinfo paywall".split()
)
SOFT = frozenset("menu side foot toolbar alert modal overlay discussion signup search tags form feedback legal copyright header".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
LAYOUT = frozenset("site main page top bottom left right primary secondary global list area box bar block container wrapper section inner outer links link item items body content text post posts article articles entry blog story stories buttons button form title wrap row col slot unit panel module holder group card region zone strip message label icon icons menu bottom head heading desktop mobile wide fixed sticky small large the a and of".split())
#: Words that make a ``header`` the site's and not an article's.
OF_SITE = frozenset("site main top global bar wrapper container inner header".split())
#: Pass 1: shares of a block's characters in links, stop-word shares, lengths.
LINKS, FEW_LINKS, STOPS_LOW, STOPS_HIGH, SHORT, LONG = 0.4, 0.2, 0.10, 0.18, 70, 180

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"[\s\xa0]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}


@dataclass(slots=True, frozen=True, eq=False)
class _Mark:
    """A marked element and the one around it."""

    outer: _Mark | None
    soft: bool


@dataclass(slots=True, frozen=True, eq=False)
class _Article:
    """An article (or main) and the mark that was open where it begins."""

    at: int
    mark: _Mark | None


@dataclass(slots=True, frozen=True)
class _State:
    """What holds for text in an element."""

    hidden: bool = False
    aside: bool = False
    mark: _Mark | None = None
    article: _Article | None = None


@dataclass(slots=True)
class _Element:
    name: str
    state: _State
    live: bool = True


@dataclass(slots=True)
class _Block:
    text: str
    tag: str  # the innermost block element around it
    linked: int  # characters in links
    links: int
    state: _State

    @property
    def paragraph(self) -> bool:
        return self.tag == "p" or self.tag in HEADINGS


def marked(attributes: str) -> frozenset[str]:
    """The words by which an element's class, id, role or label marks it as a whole."""
    found: set[str] = set()
    for name, *values in _ATTR.findall(attributes):
        value = _CAMEL.sub("-", next(filter(None, values), ""))
        # a label is one name, a class attribute holds several
        for token in [value] if name.lower() == "aria-label" else value.split():
            words = _PART.findall(token.lower())
            own = {w for w in words if w in MARKS or w in SOFT}
            if own and all(w in own or w in LAYOUT for w in words):
                if own == {"header"} and not OF_SITE.issuperset(words):
                    continue
                found |= own
    return frozenset(found)


def _inside(name: str, attributes: str, at: int, outer: _State) -> _State:
    """What holds inside an element."""
    article = outer.article
    hidden, aside, mark = outer.hidden or name in HIDDEN, outer.aside, outer.mark
    aside = aside or name in ASIDE or name == "header" and article is None
    if attributes and name not in ("body", "html", "main") and (words := marked(attributes)):
        if words & COMMENTS:
            aside = True
        elif name != "article" and not (article and words == {"header"}):
            mark = _Mark(mark, words <= SOFT)
    if name in ("article", "main"):
        article = _Article(at, mark)
    if (hidden, aside) == (outer.hidden, outer.aside) and mark is outer.mark and article is outer.article:
        return outer
    return _State(hidden, aside, mark, article)


class _Open:
    """The open elements; each is pushed and popped once."""

    def __init__(self):
        self.stack: list[_Element] = []
        self.by_name: dict[str, list[_Element]] = {}
        self.blocks: list[_Element] = []

    @property
    def state(self) -> _State:
        return self.stack[-1].state if self.stack else _State()

    @property
    def block(self) -> str:
        return self.blocks[-1].name if self.blocks else ""

    def count(self, name: str) -> int:
        return len(self.by_name.get(name, ()))

    def push(self, name: str, state: _State) -> None:
        e = _Element(name, state)
        self.stack.append(e)
        self.by_name.setdefault(name, []).append(e)
        if name in BLOCKS:
            self.blocks.append(e)

    def _drop(self, e: _Element) -> None:
        e.live = False
        own = self.by_name[e.name]
        if own[-1] is e:
            own.pop()
        if self.blocks and self.blocks[-1] is e:
            self.blocks.pop()
        while self.stack and not self.stack[-1].live:
            self.stack.pop()

    def close(self, name: str) -> None:
        """End the innermost element of a name: a block or hidden one with all in it, others alone."""
        own = self.by_name.get(name)
        if not own:
            return
        e = own[-1]
        if name in BLOCKS or name in HIDDEN:
            while self.stack and self.stack[-1] is not e:
                self._drop(self.stack[-1])
        self._drop(e)

    def end_kind(self, name: str) -> None:
        if self.blocks and self.blocks[-1].name == name:
            self._drop(self.blocks[-1])


def blocks(page: str) -> list[_Block]:
    """The blocks of a page in order, with their text in one line."""
    out: list[_Block] = []
    open_ = _Open()
    parts: list[str] = []
    linked = links = 0
    headings = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked, links
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                tag = next((h for h in HEADINGS if open_.count(h)), open_.block) if headings else open_.block
                out.append(_Block(text, tag, linked, links, open_.state))
            parts.clear()
        linked = links = 0

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        cdata, closing, name, attributes, text = m.groups()
        if text is not None or cdata is not None:
            text = text if text is not None else cdata
            if not open_.state.hidden:
                parts.append(text)
                if open_.count("a"):
                    linked += len(text.strip())
            continue
        if name is None:
            continue
        name = name.lower()
        if not closing:
            if name == "br":
                parts.append(" ")
                continue
            if name in BLOCKS:
                close()
            if name in VOID:
                continue
            if name in ENDING:
                open_.end_kind(name)
            if name == "a":
                open_.close("a")  # links do not nest
                links += 1
            open_.push(name, _inside(name, attributes, m.start(), open_.state))
            headings += name in HEADINGS
            if name in _RAW:  # only its own end tag ends it
                stop = _RAW[name].search(page, at)
                at = stop.start() if stop else end
        else:
            if name in BLOCKS or name in HIDDEN:
                close()
            open_.close(name)
    close()
    return out


def first_pass(b: _Block, doubtful: bool = False) -> bool | None:
    """True for text, False for what stands around it, None where the block leaves it open.

    doubtful: it stands in a section whose name may be that of a menu or notice.
    """
    n = len(b.text)
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    in_links = b.linked / n
    if doubtful and (in_links > FEW_LINKS or stops < STOPS_LOW):
        return False
    if in_links > LINKS:
        # a paragraph that is one link may belong to the text; several links, or a list of them, do not
        return None if b.tag == "p" and b.links <= 1 else False
    if n < SHORT or b.tag in HEADINGS:
        return None
    if b.text[0] == "©" and b.state.article is None and n < LONG:
        return False
    if stops >= STOPS_HIGH or n >= LONG and (stops >= STOPS_LOW or in_links <= FEW_LINKS):
        return True
    return None


def second_pass(labels: list[bool | None], lenient: list[bool], edge: bool | None) -> list[bool]:
    """Open blocks take the label of the nearest decided ones.

    lenient: blocks that are text where a good and a bad one are equally near, or
    where none is decided, and for which the page's edges say nothing.  edge: the
    label that stands before the first and after the last block for the others,
    None for none.
    """
    n = len(labels)
    left: list[tuple[int, bool] | None] = []
    last = None
    for k, label in enumerate(labels):
        left.append(last)
        if label is not None:
            last = k, label
    final = [False] * n
    right = None
    for k in range(n - 1, -1, -1):
        if labels[k] is not None:
            final[k] = labels[k]
            right = k, labels[k]
            continue
        a, b = left[k], right
        if edge is not None and not lenient[k]:
            a, b = a or (-1, edge), b or (n, edge)
        if a is None or b is None:
            near = a or b
            final[k] = near[1] if near else lenient[k]
        elif a[1] == b[1]:
            final[k] = a[1]
        elif k - a[0] == b[0] - k:
            final[k] = lenient[k]
        else:
            final[k] = a[1] if k - a[0] < b[0] - k else b[1]
    return final


def _around_article(found: list[_Block]) -> set[_Mark]:
    """The marked elements around the article (or main) that has the longest text besides what is marked in it."""
    sizes: dict[_Article, int] = {}
    for b in found:
        a = b.state.article
        if a is not None and b.state.mark is a.mark:
            sizes[a] = sizes.get(a, 0) + len(b.text)
    free: set[_Mark] = set()
    if sizes:
        mark = max(sizes, key=lambda a: (sizes[a], -a.at)).mark
        while mark is not None:
            free.add(mark)
            mark = mark.outer
    return free


def main_text(page: str | None) -> str:
    """The main text of a page: its good blocks, joined by line ends."""
    found = [b for b in blocks(page) if not b.state.aside] if page else []
    free = _around_article(found)
    within = any(b.state.article and (b.state.mark is None or b.state.mark in free) for b in found)
    if within:
        found = [b for b in found if b.state.article]
    # what is marked is out; in an article, a word that may name a section needs links or a lack of stop words beside it
    found = [b for b in found if b.state.mark is None or b.state.mark in free or within and b.state.mark.soft]
    final = second_pass([first_pass(b, b.state.mark is not None and b.state.mark not in free) for b in found], [b.paragraph or within for b in found], False)
    return "\n".join(b.text for b, good in zip(found, final) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points of the text) of every row."""

    def texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(texts, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
