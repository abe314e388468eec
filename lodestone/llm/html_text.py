"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Pass one decides each block by its own words:
link density, length and stop-word density, and by the element it stands in. Short or unclear
blocks stay open. Pass two gives an open block the label of its nearest decided neighbour,
first among the blocks of its own article, then of the page.

An article none of whose blocks has the share of stop words may be in another language than the
four: its long blocks are decided by length and link density alone. So are all long blocks of a
page without any block of that share, and its blocks of middle length stay open.

Furniture is an element of its own (nav, aside, form ...), a hidden one or one whose class or id
names it. A name alone does not damn what it encloses: a main element inside is no furniture, nor
is an article if the name is one of page parts (sidebar, nav ...) and no other article stands free
of names; and where no block of the page is found good, articles inside named elements are decided
anew, then blocks inside named page parts.

Defined cases: null or empty html gives an empty text; a page without any tag is one block per
page; unclosed comments, scripts and styles run to the end, other hidden elements without an end
hide nothing; a tag without an end is text; stray end tags are ignored; elements that HTML closes
by itself (p, li, cells, headings, links) are closed; the time is proportional to the page's length,
whatever its tags; white space includes the no-break space; line breaks inside a block are white space; repeated rows are extracted
each; texts of any length are kept whole; extra columns are ignored; a null url stays null.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow

# Common function words of the four languages.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i if in into is it its no not of on or she so
    than that the their them then there these they this to was we were what when which who will with would you your
    aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat
    ich ihr im ist kein man mit nach nicht noch nur oder sein sich sie sind so um und uns unter vom von vor war was
    wenn wie wir wird zu zum zur über
    au aux avec ce ces cette comme dans de du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par
    pas plus pour qu que qui sa sans se ses son sont sur un une vous à été être
    al como con cual cuando del el ella ellos era esta este esto ha hay las lo los mas más me mi muy ni nos o para pero
    por porque se ser si sin sobre su sus también te tiene todo una uno y ya""".split()
)
# Elements whose content is no text of the page; of the first kind it is raw text up to the end tag.
RAW = frozenset("script style textarea title iframe noscript".split())
HIDDEN = RAW | frozenset("template svg math object canvas audio video".split())
# Elements that hold a page's furniture.
FURNITURE = frozenset("nav footer aside form button select menu dialog".split())
# Elements that end a block where they start or end.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select
    summary table tbody td tfoot th thead tr ul""".split()
)
# Elements that end the open ones named with them when they start, up to the one that holds them all.
_CELLS, _HEADINGS = ("td", "th"), tuple(f"h{k}" for k in range(1, 7))
_ROWS = (*_CELLS, "tr")
CLOSES = (
    {"li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)), "tr": (_ROWS, ("table",))}
    | dict.fromkeys(_CELLS, (_CELLS, ("tr", "table")))
    | dict.fromkeys(("thead", "tbody", "tfoot"), ((*_ROWS, "thead", "tbody", "tfoot"), ("table",)))
    | dict.fromkeys(_HEADINGS, (_HEADINGS, ("div", "section", "article", "main", "header", "td")))
)
# Words of a class or id that mark parts of a page, which may be wrapped around its article.
PARTS = frozenset(
    """banner breadcrumb breadcrumbs footer masthead menu menus nav navbar navigation pager pagination sidebar sidebars
    skip toolbar widget widgets""".split()
)
# Names that mark parts of a page only if they stand alone.
ALONE = frozenset("header page-header site-header topbar rail".split())
# Words of a class or id that mark texts beside the article.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising advertorial comment comments commentlist consent cookie
    cookies disqus gdpr login modal newsletter newsletters notice notices popup popups promo promos promoted promotion
    promotions related replies respond share sharing signup social sponsor sponsored sponsors subscribe""".split()
)
ALONE_MARKS = frozenset("alert copyright disclaimer".split())
# Words that may stand beside those words in a name without changing what it marks.
NEUTRAL = frozenset(
    """and area article articles bar block blog body bottom box btn button buttons center col column container content desktop
    entry fixed fluid form friends global google icon icons inline inner item items js left link links list main mobile
    more my of on outer overlay page panel post posts primary region right row secondary section site slot small square
    sticky sub text the thread top unit us user view with wrap wrapper""".split()
)
# Names that only tell how a page is laid out.
LAYOUT = re.compile(r"^(?:(?:has|with|without)[_-]+.+|no[_-]+(?!comments|replies).+|(?:both|left|right|two)[_-]+sidebars?\b.*)$")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Deepest nesting that is followed, as browsers have it; deeper elements count as part of what holds them.
DEEPEST = 512
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_START = re.compile(r"<(?=[a-zA-Z!?/])")
# the parts of these patterns are possessive: each reads a page once
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'=<]*+)((?:\s++[\w:-]++(?:=(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'=<>`]++))?+)*+)\s*+/?>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)")
_END_OF_LINK, _LINK = re.compile(r"</a[\s/>]", re.I), re.compile(r"<a[\s/>]", re.I)
_PART = re.compile(r"[^\W_]+")
_WORD = re.compile(r"\w+")

GOOD, BAD, OPEN = 1, 0, None
# How an element is marked: not at all, by the name of a page part, by the name of a text beside the article, by what it is.
FREE, PART, BESIDE, SURE = 0, 1, 2, 3


@dataclass
class Rules:
    """Thresholds: characters of a short and of a long block, shares of stop words and of linked characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.20
    linked: float = 0.33


@dataclass
class Block:
    text: str
    linked: int
    region: int  # the article that holds it; 0: none
    mark: int  # the mark of what holds it, an article's surroundings apart
    around: int = FREE  # the mark of what its article stands in
    label: int | None = OPEN

    @property
    def furniture(self) -> bool:
        return self.mark > FREE


class Tags:
    """The tags of a page in one pass.

    An attribute's quotes count only behind its equals sign. What looks like a tag but has no end
    is text, and so are all later ones without a mark of greater; where quotes hide every such mark,
    tags end at the next one."""

    def __init__(self, page: str):
        self.page, self.loose, self.flat, self.open_ended = page, False, set(), set()

    def __iter__(self):
        """(start, end, name, closing, attributes) of each tag; comments and declarations have no name."""
        page, n, at = self.page, len(self.page), 0
        self.resume = None
        while m := _START.search(page, at):
            start = m.start()
            plain = _PLAIN.match(page, start)
            if plain:
                at = plain.end()
                yield start, at, plain[2].lower(), bool(plain[1]), plain[3]
            elif page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                at = n if end < 0 else end + 3
                yield start, at, "", False, ""
            elif page[start + 1] in "!?" or not (name := _NAME.match(page, start)):
                end = page.find(">", start)
                if end < 0:
                    return
                at = end + 1
                yield start, at, "", False, ""
            else:
                end = self._end(name.end())
                if end < 0:
                    return
                at = end
                yield start, at, name[1].lower(), page[start + 1] == "/", page[name.end() : at - 1]
            if self.resume is not None:
                at, self.resume = self.resume, None

    def _end(self, at: int) -> int:
        """Behind the end of the tag whose attributes start here; -1: none."""
        if not self.loose:
            k = at
            while m := _ATTRIBUTE.match(self.page, k):
                if m[1]:
                    return m.end()
                k = m.end()
            self.loose = True
        return self.page.find(">", at) + 1 or -1

    def skip(self, name: str, at: int) -> int:
        """Behind the end of the hidden element that starts here; at itself if it has none."""
        if name in self.open_ended:
            return at
        depth = 1
        if name in RAW or name in self.flat:
            if m := _closer(name).search(self.page, at):
                return m.end()
        else:
            for m in _either(name).finditer(self.page, at):
                depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
                if not depth:
                    return m.end()
            self.flat.add(name)  # from now on each ends at the next end tag
            if m := _closer(name).search(self.page, at):
                return at
        self.open_ended.add(name)
        return len(self.page) if name in ("script", "style", "textarea") else at


@lru_cache(maxsize=32)
def _closer(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)


@lru_cache(maxsize=32)
def _either(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])[^>]*+>", re.I)


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; of equal names the first counts."""
    out: dict[str, str] = {}
    at = 0
    while at < len(raw) and (m := _ATTRIBUTE.match(raw, at)):
        at = m.end()
        if m[2]:
            out.setdefault(m[2].lower(), html.unescape(m[3] or m[4] or m[5] or ""))
    return out


class Elements:
    """The open block elements. A start tag closes the paragraph, and what else cannot hold it, as browsers do."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, int]] = [("", FREE, 0, FREE)]  # element, mark, article, mark around the article
        self.count: dict[str, int] = {}
        self.beyond: dict[str, int] = {}  # open ones that lie too deep
        self.regions = 0

    def cut(self, k: int) -> None:
        for name, *_ in self.stack[k:]:
            self.count[name] -= 1
        del self.stack[k:]

    def start(self, name: str, raw: str) -> None:
        if self.stack[-1][0] == "p":
            self.cut(len(self.stack) - 1)
        names, holders = CLOSES.get(name, ((), ()))
        if any(self.count.get(x) for x in names):
            low = len(self.stack)
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in holders:
                    break
                if self.stack[k][0] in names:
                    low = k
                    if names is _HEADINGS:
                        break
            self.cut(low)
        if name in VOID or name in ("html", "body", "head"):
            return
        if len(self.stack) > DEEPEST:
            self.beyond[name] = self.beyond.get(name, 0) + 1
            return
        _, mark, region, around = self.stack[-1]
        own = SURE if name in FURNITURE or (name == "header" and not region) else _marked(raw)
        if name in ("article", "main") and not region:
            self.regions += 1
            region, own = self.regions, SURE if own == SURE else FREE
            if mark < SURE:
                mark, around = FREE, mark if name == "article" else FREE
        self.stack.append((name, max(mark, own), region, around))
        self.count[name] = self.count.get(name, 0) + 1

    def end(self, name: str) -> None:
        if self.beyond.get(name):
            self.beyond[name] -= 1
            return
        names = _HEADINGS if name in _HEADINGS else (name,)
        if not any(self.count.get(x) for x in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in names:
                self.cut(k)
                return
            if self.stack[k][0] in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", *_CELLS):
                return  # a cell is not left by the end of what lies around it


def blocks(page: str) -> list[Block]:
    """The visible blocks of a page in order.

    A link without an end tag of its own ends with its block; any link ends with the block
    element that it started in."""
    out: list[Block] = []
    parts: list[str] = []
    linked, at = 0, 0
    link = None  # elements around the open link; whether it goes on in further blocks
    next_end = next_link = -1
    tags, open_ = Tags(page), Elements()

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, mark, region, around = open_.stack[-1]
                out.append(Block(text, min(linked, len(text)), region, mark, around))
            parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                linked += len(text.strip())

    for start, end, name, closing, raw in tags:
        say(page[at:start])
        at = end
        if name in HIDDEN:
            if not closing and not (name not in RAW and raw.endswith("/")) and page[end - 2] != "/":
                at = tags.skip(name, at)
                tags.resume = at
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            link = None
            if not closing:
                if next_end < at:
                    m = _END_OF_LINK.search(page, at)
                    next_end = m.start() if m else len(page) + 1
                if next_link < at:
                    m = _LINK.search(page, at)
                    next_link = m.start() if m else len(page)
                link = len(open_.stack), next_end < next_link
        elif name in BLOCKS:
            flush()
            if closing:
                open_.end(name)
            else:
                open_.start(name, raw)
            if link and (not link[1] or len(open_.stack) < link[0]):
                link = None
    say(page[at:])
    flush()
    return out


def _marked(raw: str) -> int:
    """How attributes mark the element; hidden ones are surely not shown."""
    if not raw or raw.isspace():
        return FREE
    found = attributes(raw)
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(found.get("style", "")):
        return SURE
    return max((_named(name) for key in ("class", "id", "role") for name in found.get(key, "").lower().split()), default=FREE)


@lru_cache(maxsize=4096)
def _named(name: str) -> int:
    """What one whole name says: its words must all be furniture or neutral, and one of them furniture."""
    if LAYOUT.match(name):
        return FREE
    if name in ALONE_MARKS:
        return BESIDE
    if name in ALONE:
        return PART
    words = [w.rstrip("0123456789") for w in _PART.findall(name)]
    if any(w and w not in MARKS and w not in PARTS and w not in NEUTRAL for w in words):
        return FREE
    return BESIDE if any(w in MARKS for w in words) else PART if any(w in PARTS for w in words) else FREE


def decide(found: list[Block], rules: Rules) -> None:
    """Sets every label; where no block has the share of stop words, once more without that rule."""
    marks = [b.mark for b in found]
    if not _unhide(found, rules, False):
        for b, mark in zip(found, marks, strict=True):
            b.mark = mark
        _unhide(found, rules, True)


def _unhide(found: list[Block], rules: Rules, foreign: bool) -> bool:
    """Both passes, as often as names of furniture hide the whole text."""
    enclosed = [b for b in found if b.around]
    free = any(b.region and not b.around and not b.mark for b in found)
    held = [b for b in enclosed if free or b.around == BESIDE]
    for b in held:
        b.mark = max(b.mark, b.around)
    known = _passes(found, rules, foreign)
    if held and not any(b.label == GOOD for b in found):
        for b in held:
            b.mark = FREE if b.mark == b.around else b.mark
        known = _passes(found, rules, foreign)
    parts = [b for b in found if b.mark == PART]
    if parts and not any(b.label == GOOD for b in found):
        for b in parts:
            b.mark = FREE
        known = _passes(found, rules, foreign)
    return known


def _passes(found: list[Block], rules: Rules, foreign: bool) -> bool:
    """Sets every label; whether any block is good by its stop words. foreign: the page is decided without them."""
    known: set[int] = set()  # articles that have such a block
    few = []
    for b in found:
        words = _WORD.findall(b.text.lower())
        stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        size, b.label = len(b.text), OPEN
        if b.furniture or b.linked / size > rules.linked:
            b.label = BAD
        elif size < rules.short:
            b.label = OPEN
        elif stop >= rules.stop_high or (stop >= rules.stop_low and size >= rules.long):
            b.label = GOOD
            known.add(b.region)
        elif stop < rules.stop_low:
            few.append(b)
    for b in few:
        if foreign if not b.region else b.region not in known:
            b.label = GOOD if len(b.text) >= rules.long else OPEN
        elif not b.region:
            b.label = BAD
    first = [b.label for b in found]
    near = {}
    for back in (False, True):
        last: dict[int, int] = {}
        for i in range(len(found) - 1, -1, -1) if back else range(len(found)):
            near[i, back] = (last.get(found[i].region), last.get(-1))
            if first[i] is not OPEN:
                # furniture inside an article says nothing of the article's short blocks
                if not (found[i].furniture and found[i].region):
                    last[found[i].region] = i
                last[-1] = i
    for i, b in enumerate(found):
        if b.label is OPEN:
            own = [k for k in (near[i, False][0], near[i, True][0]) if k is not None]
            if b.region and not own:
                b.label = GOOD  # an article of short blocks only
                continue
            around = own if b.region else [k for k in (near[i, False][1], near[i, True][1]) if k is not None]
            # the nearest; of two as near, the good one
            b.label = first[min(around, key=lambda k: (abs(k - i), -first[k]))] if around else GOOD
    return bool(known)


def main_text(page: str, rules: Rules | None = None) -> str:
    found = blocks(page)
    decide(found, rules or Rules())
    return "\n".join(b.text for b in found if b.label == GOOD)


def extract(df: DataFrame, rules: Rules | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every row."""
    source = df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")))
    used = rules or Rules()

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield {"page_id": part.column(0), "url": part.column(1), "text": [main_text(h, used) for h in part.column(2).to_pylist()]}

    return map_arrow(source, run, "page_id long, url string, text string")
