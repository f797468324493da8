"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block elements; scripts, styles, titles, comments and markup never become text, and
character references are decoded.  Blocks in containers that name themselves menus, headers, footers, sidebars, notices,
adverts, forms or reader comments are boilerplate.

A name is one class, identifier or role as a whole: ``sidebar`` or ``left-sidebar`` names a sidebar, ``has-sidebar`` does not.  What
only a name or a form says is taken back for an article or main element inside that holds most words of the page, and a
form round the whole page says nothing.

First pass, by length, link density and stop-word density: a block is good, bad or undecided.  A page that marks its
article (or else its main part) has good blocks only there, and there only a block of links is bad; elsewhere a block needs
stop words too.  An article with fewer words than the good blocks outside it, such as a teaser, does not rule the page.  Second pass: undecided blocks take the label of the nearest decided block in the same part; between
a good and a bad one at the same distance an article is good and the rest bad; where nothing is decided all is good.

Null and empty pages have no text.  Unclosed and unmatched tags are allowed; a tag that never ends is text.  Repeated rows, ties and null
identifiers stay as they are.  The operator is a column expression over the html, so further columns cannot clash.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm._common import table

SHORT, LONG = 70, 200
LINKS, ARTICLE_LINKS = 0.2, 0.95
MANY_STOPS = 0.3

#: Frequent function words of four languages.
STOP_WORDS = frozenset((
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei bis das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht sich sie sind und von war wie wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en es esta este la las lo los más no para pero por que se si sin sobre su sus un una y ya").split())
PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>~`^_-–—…«»„“”‚‘’/\\"

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes", "math", "object", "canvas")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul").split())
#: Elements that end when one of the same family opens, and the containers where that search stops.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol menu dl table body article section div main aside nav select".split())
BOILERPLATE = frozenset("nav footer aside form button select menu dialog option".split())
#: Parts of class names, identifiers and roles that name boilerplate.
NAMED = frozenset((
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup signin login search sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu menubar nav navbar navigation "
    "footer toolbar comment comments commentlist disqus replies respond pagination pager copyright contentinfo complementary skip").split())
#: Parts that may stand beside them in a name; any other part says that the element is something else.
QUALIFIERS = frozenset((
    "site page main top bottom left right box slot bar block container wrapper wrap area section list item items inner outer primary secondary global local sub mini "
    "sticky fixed mobile desktop header head title body content col column row unit zone inline post posts article articles stories entries news user the and my js id x button buttons link links icon icons text form").split()) | {""}
#: Names of what readers write, which no article inside takes back.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
#: Those that are part of an article when they stand inside one.
HEADERS = frozenset({"header", "masthead", "topbar"})
MAIN_ROLES = frozenset({"main", "article"})


@dataclass
class Part:
    """An open element: what the text below it belongs to.

    ``soft`` are the elements above that only a name or a form calls boilerplate, ``marks`` the article and main elements.
    """
    name: str
    boilerplate: bool = False
    link: bool = False
    article: bool = False
    main: bool = False
    soft: tuple[int, ...] = ()
    marks: tuple[int, ...] = ()


@dataclass
class Block:
    text: str = ""
    links: int = 0
    boilerplate: bool = False
    article: bool = False
    main: bool = False
    soft: tuple[int, ...] = ()
    marks: tuple[int, ...] = ()
    pieces: list[str] = field(default_factory=list)


def parts_of(name: str) -> set[str]:
    return {p.lower() for p in NAME_PARTS.findall(name)} if re.fullmatch("[a-zA-Z]+", name) else set(re.split(r"[^a-z]+", re.sub("([a-z])([A-Z])", r"\1-\2", name).lower()))


def named(attributes: str) -> tuple[set[str], bool, set[str]]:
    """Words that name the element by its class, id and role; whether it is hidden; its roles."""
    words: set[str] = set()
    roles: set[str] = set()
    hidden = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = parts_of(one)
                known = parts & (NAMED | HEADERS)
                if known and parts - known <= QUALIFIERS and not (known <= HEADERS and parts - known - {"site", "page", "main", "top", "global", "post", "article", ""}):
                    words |= known
            if name == "role":
                roles.add(value.lower())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return words, hidden, roles


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; boilerplate ones as empty marks."""
    stack, blocks, at = [Part("")], [], 0
    current = Block()
    above: dict[int, tuple[int, ...]] = {}  # of each article or main element, the soft ones above it
    forms: set[int] = set()
    opened = 0

    def flush() -> None:
        nonlocal current
        current.text = " ".join(references.unescape("".join(current.pieces)).split())
        if current.text or current.boilerplate:
            current.boilerplate = current.boilerplate and not current.text
            blocks.append(current)
        current = Block()

    def add(raw: str) -> None:
        if not raw:
            return
        top = stack[-1]
        if top.boilerplate:
            current.boilerplate = current.boilerplate or not raw.isspace()
            return
        if not raw.isspace():
            current.article, current.main, current.soft, current.marks = top.article, top.main, top.soft, top.marks
            if top.link:
                current.links += len(raw.strip())
        current.pieces.append(raw)

    def close(place: int) -> None:
        if any(p.name in BLOCK for p in stack[place:]):
            flush()
        del stack[place:]

    pos = 0
    while True:
        tag = TAG.search(page, pos)
        if tag is None:
            break
        add(page[at:tag.start()])
        pos = at = tag.end()
        ending, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if ending:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), None)
            if place is not None:
                close(place)
            elif name in BLOCK:
                flush()
            continue
        if name in RAW and not attributes.endswith("/"):
            end = RAW[name].search(page, pos)
            pos = at = end.end() if end else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK:
            # A block element ends an open paragraph, and some elements end their like.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p" or stack[i].name in SAME.get(name, ()):
                    close(i)
                if i < len(stack) and stack[i].name in STOPS:
                    break
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        top = stack[-1]
        words, hidden, roles = named(attributes) if attributes else (set(), False, set())
        article = name == "article" or "article" in roles
        main = name == "main" or bool(roles & MAIN_ROLES)
        heading = name == "header" or bool(words & HEADERS)
        opened += 1
        own = bool(words & NAMED) and name not in ("body", "html", "article", "main")
        hard = (name in BOILERPLATE and name != "form") or hidden or bool(words & READERS) or own and name not in BLOCK or heading and not (top.article or article)
        soft = top.soft + (opened,) if (own or name == "form") and not hard else top.soft
        if name == "form":
            forms.add(opened)
        marks = top.marks
        if article or main:
            marks = marks + (opened,)
            above[opened] = soft
        stack.append(Part(name, top.boilerplate or hard, top.link or name == "a", top.article or article, top.main or main, soft, marks))
    add(page[at:])
    flush()
    settle(blocks, above, forms)
    return blocks


def settle(blocks: list[Block], above: dict[int, tuple[int, ...]], forms: set[int]) -> None:
    """Blocks below a name or a form become boilerplate, unless an article that holds most words takes it back."""
    words = [len(b.text.split()) for b in blocks]
    cleared: set[int] = set()
    for mark, soft in above.items():
        if soft and 2 * sum(n for n, b in zip(words, blocks) if mark in b.marks) > sum(words):
            cleared.update(soft)
    if not any(n and set(b.soft) <= cleared for n, b in zip(words, blocks)):
        cleared |= forms
    for b in blocks:
        if not set(b.soft) <= cleared:
            b.boilerplate, b.text = True, ""


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(PUNCTUATION) in STOP_WORDS for w in words) / len(words) if words else 0.0


def by_density(b: Block) -> bool | None:
    """Good, bad or undecided, by length, links and stop words alone."""
    n = len(b.text)
    density = min(1.0, b.links / n) if n else 0.0
    if b.boilerplate or not n or density > LINKS or "©" in b.text:
        return False
    if n < SHORT:
        return False if density else None
    return True if n >= LONG and stop_density(b.text) >= MANY_STOPS else None


def ruling(blocks: list[Block], labels: list[bool | None]) -> str | None:
    """Whether the article or the main part rules the page: it has no fewer words than the good blocks outside it."""
    for mark in ("article", "main"):
        inside = [len(b.text.split()) for b in blocks if getattr(b, mark)]
        outside = [len(b.text.split()) for b, good in zip(blocks, labels) if good and not getattr(b, mark)]
        if sum(inside) and sum(inside) >= sum(outside):
            return mark
    return None


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """Good, bad or undecided."""
    plain = [by_density(b) for b in blocks]
    marked = ruling(blocks, plain)
    if marked is None:
        return plain
    labels: list[bool | None] = []
    for b in blocks:
        n = len(b.text)
        density = min(1.0, b.links / n) if n else 0.0
        if b.boilerplate or not n or not getattr(b, marked):
            labels.append(False)
        else:
            linked = density > ARTICLE_LINKS and n < LONG
            labels.append(False if linked else True if n >= SHORT or n >= SHORT // 2 and stop_density(b.text) >= MANY_STOPS else None)
    return labels


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks inherit from the nearest decided ones of the same part."""
    part = [(b.article, b.main) for b in blocks]
    before: list[tuple[int, bool] | None] = []
    last: dict[tuple, tuple[int, bool]] = {}
    for i, label in enumerate(labels):
        before.append(last.get(part[i]))
        if label is not None and not blocks[i].boilerplate:
            last[part[i]] = (i, label)
    out, following = list(labels), {}
    for i in range(len(labels) - 1, -1, -1):
        if labels[i] is None:
            near = [(abs(i - x[0]), x[1]) for x in (before[i], following.get(part[i])) if x]
            closest = {label for distance, label in near if distance == min(near)[0]}
            out[i] = closest.pop() if len(closest) == 1 else not closest or part[i] != (False, False)
        elif not blocks[i].boilerplate:
            following[part[i]] = (i, labels[i])
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page, joined by empty lines."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, good in zip(blocks, second_pass(blocks, first_pass(blocks))) if good and b.text)


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return work(page)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page and its length."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extracted(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op6_html_text": op6_html_text}
SQL = {}
