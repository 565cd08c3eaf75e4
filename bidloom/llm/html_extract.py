"""Main text of HTML pages by two passes over their blocks.

A page is cut at its block elements; scripts, styles, markup and the like are
not text. Pass one decides a block where it can, from where it stands and from
its stop-word density, length and link density: blocks in menus, headers,
footers, sidebars, notices, adverts, forms or reader comments and runs of link
blocks are out; long blocks rich in stop words are in. Blocks in between, short
ones above all, stay ambiguous. In pass two an ambiguous block takes the label of
its nearest decided neighbours; where they differ, or there is only one, the
side counts that lies in the same section, and a block inside the article that
has no decided neighbour in it is in.

Inside an `article` or `main` element the article is marked by the page itself,
so there a low stop-word density alone leaves a block ambiguous.

The lists of stop words are of four languages. Where less of the text of long blocks
has them than has not, the language is unknown or the text terse, and length and
link density alone decide a long block; so they do for a long block of a density in
between on a page without dense ones. Chinese, Japanese and Korean letters count
as three in a length.

A form, or an element named like something around the article, is a mere
container if `main` stands in it, or if it holds more than half of the article's
text (of the page's long blocks, where no article is marked) and is not named
as others' words, adverts or notices; then its name says nothing of what it holds.

Defined results: a null or empty page, and one without main text, gives an empty
text; text is decoded once, white space inside a block becomes one space and
blocks are joined by two line feeds; nothing is cut off, whatever the length.
Unclosed and stray tags are tolerated. Repeated rows give repeated results, null
ids and URLs are passed on, an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm.tables import table

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from have he in is it not of on or that the this to was were which with you "
    "als auch auf aus bei das dem den der des die ein eine einer es für hat ich im ist mit nicht sich sie sind und von war wie zu "
    "au aux avec ce cette dans de du elle en est et il la le les ne pas par pour que qui se son sur un une vous "
    "al como con del el ella era es esta ha las lo los más muy no o para pero por se sin su una y".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that stand in a section rather than make one.
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption hr legend summary td th tr".split())
#: Elements whose content is not text of the page.
HIDDEN = frozenset("applet audio canvas embed head iframe math noembed noframes noscript object script select style svg template textarea title video button datalist".split())
RAW = frozenset("script style textarea title noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Names of content that isn't the article however much of it there is; the other names may stand on a container.
OTHERS = frozenset(
    "ad ads adv advert advertisement advertising adverts adbox comment comments consent cookie cookies disclaimer disqus footer gdpr newsletter "
    "promo promoted promotion related reply replies respond sponsor sponsored".split()
)
#: A class word that begins so only says what the page around has.
ABOUT = ("has-", "has_", "no-", "no_", "with-", "with_", "without-", "is-", "js-")

LONG, SHORT = 140, 70
DENSE, SPARSE = 0.25, 0.12
LINKS = 0.5
LINK_RUN = 3
IN, OUT, UNSURE = 1, -1, 0

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CLASS_PART = re.compile("[a-z0-9]+")
_WIDE = re.compile("[\u1100-\u11ff\u2e80-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff\uff66-\uff9d\U0001aff0-\U0001b16f\U00020000-\U0003ffff]+")
WIDE_LETTER = 3


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    inside: bool
    section: int
    wrapper: int = -1
    label: int = UNSURE

    @property
    def length(self) -> int:
        """Characters, where those that write a syllable or a word count as several."""
        return len(self.text) if self.text.isascii() else len(self.text) + (WIDE_LETTER - 1) * sum(map(len, _WIDE.findall(self.text)))

    @property
    def density(self) -> float:
        words = self.text.split()
        return sum(w.lower().strip(".,;:!?()\"'#*$%&|<>") in STOP_WORDS for w in words) / len(words)

    @property
    def link_dense(self) -> bool:
        return self.linked > LINKS * len("".join(self.text.split()))


@dataclass
class Wrapper:
    """A form or an element with a name of something around the article."""

    parent: int
    others: bool
    main: bool = False
    held: int = 0
    outside: bool = True


#: What an element says of its content: nothing, that it is not the article, or the same unless it is a container (the last of others' content).
OPEN, CLOSED, WRAP, WRAP_OTHERS = range(4)


def _outside(name: str, attributes: str, inside: bool) -> int:
    """Whether an element begins something that is not the article, by its name, role, visibility or class."""
    if name in OUTSIDE - {"form"} or (name == "header" and not inside):
        return CLOSED
    form = WRAP if name == "form" else OPEN
    if not attributes or name in ("html", "body", "article", "main"):
        return form
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("role") in ROLES - {"form"} or re.search(r"display\s*:\s*none", found.get("style", "")):
        return CLOSED
    mark = WRAP if found.get("role") == "form" else form
    for word in f"{found.get('class', '')} {found.get('id', '')}".split():
        if not word.startswith(ABOUT):
            parts = set(_CLASS_PART.findall(word)) & NAMES
            parts -= {"header", "banner"} if inside else set()
            if parts:
                mark = max(mark, WRAP_OTHERS if parts & OTHERS else WRAP)
    return mark


def _open_containers(found: list[Block], wrappers: list[Wrapper]) -> None:
    """Settle which wrappers are containers, and so which blocks stand outside."""
    free = [b for b in found if not b.outside and not b.link_dense]
    text = [b for b in free if b.inside] or [b for b in free if b.length >= LONG]
    for b in text:
        if b.wrapper >= 0:
            wrappers[b.wrapper].held += b.length
    for w in reversed(wrappers):  # a wrapper comes after those around it
        if w.parent >= 0:
            wrappers[w.parent].held += w.held
            wrappers[w.parent].main |= w.main
    total = sum(b.length for b in text)
    for w in wrappers:
        container = w.main or not w.others and 2 * w.held > total
        w.outside = not container or w.parent >= 0 and wrappers[w.parent].outside
    for b in found:
        b.outside = b.outside or b.wrapper >= 0 and wrappers[b.wrapper].outside


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, with where they stand."""
    out: list[Block] = []
    wrappers: list[Wrapper] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open block or hidden elements: name, outside, inside an article, innermost wrapper
    standing: Counter[str] = Counter()  # names of the open elements, so a stray end tag is known without a search
    text: list[str] = []
    linked, links, breaks, section, at, hidden = 0, 0, 0, 0, 0, 0

    def push(name: str, *place) -> None:
        nonlocal hidden
        stack.append((name, *place))
        standing[name] += 1
        hidden += name in HIDDEN

    def cut(k: int) -> None:
        """Close all open elements from the k-th on."""
        nonlocal hidden
        for name, *_ in stack[k:]:
            standing[name] -= 1
            hidden -= name in HIDDEN
        del stack[k:]

    def end() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            _, outside, inside, wrapper = stack[-1] if stack else ("", False, False, -1)
            out.append(Block(joined, linked, outside, inside, section, wrapper))
        text.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked, breaks
        if hidden or not piece:
            return
        if not piece.isspace():
            breaks = 0
        piece = entities.unescape(piece) if "&" in piece else piece
        text.append(piece)
        if links:
            linked += len("".join(piece.split()))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            break
        say(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), (m[3] or m[6] or "")
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS or name in HIDDEN:
                if name in BLOCKS:
                    end()
                if standing[name]:
                    cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
                links, section = (0, section + 1) if name in BLOCKS and name not in LEAVES else (links, section)
            continue
        if name == "br":
            breaks += 1
            end() if breaks > 1 else say(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name in RAW:
            closed = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            at = page.find(">", closed.start()) + 1 if closed else len(page)
            at = at or len(page)
            continue
        if name == "a":
            links += 1
        elif name in HIDDEN and not attributes.endswith("/"):
            push(name, *(stack[-1][1:] if stack else (False, False, -1)))
        elif name in BLOCKS:
            end()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end the one before them
                if stack and stack[-1][0] == name:
                    cut(len(stack) - 1)
            elif stack and stack[-1][0] == "p":
                cut(len(stack) - 1)
            if name == "body":  # ends an unclosed head
                cut(0)
            if name != "hr":
                outside, inside, wrapper = stack[-1][1:] if stack else (False, False, -1)
                if name == "main" and wrapper >= 0 and not outside and not hidden and not inside:
                    wrappers[wrapper].main = True
                inside = inside or name in ("article", "main")
                mark = _outside(name, attributes, inside)
                if mark in (WRAP, WRAP_OTHERS):
                    wrappers.append(Wrapper(wrapper, mark == WRAP_OTHERS))
                    wrapper = len(wrappers) - 1
                push(name, outside or mark == CLOSED, inside, wrapper)
            if name not in LEAVES:
                section += 1
    say(page[at:])
    end()
    _open_containers(out, wrappers)
    return out


def first_pass(found: list[Block]) -> None:
    # For every block of links, how many stand in a row around it.
    run: list[int] = []
    for dense, some in groupby(found, key=lambda b: b.link_dense):
        n = sum(1 for _ in some)
        run += [n if dense else 0] * n
    unmarked: list[tuple[Block, float]] = []
    for b, in_a_row in zip(found, run):
        if b.outside:
            b.label = OUT
            continue
        if in_a_row:
            b.label = OUT if not b.inside or in_a_row >= LINK_RUN else UNSURE
            continue
        density, long = b.density, b.length >= LONG
        if long and density >= DENSE or b.inside and b.length >= SHORT and density >= SPARSE:
            b.label = IN
        if long and not b.inside:
            unmarked.append((b, density))
    sparse = sum(b.length for b, density in unmarked if density < SPARSE)
    known = 2 * sparse <= sum(b.length for b, _ in unmarked) or any(b.inside and b.label == IN for b in found)
    dense = any(b.label == IN for b in found)
    for b, density in unmarked:
        if density < SPARSE:
            b.label = OUT if known else IN
        elif not known or not dense:
            b.label = IN


def second_pass(found: list[Block]) -> None:
    decided = [b.label for b in found]
    left, near = [], None
    for k, b in enumerate(found):
        left.append(near)
        if decided[k]:
            near = k
    near = None
    for k in range(len(found) - 1, -1, -1):
        b = found[k]
        if decided[k]:
            near = k
            continue
        sides = [s for s in (left[k], near) if s is not None]
        if b.inside:
            # What stands outside the article says nothing of a block in it.
            same = [decided[s] for s in sides if found[s].inside and not found[s].outside]
            b.label = IN if not same or IN in same else OUT
        elif sides:
            labels = {decided[s] for s in sides}
            nearest = min(sides, key=lambda s: (found[s].section != b.section, abs(s - k)))
            b.label = labels.pop() if len(labels) == 1 and len(sides) == 2 else decided[nearest] if found[nearest].section == b.section or len(sides) == 1 else OUT
        else:
            b.label = OUT


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    first_pass(found)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == IN)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(texts, pa.string())], ["page", "text"])


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """`page` (the kept columns) and its main `text`."""
    rows = pages.select(F.struct(*keep).alias("page"), F.col(html).alias("html"))
    return rows.mapInArrow(_extract, rows.select("page").schema.add("text", T.StringType()))


def op1_html_extract(spark, sf_dir):
    out = extracted(table(spark, sf_dir, "pages"))
    return out.select("page.page_id", "page.url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op1_html_extract": op1_html_extract}
