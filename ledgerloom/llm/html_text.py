"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text. The first pass labels a block by its place,
its length, the share of stop words and the share of its characters that are
links: good, bad, or undecided where a short block gives too little to go by.
In the second pass an undecided block takes the label of the nearest decided
neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.bpe import chunks, slices

# Frequent function words of the languages that pages are in.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "aber als auch auf aus bei das dem den der des die durch ein eine einer es für ich im ist mit nicht noch oder sich sie sind um und von war wie wird zu "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous par pas plus pour que qui sa se ses son sont sur un une vous "
    "al como con cuando del el ella ellos era esta este fue hay las lo los más me muy no para pero por se sin su sus también todo y yo".split()
)
# Elements whose content is never text of the page, containers that
# frame it, and words in class, id or role that name such containers.
RAW = "script style textarea title".split()
SOFT = "svg select iframe object canvas audio video button noscript template".split()
FRAMES = frozenset("nav header footer aside form menu dialog fieldset".split())
BODIES = frozenset("article main".split())
BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr caption blockquote pre section article main nav header footer aside form fieldset "
    "figure figcaption address details summary hr body html menu dialog center".split()
)
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "dialog disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related remark remarks reply replies respond "
    "responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar tooltip widget".split()
)
# First and last words of a class or id that tell a state, such as has-sidebar or comments-open.
STATES_BEFORE = frozenset("has no not with without is show hide enable disable".split())
STATES_AFTER = frozenset("open closed enabled disabled allowed on off".split())
LISTS = frozenset("ul ol dl".split())
#: Frames that keep an article in them framed where they open after the end of another one.
LATER_FRAMES = frozenset("aside footer form dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<soft>""" + "|".join(SOFT) + r""")(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    r"""|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
NESTING = frozenset("svg object noscript template".split())
#: What ends an element that is never closed: its own end, another one of its kind, or a block.
NEXT = {
    name: re.compile(rf"</(?P<end>{name})\s*>|<(?P<again>{name})(?=[\s/>])|<(?P<block>{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
    for name in SOFT
}
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = 1, -1, 0
#: The share of links from which a list is a menu.
MENU_LINKS = 0.9


@dataclass
class Rules:
    """The thresholds of the two passes."""

    short_chars: int = 70
    long_chars: int = 200
    stop_share: float = 0.25
    link_share: float = 0.5


@dataclass
class Open:
    """An element that is not closed yet, and what held before it."""

    name: str
    framed: bool
    inside: int
    items: int
    hidden: bool
    later: bool


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    framed: bool = False
    inside: int = 0
    heading: bool = False
    items: int = 0
    text: str = ""


def past(page: str, name: str, at: int) -> int:
    """Where an element whose content is no text ends: at its end tag, or at the next block if it is never closed.

    Elements of one kind may lie in each other. An end tag counts only if it comes
    before a block other than div, or where the blocks in between are closed as well.
    """
    depth, block = 1, None
    for m in NEXT[name].finditer(page, at):
        if m["block"]:
            block = m.start() if block is None else block
            if name not in NESTING and m["block"].lower() != "div":
                break
        elif m["end"]:
            depth -= 1
            if not depth:
                return m.end()
        elif name in NESTING:
            depth += 1
        else:
            break
    return len(page) if block is None else block


def blocks(page: str) -> Iterator[Block]:
    """The page's blocks in order, with what encloses each of them."""
    stack: list[Open] = []
    framed, inside, bodies, links, lists, items, finished = False, 0, 0, 0, 0, 0, False
    block = Block()
    heading = False
    at = 0

    def said(raw: str) -> None:
        if raw:
            block.parts.append(raw)
            if links:
                block.linked += len("".join(raw.split()))

    def fresh() -> Block:
        return Block(framed=framed, inside=inside, heading=heading, items=items)

    last = page.rfind(">") + 1  # what follows holds no tag
    while m := TOKEN.search(page, at, last):
        said(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if m["soft"]:
            soft = m["soft"].lower()
            if not (soft == "svg" and m[0].endswith("/>")):
                at = past(page, soft, at)
            block.parts.append(" ")
            continue
        if not name:
            if m["raw"]:
                block.parts.append(" ")
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                yield block
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        finished = finished or inside > stack[k].inside == 0
                        framed, inside, items = stack[k].framed, stack[k].inside, stack[k].items
                        del stack[k:]
                        break
                heading = False
                links = 0
                block = fresh()
            continue
        if name == "a":
            links += not attrs.endswith("/")
        elif name in ("br", "td", "th", "img", "input"):
            block.parts.append(" ")
        elif name in BLOCKS:
            yield block
            links = 0
            if name not in VOID and name != "p":
                by_mark = marked(attrs)
                later = finished and not inside and (by_mark or name in LATER_FRAMES)
                stack.append(Open(name, framed, inside, items, hidden(attrs), later))
                if name in BODIES and not by_mark:
                    # an open menu or header that was never closed ends here
                    while any(s.name in FRAMES and not s.later for s in stack[:-1]):
                        k = max(i for i, s in enumerate(stack[:-1]) if s.name in FRAMES and not s.later)
                        framed = stack[k].framed
                        del stack[k]
                    # words that hint at a frame do not hold where they wrap a body, but they do within an article
                    # and where they follow one
                    if not any(s.name == "article" for s in stack[:-1]):
                        framed = any(s.hidden or s.later for s in stack[:-1])
                    bodies += 1
                    inside = bodies
                elif name in ("body", "html"):
                    framed = framed or stack[-1].hidden
                elif name in FRAMES or by_mark:
                    framed = True
                if name in LISTS and not items:
                    lists += 1
                    items = lists
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            block = fresh()
            if name == "p" and attrs and marked(attrs):
                block.framed = True
    said(page[at:])
    yield block


def hidden(attrs: str) -> bool:
    return bool(attrs and HIDDEN.search(attrs))


def names_frame(name: str) -> bool:
    """Whether one class, id or role names a frame, and not a state of what surrounds or follows it."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w]
    if not HINTS.intersection(words):
        return False
    return len(words) == 1 or not (words[0] in STATES_BEFORE or words[-1] in STATES_AFTER)


def marked(attrs: str) -> bool:
    """Whether class, id or role name a frame, or the element is hidden."""
    if not attrs:
        return False
    if hidden(attrs):
        return True
    return any(names_frame(name) for groups in MARKED.findall(attrs) for name in "".join(groups).split())


def without_stop_words(text: str) -> bool:
    """Whether most letters belong to scripts that the stop words do not cover."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


def least_chars(text: str, rules: Rules) -> int:
    """The length from which a text is not short; scripts without spaces say more in fewer characters."""
    dense = sum("\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7af" for c in text)
    return rules.short_chars // 2 if 2 * dense > len(text) else rules.short_chars


def first_label(b: Block, rules: Rules, list_links: dict[int, float]) -> int:
    if b.framed:
        return BAD
    size = len("".join(b.text.split()))
    linked = b.linked / size if size else 0.0
    if b.inside:
        # in a body only a list that is a menu as a whole goes; other links follow what stands around them
        if b.items and list_links[b.items] > MENU_LINKS:
            return BAD
        if linked > rules.link_share:
            return OPEN
        return GOOD if size >= least_chars(b.text, rules) or b.text[-1] in ".!?…:;\"”»。！？" else OPEN
    if linked > rules.link_share:
        return BAD
    if b.heading or size < least_chars(b.text, rules):
        return BAD if b.linked else OPEN
    if without_stop_words(b.text):
        return GOOD
    words = [w.lower() for w in WORD.findall(b.text)]
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if share >= rules.stop_share:
        return GOOD
    return OPEN if len(b.text) < rules.long_chars and share >= rules.stop_share / 2 else BAD


def first_pass(found: list[Block], rules: Rules) -> list[int]:
    """Labels by place, length, links and stop words.

    Where no block has enough stop words, the page is in a language they do not
    cover, and length and links alone decide.
    """
    totals: dict[int, list[int]] = {}
    for b in found:
        if b.items:
            held = totals.setdefault(b.items, [0, 0])
            held[0] += b.linked
            held[1] += len("".join(b.text.split()))
    links = {k: linked / size for k, (linked, size) in totals.items()}
    labels = [first_label(b, rules, links) for b in found]
    if GOOD not in labels:
        for i, b in enumerate(found):
            plain = not (b.framed or b.heading or b.linked > rules.link_share * len(b.text))
            if plain and len(b.text) >= rules.long_chars and b.text[-1] in ".!?…\"”»":
                labels[i] = GOOD
    return labels


def settle(found: list[Block], labels: list[int]) -> list[int]:
    """Undecided blocks take the label of the nearest decided neighbours.

    A block of an article looks at its own article only and is good where that
    has no decided block. A heading goes with what follows it. Elsewhere a block needs a good neighbour, and where
    the nearest two are equally far and differ, it is not part of the text.
    """
    n = len(labels)
    left: list[tuple[int, int]] = [(0, n + 1)] * n
    right: list[tuple[int, int]] = [(0, n + 1)] * n
    for order, side in ((range(n), left), (range(n - 1, -1, -1), right)):
        last: dict[int, tuple[int, int]] = {}
        for i in order:
            group = found[i].inside
            if group in last:
                side[i] = (last[group][0], abs(i - last[group][1]))
            if labels[i] != OPEN and not (group and found[i].framed):
                last[group] = (labels[i], i)
    out = list(labels)
    for i in range(n):
        if labels[i] == OPEN:
            (a, da), (b, db) = left[i], right[i]
            near = a if da < db else b if db < da else (a if a == b else OPEN)
            if found[i].heading and b != OPEN:
                near = b
            out[i] = near if near != OPEN else (GOOD if found[i].inside else BAD)
    return out


def main_text(page: str, rules: Rules | None = None) -> str:
    """The blocks of the page's main text, joined by line feeds."""
    rules = rules or Rules()
    found = []
    for b in blocks(page):
        if b.parts:
            b.text = " ".join(html.unescape("".join(b.parts)).split())
            if b.text:
                found.append(b)
    labels = settle(found, first_pass(found, rules))
    return "\n".join(b.text for b, good in zip(found, labels, strict=True) if good == GOOD)


def extract_pages(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    rules: Rules | None = None,
) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``, from the whole html.

    A null or empty page has an empty text. Null ids and urls stay null;
    repeated rows are extracted each; other columns are ignored; an empty table
    gives an empty result. Markup that is never closed frames what follows it,
    up to the next article; an element without text, such as a button, that is
    never closed ends at the next block, a head with the first element that
    belongs to the body.
    """

    def run(batches):
        for batch in slices(batches):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for part, texts in chunks(keys, batch.column(2).to_pylist()):
                found = [main_text(t, rules) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in part], pa.int64()),
                        pa.array([k[1] for k in part], pa.string()),
                        pa.array(found, pa.string()),
                        pa.array([len(t) for t in found], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        pages[id_column].cast("long").alias("page_id"), pages[url_column].alias("url"), pages[html_column].alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
