"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides every block by what it holds: one that is mostly links is
boilerplate, a long one dense in stop words (or very long without links) is text, anything short or else is open. Structure is
one more feature: blocks in menus, footers, forms and the like, by tag or by words of their class and id, are boilerplate (with
words that may mean either, only if they are not plainly text), and an article element that holds most of the text found keeps
what lies outside it from being text. In the second pass an open block takes the label of its nearest decided neighbours on its
side of the article: both alike, or else the nearer one's, the one before on a tie; a heading is text if a block below it
is, up to the next heading of its rank. Where nothing is decided, open blocks are text, except beside an article.

A null or empty page, or one without main text, gives an empty text. Comments, scripts, styles and markup never do. Pages of
any length are read whole, in time that grows with their length; unclosed tags end with what contains them (a script or style
with the page, a head with the first element of the body); repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most frequent function words of the languages served.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i if in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur lui mais ne nous ou par pas pour qu que qui sa se ses son sur un une "
    "als am auch auf aus bei das dem den der die ein eine einem einen einer er es für hat im ist mit nach nicht noch oder sich sie sind so um und von war wie wird zu zum "
    "al como con del el ella era esta este ha lo los las más me mi muy no nos o para pero por sin sobre su sus también te un una y ya".split()
)
LINK_DENSITY = 0.4
LONG = 70
DENSE = 0.2

#: Elements that end a block; all others lie inside one.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button".split()
)
#: Elements whose content is never text; of these, those whose content is no markup either.
SILENT = frozenset("script style noscript template textarea select svg iframe object canvas audio video head title annotation annotation-xml datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
IN_HEAD = frozenset("title meta link base script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Elements that the next of their kind ends.
SIBLINGS = frozenset("li dt dd tr td th option".split())
#: Parts of class and id that mark what is not the article; those of the second kind may mean other things.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer menu nav navbar navigation newsletter notice notices "
    "pager pagination promoted replies reply respond sidebar side sponsor sponsored subscribe subscription".split()
)
WEAK = frozenset("banner masthead modal popup promo related share sharing social toolbar widget widgets".split())
#: Parts that say nothing themselves, so that "related-posts" is like "related" but "related-work" is not.
NEUTRAL = frozenset(
    "area articles bar block body bottom box btn button buttons col column container content footer form global group header icons inner item items left link links list main module news outer page panel "
    "post posts primary right row secondary section site slot stories text thread top unit wrap wrapper zone".split()
)
ARTICLE_NAMES = frozenset("main main-content article article-body article-content post-content entry-content".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
#: After so many tags with an open quote, quotes are no longer heeded.
LOOSE_AFTER = 8

GOOD, BAD, OPEN = 1, 0, -1


class Block:
    """ruled: 2 where structure rules the block out, 1 where it may; inside: of an article element; heading: its rank or 0."""

    __slots__ = ("text", "linked", "ruled", "inside", "heading")

    def __init__(self, text: str, linked: int, ruled: int, inside: bool, heading: int):
        self.text, self.linked, self.ruled, self.inside, self.heading = text, linked, ruled, inside, heading


def hints(marks: str) -> int:
    """What the words of class, id and role say: 2 not the article, 1 perhaps not, 0 nothing."""
    found = 0
    for word in marks.split():
        parts = [x.lower() for x in PARTS.findall(word) if not x.isdigit()]
        parts = [p for p in parts if p not in NEUTRAL] or parts[:1]
        if parts and all(p in STRONG or p in WEAK for p in parts):
            found = max(found, 2 if any(p in STRONG for p in parts) else 1)
    return found


class Marks:
    """What the attributes of a tag say; tags repeat, so answers are kept."""

    def __init__(self):
        self.known: dict[tuple[str, str], tuple[int, bool]] = {}

    def of(self, tag: str, attributes: str, inside: bool) -> tuple[int, bool]:
        """How far the element is ruled out (0, 1 or 2), and whether it opens an article."""
        got = self.known.get((tag, attributes))
        if got is None:
            if len(self.known) > 10_000:
                self.known.clear()
            got = self.known[tag, attributes] = self._read(tag, attributes)
        ruled, article = got
        if tag == "header" and not inside:
            ruled = 2
        return ruled, article and not ruled

    def _read(self, tag: str, attributes: str) -> tuple[int, bool]:
        named = {}
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            named.setdefault(name.lower(), html.unescape(a or b or c))
        get = lambda k: named.get(k, "")
        ruled = 2 if tag in BOILERPLATE else 0
        if tag not in ("html", "body", "main"):
            ruled = max(ruled, hints(f"{get('class')} {get('id')} {get('role')}"))
        if "hidden" in named or get("aria-hidden").lower() == "true" or re.search(r"display\s*:\s*none", get("style"), re.I):
            ruled = 2
        article = tag in ("article", "main") or get("role").lower() == "main" or get("id").lower() in ARTICLE_NAMES or get("class").strip().lower() in ARTICLE_NAMES
        return ruled, article


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; comments and the like have no name.

    The content of RAW elements belongs to their tag where they are closed; else their tag is given alone, but that of a script or
    style ends with the page. A "<" that no ">" follows is text.
    """
    at, n, last, loose = 0, len(page), page.rfind(">"), 0
    unclosed: set[str] = set()
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", at)
            end = page.find("-->" if comment else ">", at + 2)
            end = end + (3 if comment else 1) if end >= 0 else n
            yield at, end, "", False, ""
            at = end
            continue
        if at > last:
            return
        m = TAG.match(page, at) if loose < LOOSE_AFTER else None
        if m is None and (after.isalpha() or after == "/"):
            loose += 1
            m = LOOSE_TAG.match(page, at)
        if m is None:
            if after == "/":  # no name
                end = page.find(">", at) + 1
                yield at, end, "", False, ""
                at = end
            else:
                at += 1
            continue
        name, end, closing = m.group(2).lower(), m.end(), bool(m.group(1))
        if name in RAW and not closing and not m.group(3).endswith("/") and name not in unclosed:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, end)
            if close:
                yield at, close.end(), "", False, ""
                at = close.end()
                continue
            unclosed.add(name)
            if name in ("script", "style"):
                yield at, n, "", False, ""
                return
        yield at, end, name, closing, m.group(3)
        at = end


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, how far it rules out, whether it opens an article, whether it is silent
    opened: Counter[str] = Counter()
    ruled, inside, silent = [0, 0, 0], 0, 0
    link: int | None = None  # how deep the stack was where the open link began
    words: list[str] = []
    linked = heading = 0
    marks = Marks()

    def close() -> None:
        nonlocal words, linked
        if words:
            text = SPACE.sub(" ", html.unescape("".join(words))).strip()
            if text:
                out.append(Block(text, linked, 2 if ruled[2] else 1 if ruled[1] else 0, inside > 0, heading))
            words, linked = [], 0

    def text_of(part: str) -> None:
        nonlocal linked
        if not silent:
            words.append(part)
            if link is not None:
                linked += len(SPACE.sub(" ", part).strip())

    def pop(to: int) -> None:
        nonlocal inside, silent, link
        while len(stack) > to:
            tag, bad, article, mute = stack.pop()
            opened[tag] -= 1
            ruled[bad] -= 1
            inside -= article
            silent -= mute
        if link is not None and link > len(stack):
            link = None

    def pop_last(tag: str) -> None:
        if opened[tag] > 0:
            k = len(stack) - 1
            while stack[k][0] != tag:
                k -= 1
            pop(k)

    at = 0
    for start, end, tag, closing, attributes in tags(page):
        if start > at:
            text_of(page[at:start])
        at = end
        if not tag:
            continue
        if opened["head"] and not closing and tag not in IN_HEAD:
            pop_last("head")
        if tag == "a":
            link = None if closing else len(stack)
            continue
        if tag not in BLOCK and tag not in SILENT:
            if tag == "br":
                text_of(" ")
            continue
        if tag in BLOCK:
            close()
            heading = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and not closing else 0
        if closing:
            pop_last(tag)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div", "article", "main", "section"):
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        if tag in SIBLINGS and opened[tag] > 0:
            k = len(stack) - 1
            while k > len(stack) - 16 and k > 0 and stack[k][0] in ("div", "p", "address"):
                k -= 1
            if stack[k][0] == tag:
                pop(k)
        bad, article = marks.of(tag, attributes, inside > 0) if attributes or tag in BOILERPLATE or tag in ("article", "main", "header") else (0, False)
        stack.append((tag, bad, article, tag in SILENT))
        opened[tag] += 1
        ruled[bad] += 1
        inside += article
        silent += tag in SILENT
    if at < len(page):
        text_of(page[at:])
    close()
    return out


def content(b: Block) -> int:
    """GOOD, BAD or OPEN by links, length and density of stop words alone."""
    n = len(b.text)
    if b.linked > LINK_DENSITY * n:
        return OPEN if b.heading else BAD
    if n < LONG:
        return OPEN
    words = b.text.lower().split()
    density = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    return GOOD if density >= DENSE or n >= 2 * LONG and not b.linked else OPEN


def classify(found: list[Block]) -> tuple[list[int], list[bool]]:
    """First pass: GOOD, BAD or OPEN for each block; and whether it lies in the article that holds the page's text."""
    labels = [content(b) for b in found]
    labels = [BAD if b.ruled == 2 or b.ruled == 1 and x != GOOD else x for b, x in zip(found, labels, strict=True)]
    sums = [0, 0]
    for b, x in zip(found, labels, strict=True):
        sums[b.inside] += len(b.text) if x == GOOD else 0
    leads = sums[1] >= sums[0] and any(b.inside and x != BAD for b, x in zip(found, labels, strict=True))
    within = [leads and b.inside and b.ruled < 2 for b in found]
    return [OPEN if leads and x == GOOD and not w else x for x, w in zip(labels, within, strict=True)], within


def settle(found: list[Block], labels: list[int], within: list[bool]) -> list[int]:
    """Second pass: open blocks inherit from the nearest decided ones on their side of the article."""
    n, leads = len(labels), any(within)
    before, after = [None] * n, [None] * n
    for spots, nearest in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[bool, int] = {}
        for i in spots:
            nearest[i] = last.get(within[i])
            if labels[i] != OPEN:
                last[within[i]] = i
    #: By rank: whether a GOOD block lies between here and the next heading of that rank or a higher one.
    below, ahead = [False] * n, [False] * 7
    for i in range(n - 1, -1, -1):
        rank = found[i].heading
        below[i] = ahead[rank]
        if labels[i] == GOOD:
            ahead = [True] * 7
        elif rank:
            ahead = [False if k >= rank else x for k, x in enumerate(ahead)]
    out = []
    for i, label in enumerate(labels):
        a, b = before[i], after[i]
        if label != OPEN:
            out.append(label)
        elif found[i].heading and below[i]:
            out.append(GOOD)
        elif a is None and b is None:
            out.append(GOOD if within[i] or not leads else BAD)
        elif a is None or b is None:
            out.append(labels[b if a is None else a])
        else:
            out.append(labels[a if i - a <= b - i else b])
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, x in zip(found, settle(found, *classify(found)), strict=True) if x == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages."""
    schema = pages.select("page_id", "url").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
