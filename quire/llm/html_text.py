"""Operator 7, HTML extraction: two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks
by the part of the page they stand in, their link density, their length and
their share of stop words; short blocks stay open. The second pass gives open
blocks the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import packed, quoted, ready, row_ddl, slices, unpacked

RESULTS = ["text", "n_chars"]

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be by for from has he in is it of on or she that the they this to was were will with you
auf aus das dem den der des die ein eine für im ist mit nicht sich sie und von vor werden wie zu zur
au aux avec ce ces dans de du elle en est et il la le les ne par pas plus pour que qui se sur un une
al como con del el es la las lo los más no para por que se sin su una y
""".split())

# Elements that start and end a block.
BLOCKS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol
optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul
""".split())
RAW = frozenset("script style textarea title iframe noscript template svg math select object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form button dialog menu fieldset".split())
#: Elements whose end tag is often left out; a mark on one lasts for its block.
LOOSE = frozenset("p li dd dt tr td th tbody thead tfoot option caption h1 h2 h3 h4 h5 h6 hr".split())
MAIN = frozenset("article main".split())
#: An element that may hold a whole page; an article in it is still one.
WRAPPERS = frozenset({"form"})
# Words of class, id and role that mark what isn't the article.
MARKS = frozenset("""
ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu
breadcrumb breadcrumbs footer contentinfo masthead sidebar complementary widget cookie cookies consent gdpr notice
alert popup modal newsletter subscribe signup login search share sharing social related recommended
comment comments commentlist disqus reply replies respond discussion pagination pager toolbar copyright
""".split())

# Marks of what readers wrote, which no article element lifts.
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
# After these a class speaks of what the page has or lacks ("has-sidebar", "no-comments").
ABOUT = frozenset("has have no not with without".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
MARKED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Block rules: characters of a short and of a long block, link density from
#: which a block is no text, and the stop-word shares of text and of likely text.
SHORT, LONG, MAX_LINKS, STOP_HIGH, STOP_LOW = 70, 200, 0.5, 0.30, 0.15
#: Link density up to which a block passes where no stop word can speak for it.
FEW_LINKS = 0.2
GOOD, BAD, OPEN = "good", "bad", "open"
#: How an element is aside: not, by the mark of a plain wrapper (which an
#: article element inside may lift), or for good.
NOT, WRAPPED, APART = 0, 1, 2


def _marks(attributes: str) -> set[str]:
    """The marking words of class, id and role."""
    found = set()
    for value in MARKED.findall(attributes):
        for name in value.strip("\"'").split():
            for part in map(str.lower, PART.findall(name)):
                if part in ABOUT:
                    break
                if part in MARKS:
                    found.add(part)
    return found


def blocks_of(page: str) -> list[tuple[str, int, bool, bool, bool, bool]]:
    """(text, characters in links, in the article, aside, heading, lifted) of
    each block with visible text, in page order; lifted: in an article
    element inside a marked wrapper."""
    out: list[tuple[str, int, bool, bool, bool, bool]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # element, in the article, aside, lifted
    parts: list[str] = []
    linked, in_link, loose_aside, heading = [], False, False, False
    at, end = 0, len(page)

    def flush():
        nonlocal in_link, loose_aside, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            main, aside, lifted = stack[-1][1:] if stack else (False, NOT, False)
            links = len(" ".join(html.unescape("".join(linked)).split()))
            out.append((text, links, main, aside > NOT or loose_aside, heading, lifted))
        parts.clear(), linked.clear()
        in_link = loose_aside = heading = False

    def say(piece: str):
        parts.append(piece)
        if in_link:
            linked.append(piece)

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "br":
            say(" ")
        elif name == "a":
            in_link = not closing
        elif closing:
            if name in BLOCKS:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
        else:
            if name in BLOCKS:
                flush()
            if name in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if name in BLOCKS and name not in VOID:
                main, aside, lifted = stack[-1][1:] if stack else (False, NOT, False)
                marks = _marks(m[3]) if name not in ("html", "body") else set()
                if name in MAIN:
                    marks &= READERS
                if name in LOOSE:
                    loose_aside, heading = bool(marks), name[0] == "h" and name[1:].isdigit()
                else:
                    if name in MAIN and aside == WRAPPED and not main:
                        aside, lifted = NOT, True
                    if marks & READERS or name in ASIDE - WRAPPERS or name == "header" and not main or main and (marks or name in ASIDE):
                        aside = APART
                    elif marks or name in WRAPPERS:
                        aside = max(aside, WRAPPED)
                    stack.append((name, main or name in MAIN, aside, lifted))
    flush()
    return out


def _foreign(text: str) -> bool:
    """Whether most letters are of a script that the stop words don't use."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c >= "\u0370" for c in letters) > len(letters)


def _size(text: str) -> int:
    """Code points, those of East Asian scripts twice."""
    return len(text) + sum(c >= "\u2e80" for c in text)


def first_pass(text: str, links: int, main: bool, aside: bool, stop_words: bool = True) -> str:
    """A block's label on its own. Blocks in scripts without stop words, and
    all blocks without ``stop_words``, are judged by length and links."""
    if aside or links > MAX_LINKS * len(text):
        return BAD
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if main:
        return GOOD if _size(text) >= SHORT or stops >= STOP_LOW else OPEN
    if _size(text) < SHORT:
        return BAD if links else OPEN
    foreign = _foreign(text)
    if foreign or not stop_words:
        few = links <= FEW_LINKS * len(text)
        return GOOD if few and (foreign or len(text) >= LONG) else OPEN if few else BAD
    if stops >= STOP_HIGH or len(text) >= LONG and stops >= STOP_LOW:
        return GOOD
    return OPEN if stops >= STOP_LOW else BAD


def second_pass(labels: list[str], mains: list[bool], headings: list[bool]) -> list[bool]:
    """Whether each block is text. An open block takes the label that its
    nearest decided neighbours on both sides share, looking no further than
    the article element it is in or outside of; where they differ, a heading
    follows the next one, and any other block belongs to the text only inside
    the article element. Without decided neighbours that decides too."""
    def nearest(order) -> dict[int, str | None]:
        found, seen, main = {}, None, None
        for i in order:
            if mains[i] != main:
                seen, main = None, mains[i]
            found[i] = seen
            seen = labels[i] if labels[i] != OPEN else seen
        return found

    before, after = nearest(range(len(labels))), nearest(range(len(labels) - 1, -1, -1))
    out = []
    for i, label in enumerate(labels):
        low, high = before[i], after[i]
        if label == OPEN:
            if low == high and low or low is None and high or high is None and low:
                label = low or high
            else:
                label = high if headings[i] and high else GOOD if mains[i] else BAD
        out.append(label == GOOD)
    return out


def main_text(page: str) -> str:
    """The article of a page: its text blocks joined by two line breaks.

    Article elements inside marked wrappers count where the page has no
    other. Where no block passes at all, the page's language is taken to be
    one without stop words, and length and links decide."""
    found = blocks_of(page)
    plain = any(main and not aside and not lifted for _, _, main, aside, _, lifted in found)
    blocks = [(text, links, main, aside or lifted and plain, heading) for text, links, main, aside, heading, lifted in found]
    labels = [first_pass(*b[:4]) for b in blocks]
    if GOOD not in labels:
        labels = [first_pass(*b[:4], stop_words=False) for b in blocks]
    kept = second_pass(labels, [b[2] for b in blocks], [b[4] for b in blocks])
    return "\n\n".join(b[0] for b, k in zip(blocks, kept) if k)


def _extracted(batches):
    for b in slices(batches):
        found = [main_text(page or "") for page in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, pa.string()),
                                          pa.array(map(len, found), pa.int64())], ["row", *RESULTS])


def extract_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """The rows of ``pages`` with RESULTS: the main text and its code points.

    A null or empty page, or one without an article, has an empty text. Broken
    markup is read to the end: open elements last as far as their parent, an
    unfinished tag, comment or script lasts to the end of the page. Character
    references are decoded, white space inside a block becomes one space.
    Repeated rows are read each; an empty table gives an empty table. Results
    replace input columns of their names."""
    ready(pages.sparkSession)
    work = packed(pages, html=quoted(page))
    row = row_ddl(work)
    return unpacked(work.mapInArrow(_extracted, f"row {row}, text string, n_chars long"), pages.columns, RESULTS)
