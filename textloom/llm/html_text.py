"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one looks at each block alone: its length, the density of
stop words and of link text, and whether it stands under an element that by its tag, role, class or id holds
boilerplate. It is decided good or bad, or left short. Pass two gives each short block the label of its nearest decided
neighbours: their common label where both agree, that of the nearer one where they don't. Within an article or main
element the neighbours are those of the same element, and a tie or the absence of decided ones is good; elsewhere it
is bad. Where neither elements nor stop words decide any block as good, lengths and links alone do.

A class or id speaks for its element unless that is html or body, or wraps the page: while no article stands free and a named
container holds at least as much good text as stands outside all of them, the largest such is opened. An article is the
whole of the main text only if it holds the main share of the good text.

Defined cases: null or empty pages, and pages without main text, give an empty text; cut-off pages are read as
far as they go, an unfinished tag at the end is dropped; references are decoded once; every run of white space,
Unicode's too, is one space; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stop words of the four languages of the corpus, read together.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was we were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "als am auch auf aus bei bin bis da das dem den der des die du ein eine einem einen einer er es für hat ich im in ist mit nach nicht oder sich sie sind so und von vor war wie wir zu zum zur über "
    "al como con de del el ella en era es esta este fue ha la las le lo los más me mi muy no o para pero por que se si sin sobre su sus un una y ya".split()
)
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select option button textarea title datalist".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"))
CONTAINERS = frozenset(("noscript", "template", "svg"))
#: Elements that hold no blocks: one that begins ends them.
WITHOUT_BLOCKS = frozenset(("select", "option", "datalist"))
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CORE_TAGS = frozenset(("article", "main"))
BLOCK_TAGS = BOILERPLATE_TAGS | CORE_TAGS | frozenset(
    "address blockquote body br caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 head hr html legend li ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
UNNAMED = frozenset("html body h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class and id names that name boilerplate; those of OTHERS name what readers wrote, or other pages, and are opened only where nothing else has good text.
NAMED = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsored promo promotion cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login sidebar side menu nav navbar "
    "navigation breadcrumb breadcrumbs foot footer header masthead comment comments commentlist disqus replies reviews share sharing social related recommended widget toolbar pagination pager "
    "tags skip copyright legal disclaimer".split()
)
OTHERS = frozenset("comment comments commentlist disqus replies reviews related recommended ad ads sponsored".split())
#: Parts that say where or how, beside which a name keeps its meaning: site-header, cookie-box, menu2.
NEUTRAL = frozenset(
    "site page main top bottom left right upper lower bar box list item items wrap wrapper container inner outer area section block blocks global primary secondary mobile desktop sticky fixed default "
    "links link panel content row column col group form button btn overlay text message title policy post posts article articles user thread slot unit zone google js the my".split()
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def named_parts(value: str) -> set[str]:
    """The boilerplate parts of the names in a class or id. A name of any other word besides is taken for one of its own, as in post-side-effects."""
    found: set[str] = set()
    for name in value.split():
        parts = {x.lower() for x in NAME_PARTS.findall(name)}
        if parts <= NAMED | NEUTRAL:
            found |= parts & NAMED
    return found


BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
TAG_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
WORD = re.compile(r"[^\W\d_]+")

SHORT = 70  # characters below which a block is not decided by its words
LONG = 200
MOST_LINKS = 0.3
STOP_LOW, STOP_HIGH = 0.12, 0.25
GOOD, BAD, OPEN = 1, 0, -1


def tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag name, closing, attributes); the last has no tag name. Comments and raw elements are passed over."""
    at, n, text = 0, len(page), []
    while True:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            yield "".join(text), "", False, ""
            return
        text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG_NAME.match(page, lt + 1)
        if not m:
            if page.startswith("</", lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            elif lt + 1 < n:
                text.append("<")
                at = lt + 1
            else:
                at = n
            continue
        end = tag_end(page, m.end())
        if end < 0:
            yield "".join(text), "", False, ""
            return
        name, closing = m[1].lower(), page[lt + 1] == "/"
        yield "".join(text), name, closing, page[m.end() : end]
        text, at = [], end + 1
        if name in RAW and not closing and not page.endswith("/", 0, end):
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if close:
                at = close.start()
            elif name not in CONTAINERS:  # the rest of the page is its text
                at = n


def tag_end(page: str, at: int) -> int:
    """Where the tag's > is, quoted values passed over; a quote that never ends counts as ordinary."""
    end = page.find(">", at)
    if end < 0:
        return -1
    body = page[at:end]
    if '"' not in body and "'" not in body:
        return end
    pos = at
    while True:
        eq = re.compile(r"""=\s*(["'])|>""").search(page, pos)
        if not eq:
            return -1
        if eq[0] == ">":
            return eq.start()
        close = page.find(eq[1], eq.end())
        if close < 0:
            return end
        pos = close + 1


def is_boilerplate(name: str, attributes: str) -> bool:
    """By tag, role or hiding."""
    if name in BOILERPLATE_TAGS:
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "role" and value.lower() in BOILERPLATE_ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def boilerplate_name(name: str, attributes: str) -> set[str]:
    """What its class or id calls an element; page wrappers and headings are not called names."""
    found: set[str] = set()
    if attributes and name not in UNNAMED:
        for m in ATTRIBUTE.finditer(attributes):
            if m[1].lower() in ("class", "id"):
                found |= named_parts((m[2] or "").strip("\"'"))
    return found


Block = tuple[str, float, bool, int]


def blocks(page: str, opened: frozenset[int] = frozenset()) -> tuple[list[Block], list[int], dict[int, tuple[bool, bool]]]:
    """Blocks (text, link density, boilerplate, number of the enclosing article or main element or 0); for each, the number of the outermost
    named container that is not opened and in nothing else that is boilerplate, or 0; and of these containers whether they hold an article or main element, and whether their names are of OTHERS."""
    found: list[Block] = []
    outer: list[int] = []
    holders: dict[int, tuple[bool, bool]] = {}
    parts: list[str] = []
    link_parts: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # open containers: name, boilerplate at or above, core, outermost named container
    skipped: list[tuple[str, int]] = []  # open elements without text of the page, and how many containers were open around each
    in_link, cores, number = 0, 0, 0

    def flush() -> None:
        nonlocal parts, link_parts
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                linked = " ".join(htmllib.unescape("".join(link_parts)).split())
                found.append((text, len(linked) / len(text), stack[-1][1] if stack else False, stack[-1][2] if stack else 0))
                outer.append(stack[-1][3] if stack else 0)
        parts, link_parts = [], []

    for text, name, closing, attributes in tags(page):
        if text and not skipped:
            parts.append(text)
            if in_link:
                link_parts.append(text)
        if not name:
            break
        if name in SKIPPED or name == "optgroup":
            if closing:
                at = next((k for k in range(len(skipped) - 1, -1, -1) if skipped[k][0] == name), -1)
                if at >= 0:
                    del skipped[at:]
            else:
                if skipped and skipped[-1][0] == "option" and name in ("option", "optgroup"):  # its end tag may be left out
                    skipped.pop()
                if name != "optgroup" and not attributes.endswith("/"):
                    skipped.append((name, len(stack)))
            if name in ("title", "option", "button"):
                flush()
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name not in BLOCK_TAGS:
            continue
        if not closing:
            while skipped and skipped[-1][0] in WITHOUT_BLOCKS:
                skipped.pop()
        flush()
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    while skipped and skipped[-1][1] > k:  # the end of what holds an element is its end too
                        skipped.pop()
                    in_link = 0
                    break
            continue
        if name == "p":
            in_link = 0
        above = stack[-1] if stack else ("", False, 0, 0)
        own, named, within = is_boilerplate(name, attributes), boilerplate_name(name, attributes), above[3]
        if named:
            number += 1
            if number in opened:
                named = set()
            elif not within and not above[1] and not own:
                within = number
                holders[within] = (False, bool(OTHERS & named))
        if name in CORE_TAGS:
            # An article that an unclosed menu or header would swallow is an article all the same; reader comments may be articles too.
            nested = bool(named) or above[2] and above[1] or any(n not in BOILERPLATE_TAGS and b for n, b, _, _ in stack)
            if not nested:
                cores += not above[2]
            if within:
                holders[within] = (True, holders[within][1])
            stack.append((name, bool(nested), above[2] or (0 if nested else cores), within))
        elif name in ("p", "li", "dt", "dd", "tr", "td", "th") and not own and not named:
            if stack and stack[-1][0] == name:
                stack.pop()
            stack.append((name, stack[-1][1] if stack else False, stack[-1][2] if stack else 0, stack[-1][3] if stack else 0))
        else:
            # A header within an article holds its headline.
            own = (own or bool(named)) and not (name == "header" and above[2] and not above[1])
            stack.append((name, above[1] or own, above[2], within if above[1] or own else 0))
    flush()
    return found, outer, holders


def first_pass(text: str, links: float, boilerplate: bool, core: int) -> int:
    if boilerplate or links > MOST_LINKS and not (core and links < 0.6):
        return BAD
    words = WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if len(text) < SHORT:
        return OPEN if not links or core else BAD
    if stops >= (STOP_LOW if core or len(text) > LONG else STOP_HIGH):
        return GOOD
    # A long text without links is no menu, whatever its words: its neighbours decide.
    return OPEN if core or stops >= STOP_LOW or not links else BAD


def second_pass(labels: list[int], cores: list[int]) -> list[int]:
    out = list(labels)
    before: list[int | None] = []
    last: dict[int, int] = {}
    for k, (label, core) in enumerate(zip(labels, cores)):
        before.append(last.get(core))
        if label != OPEN:
            last[core] = k
    last = {}
    for k in range(len(labels) - 1, -1, -1):
        core, b, a = cores[k], before[k], last.get(cores[k])
        if labels[k] != OPEN:
            last[core] = k
            continue
        if a is None and b is None:
            out[k] = GOOD if core else BAD
        elif a is None or b is None:
            out[k] = labels[b if a is None else a]
        elif labels[a] == labels[b]:
            out[k] = labels[a]
        elif k - b == a - k:
            out[k] = GOOD if core else BAD
        else:
            out[k] = labels[b if k - b < a - k else a]
    return out


def by_length(found: list[Block], labels: list[int]) -> list[int]:
    """Labels where neither an element nor stop words say what the text is, as in a language that has none of them here: blocks with few links are good if they are long, or are all that there is."""
    plain = [not boiler and links <= MOST_LINKS for _, links, boiler, _ in found]
    long = [fits and len(text) >= SHORT for fits, (text, _, _, _) in zip(plain, found)]
    return [GOOD if x else label for x, label in zip(long if any(long) else plain, labels)]


def good_length(block: Block) -> int:
    return len(block[0]) if first_pass(*block) == GOOD else 0


def page_blocks(page: str) -> list[Block]:
    """The page's blocks, with the named containers opened that wrap its text."""
    opened: set[int] = set()
    while True:
        found, outer, holders = blocks(page, frozenset(opened))
        if not holders or any(core and not boiler for _, _, boiler, core in found):
            return found
        free = sum(good_length(b) for b in found if not b[2])
        held = dict.fromkeys(holders, 0)
        for (text, links, _, _), k in zip(found, outer):
            if k:
                held[k] += good_length((text, links, False, 0))
        cores = any(core for core, _ in holders.values())
        able = [(n, -k) for k, n in held.items() if n and n >= free and (holders[k][0] or not cores) and not (free and holders[k][1])]
        if not able:
            return found
        # What readers wrote comes after all else.
        opened.add(-max(able, key=lambda x: (not holders[-x[1]][1], x))[1])


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = page_blocks(page)
    inside, outside = (sum(good_length(b) for b in found if not b[2] and bool(b[3]) == core) for core in (True, False))
    if inside < outside:
        found = [(*b[:3], 0) for b in found]  # teasers beside the text
    elif any(core and not boiler for _, _, boiler, core in found):
        found = [b if b[3] else (b[0], b[1], True, 0) for b in found]  # a page that names its article has no more of it elsewhere
    labels = [first_pass(*b) for b in found]
    # Boilerplate inside an article says nothing about the blocks beside it.
    keep = [k for k, b in enumerate(found) if not b[2]]
    if not any(found[k][3] or labels[k] == GOOD for k in keep):
        labels = by_length(found, labels)
    final = second_pass([labels[k] for k in keep], [found[k][3] for k in keep])
    return " ".join(found[k][0] for k, label in zip(keep, final) if label == GOOD)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns with text and n_chars."""
    slim = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = slim.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(len(keep))]
            columns = [batch.column(k) for k in range(len(keep))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    return slim.mapInArrow(read, schema)
