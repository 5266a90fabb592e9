"""Main text of HTML pages by two passes over text blocks."""

from __future__ import annotations

import heapq
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from idmatch.llm.words import schema, typed

#: Elements that start a new block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
                   "thead title tr ul".split())
#: Elements whose content is never text of the page.
UNSEEN = frozenset("script style noscript template iframe object embed svg math canvas audio video select textarea button head "
                   "title datalist".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that runs to the matching end tag whatever it looks like.
RAW = frozenset("script style textarea title".split())
#: Words in class, id or role that name page furniture.
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|"
                   r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|header|masthead|toolbar|share|sharing|social|"
                   r"related|recommend\w*|comments?|comment\w*|replies|disqus|respond|login|signup|search|pagination|pager|"
                   r"copyright|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Of these, the ones that name what readers wrote.
READERS = re.compile(r"(?:^|[\s_-])(?:comment\w*|replies|disqus|respond)(?:$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Frequent words of the languages the pages come in: fixed values.
STOP = frozenset(
    "the of and to in a is that it for on was as with be by at this are or from an which not "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de et des en un une du que est pour dans qui par sur pas au avec il elle "
    "el los las y que se por con una para del como no su al lo es más o".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

LONG, SHORT = 200, 70
HIGH_STOP, LOW_STOP = 0.22, 0.08
MUCH_LINKED = 0.33

#: A wrapper that its name makes furniture is none if it has this many times the good text outside of such wrappers.
MOST = 4
#: Words of the shortest block that a page of short blocks alone is read from.
FEW_WORDS = 4

GOOD, BAD, UNSURE = 1, 0, -1


class Block:
    """``wrapper`` is the innermost wrapper around the text that its name makes furniture, or -1."""

    __slots__ = ("text", "linked", "furniture", "main", "heading", "wrapper")

    def __init__(self, text: str, linked: int, furniture: bool, main: bool, heading: bool, wrapper: int) -> None:
        self.text, self.linked, self.furniture, self.main, self.heading, self.wrapper = text, linked, furniture, main, heading, wrapper


def blocks(page: str, wrappers: list[tuple[int, bool]]) -> Iterator[Block]:
    """The text blocks of a page in order: references decoded, white space as one space, trimmed, none empty.

    ``wrappers`` receives (wrapper around it or -1, whether it names what readers wrote) of each wrapper with a name of
    page furniture, outer ones first. What is open is counted, so a tag costs the same at any depth.
    """
    stack: list[tuple[str, bool, int]] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = at = barred = out_of_sight = headed = 0

    def push(name: str, bar: bool, wrapper: int) -> None:
        stack.append((name, bar, wrapper))
        count(name, bar, 1)

    def count(name: str, bar: bool, by: int) -> None:
        nonlocal barred, out_of_sight, headed
        opened[name] += by
        barred += by * bar
        out_of_sight += by * (name in UNSEEN)
        headed += by * (name in HEADINGS)

    def pop() -> None:
        name, bar, _ = stack.pop()
        count(name, bar, -1)

    def state() -> tuple[bool, bool, bool, bool, int]:
        main = opened["article"] > 0 or opened["main"] > 0
        return out_of_sight > 0, barred > 0 or (opened["header"] > 0 and not main), main, headed > 0, stack[-1][2] if stack else -1

    unseen, furniture, main, heading, wrapper = state()

    def flush() -> Iterator[Block]:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            yield Block(text, linked, furniture, main, heading, wrapper)
        pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            text = entities.unescape(raw)
            pieces.append(text)
            if opened["a"]:
                linked += len(" ".join(text.split()))

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at, name = m.end(), (m[1] or "").lower()
        if not name:
            continue
        closing = page[m.start() + 1] == "/"
        if name in BLOCKS or name == "br":
            if name == "br":
                pieces.append(" ")
            else:
                yield from flush()
        if closing:
            where = len(stack) - 1 if opened[name] else -1
            while where >= 0 and stack[where][0] != name:
                where = where - 1 if name in BLOCKS or stack[where][0] not in BLOCKS else -1
            while 0 <= where < len(stack):
                pop()
        elif name not in VOID and not (m[2] or "").rstrip().endswith("/"):
            if opened["head"] and (name == "body" or name in BLOCKS - UNSEEN - {"html"}):
                kept = [x for x in stack if x[0] != "head"]
                while stack:
                    pop()
                for x in kept:
                    push(*x)
            if name in BLOCKS and stack and stack[-1][0] == "p":
                pop()
            given = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[2] or "")}
            labels = [x for k in ("class", "id", "role") if (x := given.get(k, "")) and (hit := NAMED.search(x)) and not (main and "header" in hit[0].lower())]
            hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true"
            around = stack[-1][2] if stack else -1
            if name == "form" or (labels and name not in ("html", "body", "article", "main")):
                wrappers.append((around, any(READERS.search(x) for x in labels)))
                around = len(wrappers) - 1
            push(name, name in FURNITURE or hidden, around)
            if name in RAW:
                end = re.compile(rf"</{name}\b", re.I).search(page, at)
                at = end.start() if end else len(page)
        unseen, furniture, main, heading, wrapper = state()
    yield from flush()


def density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP for w in words) / len(words)


def reads_well(b: Block) -> bool:
    """Whether a block's stop words, length and links alone make it text of the page."""
    if b.linked > MUCH_LINKED * len(b.text) or len(b.text) < SHORT:
        return False
    dense = density(b.text)
    return dense >= HIGH_STOP or (len(b.text) > LONG and (dense >= LOW_STOP or b.main))


def settle_wrappers(found: list[Block], wrappers: list[tuple[int, bool]]) -> None:
    """Makes the blocks of named wrappers furniture, unless a wrapper holds what the page is about.

    Wrappers are taken from the outermost with most good text on. One is cleared if there is no good text outside of
    wrappers, or ``MOST`` times less than in it (what readers wrote is cleared in the first case only); the text that
    stands in it alone then counts as outside, and the wrappers in it come next.
    """
    alone, inner = [0] * (len(wrappers) + 1), [[] for _ in range(len(wrappers) + 1)]
    for b in found:
        if not b.furniture and reads_well(b):
            alone[b.wrapper] += len(b.text)
    total = alone[:]
    for i in range(len(wrappers) - 1, -1, -1):
        inner[wrappers[i][0]].append(i)
        if wrappers[i][0] >= 0:
            total[wrappers[i][0]] += total[i]
    outside, cleared = alone[-1], [False] * len(wrappers) + [True]
    queue = [(-total[i], i) for i in inner[-1]]
    heapq.heapify(queue)
    while queue:
        size, i = heapq.heappop(queue)
        if size and (not outside or (-size > MOST * outside and not wrappers[i][1])):
            cleared[i] = True
            outside += alone[i]
            for j in inner[i]:
                heapq.heappush(queue, (-total[j], j))
    for b in found:
        b.furniture = b.furniture or not cleared[b.wrapper]


def first_pass(b: Block, in_main: bool) -> int:
    """A verdict from where a block stands, its stop-word density, its length and its link density."""
    if b.furniture or (in_main and not b.main) or b.linked > MUCH_LINKED * len(b.text):
        return BAD
    return GOOD if reads_well(b) else UNSURE


def short_text(marks: list[int], found: list[Block]) -> list[int]:
    """On a page without a good block, undecided ones of some words, with stop words and without links, are good."""
    if GOOD in marks:
        return marks
    sentence = lambda b: not b.linked and not b.heading and len(b.text.split()) >= FEW_WORDS and density(b.text) >= LOW_STOP
    return [GOOD if m == UNSURE and sentence(b) else m for m, b in zip(marks, found, strict=True)]


def second_pass(marks: list[int], found: list[Block]) -> list[int]:
    """Undecided blocks take the label of the nearest decided block, the one before in a tie; headings look ahead.

    With no decided block on the page, blocks inside the page's main element are kept and others dropped.
    """
    n = len(marks)
    before, after = [-1] * n, [-1] * n
    for i in range(n):
        before[i] = i if marks[i] != UNSURE else before[i - 1] if i else -1
    for i in range(n - 1, -1, -1):
        after[i] = i if marks[i] != UNSURE else after[i + 1] if i < n - 1 else -1
    out = []
    for i, mark in enumerate(marks):
        if mark == UNSURE:
            b, a = before[i], after[i]
            if found[i].main:
                # furniture around an article does not speak for what is inside it
                b = b if b >= 0 and found[b].main and not found[b].furniture else -1
                a = a if a >= 0 and found[a].main and not found[a].furniture else -1
            if b < 0 and a < 0:
                mark = GOOD if found[i].main else BAD
            elif a >= 0 and (b < 0 or found[i].heading or a - i < i - b):
                mark = marks[a]
            else:
                mark = marks[b]
        out.append(mark)
    return out


def main_text(page: str | None) -> str:
    wrappers: list[tuple[int, bool]] = []
    found = list(blocks(page or "", wrappers))
    settle_wrappers(found, wrappers)
    in_main = any(b.main and not b.furniture for b in found)
    marks = second_pass(short_text([first_pass(b, in_main) for b in found], found), found)
    return " ".join(b.text for b, m in zip(found, marks, strict=True) if m == GOOD)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a null or empty page, or one without main text, gives an empty text.

    Where blocks tie between two decided neighbours the one before counts. A page of any length is read whole, in one pass
    over its tags. Repeated rows each get a row; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return typed(pages, page_id="long", url="string", html="string").mapInArrow(run, schema(page_id="long", url="string", text="string", n_chars="long"))
