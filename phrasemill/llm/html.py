"""Main text of web pages by minimum-cut labelling of blocks.

A page becomes a list of text blocks in page order. Every block gets a cost for each label, content
and boilerplate, from a linear classifier of its text and its place in the document tree; the costs
become capacities of edges to two terminals. Neighbouring blocks, and blocks of one parent, are tied
by smoothness edges that a cut between them must pay. The minimum cut is the cheapest labelling:
what stays on the source's side is content.

Where elements settle the matter (scripts, navigation, forms, hidden parts) the cost is a large
constant, so no smoothness overrules it. What a class, id or role says is a feature among others: it
costs much, but length, ``article`` and content on both sides can outweigh it, and it costs little on
an element around ``main`` or most of the article text, which is then the layout's name.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset("nav aside footer header form button select option menu dialog fieldset search label".split())
INSIDE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of these ends an open paragraph; one of the others ends an open element of its group.
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr title".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Words in class, id or role that name boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social "
    "comment comments reply replies respond disqus discussion cookie cookies consent notice alert popup modal overlay "
    "responses feedback newsletter subscribe subscription signup login search form toolbar pagination pager copyright legal disclaimer "
    "contentinfo complementary dialog rail skip".split()
)
#: Of these, what an article may be named and still be none of the page's own text.
CARD_NAMES = frozenset("ad advert comment reply related recommended sponsored promo".split())
#: Named exactly like this inside an article, an element is none of its text, unless it wraps the text.
CERTAIN_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo promotion notice related recommended newsletter cookie cookies "
    "consent".split()
)
#: These hold what readers wrote, however much that is, as long as the page has other text.
COMMENT_NAMES = frozenset("comment comments reply replies disqus".split())
#: A name that begins like this tells what the element has beside it, not what it is.
ABOUT = frozenset("has no with without".split())
ROOT_NAMES = frozenset(("html", "body"))

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only right behind its sign
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACES = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

#: Weights of the classifier: what a block gains as content for each feature.
WEIGHTS = {"bias": -0.4, "length": 1.0, "sentence": 0.8, "links": -4.0, "inside": 3.0, "heading": 0.6, "list": -0.5,
           "named": -6.0, "wrapped": -1.0}
#: Cost of a label that the markup rules out.
CERTAIN = 1000.0
#: What a cut between neighbours costs, and between blocks of one parent.
NEAR, KIN = 0.6, 0.9


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    tags: tuple[str, ...]
    banned: bool
    linked: float
    #: "certain", "named" or "wrapped" for a block in an element that is named like boilerplate, else nothing.
    name: str = ""


@dataclass
class _Open:
    tag: str
    number: int
    banned: bool
    named: bool
    #: 1 for an exact name, 2 for that of a comment.
    exact: int = 0


def _exact(attributes: str) -> int:
    """2 if a class or id is, begins or ends with the name of a comment, 1 with another exact name."""
    best = 0
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for word in value.strip("\"'").split():
                parts = [p for p in re.split("[^a-z]+", word.lower()) if p]
                if parts and parts[0] not in ABOUT:
                    ends = {parts[0], parts[-1]}
                    best = max(best, 2 if ends & COMMENT_NAMES else 1 if ends & CERTAIN_NAMES else 0)
    return best


def _named(attributes: str, names: frozenset[str]) -> bool:
    """Whether class, id or role are among ``names``."""
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "aria-label"):
            for word in value.strip("\"'").split():
                parts = [p.lower() for p in NAME_PARTS.findall(word)]
                whole = re.split("[^a-z]+", word.lower())
                if parts and parts[0] not in ABOUT and names.intersection(parts + whole):
                    return True
    return False


def _hidden(attributes: str) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.strip("\"'").lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _name_blocks(
    found: list[Block], around: list[tuple[int, ...]], rank: list[int], wraps: set[int], exact: list[dict[int, int]], holders: set[int]
) -> None:
    """Set ``name`` of every block from the named elements ``around`` it, of which ``exact`` ones are sure.

    An element wraps the page's text if it is in ``wraps`` or has more than half of the text of the
    highest ``rank`` there is: in articles, else in main, else anywhere. Links do not count.
    """
    if not any(around):
        return
    size = [0.0 if b.banned else len(b.text) * (1 - b.linked) for b in found]
    best = max((r for r, n in zip(rank, size, strict=True) if n), default=0)
    total, held = 0.0, {}
    for n, r, numbers in zip(size, rank, around, strict=True):
        if r == best:
            total += n
            for number in numbers:
                held[number] = held.get(number, 0.0) + n
    wraps = wraps | {number for number, n in held.items() if 2 * n > total}
    # a page whose whole text is comments is a page of comments
    other = any(n and r == best and 2 not in e.values() for n, r, e in zip(size, rank, exact, strict=True))
    for block, numbers, sure in zip(found, around, exact, strict=True):
        if numbers:
            block.name = "wrapped" if wraps.issuperset(numbers) else "named"
        if any(n not in holders and (kind == 2 and other or n not in wraps) for n, kind in sure.items()):
            block.name = "certain"


def blocks(page: str) -> list[Block]:
    """The text blocks of a page. Character references are decoded, white space is one space.

    Unclosed and crossed elements are repaired the way browsers do for the common cases: a block
    element ends a paragraph, an item ends the item before, an end tag without a start is ignored.
    """
    out: list[Block] = []
    around: list[tuple[int, ...]] = []
    rank: list[int] = []
    wraps: set[int] = set()
    exact: list[dict[int, int]] = []
    holders: set[int] = set()
    stack: list[_Open] = []
    pieces: list[str] = []
    linked = count = within = 0
    unclosed: set[str] = set()
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        if pieces:
            text = SPACES.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                out.append(Block(
                    text, tuple(o.number for o in stack if o.tag in BLOCK), tuple(o.tag for o in stack),
                    any(o.banned for o in stack), min(1.0, linked / len(text))))
                around.append(tuple(o.number for o in stack if o.named))
                inside = next((i for i, o in enumerate(stack) if o.tag in INSIDE and not o.named), len(stack))
                exact.append({o.number: o.exact for o in stack[inside:] if o.exact})
                own = {o.tag for o in stack if not o.named or o.tag == "main"}
                rank.append(2 if "article" in own else 1 if "main" in own else 0)
            pieces.clear()
        linked = 0

    def leave(start: int, stop: int | None = None) -> None:
        nonlocal within
        within -= sum(o.tag in INSIDE for o in stack[start:stop])
        del stack[start:stop]

    def add(part: str) -> None:
        nonlocal linked
        pieces.append(part)
        if any(o.tag == "a" for o in stack):
            linked += len(part.strip())

    while at < end:
        found = MARK.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag in BLOCK:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    if tag in BLOCK or not any(o.tag in BLOCK for o in stack[i + 1 :]):
                        leave(i)
                    else:
                        leave(i, i + 1)
                    break
                if tag not in BLOCK and stack[i].tag in ("td", "th", "article", "nav", "footer", "aside"):
                    break
            continue
        if tag in RAW:
            # raw text has no markup: it ends at its own end tag; a nested svg or object is rare. Without an
            # end tag text elements take the rest of the page, others are empty.
            text_element = tag in ("script", "style", "title", "textarea")
            if text_element or not found[3].rstrip().endswith("/") and tag not in unclosed:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif text_element:
                    at = end
                else:
                    unclosed.add(tag)
            if tag in ("title", "textarea"):
                close()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            close()
            if tag in ENDS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == "p":
                        leave(i, i + 1)
                        break
                    if stack[i].tag in BLOCK:
                        break
            group = SIBLINGS.get(tag)
            if group:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in group:
                        leave(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
        if tag in VOID:
            continue
        count += 1
        outside = tag in OUTSIDE and not (tag == "header" and within)
        names = CARD_NAMES if tag in INSIDE else NAMES - {"header"} if within else NAMES
        described = tag not in ROOT_NAMES and bool(found[3])
        banned = outside or described and _hidden(found[3])
        named = described and _named(found[3], names)
        if tag in BLOCK or tag == "a" or banned or named:  # others say nothing, and often stay unclosed
            stack.append(_Open(tag, count, banned, named, _exact(found[3]) if described and named else 0))
            if tag == "main":
                wraps.update(o.number for o in stack if o.named)
            within += tag in INSIDE
            if tag in INSIDE and not named:
                holders.update(o.number for o in stack[:-1] if o.exact)
    close()
    _name_blocks(out, around, rank, wraps, exact, holders)
    return out


def gain(block: Block) -> float:
    """The classifier: how much more a block looks like content than like boilerplate."""
    if block.banned or block.name == "certain":
        return -CERTAIN
    tags = set(block.tags)
    words = block.text.count(" ") + 1
    value = WEIGHTS["bias"]
    value += WEIGHTS["length"] * min(2.0, words / 12)
    value += WEIGHTS["sentence"] * bool(re.search(r"[.!?…。](?:[\"'»”)]|$)", block.text))
    value += WEIGHTS["links"] * block.linked
    value += WEIGHTS["inside"] * bool(tags & INSIDE)
    value += WEIGHTS["heading"] * bool(tags & HEADINGS)
    value += WEIGHTS["list"] * ("li" in tags)
    value += WEIGHTS[block.name] if block.name else 0.0
    return value


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, less the farther apart they are in the tree, and
    between one block and the next of the same parent, whatever stands between them."""
    out = []
    last: dict[tuple[int, ...], int] = {}
    for i, block in enumerate(found):
        if i:
            before = found[i - 1].path
            common = 0
            for a, b in zip(before, block.path, strict=False):
                if a != b:
                    break
                common += 1
            out.append((i - 1, i, NEAR / (1 + len(before) + len(block.path) - 2 * common)))
        parent = block.path[:-1]
        if parent in last:
            out.append((last[parent], i, KIN))
        last[parent] = i
    return out


def min_cut(gains: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost, content winning ties.

    A block whose own gain outweighs all its ties is settled at once, and its ties become gains of
    its neighbours; what is left over goes through augmenting shortest paths (maximum flow).
    """
    n = len(gains)
    gains = list(gains)
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        beside[a][b] = beside[a].get(b, 0.0) + w
        beside[b][a] = beside[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is None and abs(gains[i]) > sum(beside[i].values()):
            label[i] = gains[i] > 0
            for j, w in beside[i].items():
                gains[j] += w if label[i] else -w
                del beside[j][i]
                if label[j] is None:
                    waiting.append(j)
            beside[i] = {}
    open_blocks = [i for i in range(n) if label[i] is None]
    if open_blocks:
        side = _max_flow(open_blocks, gains, beside)
        for i in open_blocks:
            label[i] = i not in side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], gains: list[float], beside: list[dict[int, float]]) -> set[int]:
    """The nodes from which the sink can still be reached when no path has room: boilerplate."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        room[i] = dict(beside[i])
        room[i][sink] = max(0.0, -gains[i])
        room[sink][i] = 0.0
        room[source][i] = max(0.0, gains[i])
        room[i][source] = 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > 1e-12 and v not in came:
                    came[v] = u
                    queue.append(v)
        if sink not in came:
            break
        path = [sink]
        while path[-1] != source:
            path.append(came[path[-1]])
        flow = min(room[b][a] for a, b in zip(path, path[1:], strict=False))
        for a, b in zip(path, path[1:], strict=False):
            room[b][a] -= flow
            room[a][b] += flow
    reach, queue = {sink}, deque([sink])
    while queue:
        v = queue.popleft()
        for u in room[v]:
            if u not in reach and room[u].get(v, 0.0) > 1e-12:
                reach.add(u)
                queue.append(u)
    return reach


def main_text(page: str | None) -> str:
    """Content blocks of a page, one a line; empty for null, empty and contentless pages."""
    found = blocks(page or "")
    keep = min_cut([gain(b) for b in found], edges(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Replace ``html`` by ``text`` and ``n_chars`` (code points) in every row.

    Pages are independent: one pass without a shuffle. Other columns stay, columns named like the
    two results are replaced.
    """

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(page) for page in series], dtype="object")

    kept = [c for c in df.columns if c not in (html, "text", "n_chars")]
    return df.withColumn("_text", read(F.col(html))).select(
        *[F.col(f"`{c}`") for c in kept], F.col("_text").alias("text"),
        F.char_length("_text").cast("bigint").alias("n_chars"),
    )
