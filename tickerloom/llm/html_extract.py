"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text, each with its place in the tree of elements.  A linear
classifier gives every block a score (log-odds of content): the landmark, role and class
names around it, share of linked text, length, punctuation.  The score is the block's
capacity to the source (content) or the sink (boilerplate).  Neighbours in page order, and
blocks that follow each other inside one container, are joined by edges that are the
stronger the nearer they are in the tree.  A maximum flow finds the cut of least capacity;
blocks on the source side are the text.

Blocks whose own capacity exceeds all their edges keep their label in every minimum cut, so
they are taken out first and lend their edges to their neighbours; the flow runs on the rest.
A page is worked on alone, in the task that reads it: no rows move.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tickerloom.llm.batches import Batches, map_batches

#: Elements inside a line of text; all others, but for ``br``, part blocks.
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q
    ruby s samp small span strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: A start tag closes an open element of the set, no further out than the border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}

#: Scores of elements and roles around a block (log-odds of content).
LANDMARKS = {"article": 6.0, "main": 6.0, **dict.fromkeys(
    "nav aside footer form dialog menu select button noscript svg template canvas object audio video".split(), -8.0),
    "header": -6.0}
ROLES = {"main": 6.0, "article": 6.0, "banner": -6.0, "alert": -6.0, **dict.fromkeys(
    "navigation contentinfo complementary search dialog alertdialog menu menubar form".split(), -8.0)}
#: Words of classes and ids.
GOOD = frozenset("article articlebody blogpost content entry main maincontent post story".split())
BAD = frozenset("""ad ads advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs consent
    cookie cookies copyright disclaimer footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter
    notice notices outbrain pager pagination paywall popup privacy promo promoted promotion recommended related
    search share sharing shop sidebar signin signup skip social sponsor sponsored subscribe subscription taboola tags teaser
    toolbar topbar topnav widget widgets""".split())
TALK = frozenset("comment commentlist comments discussion disqus reactions replies reply respond responses".split())
NEGATED = frozenset("has no with without".split())
CLASS_GOOD, CLASS_BAD, HIDDEN, TALKED = 3.0, -8.0, -9.0, -9.0

#: Scores of a block's own element and text.
TAGS = {"p": 1.0, "h1": 1.0, "h2": 0.5, "h3": 0.5, "blockquote": 1.0, "pre": 1.0, "li": -0.5, "legend": -2.0, "caption": 0.5}
LINKED, SHORT, LONG, LONGER, SENTENCE, RIGHTS = -4.0, -0.5, 1.0, 2.0, 0.5, -2.0

#: Capacity of an edge between neighbours at tree distance d is ``NEAR / d``, inside one container ``SAME``.  The
#: edges of a block weigh less than the names around it, more than its length.
NEAR, SAME = 2.0, 0.5
#: Capacities are whole numbers: scores in thousandths.
UNIT = 1000

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    """An open element: its place in the tree and what the elements around a block say of it."""

    tag: str
    parent: Node | None
    depth: int
    score: float
    sticky: bool = False
    positive: bool = False


@dataclass
class Block:
    node: Node
    text: str
    linked: int = 0
    edges: dict[int, int] = field(default_factory=dict)


def _hint(tag: str, attributes: dict[str, str], around: Node) -> tuple[float | None, bool]:
    """What an element's own names say (None: nothing), and whether it holds readers' comments."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDING.search(attributes.get("style", "")):
        return HIDDEN, True
    if tag in ("html", "body"):
        return None, False
    score = LANDMARKS.get(tag)
    if tag == "header" and around.positive:
        score = None
    if (role := attributes.get("role", "").lower()) in ROLES:
        score = min(ROLES[role], score) if score is not None and score < 0 else ROLES[role]
    names = [w.lower() for w in _WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")]
    meant = [w for i, w in enumerate(names) if not (i and names[i - 1] in NEGATED)]
    if not TALK.isdisjoint(meant):
        return TALKED, True
    good, bad = not GOOD.isdisjoint(meant), not BAD.isdisjoint(meant)
    if bad or ("header" in meant and not good and not around.positive):
        return min(CLASS_BAD, score or 0.0), False
    if good and "header" not in meant and (score is None or score > 0):
        score = max(score or 0.0, CLASS_GOOD, around.score if around.positive else 0.0)
    return score, False


def _open(tag: str, written: str, around: Node) -> Node:
    attributes = {}
    if written.strip(" \t\r\n/"):
        for name, double, single, bare in _ATTRIBUTE.findall(written):
            attributes.setdefault(name.lower(), double or single or bare)
    score, sticky = _hint(tag, attributes, around)
    if around.sticky or score is None:
        return Node(tag, around, around.depth + 1, around.score, around.sticky, around.positive)
    return Node(tag, around, around.depth + 1, score, sticky, score > 0)


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page, in order: text between borders of block elements."""
    top = Node("", None, 0, 0.0)
    blocks: list[Block] = []
    stack, pieces, linked, link = [top], [], 0, 0
    place = 0

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(stack[-1], text, linked))
            pieces.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            pieces.append(piece)
            if link:
                linked += len(piece.strip())

    # Behind the last closing bracket there is no whole tag; do not look for one from every opening bracket.
    last = page.rfind(">") + 1
    while place < last and (found := _TOKEN.search(page, place, last)) is not None:
        say(page[place:found.start()])
        place = found.end()
        if found[0].startswith("<!--") and not found[0].endswith(">"):
            place = len(page)
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, written = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in INLINE:
            if tag == "br":
                say(" ")
            elif tag == "a":
                link = 0 if closing else len(stack)
            continue
        end_block()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
        else:
            if stack[-1].tag == "p":
                stack.pop()
            if tag in CLOSES:
                ended, border = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in border:
                        break
                    if stack[i].tag in ended:
                        del stack[i:]
                        break
            if tag in RAW:
                closed = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, place)
                place = closed.end() if closed else len(page)
            elif tag not in VOID and not written.endswith("/"):
                stack.append(_open(tag, written, stack[-1]))
        if link > len(stack):
            link = 0
    say(_CUT_OFF.split(page[place:], maxsplit=1)[0])
    end_block()
    return blocks


def score(block: Block) -> float:
    """The classifier: log-odds that a block is content."""
    text, node = block.text, block.node
    words = text.count(" ") + 1
    total = node.score + TAGS.get(node.tag, 0.0) + LINKED * min(1.0, block.linked / len(text))
    total += LONGER if words >= 30 else LONG if words >= 10 else SHORT if words < 4 else 0.0
    if text[-1] in ".!?…。！？":
        total += SENTENCE
    if text[0] == "©" or "all rights reserved" in text.lower():
        total += RIGHTS
    return total


def _distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def join_blocks(blocks: list[Block]) -> None:
    """Edges of the page's graph, on both ends."""
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            _add(blocks, i - 1, i, NEAR / max(1, _distance(blocks[i - 1].node, block.node)))
        container = id(block.node.parent or block.node)
        if container in last:
            _add(blocks, last[container], i, SAME)
        last[container] = i


def _add(blocks: list[Block], i: int, j: int, capacity: float) -> None:
    units = round(capacity * UNIT)
    blocks[i].edges[j] = blocks[i].edges.get(j, 0) + units
    blocks[j].edges[i] = blocks[j].edges.get(i, 0) + units


def minimum_cut(terminal: list[int], edges: list[dict[int, int]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut; of several cuts the one with the most nodes there.

    ``terminal`` is the capacity from the source, or to the sink where negative; ``edges``
    holds the capacity to each neighbour, in both directions.
    """
    n = len(terminal)
    terminal, edges = list(terminal), [dict(e) for e in edges]
    side: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if side[i] is None and abs(terminal[i]) > sum(edges[i].values()):
            side[i] = terminal[i] > 0
            for j, capacity in edges[i].items():
                terminal[j] += capacity if side[i] else -capacity
                del edges[j][i]
                waiting.append(j)
            edges[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        names = {old: new for new, old in enumerate(left)}
        for old, content in zip(left, _flow([terminal[i] for i in left],
                                            [{names[j]: c for j, c in edges[i].items()} for i in left])):
            side[old] = content
    return side


def _flow(terminal: list[int], residual: list[dict[int, int]]) -> list[bool]:
    """Maximum flow by blocking flows on level graphs; nodes that cannot reach the sink are content."""
    n = len(terminal)
    supply, demand = [max(0, t) for t in terminal], [max(0, -t) for t in terminal]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if demand[i])
        for i in queue:
            level[i] = 0
        while queue:
            j = queue.popleft()
            for i in residual[j]:
                if level[i] < 0 and residual[i][j]:
                    level[i] = level[j] + 1
                    queue.append(i)
        if not any(supply[i] and level[i] >= 0 for i in range(n)):
            return [level_ < 0 for level_ in level]
        choices = [iter(list(e)) for e in residual]
        at: list[int | None] = [next(c, None) for c in choices]
        for source in range(n):
            while supply[source] and level[source] >= 0:
                path = [source]
                while path:
                    i = path[-1]
                    if level[i] == 0 and demand[i]:
                        break
                    j = at[i]
                    while j is not None and not (level[j] == level[i] - 1 and residual[i][j]):
                        j = at[i] = next(choices[i], None)
                    if j is None:
                        path.pop()
                        if path:
                            at[path[-1]] = next(choices[path[-1]], None)
                    else:
                        path.append(j)
                if not path:
                    break
                amount = min(supply[source], demand[path[-1]], *(residual[a][b] for a, b in zip(path, path[1:])))
                supply[source] -= amount
                demand[path[-1]] -= amount
                for a, b in zip(path, path[1:]):
                    residual[a][b] -= amount
                    residual[b][a] += amount


def main_text(page: str) -> tuple[str, int]:
    """The text of a page, blocks parted by line feeds, and the number of blocks read."""
    blocks = read_blocks(page)
    join_blocks(blocks)
    content = minimum_cut([round(score(b) * UNIT) for b in blocks], [b.edges for b in blocks])
    return "\n".join(b.text for b, kept in zip(blocks, content) if kept), len(blocks)


def _extract(batches: Batches) -> Batches:
    for batch in batches:
        texts, counts = [], []
        for page in batch.column("__html").to_pylist():
            text, count = main_text(page) if page else ("", 0)
            texts.append(text)
            counts.append(count)
        kept = [n for n in batch.schema.names if n != "__html"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in kept]
            + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
            names=[*kept, "text", "n_chars", "n_blocks"])


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text``, ``n_chars`` (code points) and ``n_blocks`` (blocks read).

    Character references are decoded, white space inside a block becomes one space, blocks
    are trimmed and parted by one line feed; ``br`` is white space.  Null and empty pages
    have an empty text; a page of text without any element is one block.  Tags left open,
    wrongly nested or cut off are read as browsers read them.  Rows are judged one by one,
    so repeats get equal results; an empty table gives no rows.  Columns named like results
    are replaced.
    """
    new = ("text", "n_chars", "n_blocks")
    kept = [f for f in pages.schema if f.name != html_col and f.name not in new]
    made = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType()),
                       StructField("n_blocks", LongType())])
    return map_batches(pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(html_col).cast("string").alias("__html")),
                       _extract, made)
