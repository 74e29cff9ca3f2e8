"""HTML extraction by minimum cut.

A page is read into text blocks, each with the path of elements around it.
A classifier gives every block two costs, for the labels content and
boilerplate, from its text alone: how much there is, whether it ends like a
sentence, what share of it is linked.  Elements whose names speak for or against
content (``article``, a class ``sidebar``) have costs of their own.  These are
the capacities of the edges to the two terminals.  DOM proximity gives the other
edges: a block is joined to the nearest element with such a name, to the
block before it, the more firmly the nearer they are in the tree, and to the
block before it in the same parent.  The minimum cut (by maximum flow, in phases of
shortest paths) is the cheapest labelling; blocks left on the source's side are
the main text.  So a heading or a list item, which looks like boilerplate by
itself, follows its article, and a long reader comment its list of comments.

Elements whose text is never shown or never prose (``SKIPPED``) are not read.

Runs per page in Arrow batches; a page's graph has a node per block and at most
two smoothing edges per block.  Defined cases: null or empty html gives an
empty text; html without elements is one block; unclosed and stray tags follow
the usual rules for implied ends; repeated rows and null ids are extracted row
by row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quorum.llm.common import in_batches

# Element names by their role, and words in class names and ids.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title select option "
                    "datalist textarea button input label audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("nav header footer aside menu form dialog".split())
CONTENT = frozenset("article main".split())
HINTS = re.compile(r"(?:^|[^a-z])(nav\w*|menu\w*|breadcrumb\w*|header|masthead|banner\w*|footer|sidebar\w*|side|"
                   r"aside|widget\w*|ads?|advert\w*|sponsor\w*|promo\w*|notices?|cookies?|consent|gdpr|popup|modal|overlay|"
                   r"newsletter|subscribe|signup|login|social|share|sharing|related|recommend\w*|comments?|"
                   r"comment-?\w*|repl(?:y|ies)|disqus|respond|discussion|copyright|legal|disclaimer|pagination|pager|"
                   r"search\w*|tags|toolbar|skip\w*)(?=$|[^a-z])")
GOOD = re.compile(r"(?:^|[^a-z])(article\w*|post-?(?:body|content|text)|entry-?content|main-?content|content-?body|story\w*)(?=$|[^a-z])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES = {  # a start tag of the key ends an open element of the values
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "p": ("p",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# what an end tag cannot reach past
WALLS = {"li": ("ul", "ol", "menu"), "td": ("table",), "tr": ("table",), "p": ("div", "article", "section", "td", "li", "body")}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")

# costs of dropping a block by its text, of keeping it, of an element's label against its name, of parting neighbours
BASE, LONG, LONG_CHARS, SENTENCE = 0.3, 1.2, 200, 0.6
LINKED, SHORT, SHORT_CHARS = 3.0, 0.3, 25
NAMED = 50.0
WITHIN, ADJACENT, SIBLING, DECAY = 2.6, 0.5, 0.3, 0.2
_ENDS = tuple(".!?…。！？:;\"'”’»)")


class Block:
    """Text of one block, its element path (numbers), its linked share, and the
    nearest element whose name speaks, with what it says (True: content)."""
    __slots__ = ("text", "path", "parent", "linked", "element", "says")

    def __init__(self, text, path, parent, linked, element, says):
        self.text, self.path, self.parent, self.linked, self.element, self.says = text, path, parent, linked, element, says


def _judge_tag(name: str, attributes: str) -> tuple[bool, int, bool]:
    """(not read, furniture, content) of a start tag.  Furniture is 2 where
    the element is surely that, 1 where a name only mentions it (a wrapper with
    the class ``with-sidebar``), which content inside it overrules."""
    skip, bad, good = name in SKIPPED, (name in FURNITURE) * (1 if name == "form" else 2), name in CONTENT
    if attributes and not skip:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "role":
                bad = max(bad, 2 * (value in ROLES))
                good |= value in CONTENT
            elif key == "hidden" or key == "aria-hidden" and value == "true" \
                    or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                skip = True
            elif key in ("class", "id") and name not in ("body", "html"):
                if HINTS.search(value):
                    bad = max(bad, 2 if any(map(HINTS.fullmatch, value.split())) else 1)
                good |= GOOD.search(value) is not None
    return skip, bad, good


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int, bool]] = []  # name, number, not read, furniture, content
    held: list[str] = []
    linked = skipping = links = number = at = 0

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            frames = [f for f in stack if f[0] not in INLINE]
            inside = next((i for i, f in enumerate(frames) if f[4]), None)
            bad = [f[1] for i, f in enumerate(frames) if f[3] > (inside is not None and i < inside)]
            element = bad[-1] if bad else frames[inside][1] if inside is not None else None
            out.append(Block(text, tuple(f[1] for f in frames), frames[-1][1] if frames else 0, min(1.0, linked / len(text)),
                             element, not bad))
        held.clear()
        linked = 0

    def pop_to(i: int):
        nonlocal skipping, links
        if any(f[0] not in INLINE for f in stack[i:]):
            flush()
        for f in stack[i:]:
            skipping -= f[2]
            links -= f[0] == "a"
        del stack[i:]

    while m := _TOKEN.match(page, at):
        at = m.end()
        name = m[2]
        if name is None:
            token = m[0]
            if not skipping and not (token.startswith(("<!", "<?")) and len(token) > 1):
                token = entities.unescape(token)  # a reference does not go on over a tag
                held.append(token)
                if links:
                    linked += len(token.strip())
            continue
        name = name.lower()
        if m[1]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            walls = WALLS.get(name, ())
            if i is not None and not any(f[0] in walls for f in stack[i + 1:]):
                pop_to(i)
            elif name == "p":
                flush()
            continue
        if name in ENDS_P or name in CLOSES:
            wanted = CLOSES.get(name, ()) + (("p",) if name in ENDS_P else ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in wanted:
                    pop_to(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in ("p",):
                    break
        if name == "br":
            held.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        skip, bad, good = _judge_tag(name, m[3])
        if m[3].endswith("/") and name in ("svg", "math"):
            continue
        if name not in INLINE:
            flush()
        number += 1
        stack.append((name, number, skip, bad, good))
        skipping += skip
        links += name == "a"
        if name in RAW and (end := re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)):
            at = end.start()
        elif name in RAW:
            at = len(page)
    flush()
    return out


def costs(block: Block) -> tuple[float, float]:
    """(cost of the label boilerplate, cost of the label content)."""
    keep = BASE + LONG * min(1.0, len(block.text) / LONG_CHARS) + SENTENCE * block.text.endswith(_ENDS)
    return keep, LINKED * block.linked ** 2 + SHORT * (len(block.text) < SHORT_CHARS)


def min_cut(terminals: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For every node whether it is on the source's side of a minimum cut.
    ``terminals`` has the capacities from the source and to the sink; ``edges`` are
    undirected.  Each phase finds the distances from the source and then a flow
    that blocks all shortest paths."""
    spare = [a - b for a, b in terminals]  # the common part flows straight through
    n, least = len(spare), 1e-9
    arcs: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    left: list[float] = []
    for a, b, w in edges:  # an arc and its reverse differ in the last bit
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += (b, a)
        left += (w, w)
    while True:
        level = [0 if x > least else -1 for x in spare]
        queue, met = deque(i for i in range(n) if level[i] == 0), False
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                b = to[e]
                if level[b] < 0 and left[e] > least:
                    level[b] = level[a] + 1
                    met = met or spare[b] < -least
                    queue.append(b)
        if not met:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in range(n):
            a, path = start, []
            while spare[start] > least:
                if spare[a] < -least:
                    flow = min(spare[start], -spare[a], *[left[e] for e in path])
                    for e in path:
                        left[e] -= flow
                        left[e ^ 1] += flow
                    spare[start] -= flow
                    spare[a] += flow
                    a, path = start, []
                    continue
                while tried[a] < len(arcs[a]):
                    e = arcs[a][tried[a]]
                    if left[e] > least and level[to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                else:
                    if not path:
                        break
                    a = to[path.pop() ^ 1]
                    tried[a] += 1
                    continue
                path.append(e)
                a = to[e]


def graph(found: list[Block]) -> tuple[list[tuple[float, float]], list[tuple[int, int, float]]]:
    """The terminals' capacities of every block, then of every named element, and
    the edges among them: neighbours, weaker with every level of the tree
    between them; blocks of one parent; blocks and their nearest named element."""
    terminals, edges, last = [costs(b) for b in found], [], {}
    elements: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            common = next((k for k, (x, y) in enumerate(zip(a.path, b.path)) if x != y), min(len(a.path), len(b.path)))
            apart = len(a.path) + len(b.path) - 2 * common
            edges.append((i - 1, i, ADJACENT * DECAY ** max(0, apart - 2)))
        # siblings hang from one element; a block element is its own text's parent
        shelf = b.path[-2] if len(b.path) > 1 else b.parent
        if shelf in last and last[shelf] != i - 1:
            edges.append((last[shelf], i, SIBLING))
        last[shelf] = i
        if b.element is not None:
            if b.element not in elements:
                elements[b.element] = len(terminals)
                terminals.append((NAMED, 0.0) if b.says else (0.0, NAMED))
            edges.append((i, elements[b.element], WITHIN))
    return terminals, edges


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = min_cut(*graph(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], [x.split()[0] for x in SCHEMA.split(", ")])


def extract(pages: DataFrame) -> DataFrame:
    """``SCHEMA`` for every row of ``pages`` (page_id, url, html)."""
    return in_batches(pages.select("page_id", "url", "html"), _extract, SCHEMA)
