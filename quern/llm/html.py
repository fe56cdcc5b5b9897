"""Main text of HTML pages by minimum-cut labelling.

A page becomes a list of text blocks. A small classifier turns a block's marks
(its ancestors' tags, class and id words, roles, link density, length,
punctuation) into the costs of calling it content or boilerplate; they are the
capacities from the source and to the sink. Neighbours in the page, and blocks of
one parent element, are joined by smoothness edges. The minimum cut, found with
augmenting paths, separates content from boilerplate.

Class, id and role words count as whole words of a name: ``sidebar``, ``site-sidebar``
and ``sidebar-left`` name a sidebar, ``has-sidebar`` and ``sidebar-history`` don't. Such
a word is no mark of an element that is or holds an article or a main element, or
that holds half of the page's text. A header inside an article is part of it.

Defined cases: null html counts as empty; a page without content has an empty
text; unclosed and unmatched tags are tolerated; a tag whose quote is never closed
ends at the next ``>``; scripts, styles, templates, forms, comments and the head never
are text. Every block is looked at, however long the page; reading takes time in
proportion to its length.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements that start a new block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not shown as text of the page.
HIDDEN = frozenset("script style noscript template textarea title svg math iframe object canvas select button head".split())
#: Elements whose content is not parsed as HTML.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements that hold a page's frame.
FRAME = frozenset("nav footer aside form menu dialog header fieldset".split())
#: Class, id and role words of a page's frame and of its content.
FRAME_WORDS = re.compile(
    r"ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|foot|header|masthead|topbar|toolbar|comments?|commentlist|disqus|repl(?:y|ies)|respond|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|search\w*|share\w*|social|related|recommended|widget\w*|copyright|legal|pagination|pager|complementary|contentinfo|navigation|hidden|skip\w*|tags?",
    re.I,
)
CONTENT_WORDS = re.compile(r"article\w*|content|main|post|entry|story|body|text|prose", re.I)
#: Words before a frame word that say that an element has such a part, and words after one that only say what kind of box it is.
HAVING = frozenset("has have no not with without".split())
BOX = frozenset("area bar block body bottom box button buttons center container content dialog form group icons inner items left link links list main menu outer panel primary right row secondary section slot text thread title top unit widget wrap wrapper".split())
OPENS = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
QUOTED = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")
#: Elements that a new element of a kind ends; any block ends a paragraph.
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

NEAR, SIBLING = 0.6, 0.4


class Block:
    __slots__ = ("text", "linked", "mark", "parent", "tag")

    def __init__(self, text, linked, mark, parent, tag):
        self.text, self.linked, self.mark, self.parent, self.tag = text, linked, mark, parent, tag


class Mark:
    """What an element that bears a mark says of the blocks in it; ``chars`` of text are below it."""

    __slots__ = ("tag", "kind", "above", "chars", "holds_article", "framed", "content", "article")

    def __init__(self, tag, kind, above):
        self.tag, self.kind, self.above, self.chars, self.holds_article = tag, kind, above, 0, False
        self.framed, self.content, self.article = 0, False, False


HIDES, WORDED, TAGGED, CONTENT = 3, 2, 1, -1


def framed_name(name: str) -> bool:
    """Whether a class, id or role names a part of a page's frame."""
    parts = [p for p in re.split(r"[-_]+", name) if p]
    if not parts:
        return False
    if FRAME_WORDS.fullmatch(parts[-1]):
        return len(parts) == 1 or parts[-2] not in HAVING
    return len(parts) > 1 and bool(FRAME_WORDS.fullmatch(parts[0])) and parts[1] in BOX


def kind_of(tag: str, attributes: str, in_article: bool) -> int:
    """HIDES; TAGGED or WORDED: part of a page's frame by its tag or a name; CONTENT; 0: neither."""
    names = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return HIDES
        if name in ("class", "id", "role"):
            names += value.split()
    if tag in ("article", "main"):
        return CONTENT
    if tag in FRAME and not (tag == "header" and in_article):
        return TAGGED
    if any(map(framed_name, names)):
        return WORDED
    return CONTENT if any(CONTENT_WORDS.fullmatch(p) for n in names for p in re.split(r"[-_]+", n)) else 0


class Reader:
    """Reads a page once; what stands open is kept with counts, so that no step looks through all of it."""

    def __init__(self, html: str):
        self.html, self.out, self.marks = html, [], []
        self.stack: list[tuple[str, Mark | None, int]] = []  # tag, mark, number of the element
        self.places: dict[str, list[int]] = {}  # where each tag stands in the stack
        self.block_places: list[int] = []
        self.above: list[Mark] = []
        self.text: list[str] = []
        self.linked = self.numbers = self.links = self.hidden = 0
        self.quotes_hold = True

    def flush(self) -> None:
        if self.text and (whole := SPACE.sub(" ", unescape("".join(self.text))).strip()):
            tag, _, number = self.stack[self.block_places[-1]] if self.block_places else ("", None, 0)
            self.out.append(Block(whole, min(1.0, self.linked / max(1, len(whole))), self.above[-1] if self.above else None, number, tag))
            if self.above:
                self.above[-1].chars += len(whole)
        self.text.clear()
        self.linked = 0

    def leave(self, k: int) -> None:
        while len(self.stack) > k:
            tag, mark, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.block_places.pop()
            if mark is not None:
                self.above.pop()
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN or mark is not None and mark.kind == HIDES

    def enter(self, tag: str, attributes: str) -> None:
        self.numbers += 1
        kind = 0 if tag in ("html", "body") else kind_of(tag, attributes, bool(self.places.get("article") or self.places.get("main")))
        mark = None
        if kind:
            mark = Mark(tag, kind, self.above[-1] if self.above else None)
            self.marks.append(mark)
            self.above.append(mark)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.block_places.append(len(self.stack))
        self.stack.append((tag, mark, self.numbers))
        self.links += tag == "a"
        self.hidden += tag in HIDDEN or kind == HIDES

    def add(self, piece: str) -> None:
        if piece and not self.hidden:
            self.text.append(piece)
            self.linked += len(piece) if self.links else 0

    def tag_end(self, at: int) -> int:
        """Where the tag's ``>`` is, outside quotes as long as all quotes are closed; -1 if nowhere."""
        k = at
        while self.quotes_hold:
            m = QUOTED.search(self.html, k)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            k = self.html.find(m[0], m.end()) + 1
            if not k:
                break
        self.quotes_hold = False  # the rest has been looked through once
        return self.html.find(">", at)

    def closes(self, tag: str) -> None:
        where = self.places.get(tag)
        if where and (tag in BLOCKS or not self.block_places or self.block_places[-1] <= where[-1]):
            self.leave(where[-1])

    def opens(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS and self.block_places and self.stack[self.block_places[-1]][0] in CLOSES.get(tag, set()) | {"p"}:
            self.leave(self.block_places[-1])
        if tag == "body" and self.places.get("head"):
            self.leave(self.places["head"][0])
        if tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS):
            self.enter(tag, attributes)

    def read(self) -> list[Block]:
        html, at, raw = self.html, 0, {}
        while m := OPENS.search(html, at):
            self.add(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            stop = self.tag_end(at)
            if stop < 0:
                self.add(html[m.start() :])
                at = len(html)
                break
            attributes, at = html[at:stop], stop + 1
            if tag in BLOCKS or tag == "head":
                self.flush()
            elif tag == "br":
                self.add(" ")
            if m[1]:
                self.closes(tag)
            elif tag in RAW and not attributes.endswith("/"):
                # an element that is never closed takes the rest; one search finds that out
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at) if raw.get(tag, True) else None
                raw[tag] = close is not None
                at = close.end() if close else len(html)
            else:
                self.opens(tag, attributes)
        self.add(html[at:])
        self.flush()
        return self.out


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in order, with the marks of what stands around them."""
    reader = Reader(html)
    out = reader.read()
    total = sum(len(b.text) for b in out)
    for mark in reversed(reader.marks):  # those inside come after those around them
        if mark.above is not None:
            mark.above.chars += mark.chars
            mark.above.holds_article |= mark.holds_article or mark.tag in ("article", "main")
    for mark in reader.marks:
        above = mark.above
        frame = mark.kind == TAGGED or mark.kind == WORDED and not mark.holds_article and mark.chars * 2 < total
        mark.framed = (above.framed if above else 0) + frame
        mark.content = mark.kind == CONTENT or bool(above and above.content)
        mark.article = mark.kind == CONTENT and mark.tag == "article" or bool(above and above.article)
    return out


def cost(block: Block, has_article: bool) -> float:
    """The classifier's log odds that a block is content."""
    score = -0.4 + 0.5 * min(4.0, log1p(len(block.text)) - 3.0)
    mark = block.mark
    if mark and mark.content:
        score += 3.0
    if mark and mark.article:
        score += 2.0
    elif has_article:
        score -= 2.5
    if mark and mark.framed:
        score -= 8.0 + mark.framed
    score -= 4.0 * block.linked
    if block.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4"):
        score += 1.0
    if re.search(r"[.!?…:\"”»]\s*$", block.text[-8:]):
        score += 0.5
    if block.text.startswith(("©", "(c)", "Copyright", "copyright")):
        score -= 4.0
    return score


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side; scores are differences of the terminal capacities."""
    n = len(scores)
    source, sink = n, n + 1
    graph: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, s in enumerate(scores):
        if s > 0:
            graph[source][i] = s
            graph[i].setdefault(source, 0.0)
        elif s < 0:
            graph[i][sink] = -s
            graph[sink].setdefault(i, 0.0)
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0.0) + w
        graph[b][a] = graph[b].get(a, 0.0) + w
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [i in level for i in range(n)]
        order, tried = [list(g) for g in graph], [0] * (n + 2)
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(graph[a][b] for a, b in zip(path, path[1:], strict=False))
                cutoff = None
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    graph[a][b] -= flow
                    graph[b][a] += flow
                    if cutoff is None and graph[a][b] <= 1e-9:
                        cutoff = k + 1
                del path[cutoff:]
                continue
            while tried[u] < len(order[u]):
                v = order[u][tried[u]]
                if graph[u][v] > 1e-9 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
                tried[u] += 1
            else:
                path.pop()
                level[u] = -1


def extract(html: str | None) -> list[str]:
    """The content blocks of a page, in page order."""
    found = blocks(html or "")
    if not found:
        return []
    has_article = any(b.mark and b.mark.article for b in found)
    scores = [cost(b, has_article) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR * (0.2 if found[i - 1].mark is not b.mark else 1.0)))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    side = minimum_cut(scores, edges)
    return [b.text for b, content in zip(found, side, strict=True) if content]


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = batch.slice(k, 500)
                texts = ["\n\n".join(extract(h)) for h in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
