"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text with their places in the tree. A naive Bayes classifier over
the blocks' shape (words, links, punctuation, tag), trained on the blocks of the same table whose
place names them, and that naming itself give each block a gain for content or boilerplate: the
capacity of its edge to the source or to the sink. Neighbours in the page and in the tree are
joined by smoothness edges. The maximum flow separates content from boilerplate.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaleaf.llm.common import whole

# fixed values: elements of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul head".split()
)
RAW = set("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = RAW | set("noscript template svg math object canvas audio video select button datalist map".split())
# an element that an element of the same kind ends, up to the container
ENDED_BY_SAME = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",),
}
SIBLING = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
# fixed values: what names a part of a page
CONTENT_TAGS = {"article", "main"}
BOILER_TAGS = set("nav footer aside form dialog menu search fieldset".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside footer footers header masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices banner alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies "
    "respond share sharing social related recommended recommendations widget widgets pagination pager copyright disclaimer form".split()
)
CONTENT_WORDS = set("article content main post entry story body text".split())
LINE_WORDS = {"no", "with", "has", "without", "hide", "show", "is", "not"}

TAG = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|(/?)([a-zA-Z][^\s/><]*)([^<>]*)>|[!?/][^>]*>)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ENDINGS = tuple(".!?:;…。！？\"”»)")

# gains; those of the shape are cut off at SHAPE
CONTENT, BOILER, OUTSIDE, SHAPE = 4.0, -6.0, -2.0, 3.0
# smoothness between neighbours under one parent, other neighbours, and the next under one parent or grandparent
BESIDE, APART, KIN = 1.0, 0.3, 0.5
UNIT = 1000
# pseudo-counts (content, boilerplate) of each feature value, so that a small table has a classifier too
PRIOR = (
    {f"words {b}": (1 + b, 9 - b) for b in range(9)}
    | {"links 0": (8, 4), "links 1": (4, 4), "links 2": (2, 6), "links 3": (1, 8), "links 4": (1, 9)}
    | {"end True": (8, 3), "end False": (4, 9), "comma True": (6, 3), "comma False": (4, 7)}
    | {"tag p": (8, 3), "tag h": (4, 3), "tag li": (2, 6), "tag td": (3, 3), "tag other": (3, 4)}
)
ROWS = 100
# labelled pages that the classifier is fitted on
SAMPLE = 4_000


@functools.lru_cache(maxsize=10_000)
def described(name: str, attributes: str) -> tuple[bool, int, bool]:
    """Whether an element is hidden; 1 if it names content, -1 boilerplate, 0 neither; and whether
    only its class or id does."""
    if not attributes and name not in BLOCK:
        return False, 0, False
    said = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    hidden = "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in said.get("style", "").replace(" ", "").lower()
    role = said.get("role", "").lower()
    words = [w.lower() for w in WORD_PARTS.findall(f"{said.get('class', '')} {said.get('id', '')}")]
    told = {w for w, before in zip(words, ["", *words]) if before not in LINE_WORDS}
    if name in BOILER_TAGS or role in BOILER_ROLES:
        # a form may be drawn around the whole page
        return hidden, -1, name in ("form", "fieldset") and role not in BOILER_ROLES
    if told & BOILER_WORDS and name not in ("body", "html", "main"):
        return hidden, -1, True
    if name in CONTENT_TAGS or role in ("main", "article") or said.get("itemprop") == "articleBody":
        return hidden, 1, False
    if told & CONTENT_WORDS and name in ("div", "section"):
        return hidden, 1, True
    return hidden, 0, False


class Page:
    """Blocks of a page: texts, links, tags and the nodes they lie under."""

    def __init__(self, source: str):
        # nodes: parent, whether they name boilerplate or content, whether they hold the main part
        self.parent, self.names, self.holds, self.tags = [0], [0], [False], ["html"]
        self.by_class = [False]
        self.texts: list[str] = []
        self.links: list[float] = []
        self.nodes: list[int] = []
        self._stack: list[tuple[str, int]] = [("html", 0)]
        self._open = Counter({"html": 1})
        self._pieces: list[tuple[str, bool]] = []
        self._unseen = 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            tag = TAG.search(source, at)
            if tag is None:
                self._data(source[at:])
                break
            if tag.start() > at:
                self._data(source[at : tag.start()])
            at = tag.end()
            name = (tag[2] or tag[5] or "").lower()
            if not name:
                continue
            if tag[1] or tag[4]:
                self._end(name)
                continue
            attributes = tag[3] or tag[6] or ""
            if name in RAW:
                close = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else end
            else:
                self._start(name, attributes)

    def _data(self, text: str) -> None:
        if not self._unseen:
            self._pieces.append((text, self._open["a"] > 0))

    def _flush(self) -> None:
        if not self._pieces:
            return
        texts = [html.unescape(x) if "&" in x else x for x, _ in self._pieces]
        text = " ".join("".join(texts).split())
        if text:
            linked = sum(len("".join(x.split())) for x, (_, link) in zip(texts, self._pieces) if link)
            self.texts.append(text)
            self.links.append(linked / max(1, len(text.replace(" ", ""))))
            self.nodes.append(next(n for name, n in reversed(self._stack) if name in BLOCK))
        self._pieces = []

    def _pop(self) -> None:
        name, _ = self._stack.pop()
        self._open[name] -= 1
        self._unseen -= name in UNSEEN or name.startswith("hidden ")

    def _pop_to(self, names: set[str], until: set[str]) -> None:
        """Ends the innermost open element of these names, if no other of ``until`` is inside."""
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in names:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in until:
                return

    def _start(self, name: str, attributes: str) -> None:
        block = name in BLOCK
        if block:
            self._flush()
            if self._open["p"]:
                self._pop_to({"p"}, BLOCK)
            if name in ENDED_BY_SAME:
                same = SIBLING.get(name, {name})
                if any(self._open[x] for x in same):
                    self._pop_to(same, set(ENDED_BY_SAME[name]))
        elif name == "br":
            self._data(" ")
        if name in VOID:
            return
        node, unseen = self._stack[-1][1], name in UNSEEN
        hidden, names, by_class = described(name, "" if name == "a" else attributes)
        if block:
            node = self._node(name, names, by_class, node)
        if hidden and not unseen:
            # as an element that is never seen
            name = f"hidden {name}"
        self._unseen += hidden or unseen
        self._stack.append((name, node))
        self._open[name] += 1

    def _node(self, name: str, names: int, by_class: bool, parent: int) -> int:
        if name == "header" and not names:
            # that of an article holds its title
            names = 0 if self._open["article"] or self._open["main"] else -1
        if name in ("main", "h1"):
            for _, n in self._stack:
                self.holds[n] = True
        self.parent.append(parent)
        self.names.append(names)
        self.by_class.append(by_class)
        self.holds.append(False)
        self.tags.append(name)
        return len(self.parent) - 1

    def _end(self, name: str) -> None:
        if name == "p" and not self._open["p"]:
            self._flush()
        if not self._open[name] and not self._open[f"hidden {name}"]:
            return
        if name in BLOCK:
            self._flush()
            self._pop_to({name, f"hidden {name}"}, set())
        else:
            self._pop_to({name, f"hidden {name}"}, BLOCK)

    def named(self) -> list[int]:
        """Per block 1 if its place names it content, -1 boilerplate, 0 neither. A class that
        names boilerplate does not count for an element that holds the page's main part."""
        boiler, content = [False] * len(self.parent), [False] * len(self.parent)
        for n, parent in enumerate(self.parent):
            own = self.names[n]
            if own < 0 and self.by_class[n] and self.holds[n]:
                own = 0
            boiler[n] = boiler[parent] or own < 0
            content[n] = content[parent] or own > 0
        return [-1 if boiler[n] else int(content[n]) for n in self.nodes]

    def features(self) -> list[tuple[str, ...]]:
        out = []
        for text, link, node in zip(self.texts, self.links, self.nodes):
            tag = self.tags[node]
            tag = "h" if re.fullmatch("h[1-6]", tag) else "li" if tag in ("li", "dd", "dt") else "td" if tag in ("td", "th") else tag
            out.append(
                (
                    f"words {min((text.count(' ') + 1).bit_length(), 8)}", f"links {math.ceil(min(link, 1) * 4)}",
                    f"end {text.endswith(ENDINGS)}", f"comma {',' in text}", f"tag {tag if tag in ('p', 'h', 'li', 'td') else 'other'}",
                )
            )
        return out

    def edges(self) -> list[tuple[int, int, float]]:
        found = [(i, i + 1, BESIDE if a == b else APART) for i, (a, b) in enumerate(zip(self.nodes, self.nodes[1:]))]
        last: dict[tuple[str, int], int] = {}
        for i, node in enumerate(self.nodes):
            up = self.parent[node]
            for kin in (("same", node), ("parent", up), ("grandparent", self.parent[up])):
                before = last.get(kin, i)
                if before < i - 1 or before == i - 1 and kin[0] == "parent":
                    found.append((before, i, KIN))
                last[kin] = i
        return found

    def gains(self, weights: dict[str, float]) -> list[float]:
        named = self.named()
        outside = OUTSIDE if 1 in named else 0.0
        place = {1: CONTENT, -1: BOILER, 0: outside}
        shapes = [max(-SHAPE, min(SHAPE, sum(weights[f] for f in features))) for features in self.features()]
        return [place[n] + shape for n, shape in zip(named, shapes)]

    def main_text(self, weights: dict[str, float]) -> str:
        kept = min_cut(self.gains(weights), self.edges())
        return "\n".join(text for text, keep in zip(self.texts, kept) if keep)


def min_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: the gains given up and the edges between unlike
    labels; what either side may hold is content. By maximum flow with whole capacities.

    A block whose gain outweighs all its edges has its label in every least cut; it is settled first
    and its edges become gains of its neighbours. The flow runs over what is left.
    """
    n = len(gains)
    own = [round(g * UNIT) for g in gains]
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    around = [0] * n
    for a, b, weight in edges:
        size = round(weight * UNIT)
        near[a].append((b, size))
        near[b].append((a, size))
        around[a] += size
        around[b] += size
    label: list[bool | None] = [None] * n
    clear = [i for i in range(n) if abs(own[i]) > around[i]]
    while clear:
        i = clear.pop()
        if label[i] is not None:
            continue
        label[i] = own[i] > 0
        for j, size in near[i]:
            if label[j] is None:
                own[j] += size if label[i] else -size
                around[j] -= size
                if abs(own[j]) > around[j]:
                    clear.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        number = {i: k for k, i in enumerate(left)}
        inner = [(number[i], number[j], size) for i in left for j, size in near[i] if i < j and j in number]
        for i, kept in zip(left, _least_cut([own[i] for i in left], inner)):
            label[i] = kept
    return [bool(x) for x in label]


def _least_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The source side, as large as it can be, of a least cut: by blocking flows along levels."""
    n = len(gains)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, gain in enumerate(gains):
        join(source, i, gain, 0) if gain > 0 else join(i, sink, -gain, 0)
    for a, b, size in edges:
        join(a, b, size, size)
    while True:
        # levels from the source, then a blocking flow along them
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        step = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                size = min(room[e] for e in path)
                for e in path:
                    room[e] -= size
                    room[e ^ 1] += size
                cut = next(k for k, e in enumerate(path) if not room[e])
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            edge = None
            while step[at] < len(out[at]):
                e = out[at][step[at]]
                if room[e] and level[to[e]] == level[at] + 1:
                    edge = e
                    break
                step[at] += 1
            if edge is not None:
                path.append(edge)
                at = to[edge]
            elif path:
                at = to[path.pop() ^ 1]
                step[at] += 1
            else:
                break
    # boilerplate is what can still reach the sink
    reaches = [False] * (n + 2)
    reaches[sink] = True
    queue = deque([sink])
    while queue:
        b = queue.popleft()
        for e in out[b]:
            if room[e ^ 1] and not reaches[to[e]]:
                reaches[to[e]] = True
                queue.append(to[e])
    return [not x for x in reaches[:n]]


def weights(counts: dict[tuple[str, int], int]) -> dict[str, float]:
    """Log ratios of each feature value between content and boilerplate, from counts by (value, name)."""
    kinds: dict[str, list[int]] = {}
    seen = {f: [prior + counts.get((f, side), 0) for prior, side in zip(PRIOR[f], (1, -1))] for f in PRIOR}
    for f, pair in seen.items():
        total = kinds.setdefault(f.split(" ")[0], [0, 0])
        total[0] += pair[0]
        total[1] += pair[1]
    return {
        f: math.log(pair[0] / kinds[f.split(" ")[0]][0]) - math.log(pair[1] / kinds[f.split(" ")[0]][1]) for f, pair in seen.items()
    }


def _some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def train(pages: DataFrame, column: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """The classifier's weights, counted over the blocks that their place names, in about ``sample``
    pages chosen by a hash of their text. One number per feature value and side leaves the cluster."""
    texts = pages.select(whole(column).alias("html"))
    every = max(1, math.ceil(texts.count() / sample))
    some = texts.filter(F.pmod(F.xxhash64("html"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in _some_rows(batches):
            for source in batch.column(0):
                page = Page(source.as_py())
                for name, features in zip(page.named(), page.features()):
                    if name:
                        counts.update((f, name) for f in features)
        names = ["feature", "side", "n"]
        values = [[f for f, _ in counts], [s for _, s in counts], list(counts.values())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int32(), pa.int64()))], names=names)

    counted = some.mapInArrow(run, "feature string, side int, n long")
    rows = counted.groupBy("feature", "side").agg(F.sum("n").alias("n")).collect()
    return weights({(r["feature"], r["side"]): r["n"] for r in rows})


def extract(pages: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Every page with its main text: the columns in ``keep`` (page_id, url), text, n_chars.

    Blocks are in page order, joined by a line feed; white space inside a block is one blank,
    character references are decoded. The classifier is fitted on about ``SAMPLE`` pages. Scripts, styles, comments, controls and hidden
    elements have no text. Null and empty pages, and pages without content, give an empty text.
    Repeated rows are labelled each, in the same way. An empty table gives no rows. Other columns are
    left out. A page of any length is read whole, by one task; no shuffle but that of the counts.
    """
    model = train(pages, column)
    names = keep if keep is not None else ["page_id", "url"]
    rows = pages.select(whole(column).alias("html"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(names)])
    carried = rows.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_rows(batches):
            texts = [Page(x.as_py()).main_text(model) for x in batch.column(0)]
            columns = [*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in carried], "text", "n_chars"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried)
    done = rows.mapInArrow(run, f"{kinds}text string, n_chars long")
    return done.select(*[F.col(f.name).alias(n) for f, n in zip(carried, names)], "text", "n_chars")
