"""HTML extraction (4): tree scoring. Each paragraph passes points for its length and commas to its ancestors, half as many with each level further up, all the way to the root; a
container's points are discounted by its link density; the best container and those of its siblings that score well are kept.

Pages are independent: one Arrow pass, no shuffle. A page is scanned once from start to end; no pattern here can go back over what it has read, so that a very
long page costs in proportion to its length.

Defined cases: a null page gives a null text, and so does one without any text; a page without tags is one paragraph. Unclosed and wrongly nested tags are closed where HTML
would close them, as far as that matters here; comments, scripts and styles never count, nor an unclosed one's rest. Of containers with equal scores the innermost wins, then the first. Rows that
repeat are treated alike; an empty table gives an empty one. Extra columns stay; main_text, n_paragraphs and score are overwritten.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakesift.llm.common import pieces

#: Points: one for a paragraph, one for each comma, one for each CHARS_POINT characters up to MAX_LENGTH_POINTS. Shorter ones than LEAST give none.
LEAST, CHARS_POINT, MAX_LENGTH_POINTS = 25, 100, 3
#: What of a container's points goes on to its parent.
UP = 0.5
#: A sibling is kept from this share of the best score, or as a paragraph of so many characters with less link density than this.
SIBLING_SHARE, SIBLING_CHARS, SIBLING_LINKS = 0.2, 80, 0.25
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg iframe select button textarea object".split())
UNLIKELY = frozenset("nav footer aside form menu dialog".split())
PARAGRAPH = frozenset("p pre td blockquote div section article main body".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": ("li", ("ul", "ol")), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "tr": ("tr", ("table",)), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",))}
_MARK = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^<>=]++|=)*+)>|[!?][^<>]*>)""")
_NAME = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_BAD = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|banner|promo\w*|sponsor\w*|sidebar|comments?|footer|nav\w*|menu|share|social|related|breadcrumbs?|cookie\w*|popup|widget)(?:$|[\s_-])", re.I)
_SPACE = re.compile(r"\s+")


class Tree:
    """Nodes by number in document order: parents, tags, and a list of (node, text) runs in order."""

    def __init__(self, page: str):
        self.parent, self.tag, self.bad, self.runs = [-1], ["#root"], [False], []
        self.depth, self.open = [0], dict[str, int]()
        at, stack, position = 0, [0], 0
        while (m := _MARK.search(page, position)) is not None:
            self._add(stack[-1], page[at : m.start()])
            position = at = m.end()
            if m[1]:
                end = page.find("-->", position)
                position = at = len(page) if end < 0 else end + 3
                continue
            if m[3] is None:
                continue
            name = m[3].lower()
            if m[2]:
                if self.open.get(name):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    self._leave(stack, k)
                continue
            if name in ("script", "style"):
                end = re.compile(f"</{name}", re.I).search(page, position)
                position = at = len(page) if end is None else end.start()
                continue
            self._close(stack, name)
            if name in ("br", "hr"):
                self._add(stack[-1], " ")
            self.depth.append(self.depth[stack[-1]] + 1)
            self.parent.append(stack[-1])
            self.tag.append(name)
            told = _NAME.findall(m[4]) if "=" in m[4] else ()
            self.bad.append(self.bad[stack[-1]] or name in HIDDEN or name in UNLIKELY or any(_BAD.search(x) for x in told))
            if name not in VOID and not m[4].endswith("/"):
                stack.append(len(self.tag) - 1)
                self.open[name] = self.open.get(name, 0) + 1
        self._add(stack[-1], page[at:])

    def _add(self, node: int, text: str) -> None:
        if text:
            self.runs.append((node, text))

    def _leave(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.open[self.tag[node]] -= 1
        del stack[k:]

    def _close(self, stack: list[int], name: str) -> None:
        if name in BLOCK:  # ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag == "p":
                    self._leave(stack, k)
                    break
                if tag in BLOCK:
                    break
        if name in _CLOSES:
            other, limits = _CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag in (name, other):
                    self._leave(stack, k)
                    break
                if tag in limits:
                    break


def extract(page: str | None) -> tuple[str | None, int, float]:
    """(text, paragraphs, score) of a page's best container and siblings."""
    if page is None:
        return None, 0, 0.0
    tree = Tree(page)
    n = len(tree.tag)
    block, link = list(range(n)), [False] * n
    for k in range(1, n):
        up = tree.parent[k]
        block[k] = k if tree.tag[k] in BLOCK else block[up]
        link[k] = link[up] or tree.tag[k] == "a"
    own: dict[int, list[str]] = {}
    chars, linked = [0] * n, [0] * n
    spans: list[tuple[int, str]] = []  # paragraphs: runs of text in one block
    for node, raw in tree.runs:
        if tree.bad[node]:
            continue
        text = _SPACE.sub(" ", entities.unescape(raw))
        chars[node] += len(text)
        linked[node] += len(text) if link[node] else 0
        if spans and spans[-1][0] == block[node]:
            spans[-1] = (block[node], "")
            own[id_of].append(text)
        else:
            id_of = len(spans)
            own[id_of] = [text]
            spans.append((block[node], ""))
    spans = [(b, _SPACE.sub(" ", "".join(own[k])).strip()) for k, (b, _) in enumerate(spans)]
    for k in range(n - 1, 0, -1):
        chars[tree.parent[k]] += chars[k]
        linked[tree.parent[k]] += linked[k]
    points, gain = [0.0] * n, [0.0] * n
    for node, text in spans:
        if len(text) >= LEAST and (tree.tag[node] in PARAGRAPH or node == 0):
            gain[node] += 1 + text.count(",") + text.count("、") + min(len(text) / CHARS_POINT, MAX_LENGTH_POINTS)
    for k in range(n - 1, 0, -1):  # children come after their parents
        points[tree.parent[k]] += gain[k] + UP * points[k]
    points[0] += gain[0]
    density = [linked[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
    score = [points[k] * (1 - density[k]) for k in range(n)]
    best = max(range(n), key=lambda k: (score[k], tree.depth[k], -k))
    if score[best] <= 0:
        kept = [t for b, t in spans if t]  # nothing scores: all visible text
        return ("\n".join(kept) or None), len(kept), 0.0
    good = {best}
    siblings = [k for k in range(1, n) if best and tree.parent[k] == tree.parent[best] and k != best]
    for k in siblings:
        plain = tree.tag[k] == "p" and chars[k] >= SIBLING_CHARS and density[k] < SIBLING_LINKS
        if plain or score[k] >= max(1.0, SIBLING_SHARE * score[best]):
            good.add(k)
    inside = [k in good for k in range(n)]
    for k in range(1, n):
        inside[k] = inside[k] or inside[tree.parent[k]]
    kept = [t for b, t in spans if t and inside[b] and density[b] <= 0.5]
    return ("\n".join(kept) or None), len(kept), score[best]


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with main_text, n_paragraphs and score in place of the page itself."""
    rest = pages.drop("main_text", "n_paragraphs", "score")
    schema = T.StructType([f for f in rest.schema.fields if f.name != html] + [T.StructField("main_text", T.StringType()), T.StructField("n_paragraphs", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, html):
                found = [extract(x.as_py()) for x in batch.column(html)]
                others = [c for c in batch.schema.names if c != html]
                added = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *added], [*others, "main_text", "n_paragraphs", "score"])

    return rest.mapInArrow(run, schema)


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
