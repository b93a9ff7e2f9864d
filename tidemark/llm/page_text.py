"""Main text of web pages by gradient-boosted trees over DOM nodes.

A node is in if its subtree holds main text. Spark ML fits the trees on the nodes of labelled pages; each page's nodes are scored together inside
tasks and decoded from the top: the chosen nodes are those of greatest total log-odds among sets in which every chosen node's parent
is chosen. So a kept paragraph never stands in a dropped part, while a dropped advert may stand in a kept article."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, whole_text
from tidemark.llm.page_layouts import Layout

#: Pages of the labelled sample at most, and the size of the model.
TRAINING_PAGES, TREES, DEPTH = 1500, 30, 5
#: Nodes whose features are held at a time.
NODES = 50_000
#: Fixed values of HTML: elements without content, elements whose text is never shown as text, elements that begin and end a block, elements whose content is no markup (without and with character references).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("head script style template title iframe select option textarea button".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW, RAW_DECODED = set("script style xmp iframe noembed noframes".split()), set("title textarea".split())
#: A start tag (key) ends an open element (first set) unless one of the second set is between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
TAGS = ["html body", "article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "table tbody thead tfoot tr td th", "nav", "header", "footer", "aside", "form fieldset label input select textarea button", "a", "b i em strong span u small code sub sup font mark", "figure figcaption img picture video", "blockquote pre"]
TAG_GROUP = {t: i for i, group in enumerate(TAGS) for t in group.split()}
TOKENS = ["article content post entry main story body text prose", "nav menu menubar breadcrumb breadcrumbs pagination pager toc tabs list", "header masthead top site", "footer foot copyright legal", "sidebar aside widget rail related recommended trending tags", "ad ads adv advert advertisement sponsor sponsored promo banner", "cookie consent notice gdpr popup modal alert newsletter subscribe paywall signup", "comment comments reply replies discussion respond disqus", "form search login register", "share social follow links", "hidden"]
TOKEN_GROUP = {t: i for i, group in enumerate(TOKENS) for t in group.split()}
WITHIN = [TAG_GROUP[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form")]


_S = r"[\t\n\r\f ]"
#: A tag written plainly, and one of its attributes. Quantifiers never give back, so a match takes linear time.
_TAG = re.compile(rf"<(/?)([A-Za-z][^\t\n\r\f />]*+)((?:{_S}++[^\t\n\r\f \"'<>/=]++(?:=(?:\"[^\"]*+\"|'[^']*+'|[^\t\n\r\f \"'=<>`]++))?+)*+){_S}*+/?+>")
_ATTRIBUTE = re.compile(rf"{_S}++([^\t\n\r\f =]++)(?:=(\"[^\"]*+\"|'[^']*+'|[^\t\n\r\f ]++))?+")
_NAME, _GAP, _EQUALS = re.compile(r"[A-Za-z][^\t\n\r\f />]*+"), re.compile(r"[\t\n\r\f /]*+"), re.compile(rf"{_S}*+={_S}*+")
_ATTRIBUTE_NAME, _UNQUOTED = re.compile(r"=?+[^\t\n\r\f />=]*+"), re.compile(r"[^\t\n\r\f >]*+")
_COMMENT_END = re.compile(r"--!?>")


def odd_tag(html: str, at: int) -> tuple[list[tuple[str, str | None]], int]:
    """Attributes of a tag from behind its name, and where it ends: -1 if it never does."""
    attrs = []
    while True:
        at = _GAP.match(html, at).end()
        if at >= len(html):
            return attrs, -1
        if html[at] == ">":
            return attrs, at + 1
        m = _ATTRIBUTE_NAME.match(html, at)
        name, value, at = m[0].lower(), None, m.end()
        if m := _EQUALS.match(html, at):
            at = m.end()
            quote = html[at : at + 1]
            if quote and quote in "\"'":
                end = html.find(quote, at + 1)
                if end < 0:
                    return attrs, -1
                value, at = html[at + 1 : end], end + 1
            else:
                m = _UNQUOTED.match(html, at)
                value, at = m[0], m.end()
        attrs.append((name, value))


class Dom:
    """Elements in document order, and the events of which text is made: (node, text) or None at the edge of a block.

    Any string is a page and is read in linear time, as browsers do it: a declaration or processing instruction ends at the next ">", a comment that
    never ends takes the rest, a tag that never ends is dropped, "<" before anything else is text."""

    def __init__(self, html: str):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.tokens: list[int] = []
        self.gold: list[bool] = []
        self.silent: list[bool] = []
        self.events: list[tuple[int, str] | None] = []
        self.stack: list[int] = []
        #: Places in the stack of the open elements of each tag.
        self.places: dict[str, list[int]] = {}
        self.add("#root", [])
        self.read(html)
        while self.stack:
            self.pop()

    def read(self, html: str) -> None:
        at = 0
        while at < len(html):
            mark = html.find("<", at)
            if mark != at:
                self.events.append((self.stack[-1], unescape(html[at : mark if mark >= 0 else len(html)])))
            if mark < 0:
                return
            if m := _TAG.match(html, mark):
                at, name, closing = m.end(), m[2].lower(), bool(m[1])
                attrs = [(k.lower(), v[1:-1] if v and v[0] in "\"'" else v) for k, v in _ATTRIBUTE.findall(m[3])] if m[3] else []
            else:
                closing = html.startswith("/", mark + 1)
                m = _NAME.match(html, mark + 1 + closing)
                if not m:
                    at = self.not_a_tag(html, mark)
                    continue
                name = m[0].lower()
                attrs, at = odd_tag(html, m.end())
                if at < 0:
                    return
            if closing:
                self.handle_endtag(name)
                continue
            self.handle_starttag(name, attrs)
            if name in RAW or name in RAW_DECODED:
                m = re.compile(rf"</{re.escape(name)}(?=[\t\n\r\f />])", re.IGNORECASE).search(html, at)
                text, at = html[at : m.start() if m else len(html)], m.start() if m else len(html)
                if text:
                    self.events.append((self.stack[-1], unescape(text) if name in RAW_DECODED else text))

    def not_a_tag(self, html: str, mark: int) -> int:
        """Where what begins at mark with "<", but isn't a tag, ends."""
        if html.startswith("<!--", mark):
            if m := re.compile("-?>").match(html, mark + 4):
                return m.end()
            m = _COMMENT_END.search(html, mark + 4)
            return m.end() if m else len(html)
        if html[mark + 1 : mark + 2] in ("!", "?", "/") and mark + 2 < len(html):
            end = html.find(">", mark + 2)
            return end + 1 if end >= 0 else len(html)
        self.events.append((self.stack[-1], "<"))
        return mark + 1

    def add(self, tag: str, attrs: list) -> None:
        up = self.stack[-1] if self.stack else -1
        bits, gold = 0, False
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                for t in re.findall("[a-z]+", (unescape(v) if "&" in v else v).lower()):
                    if t in TOKEN_GROUP:
                        bits |= 1 << TOKEN_GROUP[t]
            elif k == "hidden" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
                bits |= 1 << TOKEN_GROUP["hidden"]
            elif k == "data-gold":
                gold = True
        self.tag.append(tag)
        self.parent.append(up)
        self.end.append(0)
        self.tokens.append(bits)
        self.gold.append(gold)
        self.silent.append(tag in SILENT or up >= 0 and self.silent[up])
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def pop(self) -> None:
        node = self.stack.pop()
        self.end[node] = len(self.tag)
        self.places[self.tag[node]].pop()
        if self.tag[node] in BLOCK:
            self.events.append(None)

    def innermost(self, tags: set[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def pop_through(self, tags: set[str], stop: set[str]) -> None:
        """End the innermost element of tags and all in it, unless an element of stop is inside it."""
        at = self.innermost(tags)
        if at >= 0 and at > self.innermost(stop):
            while len(self.stack) > at:
                self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.events.append(None)
            if tag not in ("html", "body"):
                self.pop_through({"p"}, {"td", "th", "table", "button", "li", "div", "section", "article"})
        if tag in ENDS:
            self.pop_through(*ENDS[tag])
        if tag == "br":
            self.events.append((self.stack[-1], " "))
        self.add(tag, attrs)
        if tag in VOID:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self.pop_through({tag}, set())

    def text(self, chosen: list[bool]) -> str:
        blocks, now = [], []
        for e in [*self.events, None]:
            if e is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif chosen[e[0]] and not self.silent[e[0]]:
                now.append(e[1])
        return "\n".join(b for b in blocks if b)


def features(doms: list[Dom]) -> np.ndarray:
    return np.vstack(list(feature_blocks(doms)))


def feature_blocks(doms: list[Dom]) -> Iterator[np.ndarray]:
    """A row per node of all pages, NODES at a time. Subtrees are runs of nodes, so their sums are differences of running sums."""
    sizes = np.array([len(d.tag) for d in doms])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = int(sizes.sum())
    flat = lambda name: np.fromiter((x for d in doms for x in getattr(d, name)), np.int64, n)
    parent, end, bits = flat("parent"), flat("end") + base, flat("tokens")
    root = parent < 0
    up = np.where(root, np.arange(n), parent + base)
    group = np.fromiter((TAG_GROUP.get(t, len(TAGS)) for d in doms for t in d.tag), np.int64, n)
    own, marks = np.zeros(n), np.zeros(n)
    at = 0
    for d in doms:
        for e in d.events:
            if e and not d.silent[e[0]]:
                own[at + e[0]] += len(e[1])
                marks[at + e[0]] += e[1].count(".") + e[1].count(",")
        at += len(d.tag)
    here = np.arange(n)

    def below(x: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(x)])
        return s[end] - s[here]

    is_link, is_field = group == TAG_GROUP["a"], group == TAG_GROUP["form"]
    depth, inside, around = np.zeros(n), np.zeros((n, len(WITHIN))), np.zeros(n, np.int64)
    linked = np.zeros(n, bool)
    place, children = np.zeros(n), np.bincount(up[~root], minlength=n).astype(float)
    u, seen = up.tolist(), [0] * n
    d_, l_, a_ = [0] * n, [False] * n, [0] * n
    g_, b_, k_, r_ = group.tolist(), bits.tolist(), [0] * n, root.tolist()
    link = TAG_GROUP["a"]
    mask = {g: 1 << i for i, g in enumerate(WITHIN)}
    w_ = [0] * n
    for i in range(n):
        p = u[i]
        if not r_[i]:
            d_[i], l_[i], a_[i], w_[i] = d_[p] + 1, l_[p], a_[p] | b_[p], w_[p] | mask.get(g_[p], 0)
            k_[i] = seen[p]
            seen[p] += 1
        if g_[i] == link:
            l_[i] = True
    depth, linked, around, place = np.array(d_, float), np.array(l_), np.array(a_), np.array(k_, float)
    inside = (np.array(w_)[:, None] >> np.arange(len(WITHIN)) & 1).astype(float)
    chars, links, points, tags = below(own), below(own * linked), below(marks), (end - here).astype(float)
    paragraphs, items, fields, anchors = (below((group == TAG_GROUP[t]).astype(float)) for t in ("p", "li", "form", "a"))
    first = np.concatenate([[0], np.cumsum(own)])[here]
    top = np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = chars[top] + 1e-9
    ratio = links / (chars + 1)
    kin = np.bincount(up[~root], weights=chars[~root], minlength=n)
    alike = np.zeros(n)
    pair = up * 64 + group
    _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
    alike = counts[inverse] / np.maximum(children[up], 1)
    columns = [depth, place, children[up], children, np.log1p(chars), ratio, np.log1p(tags), chars / tags, points / (chars + 1), np.log1p(own), chars / total, chars / (chars[up] + 1), (first - first[top]) / total, np.log1p(paragraphs), items / tags, np.log1p(anchors), np.log1p(fields), ratio[up], np.log1p(kin[up] / np.maximum(children[up], 1)), alike, np.log1p(chars[up]), np.log1p(paragraphs[up])]
    table, kinds, topics = np.column_stack(columns), np.arange(len(TAGS) + 1), np.arange(len(TOKENS))
    for lo in range(0, n, NODES):
        i = slice(lo, lo + NODES)
        flags = [group[i, None] == kinds, group[up[i], None] == kinds, inside[i], bits[i, None] >> topics & 1, around[i, None] >> topics & 1]
        yield np.hstack([table[i], *flags])


class Forest:
    """Trees as full binary arrays, scored for all rows at once."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, weight: np.ndarray):
        self.feature, self.threshold, self.leaf, self.weight = feature, threshold, leaf, weight

    @classmethod
    def of(cls, model, depth: int = DEPTH) -> Forest:
        inner, leaves = 2**depth - 1, 2**depth
        trees = model.trees
        feature, threshold, leaf = np.zeros((len(trees), inner), np.int64), np.full((len(trees), inner), np.inf), np.zeros((len(trees), leaves))

        def fill(t: int, node, at: int) -> None:
            if node.getClass().getSimpleName() == "LeafNode":
                lo, hi = at, at
                while lo < inner:
                    lo, hi = 2 * lo + 1, 2 * hi + 2
                leaf[t, lo - inner : hi - inner + 1] = node.prediction()
            else:
                feature[t, at], threshold[t, at] = node.split().featureIndex(), node.split().threshold()
                fill(t, node.leftChild(), 2 * at + 1)
                fill(t, node.rightChild(), 2 * at + 2)

        for t, tree in enumerate(trees):
            fill(t, tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"), 0)
        return cls(feature, threshold, leaf, np.array(model.treeWeights))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.weight)):
            at = np.zeros(len(x), np.int64)
            while at[0] < inner if len(at) else False:
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            out += self.weight[t] * self.leaf[t, at - inner]
        return 2 * out


def decode(dom: Dom, score: list[float]) -> list[bool]:
    """The set of nodes, closed under parents, of greatest total score. The root is always in it."""
    gain = list(score)
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[dom.parent[i]] += gain[i]
    chosen = [True] * len(gain)
    for i in range(1, len(gain)):
        chosen[i] = chosen[dom.parent[i]] and gain[i] > 0
    return chosen


def gold_nodes(dom: Dom) -> list[bool]:
    """Nodes that hold main text: marked ones, what is inside them, and what they are in."""
    holds = list(dom.gold)
    for i in range(1, len(holds)):
        holds[i] = holds[i] or dom.gold[dom.parent[i]]
        dom.gold[i] = holds[i]
    for i in range(len(holds) - 1, 0, -1):
        holds[dom.parent[i]] = holds[dom.parent[i]] or holds[i]
    return holds


def training_nodes(spark: SparkSession, pages: int = TRAINING_PAGES) -> DataFrame:
    """label, features of the nodes of labelled layouts, made in tasks from their seeds."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doms = [Dom(Layout(seed).page()) for seed in batch.column("id").to_pylist()]
            x, y = features(doms), []
            for d in doms:
                y += gold_nodes(d)
            shown = np.array([not s for d in doms for s in d.silent])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(y, float)[shown]), pa.array(list(x[shown]), pa.list_(pa.float64()))], names=["label", "x"])

    from pyspark.ml.functions import array_to_vector

    return spark.range(0, min(pages, TRAINING_PAGES), 1, 8).mapInArrow(made, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))


_fitted: dict[str, Forest] = {}


def fit(spark: SparkSession, pages: int = TRAINING_PAGES) -> Forest:
    """The forest of this application; fitted once, always from the same sample and seed."""
    from pyspark.ml.classification import GBTClassifier

    key = f"{spark.sparkContext.applicationId}:{pages}"
    if key not in _fitted:
        rows = training_nodes(spark, pages).cache()
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64, minInstancesPerNode=5).fit(rows)
        rows.unpersist()
        _fitted[key] = Forest.of(model)
    return _fitted[key]


def main_text(html: str, forest: Forest) -> str:
    return main_texts([html], forest)[0]


def main_texts(pages: list[str], forest: Forest) -> list[str]:
    doms = [Dom(p) for p in pages]
    score, at, out = [x for block in feature_blocks(doms) for x in forest.log_odds(block).tolist()] if doms else [], 0, []
    for d in doms:
        out.append(d.text(decode(d, score[at : at + len(d.tag)])))
        at += len(d.tag)
    return out


def extract_text(pages: DataFrame, *, html: str = "html", forest: Forest | None = None) -> DataFrame:
    """row (struct of pages' columns, whatever their names) and text: the main text of the whole html, of any length and however broken. Null and empty html give empty text; equal pages give equal texts; an empty table gives no rows."""
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(forest or fit(spark))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, texts, some, held = batch.column("html").to_pylist(), [], [], 0
            for h in html:
                some.append(h)
                held += len(h)
                if held > 1 << 20:
                    texts += main_texts(some, model.value)
                    some, held = [], 0
            texts += main_texts(some, model.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), whole_text(F.col(html)).alias("html"))
    return rows.mapInArrow(extract, f"row {rows.schema['row'].dataType.simpleString()}, text string")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The whole html goes to the extractor; the result keeps id and address alone.
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_text(pages.select("page_id", "url", F.col("html")))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


#: The provided pages keep their main text in <article>, between paragraphs and headings, which the extractor isn't told.
OP10_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<br>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(t, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM b
"""
