"""Main text of web pages by a tree-structured graphical model over the page's elements.

Every block element is a node with two states, content or not. A node's own potential comes from its role
(tag and class words), its text length and its share of linked text; the potential between parent and child
depends on the parent's role. Sum-product messages go up the tree and down again, which gives each node's
exact marginal; text of nodes that are more likely content than not is the page's text.

The potentials are counted on labelled pages: those whose markup names its article. The label of a node is
whether it stands in that element (``article`` or ``main``), unless its very text recurs on other labelled pages,
as menus and notices do. No feature shows the label: while learning, the element that names the article and its
class words count as a nameless box. Pseudo-counts of a few nodes stand in where no page has taught anything.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import table, written
from caseloom.llm.tokens import slices

#: About so many pages are learned from; all of them where there are fewer.
TRAIN_PAGES = 1000
#: A block's text that stands on so many of them recurs and is no content.
RECURS = 3
SLICE_CHARS = 4_000_000

# HTML elements by their kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("head script style noscript template iframe object canvas audio video select button textarea title".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("html body td th tr tbody thead tfoot".split())
# An element that starts ends an open one of these, up to the one after the bar.
_ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()} | {"p": (frozenset("p"), _BLOCK - {"p"})}

# Words in class, id or role that tell what an element is for.
_AWAY = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices notification alert nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager sidebar side aside rail widget related recommended recommendations share sharing social follow subscribe newsletter signup login search form comment comments commentlist respond reply replies discussion disqus footer foot copyright legal header masthead topbar toolbar skip hidden complementary contentinfo".split()
)
_MAIN = frozenset("article content main post entry story body text page maincontent articlebody".split())
_AWAY_TAGS = frozenset("nav header footer aside form menu dialog fieldset search".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"(?:^|[\s/\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


# Words that make a class name a statement about the page and not a name of what is inside.
_STATES = (frozenset("has no with without is not".split()), frozenset("open closed enabled disabled on off visible".split()))


def role_of(tag: str, attributes: str, masked: bool = False) -> str:
    """What an element is for, by its tag and the names in its class, id and role; ``masked`` looks away from what
    names the article.

    Each name counts by itself: ``has-sidebar`` or ``comments-open`` say nothing about the element, ``entry-comments``
    is a part that is not content. Names of both kinds, or of neither, leave a plain box.
    """
    named = tag in ("article", "main")
    if masked and named:
        return "box"
    if tag in ("html", "body"):
        return "root"
    away = main = False
    if attributes:
        for m in _NAMES.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                words = [w.lower() for w in _WORDS.findall(name)]
                if len(words) > 1 and (words[0] in _STATES[0] or words[-1] in _STATES[1]):
                    continue
                if not _AWAY.isdisjoint(words):
                    away = True
                elif not _MAIN.isdisjoint(words):
                    main = not masked
        if _HIDDEN.search(attributes):
            return "away"
    if tag in _AWAY_TAGS or (away and not main and not named):
        return "away"
    if away and not (main and named):
        return "box"
    if named or main:
        return "main"
    if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
        return "heading"
    if tag in ("p", "pre", "blockquote", "figcaption", "dd"):
        return "paragraph"
    if tag in ("li", "ul", "ol", "dl", "dt"):
        return "list"
    return "cell" if tag in ("td", "th", "tr", "table", "tbody", "thead", "tfoot") else "box"


def tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag whose name ends at ``at`` has its ">", which stands outside quotes if the quotes close, else the
    first one; -1 if there is none.

    ``dead`` holds the quotes of this page that were opened outside others on a way that found no end. A way that comes
    to one of them finds none either, so a page is read a few times at the most, however its quotes are set.
    """
    opened, i = [], at
    while m := _STOP.search(page, i):
        if m[0] == ">":
            return m.start()
        opened.append(m.start())
        i = -1 if m.start() in dead else page.find(m[0], m.end())
        if i < 0:
            break
        i += 1
    dead.update(opened)
    return page.find(">", at)


class Tree:
    """The block elements of a page in document order, parents before children, and its runs of text."""

    def __init__(self, page: str, masked: bool = False):
        self.tag, self.role, self.parent, self.main = ["html"], ["root"], [-1], [False]
        self.chars, self.linked = [0], [0]
        self.runs: list[tuple[int, str]] = []  # node, text as written; "" ends a block
        open_: list[tuple[str, int, int]] = []  # tag, node (of inline elements that of their block), links around
        named: Counter = Counter()  # open elements by tag
        node, links, at, end = 0, 0, 0, len(page)
        last = page.rfind(">")
        dead: set[int] = set()  # see tag_end
        endless: set[str] = set()  # elements whose end is not on the rest of the page
        while at < end:
            i = page.find("<", at)
            if i < 0:
                i = end
            if i > at:
                self._text(node, page[at:i], links)
            if i == end:
                break
            if page.startswith("<!--", i):
                j = page.find("-->", i + 2)  # "<!-->" and "<!--->" are comments without content
                at = end if j < 0 else j + 3
                continue
            m = None if i > last else _TAG.match(page, i)
            if m is None:
                if i + 1 < end and page[i + 1] in "!?/":
                    j = page.find(">", i)
                    at = end if j < 0 else j + 1
                else:
                    self._text(node, "<", links)
                    at = i + 1
                continue
            stop, tag = tag_end(page, m.end(), dead), m[2].lower()
            at, attributes = stop + 1, page[m.end() : stop]
            if m[1]:
                if named[tag]:
                    self._cut(open_, named, next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag))
                    before, (node, links) = node, open_[-1][1:] if open_ else (0, 0)
                    if before != node:
                        self.runs.append((node, ""))
                continue
            if tag in _SILENT:
                if tag in _RAW or tag == "head" or not attributes.endswith("/"):
                    close = None if tag in endless else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                    if close is not None:
                        at = page.find(">", close.start()) + 1 or end
                    else:
                        endless.add(tag)
                        body = re.compile(r"<body[\s>]", re.I).search(page, at) if tag == "head" else None
                        at = body.start() if body else end if tag in _RAW or tag == "head" else at
                continue
            if tag in _VOID:
                if tag in ("br", "hr"):
                    self.runs.append((node, " "))
                continue
            if tag in _CLOSES_P:
                self._end(open_, named, *_ENDS["p"])
            if tag in _ENDS and tag != "p":
                self._end(open_, named, *_ENDS[tag])
            up, links = open_[-1][1:] if open_ else (0, 0)
            if tag == "html":
                continue
            named[tag] += 1
            if tag not in _BLOCK:
                links += tag == "a"
                open_.append((tag, up, links))
                node = up
                continue
            node = len(self.tag)
            self.tag.append(tag)
            self.role.append(role_of(tag, attributes, masked))
            self.parent.append(up)
            self.main.append(self.main[up] or tag in ("article", "main"))
            self.chars.append(0)
            self.linked.append(0)
            open_.append((tag, node, links))
            self.runs.append((node, ""))

    @staticmethod
    def _cut(open_: list, named: Counter, k: int) -> None:
        named.subtract(t for t, _, _ in open_[k:])
        del open_[k:]

    @classmethod
    def _end(cls, open_: list, named: Counter, ended: frozenset, fence: frozenset) -> None:
        if not any(named[t] for t in ended):
            return
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in ended:
                cls._cut(open_, named, k)
                return
            if open_[k][0] in fence:
                return

    def _text(self, node: int, text: str, links: int) -> None:
        self.runs.append((node, text))
        n = len(text) - text.count(" ") - text.count("\n")
        self.chars[node] += n
        if links > 0:
            self.linked[node] += n

    def features(self) -> list[tuple[str, str, str]]:
        """Role, own text length and linked share of each node, in buckets."""
        out = []
        for role, n, a in zip(self.role, self.chars, self.linked):
            length = "0" if n == 0 else "1" if n < 25 else "2" if n < 80 else "3" if n < 300 else "4"
            out.append((role, "length " + length, "links " + ("-" if n == 0 else "0" if a == 0 else "1" if 2 * a < n else "2")))
        return out

    def texts(self) -> list[str]:
        """The text of each node's own runs, white space as one space."""
        out: list[list[str]] = [[] for _ in self.tag]
        for node, text in self.runs:
            out[node].append(text or " ")
        return [" ".join("".join(x).split()) for x in out]


#: Bounds on a log ratio, of length and links and of the role: labelled pages of one make agree too well.
LIMITS = (2.0, 5.0)
#: Least chance of a change of state from parent to child, for the same reason. An element that is there for
#: something else is bound by what the pages teach alone.
CHANGE = 0.05
#: Pseudo-counts: (feature, not content, content) and (parent's role, parent's state, child's state).
_OWN_PRIOR = {"away": (8, 0.05), "main": (0.5, 8), "root": (8, 0.5), "heading": (1, 2), "paragraph": (1, 4), "list": (4, 2), "cell": (2, 2), "box": (3, 2), "length 0": (4, 3), "length 1": (4, 2), "length 2": (2, 2), "length 3": (1, 4), "length 4": (0.5, 5), "links -": (2, 2), "links 0": (2, 6), "links 1": (2, 2), "links 2": (6, 0.5)}
_ROLES = ("away", "main", "root", "heading", "paragraph", "list", "cell", "box")
_PAIR_PRIOR = {(r, p, c): n for r in _ROLES for (p, c), n in {(0, 0): 8, (0, 1): 4 if r in ("root", "box") else 1, (1, 0): 1, (1, 1): 8}.items()} | {("away", p, c): (8, 1e-3)[c] for p in (0, 1) for c in (0, 1)}


class Model:
    """Log potentials of nodes, and potentials of parent and child."""

    def __init__(self, own: Counter, pair: Counter):
        counts = {f: [own[f, y] + _OWN_PRIOR[f][y] for y in (0, 1)] for f in _OWN_PRIOR}
        groups = [[f for f in counts if (f.partition(" ")[0] if " " in f else "role") == g] for g in ("role", "length", "links")]
        self.own: dict[str, float] = {}
        for group in groups:
            total = [sum(counts[f][y] for f in group) for y in (0, 1)]
            for f in group:  # log of the ratio content to not
                ratio = math.log(counts[f][1] / total[1]) - math.log(counts[f][0] / total[0])
                most = LIMITS[group[0] == "away"] * (4 if f == "away" else 1)
                self.own[f] = max(-most, min(most, ratio))
        self.own |= {"length 0": 0.0, "links -": 0.0}  # no text of its own says nothing either way
        self.pair: dict[str, tuple[float, float, float, float]] = {}
        for r in _ROLES:
            n = {k: pair[(r, *k)] + _PAIR_PRIOR[(r, *k)] for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
            a, b = n[0, 0] + n[0, 1], n[1, 0] + n[1, 1]
            to0, to1 = n[0, 1] / a, n[1, 1] / b
            if r != "away":
                to0, to1 = (min(max(x, CHANGE), 1 - CHANGE) for x in (to0, to1))
            self.pair[r] = (1 - to0, to0, 1 - to1, to1)
        self.pair["main"] = self.pair["box"]  # what names the article was a box while learning

    def marginals(self, tree: Tree) -> list[float]:
        """Chance of content for every node: sum-product up the tree, then down."""
        n = len(tree.parent)
        up = [(0.0, 0.0)] * n  # log messages to the parent's two states
        log0, log1 = [0.0] * n, [0.0] * n  # own potential and the children's messages
        for i, (a, b, c) in enumerate(tree.features()):
            # length and links tell the less the more the role says; halved, as they go together
            log1[i] = self.own[a] + 0.5 * (self.own[b] + self.own[c])
        for i in range(n - 1, 0, -1):
            p = tree.parent[i]
            f00, f01, f10, f11 = self.pair[tree.role[p]]
            top = max(log0[i], log1[i])
            e0, e1 = math.exp(log0[i] - top), math.exp(log1[i] - top)
            up[i] = (math.log(f00 * e0 + f01 * e1) + top, math.log(f10 * e0 + f11 * e1) + top)
            log0[p] += up[i][0]
            log1[p] += up[i][1]
        out = [0.0] * n
        down0, down1 = log0[:], log1[:]  # beliefs, parents first
        down0[0] += 5.0  # the page as a whole is not content
        for i in range(1, n):
            p = tree.parent[i]
            f00, f01, f10, f11 = self.pair[tree.role[p]]
            b0, b1 = down0[p] - up[i][0], down1[p] - up[i][1]  # without this child's own message
            top = max(b0, b1)
            e0, e1 = math.exp(b0 - top), math.exp(b1 - top)
            down0[i] += math.log(f00 * e0 + f10 * e1)
            down1[i] += math.log(f01 * e0 + f11 * e1)
        for i in range(n):
            out[i] = 1 / (1 + math.exp(min(700.0, down0[i] - down1[i])))
        return out


def main_text(page: str, model: Model) -> str:
    """Texts of the content blocks in page order, white space within a block as one space."""
    if not page:
        return ""
    tree = Tree(page)
    chance = model.marginals(tree)
    blocks, block, last = [], [], -1
    for node, text in tree.runs:
        if node != last or not text:
            if block:
                blocks.append("".join(block))
            block, last = [], node
        if text and chance[node] > 0.5:
            block.append(text)
    blocks.append("".join(block))
    return " ".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks if b) if t)


def train(pages: DataFrame, n_pages: int = TRAIN_PAGES) -> Model:
    """Count potentials on about ``n_pages`` pages, chosen by a hash of the page and taken whole.

    Only a few dozen counts reach the driver. Pages without a named article teach nothing.
    """
    usable = pages.select("html").filter(F.col("html").isNotNull())
    total = usable.count()
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit("train"), "html"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, n_pages / max(total, 1)))))
    feature = ["role", "length", "links"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, html_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = Tree(html_text, masked=True)
                if not any(tree.main):
                    continue
                n = len(tree.tag)
                texts = [hashlib.md5(t.encode()).digest() if t else None for t in tree.texts()]
                columns = list(zip(*tree.features()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(tree.parent, pa.int32()), pa.array(tree.main, pa.bool_()), pa.array(texts, pa.binary()), *(pa.array(c, pa.string()) for c in columns)],
                    ["page", "node", "parent", "main", "text", *feature],
                )

    numbered = chosen.select(F.xxhash64("html").alias("page"), "html").dropDuplicates(["page"])
    nodes = written(numbered.mapInArrow(listed, "page bigint, node int, parent int, main boolean, text binary, role string, length string, links string"), "nodes")
    often = nodes.filter("text is not null").select("page", "text").distinct().groupBy("text").agg(F.count("*").alias("n")).filter(F.col("n") >= RECURS).select("text", F.lit(True).alias("often"))
    known = nodes.join(often, "text", "left").select("page", "node", "parent", *feature, (F.col("main") & F.col("often").isNull()).alias("y"))
    above = known.select("page", F.col("node").alias("parent"), F.col("role").alias("above"), F.col("y").alias("p"))
    both = known.join(above, ["page", "parent"], "left")
    counts = both.filter("node > 0").groupBy(*feature, "above", "p", "y").agg(F.count("*").alias("n"))
    own, pair = Counter(), Counter()
    for r in counts.collect():  # at most a few hundred combinations
        for name in feature:
            own[r[name], int(r["y"])] += r["n"]
        pair[r["above"], int(r["p"]), int(r["y"])] += r["n"]
    return Model(own, pair)


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    The whole html is read; null counts as empty, and a page without content has an empty text. Repeated
    rows give repeated rows; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.utf8_length(batch.column(2)), 0).to_pylist()
            for i, j in slices(sizes, SLICE_CHARS):
                texts = [main_text(t or "", model) for t in batch.column(2)[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars bigint")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: a row for each row of ``pages``.

    A null or empty html has an empty text, and so has a page without content; pages of any length are read
    whole; a block that is as likely content as not is left out; repeated rows give equal rows; an empty table
    gives none; no other column is read, whatever its name.
    """
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, train(pages))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLE: dict[str, str] = {}
