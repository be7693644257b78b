"""Main text of HTML pages by wrapper induction.

Pages of one host and layout (the labels below body) come from one template. One page of each is its
reference; every other page's DOM tree, with runs of like siblings folded into one node, is aligned
with the reference's by simple tree matching (the largest order-preserving match of nodes with equal
labels). Spark counts, for each reference node, on how many pages it stands, with how many different
texts, and how much text those are. That is the wrapper:

- Nodes whose text is the same, or hardly changes where others do, are template.
- A node that holds most of the changing text is where the content is, so a class word like sidebar
  or a form around it means its layout only.
- Tags, roles and class words mark the rest: menus, notices, adverts, comments. If article or main
  elements hold the heading or most of the text, the content is in there; if not, they are teasers.

Pages never meet in one task: alignment is page by page against a reference that a join brings. The
references are written first, so Spark knows their size before it plans the join: it broadcasts them
below its threshold and shuffles beyond it.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_by_bytes, written

# HTML elements by what they mean here.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby s samp small span strike strong sub sup time tt u var wbr br "
    "math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "canvas", "annotation")
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
MAIN_TAGS = ("article", "main")
# Marks of asides. Strong ones give way to a main element or heading inside, weak ones also to the wrapper.
STRONG_TAGS = frozenset("head nav footer button select dialog menu input label".split())
WEAK_TAGS = frozenset("aside form header".split())
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr menu menubar nav navbar "
    "navigation newsletter outbrain pager pagination replies reply respond sitemap skip sponsor sponsored subscribe taboola".split()
)
WEAK_WORDS = frozenset(
    "banner banners header masthead modal notice notices notification popup promo promoted promotion recommended related share sharing sidebar social toolbar topbar widget widgets".split()
)
#: Words for readers' answers that may also name a part of an article; inside a main element they say nothing.
ANSWER_WORDS = frozenset("discussion responses".split())
#: Words that only place or frame a thing. A mark joined to any other word (ad-hoc, editor-comment, menu-plan) names something else.
FRAME_WORDS = frozenset(
    "area article bar block bottom box boxes btn button card center col column container content count cta desktop drawer entry fixed float form global grid group head heading holder icon inline inner item items js "
    "label layer left level line link links list lists main mobile module nested new note outer page pane panel placeholder policy popup post posts primary right row secondary section sections settings side signup "
    "site slot small sticky story sub tag tags text thread title toggle top unit user users view widget wrap wrapper zone".split()
)
#: Elements whose text is prose even if all of it is a link.
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption td".split())
FORM_TAGS = frozenset("form fieldset".split())
STRONG_ROLES = frozenset("navigation contentinfo search dialog alert".split())
WEAK_ROLES = frozenset("banner complementary form".split())
#: A class that begins so is about the layout around such a thing.
LAYOUT = frozenset("has with no without layout".split())
#: Elements nested deeper are read as blocks of their ancestor at that depth; so many groups of children are matched in order, more are grouped by label.
DEPTH, GROUPS = 200, 64

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<svg\b[^>]*/>|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|[^>]*(?:>|\Z))",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?![\w\-])", re.I)
UNSEEN = re.compile(r"\b(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")


def marked(words: list[str], marks: frozenset[str]) -> bool:
    """Whether a name's words are one of the marks, alone or with other marks and words that frame it; digits and single letters do not count."""
    return not marks.isdisjoint(words) and all(len(w) == 1 or w in FRAME_WORDS or w in STRONG_WORDS or w in WEAK_WORDS or w in ANSWER_WORDS for w in words)


class Node:
    """An element: label for matching, marks, children (nodes and texts), and the folded node it belongs to."""

    __slots__ = ("children", "folded", "heading", "hidden", "label", "main", "strong", "tag", "weak")

    def __init__(self, tag: str, attributes: str = "", in_main: bool = False):
        self.tag, self.children, self.folded, self.heading, self.main, self.hidden = tag, [], -1, False, False, False
        self.strong, self.weak = tag in STRONG_TAGS, tag in WEAK_TAGS and not (tag == "header" and in_main)
        first = ""
        if attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                if key.lower() == "role":
                    self.strong |= value in STRONG_ROLES
                    self.weak |= value in WEAK_ROLES
                    continue
                if key.lower() == "style":
                    self.hidden |= UNSEEN.search(value) is not None
                    continue
                first = first or "-".join(WORD.findall(value))
                for name in value.split():
                    words = WORD.findall(name)
                    if words and words[0] not in LAYOUT:
                        self.strong |= marked(words, STRONG_WORDS)
                        self.weak |= marked(words, WEAK_WORDS) or not in_main and marked(words, ANSWER_WORDS)
            if "hidden" in attributes.lower():
                self.hidden |= HIDDEN.search(QUOTED.sub("", attributes)) is not None
        self.label = f"{tag}.{first}" if first else tag

    def aside(self, rich: set[int]) -> bool:
        """Whether it is none of the content; rich has the folded nodes that hold most of the changing text."""
        if self.tag in ("html", "body"):
            return False
        if self.hidden:
            return True
        if self.tag in MAIN_TAGS:
            return self.strong and not self.heading
        if self.strong:
            return not self.main and not (self.heading and self.tag not in STRONG_TAGS)
        return self.weak and not self.main and not (self.heading and self.tag != "header") and self.folded not in rich


class Link(str):
    """A piece of text inside a link."""


END = "\0"  # between blocks of one node


def parse(page: str) -> Node:
    """The DOM of a page; raw elements and inline ones that are no asides leave no node, and open elements end where the page does."""
    root = Node("html")
    stack, deep, at, link = [root], [], 0, False
    for m in TAG.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            stack[-1].children.append(Link(text) if link else text)
        at = m.end()
        if not m["tag"]:
            continue
        tag, end, inline = m["tag"].lower(), m["end"], False
        if tag in INLINE or tag == "label" and FORM_TAGS.isdisjoint(x.tag for x in stack):
            if tag == "br":
                stack[-1].children.append(" ")
            if tag == "a":
                link = not end
            inside = any(x.tag == tag for x in stack)  # of an inline aside, so its end has to be found
            inline = not end and (inside or bool(m["attributes"])) and tag not in VOID
            node = Node(tag, m["attributes"]) if inline else None
            if inline and tag == "label":
                node.strong = False
            if not (inside and end) and not (inline and (inside or node.strong or node.hidden)):
                continue
        if end:
            if tag == "html" or tag == "body":
                continue
            if tag not in INLINE and tag != "label":
                link = False
            if tag in deep:
                while deep.pop() != tag:
                    pass
                stack[-1].children.append(END)
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    deep = []
                    break
            continue
        closing = CLOSES.get(tag, ()) if not inline else ()
        if tag in ENDS_P and "p" not in closing:
            closing = (*closing, "p")
        while not deep and len(stack) > 1 and stack[-1].tag in closing:
            stack.pop()
        if tag == "html":
            continue
        if tag == "body" and stack[-1].tag == "head":
            stack.pop()
        if len(stack) > DEPTH:
            stack[-1].children.append(END)
            if tag not in VOID:
                deep.append(tag)
            continue
        if not inline:
            node = Node(tag, m["attributes"], any(x.tag in MAIN_TAGS for x in stack))
        if tag == "h1" or tag in MAIN_TAGS and not node.strong:
            for x in stack:
                x.heading, x.main = x.heading or tag == "h1", x.main or tag != "h1"
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


Tree = tuple[str, list]  # label, children; written as JSON


def groups_of(nodes: list[Node]) -> list[list[Node]]:
    """The child nodes of nodes in groups with equal labels: runs, or all of a label where the runs are too many."""
    runs: list[list[Node]] = []
    for n in nodes:
        for c in n.children:
            if isinstance(c, Node):
                if runs and runs[-1][0].label == c.label:
                    runs[-1].append(c)
                else:
                    runs.append([c])
    if len(runs) <= GROUPS:
        return runs
    by_label: dict[str, list[Node]] = {}
    for r in runs:
        by_label.setdefault(r[0].label, []).extend(r)
    return list(by_label.values())


def fold(node: Node) -> Tree:
    """The tree for matching: siblings of a group become one node, with their children in a row, folded again. Depth is at most DEPTH."""
    numbered = 0

    def fold_all(nodes: list[Node]) -> Tree:
        nonlocal numbered
        for n in nodes:
            n.folded = numbered
        numbered += 1
        return (nodes[0].label, [fold_all(group) for group in groups_of(nodes)])

    return fold_all([node])


def sized(tree: Tree) -> tuple[str, list, int]:
    children = [sized(c) for c in tree[1]]
    return tree[0], children, 1 + sum(c[2] for c in children)


def starts(children: list, number: int) -> list[int]:
    """The preorder numbers of the children of the node with that number."""
    out, at = [], number + 1
    for c in children:
        out.append(at)
        at += c[2]
    return out


def simple_tree_matching(a: Tree, b: Tree) -> dict[int, int]:
    """The nodes of a (numbered in preorder) that match nodes of b, roots first, order kept, most nodes matched."""

    def match(x, y, nx: int, ny: int) -> tuple[int, list[tuple[int, int]]]:
        if x[0] != y[0]:
            return 0, []
        xs, ys, pairs, total = x[1], y[1], [(nx, ny)], 1
        px, py = starts(xs, nx), starts(ys, ny)
        if [c[0] for c in xs] == [d[0] for d in ys] and len({c[0] for c in xs}) == len(xs):  # one way to match them all
            for c, d, i, j in zip(xs, ys, px, py):
                w, own = match(c, d, i, j)
                total, pairs = total + w, pairs + own
            return total, pairs
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        for i, c in enumerate(xs):
            row, above = best[i + 1], best[i]
            for j, d in enumerate(ys):
                w = 0
                if c[0] == d[0]:
                    found[i, j] = match(c, d, px[i], py[j])
                    w = found[i, j][0]
                row[j + 1] = max(above[j + 1], row[j], above[j] + w)
        i, j = len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs += found[i, j][1]
        return best[-1][-1] + total, pairs

    return dict(match(sized(a), sized(b), 0, 0)[1])


def layout(tree: Tree) -> str:
    """The labels below body, each once: pages of a host with equal ones share a reference."""
    body = next((c for c in tree[1] if c[0].split(".")[0] == "body"), tree)
    return " ".join(dict.fromkeys(c[0] for c in body[1]))


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def blocks(node: Node, gone: set[int], rich: set[int], out: list[tuple[str, bool, float]], inside: bool) -> None:
    """Appends (text, whether inside a main element, share of link text) of the blocks under node that are not asides, in page order."""
    if node.folded in gone or node.aside(rich):
        return
    inside = inside or node.tag in MAIN_TAGS
    run: list[str] = []
    for c in [*node.children, END]:
        if isinstance(c, Node):
            if c.tag in INLINE or c.tag == "label" and c.hidden:  # an inline aside: what stands around it is one block
                continue
        elif c is not END:
            run.append(c)
            continue
        if run:
            text = clean("".join(run))
            if text:
                linked = 0 if node.tag in PROSE_TAGS else sum(len(x) for x in run if isinstance(x, Link))
                out.append((text, inside, linked / max(1, sum(map(len, run)))))
        run = []
        if isinstance(c, Node):
            blocks(c, gone, rich, out, inside)


#: Outside of main elements, blocks with more link text than this are menus.
LINKED = 0.8


def content(root: Node, gone: set[int], rich: set[int]) -> list[str]:
    """The page's content blocks: those inside main elements if they hold the heading or most of the text, else the others."""
    found: list[tuple[str, bool, float]] = []
    blocks(root, gone, rich, found, False)
    held = [sum(len(t) for t, inside, linked in found if inside == where and linked <= LINKED) for where in (True, False)]
    heads = any(n.heading for n in main_nodes(root))
    if any(inside for _, inside, _ in found) and (heads or held[0] >= held[1]):
        return [t for t, inside, _ in found if inside]
    outside = [(t, linked) for t, inside, linked in found if not inside]
    return [t for t, linked in outside if linked <= LINKED] or [t for t, _ in outside]


def main_nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in MAIN_TAGS and not node.strong:
            yield node
        stack += [c for c in node.children if isinstance(c, Node)]


def slots(root: Node) -> dict[int, str]:
    """All text of each folded node's own blocks, asides included."""
    texts: dict[int, list[str]] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        for c in reversed(node.children):
            if isinstance(c, Node):
                stack.append(c)
            elif c is not END and c.strip():
                texts.setdefault(node.folded, []).append(c)
    return {k: " ".join(v) for k, v in texts.items()}


#: A node is template if it stands on so many pages (inside main elements, on so many) with one text, or with at most this share of the different texts of the most varying node.
LEAST_PAGES, LEAST_IN_MAIN, CONSTANT_SHARE = 2, 5, 0.1


class Wrapper:
    """Of a host's layout: the reference's tree, its template nodes, and those that hold most of the changing text."""

    def __init__(self, tree: Tree, stats: list[list[int]]):
        self.tree, self.gone, self.rich = tree, set(), set()
        at, main, parent = 0, [], []
        stack = [(tree, False, -1)]
        while stack:  # in preorder
            node, inside, above = stack.pop()
            inside = inside or node[0].split(".")[0] in MAIN_TAGS
            main.append(inside)
            parent.append(above)
            stack += [(c, inside, at) for c in reversed(node[1])]
            at += 1
        varying = [texts / pages for _, pages, texts, _ in stats if texts > 1]
        most = max(varying, default=0.0)
        held = [0] * len(main)
        for n, pages, texts, size in stats:
            if most and pages >= (LEAST_IN_MAIN if main[n] else LEAST_PAGES) and (texts == 1 or pages >= LEAST_IN_MAIN and texts / pages <= CONSTANT_SHARE * most):
                self.gone.add(n)
            else:
                held[n] = size
        for n in range(len(held) - 1, 0, -1):
            held[parent[n]] += held[n]
        self.rich = {n for n, size in enumerate(held) if 2 * size > held[0]}


def main_text(root: Node, tree: Tree, wrapper: Wrapper) -> str:
    """The main text of a page under its layout's wrapper."""
    pairs = simple_tree_matching(tree, wrapper.tree)
    gone, rich = ({n for n, r in pairs.items() if r in of} for of in (wrapper.gone, wrapper.rich))
    return "\n".join(content(root, gone, rich))


HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: References that a task holds before it hands them on.
HELD = 20_000


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), HOST, 1), F.lit("")))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"), host.alias("host"))


def read(page: bytes | None) -> tuple[Node, Tree]:
    root = parse((page or b"").decode("utf-8", "replace"))
    return root, fold(root)


PARSED = "page_id long, url string, host string, layout string, html binary, k long, tree string"


def parsed(rows: DataFrame) -> DataFrame:
    """rows with their layout, and rows (host, layout, k, tree): for each layout a task has met, the folded tree of the page with the least hash k."""
    names = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[int, str]] = {}

        def out() -> pa.RecordBatch:
            columns = [[h for h, _ in held], [x for _, x in held], [k for k, _ in held.values()], [t for _, t in held.values()]]
            host, label, k, tree = (pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string())))
            return pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.string()), host, label, pa.nulls(len(held), pa.binary()), k, tree], names)

        for part in groups_by_bytes(batches, "html"):
            labels = []
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                tree = read(page)[1]
                labels.append(layout(tree))
                key, k = (host, labels[-1]), zlib.crc32(page or b"")
                if key not in held or k < held[key][0]:
                    held[key] = (k, json.dumps(tree))
            none = [pa.nulls(len(labels), pa.int64()), pa.nulls(len(labels), pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(labels, pa.string()), part.column("html"), *none], names)
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return rows.mapInArrow(run, PARSED)


class Known:
    """What is told about layouts, read from JSON once in a task; a bounded store."""

    def __init__(self, make, kept: int = 2000):
        self.make, self.kept, self.held = make, kept, {}

    def get(self, host: str, label: str, told: str):
        if (host, label) not in self.held:
            if len(self.held) > self.kept:
                self.held.clear()
            self.held[host, label] = self.make(told)
        return self.held[host, label]


KEY = ["host", "layout"]


def slot_counts(pages: DataFrame, trees: DataFrame) -> DataFrame:
    """Rows (host, layout, node, pages, texts, size): for each reference node with text, its pages, different texts and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(json.loads)
        for part in groups_by_bytes(batches, "html"):
            out = []
            for host, label, page, told in zip(*(part.column(c).to_pylist() for c in (*KEY, "html", "tree"))):
                root, tree = read(page)
                pairs = simple_tree_matching(tree, known.get(host, label, told))
                out += [(host, label, pairs[n], zlib.crc32(t.encode("utf-8", "replace")), len(t)) for n, t in slots(root).items() if n in pairs]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*KEY, "node", "text", "size"])

    found = pages.join(trees, KEY).select(*KEY, "html", "tree").mapInArrow(run, "host string, layout string, node int, text long, size long")
    one = found.groupBy(*KEY, "node", "text", "size").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy(*KEY, "node").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("texts"), F.sum(F.col("size") * F.col("n")).alias("size"))


def wrappers(pages: DataFrame, trees: DataFrame) -> DataFrame:
    """Rows (host, layout, told): JSON of the reference's tree and its nodes' counts."""
    numbers = F.array(*[F.col(c).cast("long") for c in ("node", "pages", "texts", "size")])
    stats = slot_counts(pages, trees).groupBy(*KEY).agg(F.to_json(F.sort_array(F.collect_list(numbers))).alias("stats"))
    return trees.join(stats, KEY, "left").select(*KEY, F.concat(F.lit("["), "tree", F.lit(", "), F.coalesce("stats", F.lit("[]")), F.lit("]")).alias("told"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null or empty html gives an empty text. A url without a host, or a null one, belongs to the
    host "". Repeated rows are answered one by one; a null page_id stays null. Columns other than
    page_id, url and html are not read. An empty table gives an empty result. Invalid bytes become
    U+FFFD. Whole pages are read; nothing but asides, template nodes and markup is dropped. Elements
    nested deeper than DEPTH are read as blocks of their ancestor at that depth.
    """
    both = written(parsed(with_host(pages)), "parsed")
    rows = both.where("tree is null").drop("k", "tree")
    trees = written(both.where("tree is not null").groupBy(*KEY).agg(F.min_by("tree", F.struct("k", "tree")).alias("tree")), "trees")
    told = rows.join(written(wrappers(rows, trees), "wrappers"), KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(lambda text: Wrapper(*json.loads(text)))
        for part in groups_by_bytes(batches, "html"):
            texts = []
            for host, label, page, wrapper in zip(*(part.column(c).to_pylist() for c in (*KEY, "html", "told"))):
                texts.append(main_text(*read(page), known.get(host, label, wrapper)))
            lengths = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    return told.select("page_id", "url", *KEY, "html", "told").mapInArrow(run, "page_id long, url string, text string, n_chars long")
