"""Main text of web pages: flat text blocks, classified by a decision tree over each block and its neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_prefix, text_slices, texts

#: Comments, CDATA, tags, other markup. In a tag a quote opens a value only behind "=", so that a stray one cannot reach over the tag's end.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>="']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")  # <p/>, but not <a href=/>
# Element names of HTML.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SILENT = {"script", "style", "head", "title", "template", "textarea", "select", "option", "button", "input", "svg", "math", "iframe", "object", "canvas", "audio", "video", "noembed", "noframes", "xmp", "datalist", "noscript"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_ASIDE = {"nav", "header", "footer", "aside", "menu", "dialog", "fieldset"}
_IN_HEAD = {"head", "title", "base", "link", "meta", "style", "script", "template", "noscript", "noframes"}
_FLOW = {"p", "div", "article", "section", "main", "body", "table", "ul", "ol", "dl", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "header", "footer", "nav", "aside", "form"}
_FIELDS = {"input", "select", "textarea", "button"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "article", "section", "aside", "nav", "header", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "main", "figure", "hr", "dl", "fieldset", "address", "details", "menu"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
_SCOPE = {"p": {"td", "th", "article", "section", "body"}, "li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
#: Words in class, id, role and label values that tell of page furniture.
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adbox|adslot|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|header|masthead|topbar|footer|foot|copyright|sidebar\w*|side|aside|rail|widget\w*|related\w*|recommend\w*|popular|trending|comment\w*|respond|reply|replies|disqus\w*|discussion|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login|search\w*|share|sharing|social\w*|toolbar|pagination|pager|tags?|taglist|skip\w*|complementary|contentinfo|navigation|alert|dialog)(?:$|[\s_-])", re.I
)
#: Those of them that also name wrappers of whole pages: search-result-page, page-header-wrap, modal-page, login-layout.
_LOOSE = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|banner|search\w*|side|rail|foot|notice\w*|popup|modal|overlay|alert|dialog|login|signup|subscri\w*|toolbar|tags?|skip\w*|popular|trending|promo\w*)(?:$|[\s_-])", re.I)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text|articlebody)(?:$|[\s_-])", re.I)
#: What a class says about the page's layout or leaves out: no-sidebar, has-sidebar, with-comments.
_MODIFIER = re.compile(r"(?<![^\s_-])(?:no|has|with|without)[_-]\S*", re.I)
#: A form is a page's wrapper, not furniture, from so many words in blocks of prose on.
FORM_PROSE = 40
#: Head of an article, not of the page.
_OWN_HEADER = re.compile(r"(?:entry|post|article)[_-]header", re.I)

NAMES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_furniture", "in_article", "page_has_article", "heading"]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    article: bool
    heading: bool
    form: int = -1  # the outermost form that it is in and that nothing else has judged


def label_mark(given: dict[str, str]) -> str:
    """What an element's labels make of its text: a role decides, then a class or id of content, then words of furniture, then of content.

    A class that has words of both, as sidebar-content, is furniture; text and body alone do not outweigh another class. Furniture
    by no other than _LOOSE words is loose.
    """
    role, others = given.get("role", ""), given.get("aria-label", "")
    names = _MODIFIER.sub("", " ".join(given.get(x, "") for x in ("class", "id", "itemprop"))).split()
    if _FURNITURE.search(role):
        return "furniture"
    if any(_OWN_HEADER.fullmatch(x) or (_CONTENT.search(x) and not _FURNITURE.search(x) and x.lower() not in ("text", "body")) for x in names):
        return "article"
    labels = " ".join([*names, role, others])
    if _FURNITURE.search(labels):
        return "furniture" if any(_FURNITURE.search(x) and not _LOOSE.search(x) for x in labels.split()) else "loose"
    return "article" if _CONTENT.search(labels) else ""


class _Open:
    """The open elements, with running counts of what they make of their text: a tag costs the same at any depth.

    Beside its own mark an element has a state, which is what counts for its text: that of the nearest mark, but
    furniture that is not loose stays furniture inside.
    """

    def __init__(self):
        self.stack: list[tuple[str, str]] = []
        self.state: list[tuple[str, int]] = []  # (furniture, loose, article or none, form)
        self.count = Counter()  # open elements by mark; "link" and "heading" too
        self.places: dict[str, list[int]] = defaultdict(list)  # by name; "#block" for all that are not inline
        self.forms: list[int] = []  # number of fields in each form

    def _kinds(self, name: str, mark: str) -> list[str]:
        return [mark] * bool(mark) + ["link"] * (name == "a") + ["heading"] * (name in _HEADING)

    @property
    def now(self) -> tuple[str, int]:
        return self.state[-1] if self.state else ("", -1)

    def push(self, name: str, mark: str) -> None:
        self.places[name].append(len(self.stack))
        if name not in _INLINE:
            self.places["#block"].append(len(self.stack))
        self.count.update(self._kinds(name, mark))
        state, form = self.now
        if state != "furniture" and mark in ("furniture", "loose", "article"):
            state = mark
            form = -1 if mark == "article" else form
        if name == "form" and form < 0 and state in ("", "article"):
            self.forms.append(0)
            form = len(self.forms) - 1
        self.stack.append((name, mark))
        self.state.append((state, form))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, mark = self.stack.pop()
            self.state.pop()
            if name:
                self.places[name].pop()
            if name and name not in _INLINE:
                self.places["#block"].pop()
            self.count.subtract(self._kinds(name, mark))

    def last(self, name: str) -> int:
        return self.places[name][-1] if self.places.get(name) else -1

    def end_inline(self, depth: int) -> None:
        """An inline element that is closed inside a block: the block stays open, and so does what the element's labels say."""
        name, mark = self.stack[depth]
        self.places[name].remove(depth)
        self.count.subtract(self._kinds(name, ""))
        self.stack[depth] = ("", mark)


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page in order. Markup may be broken; unknown and unclosed tags are tolerated.

    A head without an end tag ends at the first text or element that cannot stand in it, an open select at the next block.
    A form is furniture if it is inside furniture or holds fields and under FORM_PROSE words of prose.
    """
    out: list[Block] = []
    elements = _Open()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            has, n = elements.count, text.count(" ") + 1
            state, form = elements.now
            out.append(Block(text, n, min(linked, n), state in ("furniture", "loose"), has["article"] > 0, has["heading"] > 0, form))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and elements.stack and elements.stack[-1][0] == "head" and not raw.isspace():
            close(len(elements.stack) - 1)
        if raw and not elements.count["silent"]:
            text = html.unescape(raw)
            parts.append(text)
            if elements.count["link"]:
                linked += len(text.split())

    def close(depth: int) -> None:
        if elements.last("#block") >= depth:
            flush()
        elements.pop_to(depth)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        token = m.group()
        if token.startswith("<![CDATA["):
            add(html.escape(token[9:].removesuffix("]]>")))
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            depth = elements.last(name)
            if depth < 0:
                if name not in _INLINE:
                    flush()
            elif name in _INLINE and elements.last("#block") > depth:
                elements.end_inline(depth)
            else:
                close(depth)
            continue
        if elements.places.get("head") and name not in _IN_HEAD:
            close(elements.last("head"))
        if name in _FLOW and elements.places.get("select"):
            close(elements.last("select"))
        for ended, by in _CLOSED_BY.items():
            if name in by and elements.last(ended) > max((elements.last(x) for x in _SCOPE.get(ended, ())), default=-1):
                close(elements.last(ended))
        if name == "br" or name not in _INLINE:
            flush()
        if name == "br":
            continue
        if name in _FIELDS and elements.now[1] >= 0:
            elements.forms[elements.now[1]] += 1
        given: dict[str, str] = {}
        for key, value in _ATTRIBUTE.findall(m[3]) if "=" in m[3] or "hidden" in m[3].lower() else ():
            given.setdefault(key.lower(), value.strip("\"'"))
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I)
        label, mark = label_mark(given) if given else "", ""
        if name in _SILENT or hidden:
            mark = "silent"
        elif name in ("html", "body"):
            mark = ""
        elif name in _ASIDE and not (name == "header" and (label == "article" or elements.count["article"])):
            mark = "loose" if name in ("header", "fieldset") and label in ("", "loose") else "furniture"
        elif name in ("article", "main"):
            mark = "article"
        elif not (label in ("furniture", "loose") and name in _INLINE and name != "span"):
            mark = label
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in _VOID and not _CLOSED.search(m[3]):
            elements.push(name, mark)
    flush()
    prose = [0] * len(elements.forms)
    for b in out:
        if b.form >= 0 and b.words >= 10 and 2 * b.linked < b.words:
            prose[b.form] += b.words
    for b in out:
        if b.form >= 0 and prose[b.form] < FORM_PROSE and (elements.forms[b.form] or not b.article):
            b.furniture = True
    return out


def block_features(blocks: list[Block]) -> np.ndarray:
    """NAMES of every block; neighbours beyond the page's ends count as empty."""
    words = np.array([0, *(b.words for b in blocks), 0], float)
    density = np.array([0, *(b.linked / b.words for b in blocks), 0], float)
    somewhere = any(b.article for b in blocks)
    flags = np.array([(b.furniture, b.article, somewhere, b.heading) for b in blocks], float).reshape(len(blocks), 4)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], flags])


# The labelled table: small pages, written for this operator. A number in braces stands for so many words of prose; a block
# that begins with a pilcrow is main text. The first pages tell by nothing but their words and links, and by those of the
# blocks around; the others also by elements and class names.
_MENU = "<div><a href=/>{1}</a></div><div><a href=/b>{2}</a></div><div><a href=/c>{1}</a></div>"
LABELLED = [
    _MENU + "<div>¶{6}</div><div>¶{45}</div><div>¶{4}</div><div>¶{60}</div><div>¶{9}</div><div>¶{38}</div>" + _MENU,
    "<table><tr><td><a href=/>{2}</a></td><td>{2}</td><td><a href=/c>{3}</a></td></tr><tr><td>¶{7}</td></tr><tr><td>¶{80}</td></tr><tr><td>¶{3}</td></tr><tr><td>¶{52}</td></tr><tr><td><a href=/d>{4}</a></td><td>{3}</td><td><a href=/e>{2}</a></td></tr></table>",
    "<div><a href=/>{3}</a></div><div>{1}</div><div><a href=/b>{4}</a></div><div>{2}</div><div><a href=/c>{2}</a></div><h1>¶{8}</h1><p>¶{33}</p><p>¶{12}</p><p>¶{5}</p><p>¶{70}</p>",
    "<p>¶{55}</p><p>¶{14}</p><p>¶{90}</p><p>¶{2}</p><p>¶{40} <a href=/x>{2}</a></p>",
    _MENU + "<p>{5}</p>" + _MENU + "<h2>¶{5}</h2><p>¶{26}</p><p>¶{17}</p><p>¶{31} <a href=/y>{4}</a></p>" + _MENU + "<p>{6}</p>" + _MENU,
    "<div><a href=/1>{9}</a> {1}</div><div><a href=/2>{8}</a> {2}</div><div><a href=/3>{11}</a></div><div>¶{10}</div><div>¶{64}</div><div>¶{6}</div><div>¶{48}</div><div><a href=/4>{10}</a> {1}</div><div><a href=/5>{12}</a></div>",
    _MENU + "<div>¶{42}</div><div>¶{3}</div><div>¶{50} <a href=/x>{1}</a></div><div>¶{28}</div><div>¶{2}</div><div>¶{61}</div>" + _MENU,
    "<p>¶{25} <a href=/x>{3}</a></p><p>¶{18}</p><p>¶{2}</p><p>¶{34} <a href=/y>{2}</a> {9}</p><p>¶{3}</p><p>¶{22}</p>",
    _MENU + "<h2>¶{3}</h2><div>¶{36}</div><div>¶{2}</div><div>¶{19}</div>" + _MENU + "<div>{2}</div>" + _MENU,
    "<div>{4}</div>" + _MENU + "<div>¶{5}</div><div>¶{60}</div><div>¶{3}</div>" + _MENU + "<div>{5}</div><div><a href=/z>{2}</a></div>",
    "<p>{3}</p>" + _MENU + "<p>¶{31}</p><p>¶{6}</p><p><a href=/m>{3}</a></p><p>{6}</p><p><a href=/n>{2}</a></p><p>{8}</p><p><a href=/o>{2}</a></p>",
    "<td>{2}</td><td><a href=/u>{2}</a></td><td>{5}</td><td><a href=/v>{1}</a></td><tr><td>¶{24}</td></tr><tr><td>¶{40}</td></tr><tr><td>¶{5}</td></tr><tr><td><a href=/w>{3}</a></td></tr>",
    _MENU + "<p>¶{70}</p>" + _MENU + "<p>{4}</p>" + _MENU,
    _MENU + "<h2>¶{4}</h2><p>¶{40} <a href=/x>{2}</a></p><p>¶{30}</p><p><a href=/m>{3}</a></p><p>{3}</p><p><a href=/n>{4}</a></p><p>{7}</p><p><a href=/o>{2}</a></p>",
    "<p>¶{20}</p>",
    "<p>¶{3}</p>",
    "<h1>¶{4}</h1><p>¶{9}</p><p>¶{7}</p>",
    _MENU + "<div>{4}</div><div><a href=/q>{3}</a> {1}</div><div>{3}</div>" + _MENU + "<div>¶{41}</div><div>¶{8}</div><div>¶{29}</div>",
    "<nav><ul><li><a href=/>{1}</a><li><a href=/b>{2}</a></ul></nav><div class=ad>{9}</div><article><h1>¶{8}</h1><p>¶{60}</p><p>¶{3}</p><p>¶{1}</p><p>¶{80} <a href=/x>{2}</a></p></article><footer>{14}</footer>",
    "<header><a href=/>{1}</a><p>{12}</p></header><main><h1>¶{5}</h1><p>¶{2}</p><ul><li><a href=/x>¶{1}</a><li><a href=/y>¶{4}</a></ul><aside><a href=/z>{30}</a></aside><section class=comments><p>{90}</p></section></main><footer>{12}</footer>",
    "<div class=cookie-notice>{100}</div><div class=newsletter>{200}</div><article><h2>¶{12}</h2><p>¶{20}</p><div class=related>{40}</div><p>¶{6}</p></article><form>{6}</form>",
    "<div>{5}</div><div>{30}</div><article><h1>¶{9}</h1><p>¶{64}</p><p>¶{17}</p></article><div>{11}</div><div>{25}</div>",
    "<div class=banner>{45}</div><h1>¶{6}</h1><p>¶{80}</p><p><a href=/n>{12}</a></p><p>¶{22}</p><div class=sidebar>{50}</div>",
    "<div><a href=/>{2}</a></div><article><h1>¶{6}</h1><p>¶{20} <a href=/x>{2}</a></p><p>¶{3}</p><p>¶{2}</p><p><a href=/q>¶{3}</a></p><p>¶{4}</p><p>¶{1}</p></article>",
    "<article><ul><li><a href=/x>¶{9}</a></li><li>¶{2}</li><li><a href=/y>¶{30}</a></li><li>¶{1}</li></ul><p>¶{12} <a href=/x>{9}</a></p><p>¶{30}</p><p>¶{1}</p></article><div><a href=/>{2}</a></div>",
    "<nav><a href=/>{2}</a></nav><article><p>¶{40} <a href=/x>{5}</a></p><p>¶{6}</p><p>¶{3}</p><p><a href=/y>¶{6}</a></p><p>¶{2}</p><p><a href=/z>¶{18}</a></p><p>¶{3}</p></article>",
    "<article><p>¶{2}</p><div class=related><a href=/r>{20}</a></div><p>¶{60}</p><p><a href=/s>¶{7}</a></p><p>¶{50}</p><ul><li><a href=/x>¶{5}</a><li><a href=/y>¶{9}</a></ul><div class=share><a href=/z>{2}</a></div><p>¶{44}</p><p><a href=/w>¶{12}</a></p></article>",
    "<main><p><a href=/a>¶{3}</a></p><p>¶{2}</p><p><a href=/b>¶{4}</a></p><p>¶{7}</p><p><a href=/c>¶{2}</a></p><p>¶{30}</p><p><a href=/d>¶{1}</a></p><p>¶{3}</p><p><a href=/e>¶{2}</a></p><div class=tags><a href=/t>{1}</a></div><div class=tags><a href=/t>{4}</a></div></main>",
    "<article><h1><a href=/a>¶{7}</a></h1><p>¶{3}</p><p><a href=/b>¶{5}</a></p><p>¶{1}</p><div class=menu><a href=/c>{2}</a></div><p>¶{4}</p><p><a href=/d>¶{8}</a></p></article><div><a href=/e>{9}</a></div><div>{2}</div><div><a href=/f>{3}</a></div>",
    "<article><p>¶{3}</p><h2>¶{6}</h2><p>¶{8}</p><p>¶{5}</p></article>",
    "<div class=topbar>{4}</div><div class=entry-content><h1>¶{7}</h1><p>¶{5}</p><p>¶{70}</p><p>¶{85}</p><div class=share><a href=/s>{20}</a></div><div class=comments><p>{25}</p></div></div><div class=footer>{6}</div>",
    "<nav><a href=/>{6}</a></nav><main><div class=breadcrumbs><a href=/b>{18}</a></div><h1>¶{9}</h1><p>¶{40}</p><h3>¶{4}</h3><p>¶{66}</p><div class=ads>{30}</div></main><div>{18}</div>",
    "<div class=menu>{3}</div><p>¶{30}</p><h2>¶{2}</h2><p>¶{27}</p><p><a href=/m>{10}</a></p>",
]


def labelled_rows() -> list[tuple[float, list[float]]]:
    """(label, features) of the labelled table's blocks."""
    rows = []
    for page in LABELLED:
        blocks = blocks_of(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        rows += [(float(b.text.startswith("¶")), x.tolist()) for b, x in zip(blocks, block_features(blocks), strict=True)]
    return rows


@dataclass
class Tree:
    """A decision tree as arrays: at node i, feature[i] <= cut[i] leads to left[i], else right[i]; leaves have feature -1."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(feature[at] >= 0)):
            node = at[open_]
            at[open_] = np.where(x[open_, feature[node]] <= cut[node], left[node], right[node])
        return np.array(self.value)[at]


def train_tree(spark: SparkSession, rows: list[tuple[float, list[float]]] | None = None, depth: int = 6) -> Tree:
    """Fit Spark's decision tree to a small labelled table and take its nodes over as arrays."""
    table = spark.createDataFrame([(y, Vectors.dense(x)) for y, x in rows or labelled_rows()], ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(table)
    tree = Tree([], [], [], [], [])

    def take(node) -> int:
        i = len(tree.feature)
        for x, v in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, float(node.prediction()))):
            x.append(v)
        if node.subtreeDepth():
            tree.feature[i], tree.cut[i] = int(node.split().featureIndex()), float(node.split().threshold())
            tree.left[i] = take(node.leftChild())
            tree.right[i] = take(node.rightChild())
        return i

    take(model._call_java("rootNode"))
    return tree


def main_text(page: str, tree: Tree) -> str:
    blocks = blocks_of(page)
    keep = tree.predict(block_features(blocks)) >= 0.5 if blocks else []
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", rows: list[tuple[float, list[float]]] | None = None) -> DataFrame:
    """``pages`` without the html, with the main text in ``out_col`` (a column of that name is replaced).

    A page is cut into blocks at block-level tags; the tree judges each block by its words and link density, those of
    the blocks before and after, and what elements and labels around it say. Kept blocks are joined by one space. Null and
    empty pages have empty text; other columns, nulls in them and repeated rows stay as they are; an empty table gives an
    empty table. Whole pages of any length and depth, in time linear in their tags.
    """
    tree = train_tree(pages.sparkSession, rows)
    others = [c for c in pages.columns if c not in (html_col, out_col)]
    source = pages.select(*others, F.col(html_col).cast("string").alias(page := free_prefix(pages.columns) + "html"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in others)

    def kernel(batches):
        for part in text_slices(batches, page):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([main_text(x, tree) for x in texts(part.column(page))], pa.string())], [*others, out_col])

    return source.mapInArrow(kernel, f"{schema}{', ' if others else ''}`{out_col}` string")
