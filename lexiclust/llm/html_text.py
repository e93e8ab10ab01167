"""Main-text extraction from HTML by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, less
with each level; a container's points are discounted by its link density.  The
best container is kept with all else of the article or main element around it, or
of its parent if there is none, in page order; only parts that are mostly links
(or marked as no content) are left out.  Beside an article, siblings stay that
score well or read like prose.

Defined results: null or empty html gives an empty text; markup that is cut off
or never closed is closed at the end of the page; a page without scoring
paragraphs gives all its text outside the removed parts; repeated rows are kept;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML and words that mark page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
table tbody td tfoot th thead tr ul""".split())
REMOVED = frozenset("""aside button canvas dialog embed fieldset footer form head header input label menu nav object
option select svg""".split()) | RAW
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"),
                  "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
PAGE_PARTS = re.compile(r"""(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|cookies?|disqus|footer|
header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|popup|promo|related|replies|respond|share|
sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])""", re.I | re.X)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
KEPT_WHATEVER = frozenset("html body article main".split())
#: share of link text above which a part beside the best container is left out
LINKS = 0.5
STARTING_POINTS = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0,
                   "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "body": 0.0}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?][^>]*>?""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "points", "text", "linked", "removed")

    def __init__(self, tag, parent, removed=False):
        self.tag, self.parent, self.removed = tag, parent, removed
        self.children = []
        self.points = None
        self.text = self.linked = 0


def _unwanted(tag: str, attributes: str) -> bool:
    if tag in REMOVED:
        return True
    if not attributes or tag in KEPT_WHATEVER or attributes.isspace():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in ROLES or name in ("class", "id") and PAGE_PARTS.search(value):
            return True
    return False


def tree(page: str) -> Node:
    """Elements of a page; children are nodes and decoded strings in order."""
    root = Node("#root", None)
    open_node, at, n = root, 0, len(page)

    def add_text(raw):
        if raw:
            open_node.children.append(entities.unescape(raw) if "&" in raw else raw)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add_text(page[at:])
            break
        if m.start() > at:
            add_text(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):  # an end tag closes the nearest open element of its name, and what is open inside
            node = open_node
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                open_node = node.parent
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            node = open_node
            while node is not root and node.tag not in ("p", "td", "th", "li", "table", "div", "article", "section", "body"):
                node = node.parent
            if node.tag == "p":
                open_node = node.parent
        if tag in CLOSED_BY_SAME:
            node = open_node
            while node is not root and node.tag != tag and node.tag not in CLOSED_BY_SAME[tag]:
                node = node.parent
            if node.tag == tag:
                open_node = node.parent
        attributes = m.group(3)
        child = Node(tag, open_node, open_node.removed or _unwanted(tag, attributes))
        open_node.children.append(child)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        open_node = child
    return root


def _walk(root: Node):
    """Nodes in page order, parents first, without recursion."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if type(c) is Node)


def score(root: Node) -> Node | None:
    """Give points and text lengths; the best container, if any."""
    order = [x for x in _walk(root) if not x.removed]
    for node in reversed(order):  # children before parents
        words = []
        for c in node.children:
            if type(c) is str:
                words.append(c)
            elif not c.removed:
                node.text += c.text
                node.linked += c.text if c.tag == "a" else c.linked
        node.text += sum(len(" ".join(w.split())) for w in words)
    for node in order:
        if node.tag not in BLOCK or node.tag in ("ul", "ol", "dl", "table", "tr"):
            continue
        words, stack = [], [c for c in reversed(node.children)]
        while stack:  # the block's own text, inline elements included
            c = stack.pop()
            if type(c) is str:
                words.append(c)
            elif not c.removed and c.tag not in BLOCK and c.tag != "a":
                stack.extend(reversed(c.children))
        own = " ".join("".join(words).split())
        if len(own) < 2:
            continue
        points = min(len(own) / 100.0, 3.0) + own.count(",") + 1.0
        above, level = node.parent if node.tag != "article" else node, 0
        while above is not None and above.tag != "#root" and level < 5:
            if above.points is None:
                above.points = STARTING_POINTS.get(above.tag, 0.0)
            above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            above, level = above.parent, level + 1
    best, most = None, float("-inf")
    for node in order:
        if node.points is not None and node.tag in BLOCK:
            value = node.points * (1.0 - node.linked / max(node.text, 1))
            if value > most:
                best, most = node, value
    return best


def _blocks(node: Node, out: list[str]) -> None:
    """Append the texts of the node's blocks in page order."""
    line: list[str] = []

    def flush():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack = [(node, False)]
    while stack:
        item, leaving = stack.pop()
        if type(item) is str:
            line.append(item)
            continue
        if leaving:
            flush()
            continue
        if item.removed:
            if item.tag in BLOCK:
                flush()
            continue
        if item.tag == "br":
            line.append(" ")
            continue
        if item.tag in BLOCK:
            flush()
            stack.append((item, True))
        stack.extend((c, False) for c in reversed(item.children))
    flush()


def _around(top: Node, best: Node, out: list[str]) -> None:
    """Append the texts of ``top``, an ancestor of ``best`` or itself, without
    parts outside ``best`` that are mostly links; text between blocks is one part."""
    path, node = {best}, best
    while node is not top:
        node = node.parent
        path.add(node)
    stack: list = [top]
    while stack:
        part = stack.pop()
        if part is best:
            _blocks(part, out)
        elif part in path:
            parts: list = []
            for c in part.children:
                if type(c) is Node and (c.tag in BLOCK or c in path):
                    parts.append(c)
                elif parts and parts[-1].tag == "#text":
                    parts[-1].children.append(c)
                else:
                    parts.append(Node("#text", part))
                    parts[-1].children.append(c)
            stack.extend(reversed(parts))
        elif not part.removed:
            if part.tag == "#text":
                for c in part.children:
                    n = len(" ".join(c.split())) if type(c) is str else 0 if c.removed else c.text
                    part.text += n
                    part.linked += 0 if type(c) is str or c.removed else n if c.tag == "a" else c.linked
            if part.linked <= LINKS * part.text:
                _blocks(part, out)


def main_text(page: str | None) -> str:
    """Main text of one page: blocks joined by line ends."""
    if not page:
        return ""
    root = tree(page)
    best = score(root)
    out: list[str] = []
    if best is None:
        _blocks(root, out)
        return "\n".join(out)
    value = best.points * (1.0 - best.linked / max(best.text, 1))
    article = best
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    if article is None:
        _around(best if best.tag in ("body", "html") or best.parent is None else best.parent, best, out)
        return "\n".join(out)
    for c in article.parent.children:
        if c is article:
            _around(article, best, out)
        elif type(c) is Node and not c.removed and c.tag in BLOCK and c.text:
            density = c.linked / c.text
            good = c.points is not None and c.points * (1.0 - density) >= max(10.0, 0.2 * value)
            prose = c.tag == "p" and (c.text > 80 and density < 0.25)
            if good or prose or (c.tag in ("h1", "h2") and density < 0.25):
                _blocks(c, out)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
