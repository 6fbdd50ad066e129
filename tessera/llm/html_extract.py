"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors; a container's points are discounted by its link
density, and the best container is kept with those siblings that score well or read like prose. Elements that are not
of the article by their tag or role are dropped first; names of classes and ids, and forms, only make candidates for it.

A page is read in time linear in its length: a quote counts in a tag only after an attribute's ``=``, tags match without
backtracking, and elements are nested DEPTH deep at most (deeper ones stand side by side; no text is lost).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Fixed values of HTML: elements without an end tag, elements whose content is raw text, elements that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag on the left ends an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
#: ... within these.
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "body": {"html"}}
#: Elements, roles and name parts that are not of the article.
DROP = frozenset("nav footer aside form button select input label dialog menu head header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|breadcrumbs?|comment|comments|commentlist|respond|replies|disqus|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|footer|header|masthead|menu|nav|navbar|navigation|newsletter|subscribe|signup|login|pager|pagination|promo|promoted|related|recommended|share|sharing|social|sidebar|sidenav|sponsor|sponsored|toolbar|widget|widgets)(?:$|[\s_-])",
    re.I,
)
#: Names that make a candidate of an article, too: readers' comments are often marked up as articles.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|comment-body|reply|replies|respond|disqus)(?:$|[\s_-])", re.I)
#: An attribute: a name, and a value in quotes or up to white space or the end of the tag. A tag, a comment, other markup.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]*+)))?+""")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+[\s/]*+)>""")
MARKUP = re.compile(r"<(?:(!--)|[!?]|/(?![a-zA-Z])|(/?[a-zA-Z]))")
#: Nested elements, at most.
DEPTH = 512
SPACES = re.compile(r"\s+")
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
#: Least characters of a scored paragraph; the share of the best score from which a sibling is kept.
LEAST, SHARE = 25, 0.2
#: A candidate with over this share of the page's low-link prose stays; with less than that share outside the dropped
#: candidates, all stay.
MOST, FEW = 0.75, 0.1
#: What an element looks like, and what a subtree holds.
CANDIDATE, UNWANTED = 1, 2
TITLE, ARTICLE = 1, 2


class Node:
    __slots__ = ("tag", "parent", "depth", "items", "looks", "dropped", "points", "chars", "linked", "own", "commas", "title", "reads")

    def __init__(self, tag: str, parent: Node | None, looks: int = 0):
        self.tag, self.parent, self.looks, self.dropped = tag, parent, looks, looks == UNWANTED
        self.depth = parent.depth + 1 if parent else 0
        self.items: list = []  # nodes and texts
        self.points, self.chars, self.linked = 0.0, 0, 0  # score; characters, and those in links
        self.own, self.commas = 0, 0  # characters and commas outside blocks below
        self.title = self.reads = False  # whether an h1, or a paragraph that isn't empty, is in it


def _looks(tag: str, attributes: str) -> int:
    if tag in DROP and tag not in ("form", "header"):
        return UNWANTED
    found = CANDIDATE if tag in DROP else 0
    if not attributes or tag in ("html", "body", "main"):
        return found
    names = COMMENTS if tag == "article" else NAMES
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and names.search(value) or name == "role" and value.lower() == "form" and tag != "article":
            found = CANDIDATE
        elif tag == "article":
            continue
        elif name == "role" and value.lower() in ROLES or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return UNWANTED
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return UNWANTED
    return found


def _end_of_raw(page: str, tag: str, at: int) -> int:
    """Where the end tag of an element of raw text ends, or else the page."""
    close = re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A).search(page, at)
    end = page.find(">", close.end()) if close else -1
    return end + 1 or len(page)


def parse(page: str) -> Node:
    """A tree of elements. Broken markup is mended as browsers do for paragraphs, lists and tables; an end tag without
    its start is passed over; a tag that the page ends in is left out."""
    root = Node("#root", None)
    now, at, end = root, 0, len(page)
    opened: Counter = Counter()  # open elements by tag

    def leave(node: Node) -> Node:
        """Closes the elements from the innermost open one to node."""
        up = now
        while up is not node.parent:
            opened[up.tag] -= 1
            up = up.parent
        return up

    while at < end:
        m = MARKUP.search(page, at)
        begin = m.start() if m else end
        if begin > at:
            now.items.append(entities.unescape(page[at:begin]) if "&" in page[at:begin] else page[at:begin])
        if not m:
            break
        if not m[2]:
            close = page.find("-->", begin + 2) + 2 if m[1] else page.find(">", begin)
            at = close + 1 if close >= (2 if m[1] else 0) else end
            continue
        m = TAG.match(page, begin)
        if not m:  # the page ends within it
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            up = now
            while opened[tag] and up.tag != tag:
                if up.tag in ("table", "article", "body") and tag not in BLOCK:
                    break
                up = up.parent
            if opened[tag] and up.tag == tag:
                now = leave(up)
            continue
        if tag in RAW:
            at = _end_of_raw(page, tag, at)
            continue
        if tag in BLOCK:  # a block ends an open paragraph (and what is open in it)
            up = now
            while up is not root and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p" or (up.tag[0] == "h" and up.tag[1:].isdigit() and tag[0] == "h" and tag[1:].isdigit()):
                now = leave(up)
        if tag in ENDS:
            up, found = now, None
            while up is not root and up.tag not in WITHIN[tag]:
                if up.tag in ENDS[tag]:
                    found = up
                up = up.parent
            if found:
                now = leave(found)
        if now.depth >= DEPTH:
            now = leave(now)
        node = Node(tag, now, _looks(tag, m[3]))
        now.items.append(node)
        if tag not in VOID and (tag in BLOCK or not m[3].endswith("/")):  # a slash does not close an HTML block
            now = node
            opened[tag] += 1
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that are not dropped, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [x for x in reversed(n.items) if type(x) is not str and not x.dropped]
    return out


def _choose(root: Node) -> bool:
    """Drops the candidates that are not the article's, and says if it dropped any.

    One stays if it holds the page's title (h1), its only articles or main element, or most of its low-link prose; what
    is in it is then judged on its own. If hardly any prose and no article is left without the others, they stay too.
    """
    nodes = _order(root)
    if not any(n.looks for n in nodes):
        return False
    inline, prose, holds = {}, {}, {}  # by node: characters and linked ones outside blocks, prose, what it holds
    said: dict[Node, int] = {}  # by node: characters outside links
    for n in reversed(nodes):  # children first
        size, linked, text, what = 0, 0, 0, 0
        said[n] = 0 if n.tag == "a" else sum(len(x.strip()) if type(x) is str else said.get(x, 0) for x in n.items)
        for x in n.items:
            if type(x) is str:
                size += len(x.strip())
            elif not x.dropped:
                more = inline[x]
                size, linked, text, what = size + more[0], linked + more[1], text + prose[x], what | holds[x]
        if n.tag == "a":
            linked = size
        if n.tag in BLOCK or n is root:
            text += size if size >= LEAST and linked < size / 2 else 0
            size = linked = 0
        if n.tag in ("article", "main") and said[n] and not n.looks:
            what |= ARTICLE
        inline[n], prose[n], holds[n] = (size, linked), text, what | (TITLE if n.tag == "h1" else 0)
    clean, todo = False, [root]  # whether an article is outside all candidates
    while todo:
        n = todo.pop()
        clean = clean or n.tag in ("article", "main") and said[n] > 0
        todo += [x for x in n.items if type(x) is not str and not x.dropped and not x.looks]
    dropped, left, todo = [], prose[root], [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag in ("article", "main")
        for x in n.items:
            if type(x) is str or x.dropped:
                continue
            title = holds[x] & TITLE and (x.tag != "header" or inside) and not (clean and x.tag == "article")
            if not x.looks or title or not clean and (holds[x] & ARTICLE or prose[x] > MOST * prose[root]):
                todo.append((x, inside))
            else:
                dropped.append(x)
                left -= prose[x]
    if left < FEW * prose[root] and not clean:
        return False
    for x in dropped:
        x.dropped = True
    return bool(dropped)


def _score(nodes: list[Node]) -> None:
    for n in reversed(nodes):  # children first
        n.title = n.tag == "h1"
        for x in n.items:
            if type(x) is str:
                size = len(x.strip())
                n.chars, n.own, n.commas = n.chars + size, n.own + size, n.commas + x.count(",")
            elif not x.dropped:
                n.chars, n.linked = n.chars + x.chars, n.linked + x.linked
                n.title, n.reads = n.title or x.title, n.reads or x.reads
                if x.tag not in BLOCK:
                    n.own, n.commas = n.own + x.own, n.commas + x.commas
        n.reads = n.reads or (n.chars > 0 and n.tag in PARAGRAPH)
        if n.tag == "a":
            n.linked = n.chars
    for n in nodes:
        if n.own >= LEAST and (n.tag in PARAGRAPH or n.tag in ("div", "section", "article", "main", "body")):
            points = 1 + n.commas + min(n.own / 100, 3)
            up = n.parent if n.tag in PARAGRAPH else n
            size, level = up.chars, 0
            while up is not None:
                if up.chars > size:  # an element that holds the same text as the one in it is its wrapper, on its level
                    size, level = up.chars, level + 1
                up.points += points * (1 if level == 0 else 1 / 2 if level == 1 else 1 / (3 * level))
                up = up.parent


def _joined(best: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order: those with a share of its score, headings and prose.
    Siblings are looked at on each level up to the article around it (or else the main element), and of an article's a paragraph in
    them is enough; without one, up to the first level at which there is other text and none of it belongs."""
    around, up = None, best.parent
    while up is not None:
        if up.tag == "article" or (up.tag == "main" and around is None):
            around = up
        up = up.parent
    least, kept, at = SHARE * best.points * (1 - _density(best)), [best], best
    while at.parent is not None and at is not around:
        article = around is not None and around.tag == "article"
        before, after, passed = [], [], False
        for x in at.parent.items:
            if x is at:
                passed = True
            elif type(x) is not str and not x.dropped and x.chars:
                low = _density(x) < 0.25
                prose = low and (x.tag in ("h1", "h2") or x.title or (x.tag == "p" and x.chars > 80) or (article and x.reads))
                if prose or x.points > 0 and x.points * (1 - _density(x)) >= least:
                    (after if passed else before).append(x)
        kept = before + kept + after
        if around is None and at.parent.chars > at.chars and not before and not after:
            break
        at = at.parent
    return kept


def _density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below nodes in page order, white space in a block made one space."""
    out, now = [], []

    def cut():
        text = SPACES.sub(" ", "".join(now)).strip()
        if text:
            out.append(text)
        now.clear()

    todo: list = [x for n in reversed(nodes) for x in (None, n)][1:] if nodes else []
    while todo:
        x = todo.pop()
        if x is None:
            cut()
        elif type(x) is str:
            now.append(x)
        elif x.tag in ("br", "wbr"):
            now.append(" " if x.tag == "br" else "")
        elif not x.dropped:
            if x.tag in BLOCK:
                cut()
                todo.append(None)
            todo += reversed(x.items)
    cut()
    return out


def _scored(root: Node) -> list[Node]:
    nodes = _order(root)
    _score(nodes)
    return [n for n in nodes if n.points > 0 and n.tag not in PARAGRAPH]


def main_text(page: str) -> str:
    root = parse(page)
    some = _choose(root)
    scored = _scored(root)
    if not scored:  # a short article, or else the page with all candidates
        if short := [n for n in _order(root) if n.tag in ("article", "main") and n.chars and _density(n) < 0.5]:
            return "\n\n".join(_blocks(short[:1]))
        if some:
            whole = parse(page)
            scored = _scored(whole)
            root = whole if scored or not _blocks([root]) else root
    if not scored:  # nothing reads like prose: all that is left of the page
        return "\n\n".join(_blocks([root]))
    best = max(scored, key=lambda n: n.points * (1 - _density(n)))
    return "\n\n".join(_blocks([best] if best.parent is None or best.tag in ("html", "body") else _joined(best)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html, with text (empty if there is none) and n_chars. A null html is empty; every row is parsed
    whole, on its own; of containers with one score the first in the page is taken, an outer one before those in it; repeated rows
    each get a row, an empty table an empty result."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return pages.withColumn("_t_text", text(text_of(html_col))).drop(html_col, "text", "n_chars").withColumn("text", F.col("_t_text")).withColumn("n_chars", F.length("text").cast("long")).drop("_t_text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
