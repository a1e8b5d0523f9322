"""Main text of web pages by tree scoring.

A page becomes a tree of elements, with the end tags that HTML lets authors leave
out implied. Parts that are never article text (menus, page headers, footers,
sidebars, notices, adverts, fields, scripts) are pruned by tag, role and hidden
attributes. Forms, and class and id names, are only evidence: whole names are judged, bad ones
are weighed against good ones, and what they speak against is pruned unless it holds
most of the page's unlinked text; reader comments are pruned however long.
Paragraphs pass points for their length and their commas to their ancestors, less
to farther ones, and each ancestor's score is discounted by its link density. The
best container is kept. Where it is an article element, siblings that score or read like it join
it; elsewhere, at every level above, all that stands beside it does, but for
what is mostly links, notices, and headings that only such follows.

Row-wise and without a shuffle. Null and empty pages give an empty text. No text is
dropped by length or number; elements nested deeper than NEST are read as siblings,
which changes where they belong and nothing else. Other columns are untouched, and
repeated rows each get their text.
"""

from __future__ import annotations

import functools
import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import table, text_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
#: An attribute with its value, so that names inside values are not taken for attributes.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends when it is still open, up to the element that bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PRUNED = frozenset("head nav aside footer button select option datalist label dialog template svg math canvas object audio video menu search".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article, at the end of a name, or at its start before a mere holder.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail menu navbar nav navigation breadcrumb breadcrumbs "
    "footer masthead topbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription social share sharing related recommended "
    "comment comments disqus respond replies pagination pager widget login signup paywall toolbar skip copyright".split()
)
HOLDERS = frozenset(
    "area bar block body bottom box button buttons col column container content count group heading icon icons inner item items left link links list outer panel "
    "posts right row section slot stories text thread title top unit wrap wrapper zone".split()
)
MODIFIERS = frozenset("has with without no not is js show hide".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())
GOOD = frozenset("article body content entry main page post story text blog".split())
ARTICLE = frozenset(("article", "main"))
CONTAINERS = frozenset("# body article main section div center td th table details dialog fieldset".split())
#: Blocks outside article elements, of so many characters at most, that are notices.
NOTICE = re.compile(r"^\s*(?:©|copyright (?:©|\(c\)|\d{4}))|\ball rights reserved\b|\bwe use cookies\b", re.I)
NOTICE_CHARS = 300
NOTICE_HINT = re.compile("©|&copy|copyright|rights reserved|cookies|&#", re.I)
#: Elements nested deeper are read as siblings, as browsers do.
NEST = 512


class Node:
    __slots__ = ("tag", "parent", "parts", "names", "score", "chars", "linked", "commas", "cut", "marked")

    def __init__(self, tag, parent, names=""):
        self.tag, self.parent, self.names = tag, parent, names
        self.parts = []
        self.score, self.chars, self.linked, self.commas, self.cut, self.marked = 0.0, 0, 0, 0, False, False


@functools.lru_cache(maxsize=10_000)
def words_of(name: str) -> tuple[str, ...]:
    return tuple(re.findall("[a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", name).lower()))


@functools.lru_cache(maxsize=10_000)
def standing(name: str, inside: bool) -> int:
    """-1 for a class or id name that marks what is not the article, 1 for one that marks the article, else 0."""
    words = words_of(name)
    if words and words[0] not in MODIFIERS:
        header = words[-1] == "header" and not inside and (len(words) == 1 or words[0] in ("site", "page", "top", "global"))
        if words[-1] in MARKS or header or words[0] in MARKS and all(w in MARKS or w in HOLDERS for w in words[1:]):
            return -1
    return 1 if words and words[0] not in MODIFIERS and not GOOD.isdisjoint(words) else 0


def unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is pruned, whether its names speak against it, and its names."""
    if tag in PRUNED or tag == "header" and not inside:
        return True, False, ""
    if not attributes or tag in ("html", "body"):
        return False, tag == "form", ""
    names, form = [], tag == "form"
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "role":
            if value.lower() in ROLES:
                return True, False, ""
            form = form or value.lower() == "form"
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                return True, False, ""
        elif name in ("class", "id"):
            names += value.split()
    return False, tag not in ARTICLE and (form or sum(standing(n, inside) for n in names) < 0), " ".join(names)


def tree(page: str) -> list[Node]:
    """The elements in page order, the root first."""
    root = Node("#", None)
    nodes, stack, at, inside, paragraphs = [root], [root], 0, 0, 0

    def close(to: int) -> None:
        nonlocal inside, paragraphs
        inside -= sum(n.tag in ARTICLE for n in stack[to:])
        paragraphs -= sum(n.tag == "p" for n in stack[to:])
        del stack[to:]

    def ended(tags, bounds) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return close(i)
            if stack[i].tag in bounds:
                return

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or tag in HEADINGS and stack[i].tag in HEADINGS:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK or tag == "p" and stack[i].tag in ("td", "th", "button"):
                    break
            continue
        if tag == "br" or tag == "wbr":
            stack[-1].parts.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            if paragraphs:
                ended({"p"}, {"td", "th", "caption", "button"})
            if tag in ENDS:
                ended(*ENDS[tag])
        cut, marked, names = unwanted(tag, m[3], inside > 0)
        node = Node(tag, stack[-1], names)
        node.cut, node.marked = cut or node.parent.cut, marked
        node.parent.parts.append(node)
        nodes.append(node)
        if tag not in VOID and not m[3].endswith("/") and len(stack) < NEST:
            stack.append(node)
            inside += tag in ARTICLE
            paragraphs += tag == "p"
    return nodes


def lines(tops: list[Node]) -> list[str]:
    """The blocks of text under the given elements, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    todo: list = list(reversed(tops))
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif not part.cut:
            if part.tag in BLOCK or part.tag == "#":
                flush()
                todo.append(None)
            todo.extend(reversed(part.parts))
    flush()
    return out


def measure(nodes: list[Node]) -> None:
    """Text lengths, link lengths and commas of each element, children before parents."""
    for node in reversed(nodes):
        node.chars = node.linked = node.commas = 0
        if node.cut:
            continue
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part.strip())
                node.commas += part.count(",") + part.count("、") + part.count("，")
            elif not part.cut:
                node.chars += part.chars
                node.linked += part.linked
                node.commas += part.commas
        if node.tag == "a":
            node.linked = node.chars


def prune(nodes: list[Node]) -> None:
    """Cuts forms and what its names speak against, unless it holds most of the unlinked text and every article element; comments in any case."""
    if not any(n.marked for n in nodes):
        return
    most = (nodes[0].chars - nodes[0].linked) / 2
    articles = [n for n in nodes if n.tag in ARTICLE and n.chars and not n.cut]
    unmarked = [n for n in articles if not n.marked and not any(u.marked for u in ancestors(n))]
    for node in nodes:
        if node.parent is not None and node.parent.cut:
            node.cut = True
        elif node.marked and not node.cut:
            small = node.chars - node.linked <= most or bool(unmarked)
            node.cut = small or any(not COMMENTS.isdisjoint(words_of(n)) for n in node.names.split())
    measure(nodes)


def cut_notices(nodes: list[Node]) -> None:
    """Cuts short blocks outside article elements that are notices."""
    inside, found = set(), False
    for node in nodes:
        if node.tag in ARTICLE or node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
        elif node.tag in BLOCK and not node.cut and 0 < node.chars <= NOTICE_CHARS and NOTICE.search(" ".join(lines([node]))):
            found = True
            for part in under(node):
                part.cut = True
    if found:
        measure(nodes)


def weigh(nodes: list[Node]) -> None:
    """Points of paragraphs for their ancestors."""
    holders = {id(n.parent) for n in nodes if n.tag in BLOCK and not n.cut}
    for node in nodes:
        if node.cut or not node.chars or node.tag in HEADINGS:
            continue
        if node.tag in ("p", "pre", "blockquote", "td", "li", "dd") or node.tag in BLOCK and id(node) not in holders:
            points = (node.chars >= 25) + node.commas + min(node.chars / 100, 3.0)
            up, level = node.parent, 1
            while up is not None:
                up.score += points / (1 if level == 1 else 2 * (level - 1))
                up, level = up.parent, level + 1


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def value(node: Node) -> float:
    bonus = 25 * (node.tag in ARTICLE) + 25 * any(standing(n, True) > 0 for n in node.names.split())
    return (node.score + bonus) * (1 - density(node))


def main_text(page: str) -> str:
    nodes = tree(page)
    measure(nodes)
    prune(nodes)
    if NOTICE_HINT.search(page):
        cut_notices(nodes)
    weigh(nodes)
    open_ = [n for n in nodes if not n.cut and n.chars and n.tag in CONTAINERS and (n.score or n.tag in ARTICLE)]
    if not open_:
        return "\n".join(lines(nodes[:1]))
    best_score, at = max((value(n), -i) for i, n in enumerate(open_))
    best = open_[-at]
    for up in ancestors(best):  # a part of an article stands for the whole of it
        if up.tag in ARTICLE:
            best = up
    if best.tag in ARTICLE:
        return "\n".join(lines(beside_article(best, max(10.0, 0.2 * best_score))))
    kept = [best]
    for up in ancestors(best):
        kept, best = beside(up, best, kept), up
    return "\n".join(lines(kept))


def ancestors(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def units(parent: Node) -> list[list]:
    """A parent's parts: each block by itself, and each run of text and inline elements between blocks."""
    out: list[list] = [[]]
    for part in parent.parts:
        if isinstance(part, Node) and part.tag in BLOCK:
            out += [[part], []]
        else:
            out[-1].append(part)
    return [u for u in out if u]


def reads(unit: list) -> bool:
    """Whether a unit beside the best container is text of the page, not mostly links, nor named as something else."""
    nodes = [p for p in unit if isinstance(p, Node) and not p.cut]
    chars = sum(n.chars for n in nodes) + sum(len(p.strip()) for p in unit if isinstance(p, str))
    return chars > 2 * sum(n.linked for n in nodes) and not any(n.marked for n in nodes)


def beside(parent: Node, best: Node, kept: list) -> list:
    """What stands for the parent: kept, for its part best, and the parts beside it that read like text; headings stay where anything after them does."""
    out: list = []
    follows = False
    for unit in reversed(units(parent)):
        if unit == [best]:
            out[:0], follows = kept, True
            continue
        nodes = [p for p in unit if isinstance(p, Node)]
        if len(unit) == 1 and nodes and nodes[0].tag in HEADINGS:
            stays = follows and not nodes[0].cut and not nodes[0].marked
        elif not any(n.chars and not n.cut for n in nodes) and not any(isinstance(p, str) and p.strip() for p in unit):
            continue
        else:
            stays = reads(unit)
            follows = follows or stays
        if stays:
            whole = Node("div", None)  # a run beside blocks is a block of its own
            whole.parts = unit
            out[:0] = [whole]
    return out


def beside_article(best: Node, least: float) -> list[Node]:
    """The article, with siblings that score or read like it, and the heading right before it if it has none."""
    kept: list[Node] = []
    titled = any(n.tag in ("h1", "h2") for n in under(best))
    for part in best.parent.parts:
        if part is best:
            kept.append(part)
        elif isinstance(part, Node) and not part.cut and part.chars and not part.marked:
            prose = part.tag == "p" and (part.chars > 80 and density(part) < 0.25 or not part.linked and re.search(r"\.(?:\s|$)", "".join(lines([part]))))
            heading = part.tag in HEADINGS and not titled and best in part.parent.parts[part.parent.parts.index(part) + 1 :]
            if prose or heading or part.tag in BLOCK and part.tag not in HEADINGS and value(part) >= least:
                kept.append(part)
    return kept


def under(top: Node):
    todo = [top]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(p for p in node.parts if isinstance(p, Node) and not p.cut)


def with_main_text(df: DataFrame, html: str = "html", into: str = "main_text") -> DataFrame:
    """df and the main text of its html column; a column named into is replaced."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return df.withColumn(into, extract(text_of(html)))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), into="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
