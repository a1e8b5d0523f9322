import html
import random
import re
from html.parser import HTMLParser

import pytest

from orderloom.llm import html_main

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text\n only", "plain text only"),
        ("<header>Site</header><main><article><header><h1>T</h1></header><p>One &lt;b&gt; two<br>three&nbsp;x<p>Second, para.<ul><li>a<li>b</ul></article>"
         '<div id="comments"><p>hi there, this is a long comment, really</p></div></main><footer>x</footer>', "T\nOne <b> two three x\nSecond, para.\na\nb"),
        ("<body><nav><a href=/>Home</a></nav><div class='sidebar'><p>Buy, buy, buy these things now, they are cheap.</p></div><div><p>A first paragraph, long enough to count.</p>"
         "<p>A second one, with commas, and <a href=x>a link</a>.</p></div><form>Name <input></form></body>", "A first paragraph, long enough to count.\nA second one, with commas, and a link."),
        ("<script>if (a < b) '<p>no</p>'</script><style>p{}</style><p>yes<!-- <p>no --> &amp; no", "yes & no"),
        ("<div class=cookie-notice>We use cookies</div><article><p>x <b>y<i>z</b></article>", "x yz"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<article><p>one<a href='", "one"),
        ('<div class=content style="overflow: hidden"><p>The one paragraph, kept.</p></div>', "The one paragraph, kept."),
        ('<div title="the hidden gem"><p>The one paragraph, kept.</p></div>', "The one paragraph, kept."),
        ('<div data-x="some class=ad"><p>The one paragraph, kept.</p></div>', "The one paragraph, kept."),
        ('<div class="content has-sidebar"><p>The one paragraph, kept.</p><div class="sidebar"><p>Not this.</p></div></div>', "The one paragraph, kept."),
        ('<div class="widget-ready entry"><p>The one paragraph, kept.</p></div>', "The one paragraph, kept."),
        ('<div class="page-header"><p>Site</p></div><div class="sidebar"><p>The one paragraph of the page, which has the most text.</p></div>', "The one paragraph of the page, which has the most text."),
        ('<div><p>Short text here.</p></div><section id="comments"><p>A comment that is far longer than the text of the page itself, by any count.</p></section>', "Short text here."),
        ("<div hidden><p>no</p></div><p aria-hidden=true>no</p><p aria-hidden='false' class='x' role=note>yes</p>", "yes"),
    ],
)
def test_pages(page, text):
    assert html_main.main_text(page) == text


def test_planted_articles(spark):
    """The article element of the generated pages, cut out by plain patterns."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.op10_html_extraction(spark, SF).collect()}
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        want = "\n".join(filter(None, blocks))
        assert got[r.page_id] == (want, len(want))


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, "k"), (1, "u", "", "k"), (1, "u", "<p>a b</p>", "k"), (1, "u", "<p>a b</p>", "k")], "page_id long, url string, html string, text string")
    out = html_main.with_main_text(df)
    assert out.columns == [*df.columns, "main_text"]
    assert sorted(r.main_text for r in out.collect()) == ["", "", "a b", "a b"]
    assert html_main.with_main_text(df.limit(0)).count() == 0


def test_odd_pages_stay_cheap():
    html_main.main_text("<div>" * 50_000 + "x")
    html_main.main_text("<p><b>" * 20_000)
    html_main.main_text('<a href="' * 20_000)
    html_main.main_text("</p>" * 20_000 + "&am" * 20_000)


def test_deep_pages_keep_their_text():
    deep = "<div>" * 700 + "<p>deep words here</p>" + "</div>" * 700 + "<p>after</p>"
    assert sorted(html_main.main_text(f"<article>{deep}</article>").split("\n")) == ["after", "deep words here"]
    long_ = "word, " * 200_000
    assert html_main.main_text(f"<article><p>{long_}</p></article>") == long_.strip()


class Plain(HTMLParser):
    """The tree of a page whose end tags are all there: [tag, names, parts]."""

    def __init__(self, page):
        super().__init__()
        self.root = ["#", "", []]
        self.open = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class", ""), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def plain_main_text(page):
    """Scores by their definition, each from all descendants anew."""
    root, parent, order = Plain(page).root, {}, []

    def walk(node, above):
        parent[id(node)] = above
        order.append(node)
        for part in node[2]:
            if not isinstance(part, str):
                walk(part, node)

    walk(root, None)
    under = lambda node: [x for p in node[2] for x in ([p] if isinstance(p, str) else under(p))]
    links = lambda node: [x for p in node[2] if not isinstance(p, str) for x in (under(p) if p[0] == "a" else links(p))]
    size = lambda texts: sum(len(t.strip()) for t in texts)
    blocks = {"div", "section", "p", "ul", "li", "article"}
    is_block = lambda n: n[0] in blocks
    scores = {id(n): 0.0 for n in order}
    for n in order:
        leaf = is_block(n) and not any(not isinstance(p, str) and is_block(p) for p in n[2])
        if size(under(n)) and (n[0] in ("p", "li") or leaf):
            points = (size(under(n)) >= 25) + sum(t.count(",") for t in under(n)) + min(size(under(n)) / 100, 3.0)
            up, share = parent[id(n)], [1, 2]
            while up is not None:
                scores[id(up)] += points / share[0]
                share = [share[1], share[1] + 2]
                up = parent[id(up)]
    density = lambda n: size(links(n)) / size(under(n)) if size(under(n)) else 0.0
    value = lambda n: (scores[id(n)] + 25 * (n[0] == "article") + 25 * ("content" in n[1])) * (1 - density(n))
    some = [n for n in order if n[0] in ("#", "div", "section", "article") and size(under(n)) and (scores[id(n)] or n[0] == "article")]
    best = max(some, key=lambda n: (value(n), -order.index(n)))
    least = max(10.0, 0.2 * value(best))
    up = parent[id(best)]
    while up is not None:
        best = up if up[0] == "article" else best
        up = parent[id(up)]
    kept = []
    if best[0] == "article":
        for p in parent[id(best)][2]:
            if p is best:
                kept.append(p)
            elif not isinstance(p, str) and size(under(p)):
                reads = p[0] == "p" and (size(under(p)) > 80 and density(p) < 0.25 or not links(p) and re.search(r"\.(\s|$)", " ".join("".join(under(p)).split())))
                if reads or is_block(p) and value(p) >= least:
                    kept.append(p)
    else:  # all from the root down, but for blocks beside the best one or what holds it that are mostly links
        holds = lambda n: n is best or any(not isinstance(p, str) and holds(p) for p in n[2])

        def keep(node):
            if node is best:
                return kept.append(node)
            for p in node[2]:
                if holds(p):
                    keep(p)
                elif 2 * size(links(["", "", [p]])) < size(under(p)):
                    kept.append(p)

        keep(root)

    def lines(node):
        out, run = [], ""
        for p in node[2]:
            if isinstance(p, str):
                run += p
            elif is_block(p):
                out += [run, *lines(p)]
                run = ""
            else:
                first, *rest = lines(p) or [""]
                run += first
        return [*out, run]

    return "\n".join(x for k in kept for b in lines(k) if (x := " ".join(b.split())))


def page_of(rng, depth=0):
    text = lambda: " ".join(rng.choice(["word", "more,", "text.", "and", "so, on", "longer words stand here"]) for _ in range(rng.randint(1, 30)))
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["p", "p", "p", "link", "ul", "div", "div", "section"] + ["article"] * (depth == 1 and rng.random() < 0.1))
        if kind == "p":
            out.append(f"<p>{text()}</p>" if rng.random() < 0.8 else f"<p>{text()} <a>{text()}</a> {text()}</p>")
        elif kind == "link":
            out.append(f"<p><a>{text()}</a></p>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li><a>{text()}</a></li>" if rng.random() < 0.7 else f"<li>{text()}</li>" for _ in range(3)) + "</ul>")
        elif depth < 4:
            name = rng.choice(["", "", ' class="content"', ' class="x"'])
            out.append(f"<{kind}{name}>{page_of(rng, depth + 1)}</{kind}>")
    return "".join(out) or "<p>one</p>"


def test_tree_scoring_against_a_plain_version():
    rng, parts = random.Random(11), 0
    for _ in range(600):
        page = page_of(rng)
        got = html_main.main_text(page)
        assert got == plain_main_text(page), page
        parts += len(got) < 0.8 * len(re.sub("<[^>]*>", "", page))
    assert parts > 50


WORDS = "harbour lantern, meadow, quietly river stone winter morning window letter".split()


def planted_page(rng):
    """A page without article elements, and its paragraphs in page order; menus, notices, fields and scripts stand between them."""
    want: list[str] = []

    def block(tag, sentences):
        text = " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 12))).capitalize() + rng.choice([".", "."] if sentences > 1 else ["", "."]) for _ in range(sentences))
        want.append(text)
        return f"<{tag}>{text}</{tag}>"

    junk = lambda: rng.choice([
        "", "", "<nav><ul><li><a href=x>Menu, entry</a></li></ul></nav>", "<script>var a = 'no';</script>", "<div class=sidebar><p>Side text, short.</p></div>", "<aside>Beside, aside.</aside>",
        "<ul><li><a href=1>See this, too</a></li><li><a href=2>And this one</a></li></ul>", "<div>© 2024 Some Body</div>", "<label>Name</label><input name=q><button>Send</button>", "<div id=comments><p>Great, thanks.</p></div>",
    ])
    head = block("h2", 1) if rng.random() < 0.5 else ""
    body = "".join(block("p", rng.randint(2, 5)) for _ in range(rng.randint(4, 8)))
    after = [block("p", rng.randint(1, 4)) if rng.random() < 0.7 else f"<ul>{block('li', 1)}{block('li', 1)}</ul>" for _ in range(rng.randint(0, 3))]
    inner = f"{head}{junk()}<div class=text>{body}</div>" if rng.random() < 0.5 else f"<div>{head}{body}</div>"
    second = "".join(after) if rng.random() < 0.4 else f"<div>{''.join(after)}</div>"
    last = f"<section>{block('p', 1)}</section>" if rng.random() < 0.5 else ""
    page = f"{inner}{junk()}{second}{junk()}{last}"
    for _ in range(rng.randint(0, 2)):
        page = f"<div>{junk()}{page}{junk()}</div>"
    if rng.random() < 0.4:
        page = f"<form id=aspnetForm action=x>{page}<input type=hidden name=v></form>"
    return f"<html><head><title>No</title></head><body>{page}<footer>Foot, note.</footer></body></html>", want


def test_no_paragraph_is_lost():
    rng = random.Random(21)
    for _ in range(800):
        page, want = planted_page(rng)
        assert html_main.main_text(page) == "\n".join(want), page


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class=ad><p>%s</p></div><article><p>Short.</p></article>", "Short."),
        ("<div><div><h3>Before</h3><p>%s</p></div><h3>More</h3><ul><li><a>one</a></ul></div>", "Before\n%s"),
        ("<div>start <b>of</b> it<div><p>%s</p></div>end <i>of</i> it</div>", "start of it\n%s\nend of it"),
        ("<h1>Title</h1><article><p>%s</p></article>", "Title\n%s"),
        ("<form role=form><p>Name, please.</p></form><p>%s</p>", "%s"),
    ],
)
def test_places(page, want):
    prose = " ".join(f"Sentence {i} is long enough, and stands here." for i in range(8))
    assert html_main.main_text(f"<html><body>{page.replace('%s', prose)}</body></html>") == want.replace("%s", prose)
