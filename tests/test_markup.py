"""Extraction against a tree parser on generated pages: nested and unclosed
lists, capitals, quoted attributes, character references, comments."""

import html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from arbor.operators import extract as X
from arbor.operators import markup as M

VOID = {"br", "img", "hr", "input", "meta", "link"}
BLOCKS = {"div", "p", "ul", "ol", "li", "h1", "h2", "article", "section", "table", "nav", "body", "footer"}


class Node:
    def __init__(self, name, attrs, parent):
        self.name, self.attrs, self.parent, self.children = name, dict(attrs), parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def texts(self):
        for c in self.children:
            yield from c.texts() if isinstance(c, Node) else [c]

    def text(self):
        return "".join(t.strip() for t in self.texts())


class Tree(HTMLParser):
    """Open elements as a chain of nodes; HTML's optional end tags."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("", [], None)
        self.skip = 0
        self.feed(page)
        self.close()

    def _open(self, name, stop=()):
        node = self.top
        while node.parent is not None and node.name not in stop:
            if node.name == name:
                return node
            node = node.parent
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
            return
        if tag == "li" and (node := self._open("li", ("ul", "ol"))):
            self.top = node.parent
        if tag in BLOCKS and (node := self._open("p", ("ul", "ol"))):
            self.top = node.parent
        node = Node(tag, attrs, self.top)
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        elif node := self._open(tag, ("ul", "ol") if tag in ("li", "p") else ()):
            self.top = node.parent

    def handle_data(self, data):
        if not self.skip:
            if self.top.children and isinstance(self.top.children[-1], str):
                self.top.children[-1] += data
            else:
                self.top.children.append(data)


def page(rnd):
    def words():
        return " ".join(rnd.choice(["casa", "M&amp;M", "caf&#233;", "caf&eacute;", "&#xE9;t&#xe9;", "5 &lt; 6", "&bogus;", "a & b",
                                    "&#128;", "x > y", "&copy;", "Ñandú", "1 < 2"]) for _ in range(rnd.randint(1, 3)))

    def tag(name):
        return name.upper() if rnd.random() < 0.3 else name

    def close(name, odds):
        return f"</{tag(name)}>" if rnd.random() < odds else ""

    def item(depth):
        body = rnd.choice([words(), f'<{tag("a")} title="a>b" {rnd.choice(["href", "HREF"])}={rnd.choice(["'/x'", '"/y?a=1&amp;b=2"', "/z"])}>{words()}</a>',
                           f"<p>{words()}", f"<b> {words()} </b> tail"])
        if depth < 2 and rnd.random() < 0.3:
            body += listing(depth + 1)
        return f"<{tag('li')}{rnd.choice(['', ' class=next', '\n'])}>{body}{close('li', 0.5)}\n"

    def listing(depth=0):
        name = rnd.choice(["ul", "ul", "ol"])
        return f"<{tag(name)}>" + "".join(item(depth) for _ in range(rnd.randint(0, 3))) + f"</{tag(name)}>"

    parts = ["<!-- <li>no</li> -->", "<SCRIPT>var a='<li>'</SCRIPT>", "<style>li{}</style >", listing(), listing(),
             f"<{tag('h1')}>{words()}</{tag('h1')}>", f"<p>{words()}{close('p', 0.5)}", f"<p class=x>{words()}", f"<div>{words()}</div>",
             f"<span class='price txt-bold'>{words()}</span>", f"<div><{tag('ul')}><li>{words()}</div>"]
    rnd.shuffle(parts)
    return "<body>" + "".join(parts[:rnd.randint(1, len(parts))])


def test_extraction_equals_a_tree_parser(spark):
    rnd = random.Random(11)
    rows = [(k, f"http://h.example.com/en/{k}", page(rnd)) for k in range(400)]
    rows += [(900, "http://h.example.com/en/1", "<ul><li>a<li>b<li>c</ul>"),
             (901, "http://h.example.com/en/1", "<UL><LI>a<UL><LI>n1</UL><LI>b</UL><H1>T</H1><P>d"),
             (902, None, None), (903, "", ""), (904, "", "no tags < at all"), (905, "", "<li>x</p></ul><li>y</li></li>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    items = {}
    for r in X.page_items(X.list_pages(pages)).collect():
        items.setdefault(r.page_id, []).append((r.item_pos, r.property_id, r.item_text))
    found = {r.id: r for r in X.records_with_errors(pages).collect()}
    errors = {r.id: r.error for r in X.error_rows(pages).collect()}
    assert len(found) == len(rows)
    for k, _, text in rows:
        nodes = list(Tree(text or "").root.walk())
        lis = [n for n in nodes if n.name == "li"]
        hrefs = [next((x.attrs["href"] for x in n.walk() if "href" in x.attrs), None) for n in lis]
        assert sorted(items.get(k, [])) == [(i, h, n.text()) for i, (h, n) in enumerate(zip(hrefs, lis))], text
        first = lambda name, cls="": next((n.text() for n in nodes if n.name == name and cls in n.attrs.get("class", "").split() + [""]), None)
        want = [[n.text() for n in u.walk() if n.name == "li"] for u in nodes if u.name == "ul"]
        assert found[k].features == want, text
        assert found[k].title == (first("h1") or None) and found[k].description == (first("p") or None), text
        assert found[k].price == (first("span", "txt-bold") or None)
        missing = [f for f, t in (("title", first("h1")), ("description", first("p"))) if not t]
        assert errors.get(k) == ("missing: " + ",".join(missing) if missing else None)


@pytest.mark.parametrize("text", ["&#233;&eacute;&amp;lt;", "&#0;&#x110000;&#xD800;&#55296;", "&", "a&b;c&;", "&#x80;&#150;", "plain"])
def test_character_references(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(M.decoded(F.col("t"))).first()[0]
    assert got == html.unescape(text)
