"""Tables out of HTML: links, dated topic lists, cited paragraphs, reference lists and article texts.

Pages become trees by the standard library's parser and are read by table functions, one page at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import first_date

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_MARK = re.compile(r"\[\d+\]")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def text(self) -> str:
        if self.tag in ("script", "style"):
            return ""
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def own(self, *tags: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag in tags]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "dt", "dd") and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def flat(text: str) -> str:
    return " ".join(text.split())


def links(html: str | None) -> list[tuple[int, str, str]]:
    """(ordinal, href, label) of every link with a target."""
    found = [n for n in tree(html).find("a") if n.attrs.get("href")]
    return [(i, n.attrs["href"], flat(n.text())) for i, n in enumerate(found)]


def article_text(html: str | None) -> tuple[str, str]:
    """(title, text): the first heading or the title, and the paragraphs of the article or else of the page."""
    root = tree(html)
    body = (root.find("article", "main") or [root])[0]
    heads = body.find("h1") or root.find("h1", "title")
    paragraphs = [flat(p.text()) for p in body.find("p")]
    return (flat(heads[0].text()) if heads else ""), "\n".join(p for p in paragraphs if p)


def normal_heading(text: str) -> str:
    return flat(_MARK.sub("", text)).lower()


def topic_leaves(html: str | None, target: str = "") -> list[dict]:
    """Rows of a current-events page: dated regions hold category headings with trees of topics, whose leaves are summaries.

    A leaf has its date, category, chain of topics, its summary without links to outlets, and those links by outlet."""
    out = []
    wanted = normal_heading(target)
    for region in tree(html).walk():
        date = re.fullmatch(r"(\d{4})_([A-Za-z]+)_(\d{1,2})", region.attrs.get("id", ""))
        if not date:
            continue
        category = ""
        for node, in_item in _below(region):
            if node.tag in ("b", "h3", "h4"):
                category = flat(node.text())
            elif node.tag == "ul" and not in_item:
                for item in node.own("li"):
                    out += _leaves(item, [], region.attrs["id"], category, wanted)
    return out


def _below(region: Node) -> Iterator[tuple[Node, bool]]:
    """All nodes of a region in page order, and whether they are part of a list item."""
    open_ = [(c, False) for c in reversed(region.children) if isinstance(c, Node)]
    while open_:
        node, in_item = open_.pop()
        yield node, in_item
        open_ += [(c, in_item or node.tag == "li") for c in reversed(node.children) if isinstance(c, Node)]


def _leaves(item: Node, chain: list[str], date: str, category: str, wanted: str) -> list[dict]:
    below = item.own("ul")
    if below:
        head = flat("".join(c if isinstance(c, str) else "" if c.tag == "ul" else c.text() for c in item.children))
        return [row for ul in below for li in ul.own("li") for row in _leaves(li, [*chain, head], date, category, wanted)]
    if wanted and not any(wanted in normal_heading(t) for t in chain):
        return []
    outlets, parts = {}, []
    for c in item.children:
        label = flat(c.text()) if isinstance(c, Node) else ""
        outlet = re.fullmatch(r"\((.+)\)", label)
        if isinstance(c, Node) and c.tag == "a" and outlet:
            outlets[outlet[1]] = c.attrs.get("href", "")
        else:
            parts.append(c if isinstance(c, str) else c.text())
    return [{"date": date, "category": category, "topics": chain, "summary": flat(_MARK.sub("", "".join(parts))), "articles": outlets}]


def external_link(node: Node) -> str:
    """The first link of class external, else the first to http."""
    found = [a for a in node.find("a") if a.attrs.get("href")]
    marked = [a for a in found if "external" in a.classes()] or [a for a in found if a.attrs["href"].startswith("http")]
    return marked[0].attrs["href"] if marked else ""


# The elements that mark a reference's date, the best first, as tag, attribute and the class that it has to name.
DATE_MARKS = (("span", "class", "reference-date"), ("span", "class", "date"), ("time", "datetime", ""), ("time", "", ""))


def reference_date(item: Node) -> str:
    """A reference's date: of the elements that mark dates, the best kind first, or else of its whole text."""
    for tag, attribute, name in DATE_MARKS:
        marked = next((n for n in item.find(tag) if (not attribute or attribute in n.attrs) and (not name or name in n.classes())), None)
        if marked is not None and (found := first_date(marked.attrs.get("datetime") or marked.text())):
            return found.isoformat()
    found = first_date(item.text())
    return found.isoformat() if found else ""


def references(html: str | None) -> list[tuple[int, str, str, str, str]]:
    """(ordinal, id, text, link, date) of references: items with an id between the heading References and the next of its rank.

    Without the heading they are those of lists of class references, and without such lists all items with an id."""
    root = tree(html)
    inside, items = False, []
    for node in root.walk():
        if node.tag == "h2":
            inside = "References" in (node.attrs.get("id"), *(n.attrs.get("id") for n in node.find("span")))
        elif inside and node.tag == "li" and node.attrs.get("id"):
            items.append(node)
    lists = [n for n in root.find("ol", "ul") if "references" in n.classes()]
    items = items or [li for n in (lists or [root]) for li in n.find("li") if li.attrs.get("id")]
    return [(i, li.attrs["id"], flat(li.text()), external_link(li), reference_date(li)) for i, li in enumerate(items)]


def citations(html: str | None) -> list[tuple[int, str, str, str]]:
    """(ordinal, title, summary, reference id): paragraphs with citation markers; the title is the last h3 or h4, or a bold start."""
    out, title = [], ""
    for node in tree(html).walk():
        if node.tag in ("h3", "h4"):
            title = normal_heading(node.text())
        elif node.tag == "p":
            first = next((c for c in node.children if isinstance(c, Node) or c.strip()), None)
            head = normal_heading(first.text()) if isinstance(first, Node) and first.tag in ("b", "strong") else title
            marks = [a.attrs["href"][1:] for a in node.find("a") if a.attrs.get("href", "").startswith("#")]
            out += [(head, flat(_MARK.sub("", node.text())), m) for m in marks]
    return [(i, *row) for i, row in enumerate(out)]


@F.udtf(returnType="ordinal int, href string, label string")
class LinkTable:
    def eval(self, html: str):
        yield from links(html)


@F.udtf(returnType="date string, category string, topics array<string>, summary string, articles map<string,string>")
class TopicTable:
    def eval(self, html: str, target: str):
        for r in topic_leaves(html, target or ""):
            yield r["date"], r["category"], r["topics"], r["summary"], r["articles"]


@F.udtf(returnType="ordinal int, reference_id string, text string, link string, date string")
class ReferenceTable:
    def eval(self, html: str):
        yield from references(html)


@F.udtf(returnType="ordinal int, title string, summary string, reference_id string")
class CitationTable:
    def eval(self, html: str):
        yield from citations(html)


def article(html: Column | str) -> Column:
    """struct(title, text) of each page, in Arrow batches."""
    @F.pandas_udf("title string, text string")
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article_text(h) for h in batch], columns=["title", "text"])

    return run(html)
