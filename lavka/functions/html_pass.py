"""One tolerant walk over a stored page, run inside Arrow batches.

Only what needs nesting goes through here: product fields, description
paragraphs, characteristic rows and nested menus. Flat links are read by
built-in expressions (``lavka.functions.links``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle

# Ship this module inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that never have an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An open or closed element; ``pieces`` is a list only where text is wanted."""

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs = tag, attrs
        self.pieces: list[str] | None = None
        self.cells: list[Node] | None = None
        self.anchors: list[str] = []
        self.owners: list[str] = []

    def text(self) -> str:
        return "".join(self.pieces or [])

    def stripped(self) -> str:
        return "".join(piece.strip() for piece in self.pieces or [])


class Walker(HTMLParser):
    """Keeps the stack of open elements and hands every text run to those that
    record it. An end tag closes everything opened since its start tag and is
    ignored when there is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Node] = []
        self.run: list[str] = []

    def entered(self, node: Node) -> None:
        raise NotImplementedError

    def read(self, html: str) -> "Walker":
        self.feed(html)
        self.close()
        self._end_run()
        return self

    def _end_run(self) -> None:
        text, self.run = "".join(self.run), []
        if text and not (self.open and self.open[-1].tag in ("script", "style", "template")):
            for node in self.open:
                if node.pieces is not None:
                    node.pieces.append(text)

    def handle_starttag(self, tag, attrs):
        self._end_run()
        node = Node(tag, {name: value or "" for name, value in attrs})
        self.entered(node)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_run()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_comment(self, data):
        self._end_run()

    def handle_data(self, data):
        self.run.append(data)


class ProductWalker(Walker):
    """Finds the first node of each selector ``(tag, attribute, value)`` (any of
    them may be None) and, inside the description block, paragraphs and rows."""

    def __init__(self, selectors: dict[str, tuple]):
        super().__init__()
        self.selectors = selectors
        self.found: dict[str, Node] = {}
        self.paragraphs: list[Node] = []
        self.rows: list[Node] = []

    def entered(self, node: Node) -> None:
        for name, (tag, attribute, value) in self.selectors.items():
            if name in self.found or (tag and tag != node.tag):
                continue
            if attribute and " ".join(node.attrs.get(attribute, "").split()) != value:
                continue
            node.pieces = []
            self.found[name] = node
        block = self.found.get("description")
        if block is None or block not in self.open:
            return
        if node.tag == "p":
            node.pieces = []
            self.paragraphs.append(node)
        elif node.tag == "tr" and any(n.tag == "table" for n in self.open):
            node.cells = []
            self.rows.append(node)
        elif node.tag == "td":
            node.pieces = []
            for row in self.open:
                if row.cells is not None:
                    row.cells.append(node)

    def fields(self) -> dict:
        def of(name: str) -> Node:
            return self.found.get(name) or Node("", {})

        return {
            "title": of("title").text(),
            "code": of("code").text(),
            "price": of("price").stripped(),
            "paragraphs": [p.stripped() for p in self.paragraphs],
            "pairs": [
                {"key": row.cells[0].stripped().rstrip(":"), "value": row.cells[1].stripped()}
                for row in self.rows
                if len(row.cells) == 2
            ],
            "error": None,
        }


class MenuWalker(Walker):
    """For every link inside a nested list: one row per entry that owns the list,
    an owner being a link that precedes the list under the same parent."""

    def __init__(self, menu_class: str, list_class: str, link_class: str):
        super().__init__()
        self.menu_class, self.list_class, self.link_class = menu_class, list_class, link_class
        self.rows: list[tuple] = []
        self.position = 0

    def entered(self, node: Node) -> None:
        classes = node.attrs.get("class", "").split()
        parent = self.open[-1] if self.open else None
        if node.tag == "ul" and self.list_class in classes and parent:
            node.owners = list(parent.anchors)
        elif node.tag == "a" and (self.menu_class in classes or self.link_class in classes):
            self.position += 1
            href = node.attrs.get("href", "")
            if self.link_class in classes and href:
                node.pieces = []
                depth = 0
                for holder in reversed(self.open):
                    depth += bool(holder.owners)
                    self.rows.extend((owner, href, node, depth, self.position) for owner in holder.owners)
            if parent:
                parent.anchors.append(href)


NO_FIELDS = {"title": "", "code": "", "price": "", "paragraphs": [], "pairs": []}


def read_products(
    batches: Iterator[pd.DataFrame], selectors: dict, parts: tuple[str, ...], last_pairs: bool = False
) -> Iterator[pd.DataFrame]:
    """Pages to the wanted parts of their product beside their other columns; a
    page that fails becomes an error row. ``last_pairs`` keeps of each key the last
    value, at the key's first place."""
    for batch in batches:
        rows = []
        for html in batch["html"]:
            try:
                rows.append(ProductWalker(selectors).read(html).fields())
            except Exception as problem:  # one page must not stop the others
                rows.append({**NO_FIELDS, "error": f"{type(problem).__name__}: {problem}"})
        names = [*parts, "error"]
        for row in rows if last_pairs else ():
            last = {pair["key"]: pair for pair in row["pairs"]}
            row["pairs"] = list(last.values())
        yield batch.drop(columns="html").assign(**{name: [row[name] for row in rows] for name in names})


def read_menus(batches: Iterator[pd.DataFrame], **classes: str) -> Iterator[pd.DataFrame]:
    """(page_id, html) to one row per owner and link, a pair kept at its first place."""
    names = ["page_id", "ancestor_path", "href", "text", "depth", "pos"]
    for batch in batches:
        rows = []
        for page_id, html in zip(batch["page_id"], batch["html"]):
            seen = set()
            for owner, href, node, depth, pos in MenuWalker(**classes).read(html or "").rows:
                if (owner, href, node.text()) not in seen:
                    seen.add((owner, href, node.text()))
                    rows.append((page_id, owner, href, node.text(), depth, pos))
        yield pd.DataFrame(rows, columns=names)
