"""Trees of one document, built from the nodes that shredding gives."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from quillspark.sources.markup import parse_html, parse_xml

ID = "xml:id"


class Node:
    """An element (``e``), text run (``t``), comment (``c``), processing instruction (``p``) or document (``d``).

    A carved copy keeps the ``node_id`` of the node it stands for and points to it by ``source``.
    """

    __slots__ = ("kind", "ns", "tag", "attrs", "text", "parent", "children", "node_id", "path", "source", "final", "index", "named")

    def __init__(self, kind: str, tag: str | None = None, ns: str | None = None, attrs: dict | None = None, text: str | None = None, parent: Node | None = None, node_id: int = 0, xpath: str | None = None) -> None:
        self.kind = kind
        self.tag = tag
        self.ns = ns
        self.attrs = {} if attrs is None else attrs
        self.text = text
        self.parent = parent
        self.children: list[Node] = []
        self.node_id = node_id
        self.path = xpath
        self.source = self.index = self.named = None
        self.final = False

    @property
    def id(self) -> str | None:
        attrs = self.attrs
        return (attrs.get(ID) or attrs.get("id")) if attrs else None

    @property
    def xpath(self) -> str | None:
        """The path from the root; of parsed trees it is worked out for all children of an element when one is asked for."""
        if self.path is None and self.kind == "e":
            if self.source is not None:
                self.path = self.source.xpath
            elif self.parent is not None and not self.final:
                self.parent.name_children()
        return self.path

    def name_children(self) -> None:
        root = self.root()
        if root.kind != "d":
            return
        whole = top(root)
        home, above = (whole.ns or "") if whole is not None else "", None if self.kind == "d" else self.xpath
        counts: dict[str, int] = {}
        for all_, c in enumerate(self.elements(), 1):
            k = counts[c.tag] = counts.get(c.tag, 0) + 1
            if c.path is None:
                c.path = f"/{c.tag}" if above is None else f"{above}/{c.tag}[{k}]" if (c.ns or "") == home else f"{above}/*[{all_}]"

    def by_tag(self) -> dict[str, list[Node]]:
        """Elements below this node by local name, in document order; built once, as what XPath keeps beside them."""
        if self.named is None:
            self.named = {}
            for n in self.walk():
                if n.kind == "e" and n is not self:
                    self.named.setdefault(n.tag, []).append(n)
        return self.named

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == "e"]

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if n.children:
                todo += n.children[::-1]

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None and n.kind != "d":
            yield n
            n = n.parent

    def root(self) -> Node:
        n = self
        while n.parent is not None:
            n = n.parent
        return n

    def string(self) -> str:
        if self.kind not in "ed":
            return self.text or ""
        if len(self.children) == 1 and self.children[0].kind == "t":
            return self.children[0].text
        return "".join([n.text for n in self.walk() if n.kind == "t"])

    def shell(self) -> Node:
        """The element alone, without children."""
        out = Node(self.kind, self.tag, self.ns, dict(self.attrs), self.text, None, self.node_id, self.path)
        out.source = self.source or self
        return out

    def copy(self) -> Node:
        out = self.shell()
        for c in self.children:
            out.add(c.copy())
        return out

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child


def build(rows: list[dict]) -> Node:
    """The document node over node rows in preorder."""
    top = Node("d", node_id=-1)
    by_id: dict[int | None, Node] = {None: top}
    for r in rows:
        if r["kind"] in "etcp":
            made = Node(r["kind"], r["tag"], r["ns"] or None, r["attrs"], r["text"], None, r["node_id"], r["xpath"])
            by_id[r["node_id"]] = by_id[r["parent_id"]].add(made)
    return top


class TreeBuilder:
    """Builds a tree while a document is parsed, with the numbers and paths that the node table has."""

    def __init__(self) -> None:
        self.top, self.pending, self.n = Node("d", node_id=-1), [], 0
        self.open, self.tags = [self.top], []

    def _add(self, made: Node) -> Node:
        made.node_id = self.n
        self.n += 1
        parent = made.parent = self.open[-1]
        parent.children.append(made)
        return made

    def flush(self) -> None:
        if self.pending:
            text, self.pending = "".join(self.pending), []
            if text and self.tags:
                self._add(Node("t", text=text))

    def start(self, ns: str | None, tag: str, attrs: dict[str, str], at: tuple[int, int] | None) -> None:
        if self.pending:
            self.flush()
        self.open.append(self._add(Node("e", tag, ns, attrs)))
        self.tags.append(tag)

    def end(self) -> None:
        if self.pending:
            self.flush()
        self.open.pop()
        self.tags.pop()

    def data(self, text: str, at: tuple[int, int] | None) -> None:
        self.pending.append(text)

    def other(self, kind: str, text: str, at: tuple[int, int] | None) -> None:
        self.flush()
        if kind == "x":
            self.top.text = text
        elif self.tags:
            self._add(Node(kind, text=text))

    def finish(self) -> Node:
        self.flush()
        return self.top


def read(raw: bytes | str | None, kind: str = "xml") -> Node:
    """The tree of a raw document; null and empty give a document without children, a malformed one what was read."""
    if not raw:
        return Node("d", node_id=-1)
    return parse_xml(raw, None, TreeBuilder(), placed=False) if kind == "xml" else parse_html(raw, TreeBuilder())


def error_of(tree: Node) -> str | None:
    """Why the document of a tree is malformed, if it is."""
    return tree.text if tree.kind == "d" else None


def top(tree: Node) -> Node | None:
    """The outermost element."""
    return next(iter(tree.elements()), None) if tree.kind == "d" else tree


def attributes(attrs: dict[str, str]) -> str:
    return "".join(f" {k.rpartition('}')[2]}={quoteattr(v)}" for k, v in attrs.items())


def serialise(node: Node) -> str:
    """XML with local names, no namespaces."""
    if node.kind == "t":
        return escape(node.text or "")
    if node.kind in "cp":
        return f"<!--{node.text}-->" if node.kind == "c" else f"<?{node.text}?>"
    inner = "".join(map(serialise, node.children))
    if node.kind == "d":
        return inner
    return f"<{node.tag}{attributes(node.attrs)}>{inner}</{node.tag}>" if inner else f"<{node.tag}{attributes(node.attrs)}/>"


def pretty(node: Node, depth: int = 0) -> str:
    """Indented XML, for elements without mixed content; mixed content stays in one line."""
    pad = "  " * depth
    if node.kind != "e" or any(c.kind == "t" and c.text.strip() for c in node.children) or not node.elements():
        return pad + serialise(node)
    inner = "\n".join(pretty(c, depth + 1) for c in node.children if c.kind != "t")
    return f"{pad}<{node.tag}{attributes(node.attrs)}>\n{inner}\n{pad}</{node.tag}>"


def dedent(source: str) -> str:
    """Common indentation off all lines."""
    lines = source.split("\n")
    wide = [len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()]
    cut = min(wide, default=0)
    return "\n".join([lines[0], *[x[cut:] if x.strip() else "" for x in lines[1:]]]).strip("\n")
