"""Pages of a document: divisions up to a depth with carved introductions, page milestones, expressions; links between them.

A selector takes the document and the settings and returns elements. Carved elements are copies that keep the numbers of
the nodes they stand for.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from quillspark.tree import xpath
from quillspark.tree.library import unique
from quillspark.tree.nodes import ID, Node, top

# Empty elements that are no content of an introduction.
MILESTONES = {"pb", "cb", "lb", "milestone", "anchor"}
DOCBOOK = "http://docbook.org/ns/docbook"


@dataclass
class PageSettings:
    """``selector`` is ``divisions``, ``docbook``, ``jats``, ``pages``, an XPath expression, or a function."""

    selector: str | Callable = "//text/body/div"
    depth: int = 1
    file_pattern: str = "{xml_id}.html"
    link_pattern: str | None = None
    fragments: dict[str, dict] = field(default_factory=dict)


def has_content(node: Node) -> bool:
    """Whether a node makes an introduction: text, or an element that is no empty milestone."""
    return bool(node.text and node.text.strip()) if node.kind == "t" else node.kind == "e" and (node.tag not in MILESTONES or bool(node.elements()))


def nested(candidates: list[Node]) -> list[Node]:
    """Leaves as they are; of a section with candidates among its children, what stands before the first one, if that is content."""
    chosen, out = {id(n) for n in candidates}, []
    for section in candidates:
        first = next((k for k, c in enumerate(section.children) if id(c) in chosen), None)
        if first is None:
            out.append(section)
        elif any(map(has_content, section.children[:first])):
            intro = section.shell()
            for c in section.children[:first]:
                intro.add(c.copy())
            intro.parent = section.parent
            out.append(intro)
    return out


def _within(tree: Node, depth: int, fits: Callable[[Node], bool]) -> list[Node]:
    return [n for n in tree.walk() if n.kind == "e" and fits(n) and 1 + sum(fits(a) for a in n.ancestors()) <= max(1, depth)]


def divisions(tree: Node, settings: PageSettings) -> list[Node]:
    ns = top(tree).ns
    div = lambda n: n.tag == "div" and n.ns == ns
    inside = lambda n: any(a.tag == "body" and a.parent is not None and a.parent.tag == "text" for a in n.ancestors())
    return nested([n for n in _within(tree, settings.depth, div) if inside(n)])


def docbook(tree: Node, settings: PageSettings) -> list[Node]:
    return nested(_within(tree, settings.depth, lambda n: n.tag == "section" and n.ns == DOCBOOK))


def jats(tree: Node, settings: PageSettings) -> list[Node]:
    """Front, sections, and the back where it is not empty."""
    whole = top(tree)
    part = lambda name: [c for c in whole.elements() if c.tag == name] if whole.tag == "article" else []
    return [*part("front"), *nested(_within(tree, settings.depth, lambda n: n.tag == "sec")), *[b for b in part("back") if b.children]]


def page_context(tree: Node, here: Node, after: Node | None) -> Node | None:
    """What a page is carved from: the nearest common ancestor with the next break; for the last page the nearest
    division or text, the whole text if that has one break only."""
    if after is not None:
        above = {id(a) for a in after.ancestors()}
        return next((a for a in here.ancestors() if id(a) in above), None)
    text = next((a for a in here.ancestors() if a.tag == "text"), None)
    if text is not None and sum(n.tag == here.tag for n in text.walk()) == 1:
        return text
    return next((a for a in here.ancestors() if a.tag in ("div", "text")), top(tree))


def carve(context: Node, here: Node, after: Node | None) -> Node | None:
    """The context between two breaks: elements that hold a break are rebuilt, others in between are taken whole."""
    marks = {id(here), id(after)}
    holds = {id(a) for m in (here, after) if m is not None for a in m.ancestors()}
    low, high = here.node_id, after.node_id if after is not None else float("inf")

    def taken(n: Node) -> Node | None:
        if id(n) in marks:
            return n.copy() if n is here else None
        if id(n) in holds:
            out = n.shell()
            for c in n.children:
                if (made := taken(c)) is not None:
                    out.add(made)
            return out
        return n.copy() if low < n.node_id < high else None

    return taken(context)


def pages(tree: Node, settings: PageSettings) -> list[Node]:
    """One carved tree for each page break, named by the break's id, number or place."""
    whole = top(tree)
    breaks = [n for n in tree.walk() if n.kind == "e" and n.tag == "pb" and n.ns == whole.ns]
    used, out = {n.id for n in tree.walk() if n.kind == "e" and n.id}, []
    for k, here in enumerate(breaks):
        after = breaks[k + 1] if k + 1 < len(breaks) else None
        context = page_context(tree, here, after)
        if context is None or (made := carve(context, here, after)) is None:
            continue
        name = here.id
        if not name:
            number = re.sub(r"[^A-Za-z0-9_.-]+", "-", (here.get("n") or "").strip()).strip("-")
            name = unique(f"page-{number}" if number else f"page-{k + 1}", used)
        made.attrs = made.attrs | {ID: name}
        made.parent = context.parent
        out.append(made)
    return out


SELECTORS: dict[str, Callable] = {"divisions": divisions, "docbook": docbook, "jats": jats, "pages": pages}


def select(tree: Node, settings: PageSettings, env: xpath.Env) -> list[Node]:
    """The pages of a document, elements only."""
    if top(tree) is None:
        return []
    if callable(settings.selector):
        found = settings.selector(tree, settings)
    elif settings.selector in SELECTORS:
        found = SELECTORS[settings.selector](tree, settings)
    else:
        found = xpath.evaluate(tree, settings.selector, env)
    return [n for n in found if isinstance(n, Node) and n.kind == "e"]


def file_name(pattern: str, page: Node, number: int, stem: str) -> str:
    """A page's file: fields of the pattern are filled; without a field it is taken as it is; without an id, the number."""
    if pattern == "{xml_id}.html" and page.id is not None:
        return f"{page.id}.html"
    if not re.search(r"\{\w+\}", pattern):
        return pattern
    values = {"xml_id": page.id, "ident": page.get("ident") or page.id, "index": str(number), "stem": stem}
    if any(values.get(f) is None for f in re.findall(r"\{(\w+)\}", pattern) if f in values):
        return f"{number:03d}" + (re.search(r"\.\w+$", pattern) or ["" if "." not in pattern else ".html"])[0]
    return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), pattern)


def metadata(found: list[Node], settings: PageSettings, stem: str) -> list[dict]:
    """Pages with number, id, file, neighbours and path."""
    out = []
    for k, page in enumerate(found, 1):
        out.append({"page_no": k, "page_id": f"chunk-{k:03d}", "file": file_name(settings.file_pattern, page, k, stem).replace("/", "-").replace("\\", "-"), "xml_id": page.id, "xpath": page.xpath})
    stems = [p["file"].rpartition(".")[0] or p["file"] for p in out]
    for k, p in enumerate(out):
        p["prev"], p["next"] = stems[k - 1] if k else None, stems[k + 1] if k + 1 < len(out) else None
    return out


def anchors(found: list[Node], files: list[str], external: dict[str, str] | None = None) -> dict[str, str]:
    """File of each id: the first page that holds it; ids of other runs only fill gaps."""
    out: dict[str, str] = {}
    for page, file in zip(found, files, strict=True):
        for n in page.walk():
            if n.kind == "e" and n.id:
                out.setdefault(n.id, file)
    for k, v in (external or {}).items():
        out.setdefault(k, v)
    return out


def rewritten(href: str, here: str, held: dict[str, str], pattern: str | None = None) -> str:
    """A link of a page: ``#id`` of the same file stays, other known ids get their file; unknown ones are left alone.

    With a pattern, its first group names the id in links of another form.
    """
    m = re.fullmatch(pattern, href) if pattern else None
    anchor = m[1] if m else href[1:] if href.startswith("#") else None
    if anchor is None:
        return href
    found = anchor if anchor in held else unquote(anchor) if unquote(anchor) in held else None
    if found is None:
        return href
    file = held[found]
    if file == here:
        return f"#{found}"
    return file if file.rpartition(".")[0] == found else f"{file}#{found}"


def rewrite(pieces: list, here: str, held: dict[str, str], pattern: str | None = None) -> list:
    """Links in output elements: ``href``, ``data-target``, and link components, which become plain links."""
    for p in pieces:
        for n in p.walk() if isinstance(p, Node) else ():
            if n.kind != "e":
                continue
            if n.tag == "pb-link" and (to := n.get("xml-id") or n.get("node-id") or n.get("hash")):
                n.tag, n.attrs = "a", {k: v for k, v in n.attrs.items() if k not in ("xml-id", "node-id", "hash")} | {"href": f"#{to}"}
            for name in ("href", "data-target"):
                if name in n.attrs:
                    n.attrs[name] = rewritten(str(n.attrs[name]), here, held, pattern)
    return pieces
