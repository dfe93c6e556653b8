"""What behaviours make of a node in each channel: HTML, print and EPUB elements, Markdown, Typst, plain text, records.

A method gets the node, its classes, its content (items of an expression) and the parameters it accepts, and returns a
list of pieces: output elements, strings, or records.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from quillspark.tree.nodes import Node, serialise
from quillspark.tree.xpath import Attribute, text_of

if TYPE_CHECKING:
    from quillspark.tree.process import Process

# Parameters that behaviours accept beside their content.
ACCEPTS = {
    "heading": ["level"], "list": ["type"], "list_item": ["n"], "link": ["uri", "target"], "cell": ["type"], "figure": ["title"], "graphic": ["url", "width", "height", "scale", "title"],
    "note": ["place", "label"], "cit": ["source"], "break": ["type", "label"], "anchor": ["id"], "alternate": ["default", "alternate"], "webcomponent": ["name"], "code": ["language"], "index": ["type"], "metadata": ["key"],
}
# Base languages written from right to left.
RTL = {"ar", "arc", "dv", "fa", "ha", "he", "khw", "ks", "ku", "ps", "ur", "yi", "syr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SOFT = "­"
_MARKUP, _SOFT_SPACE = re.compile('[&<>"]'), re.compile(SOFT + r"\s+")
_LINE, _BLANKS, _LINES, _TAIL = re.compile(r"[ \t]*\r?\n\s*"), re.compile(r"[ \t]+"), re.compile(r"\n{3,}"), re.compile(r"[ \t]+\n")


def param_text(items: list | None) -> str:
    """A parameter as text: its first item, stripped; nothing for the empty sequence."""
    return text_of(items[0]).strip() if items else ""


def flat(items: list | None):
    """A parameter as one value: truth values and numbers stay, text is stripped, several items are joined, nothing is null."""
    if not items:
        return None
    if len(items) == 1 and isinstance(items[0], bool | int | float):
        return items[0]
    return " ".join(t for x in items if (t := " ".join(text_of(x).split()))) or None


def note_name(node: Node, otherwise: str) -> str:
    return re.sub(r"[-.]", "_", node.id or otherwise)


def language(node: Node) -> dict[str, str]:
    """``lang`` and ``dir`` of an element that names its language."""
    code = node.get("xml:lang")
    return {} if not code else {"lang": code} | ({"dir": "rtl"} if code.lower().split("-")[0] in RTL else {})


def range_anchor(node: Node, process: Process) -> bool:
    """Whether a note closes a range: its target is an anchor, and it stands in the text."""
    if node.tag != "note" or not node.get("target") or any(a.tag == "listAnnotation" for a in node.ancestors()):
        return False
    peer = process.env.by_id(node.root()).get(node.get("target").lstrip("#").strip())
    return peer is not None and peer.tag == "anchor"


def joined(pieces: list) -> str:
    """Pieces as one string; a line break after a soft hyphen goes, also across pieces."""
    if len(pieces) == 1:
        return html(pieces[0]) if isinstance(pieces[0], Node) else str(pieces[0])
    out, soft = [], False
    for p in pieces:
        p = html(p) if isinstance(p, Node) else str(p)
        p = p.lstrip(" \t\r\n") if soft else p
        if p:
            out.append(p)
            soft = p[-1] == SOFT
    return "".join(out)


def html(node: Node) -> str:
    """HTML of an output element: void elements have no end tag, other empty ones do."""
    out: list[str] = []
    _write(node, out)
    return "".join(out)


def _write(node: Node, out: list[str]) -> None:
    if node.kind == "t":
        text = node.text or ""
        if _MARKUP.search(text):
            text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        out.append(text)
        return
    tag, attrs = node.tag, ""
    for k, v in node.attrs.items():
        v = str(v)
        if _MARKUP.search(v):
            v = v.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
        attrs += f' {k.rpartition("}")[2]}="{v}"'
    out.append(f"<{tag}{attrs}>")
    if tag not in VOID:
        for c in node.children:
            if c.kind in "et":
                _write(c, out)
        out.append(f"</{tag}>")


class Html:
    """Elements of web pages."""

    name, copies_foreign, collects, records = "web", True, True, False

    def __init__(self, process: Process) -> None:
        self.process = process

    # text runs are kept as they are
    def run(self, text: str) -> str:
        return _SOFT_SPACE.sub(SOFT, text) if SOFT in text else text

    def element(self, tag: str, classes: list[str] | None, node: Node | None, content: list | None = None, **attrs: str) -> Node:
        made = {} if classes is None else {"class": " ".join(dict.fromkeys(classes))}
        for k, v in attrs.items():
            if v is not None:
                made[k.rstrip("_").replace("_", "-")] = v
        if node is not None and node.attrs:
            made |= language(node)
            if (name := node.id) and "id" not in made and tag not in ("a", "td", "th", "figure"):
                made["id"] = name
        out = Node("e", tag, None, made)
        out.final = True
        return self.fill(out, self.process.content(node, content)) if content else out

    @staticmethod
    def fill(out: Node, pieces: list) -> Node:
        children = out.children
        for p in pieces:
            if isinstance(p, Node):
                p.parent = out
                children.append(p)
            elif isinstance(p, str) and p:
                last = children[-1] if children else None
                if last is not None and last.kind == "t":
                    last.text += p.lstrip(" \t\r\n") if last.text.endswith(SOFT) else p
                else:
                    children.append(Node("t", None, None, None, p, out))
        return out

    def foreign(self, node: Node) -> list:
        out = node.shell()
        out.final = True
        return [self.fill(out, self.process.apply(node.children))]

    def unmatched(self, node: Node) -> list:
        return self.process.apply(node.children)

    def block(self, node, cls, content):
        return [self.element("div", cls, node, content)]

    def inline(self, node, cls, content):
        return [self.element("span", cls, node, content)]

    def paragraph(self, node, cls, content):
        return [self.element("p", cls, node, content)]

    def heading(self, node, cls, content, level=None):
        return [self.element(f"h{self.level(level, 6)}", cls, node, content)]

    @staticmethod
    def level(level: list | None, most: int) -> int:
        try:
            return max(1, min(most, int(float(param_text(level)))))
        except ValueError:
            return 1

    def section(self, node, cls, content):
        return [self.element("section", cls, node, content)]

    def body(self, node, cls, content):
        return [self.element("body", cls, node, content)]

    def document(self, node, cls, content):
        out = self.element("html", cls, node)
        head = out.add(self.element("head", None, None))
        head.add(self.element("meta", None, None, charset="utf-8"))
        if self.process.css:
            self.fill(head.add(self.element("style", None, None, type="text/css")), [self.process.css])
        body = out.add(self.element("body", None, None))
        self.fill(body, self.process.content(node, content))
        return [out]

    def pass_through(self, node, cls, content):
        return self.process.content(node, content)

    @staticmethod
    def labelled(node: Node | None) -> bool:
        return node is not None and any(c.tag == "label" for c in node.elements())

    def list(self, node, cls, content, type=None):  # noqa: A002
        ordered = (param_text(type) or node.get("type")) == "ordered"
        return [self.element("dl" if self.labelled(node) else "ol" if ordered else "ul", cls, node, content)]

    def list_item(self, node, cls, content, n=None):
        if self.labelled(node.parent):
            before = [c for c in node.parent.elements() if c.node_id < node.node_id]
            label = before[-1] if before and before[-1].tag == "label" else None
            if label is not None or n:
                term = self.element("dt", cls, node)
                self.fill(term, self.process.apply(label.children) if label is not None else [param_text(n)])
                return [term, self.element("dd", cls, node, content)]
        return [self.element("li", cls, node, content)]

    def address(self, items: list | None) -> str | None:
        if items and isinstance(items[0], Node):
            return items[0].get("{http://www.w3.org/1999/xlink}href")
        return param_text(items) or None

    def link(self, node, cls, content, uri=None, target=None):
        return [self.element("a", cls, node, content, href=self.address(uri), target=param_text(target) or None)]

    def table(self, node, cls, content):
        return [self.element("table", cls, node, content)]

    def row(self, node, cls, content):
        return [self.element("tr", cls, node, content)]

    def cell(self, node, cls, content, type=None):  # noqa: A002
        return [self.element("th" if param_text(type) == "head" else "td", cls, node, content, colspan=node.get("cols"), rowspan=node.get("rows"))]

    def figure(self, node, cls, content, title=None):
        out = self.element("figure", cls, None, None)
        self.fill(out, self.process.content(node, content))
        if title:
            out.add(self.element("figcaption", None, None)).attrs |= language(node)
            self.fill(out.children[-1], self.process.content(node, title))
        return [out]

    def graphic(self, node, cls, content, url=None, width=None, height=None, scale=None, title=None):
        style = "; ".join(f"{k}: {param_text(v)}" for k, v in (("width", width), ("height", height), ("scale", scale)) if param_text(v))
        return [self.element("img", cls, node, None, src=self.address(url), style=style or None)]

    def note(self, node, cls, content, place=None, label=None):
        mark, where = param_text(label), param_text(place)
        run = self.process.run
        if where == "start":
            return self.range_start(node, cls, mark)
        if where != "margin" and not mark and not content:
            return []
        name = run.names.get(node.node_id) or note_name(node, str(run.next_id()))
        if where == "margin":
            if not mark:
                return [self.element("span", [*cls, "margin-note"], node, content, id=f"margin_ref_{name}")]
            body = self.element("span", [*cls, "margin-note"], node)
            self.fill(body.add(self.element("span", ["n"], None)), [mark])
            self.fill(body, [" ", *self.process.content(node, content)])
            return [self.fill(self.element("span", [*cls, "margin-note-ref"], node), [mark]), body]
        shown = foot = mark
        ends = bool(mark) and range_anchor(node, self.process)
        if ends:
            shown, foot = f"-{mark}", f"{mark}-{mark}"
        elif not mark:
            shown = foot = str(run.next_note())
        return self.footnote(node, cls, content, name, shown, foot, mark, where, ends)

    def range_start(self, node, cls, mark):
        if not mark:
            return []
        # The note that closes the range keeps the name that is given to it here, so that the link finds it.
        target = next((n for n in node.root().walk() if n.tag == "note" and node.id and (n.get("target") or "").lstrip("#") == node.id), None)
        name = note_name(target if target is not None else node, str(self.process.run.next_id()))
        if target is not None:
            self.process.run.names[target.node_id] = name
        out = self.element("span", [*cls, "note-range-start"], None, style="display:inline-block", data_n=mark, data_range="start")
        self.fill(out.add(self.element("a", ["note"], None, rel="footnote", href=f"#fn_{name}")), [f"{mark}-"])
        return [out]

    def footnote(self, node, cls, content, name, shown, foot, mark, where, ends):
        ends = "end" if ends else None
        ref = self.element("span", None, None, id=f"fnref_{name}", style="display:inline-block", class_=" ".join(cls), data_n=mark or None, data_range=ends)
        self.fill(ref.add(self.element("a", ["note"], None, rel="footnote", href=f"#fn_{name}")), [shown])
        body = self.element("dl", None, None, class_="footnote", id=f"fn_{name}", data_n=mark or None, data_range=ends)
        self.fill(body.add(self.element("dt", ["fn-number"], None)), [foot])
        inner = body.add(self.element("dd", ["fn-content"], None))
        inner.attrs |= language(node)
        self.fill(inner, self.process.content(node, content))
        self.fill(inner.add(self.element("a", ["fn-back"], None, href=f"#fnref_{name}")), ["↩"])
        self.process.run.add(body, foot, mark or None, where, node)
        return [ref]

    def place_notes(self, pieces: list, notes: list) -> list:
        """Collected footnotes at the end of the body, else of the last element."""
        roots = [p for p in pieces if isinstance(p, Node) and p.kind == "e"]
        if not roots or not notes:
            return pieces
        whole = next((r for r in roots if r.tag == "html"), None)
        target = next((c for c in whole.children if c.tag == "body"), whole) if whole is not None else roots[-1]
        for n in notes:
            target.add(n["body"])
        return pieces

    def cit(self, node, cls, content, source=None):
        out = self.element("blockquote", cls, node, content)
        if source:
            self.fill(out.add(self.element("cite", None, None)), self.process.content(node, source))
        return [out]

    def webcomponent(self, node, cls, content, name=None, **more):
        tag = param_text(name) or "span"
        if tag == "pb-code-highlight" and not self.process.webcomponents:
            return self.code(node, cls, content, more.get("language"))
        out = self.element(tag, cls, None, None, id=node.id)
        for k, v in more.items():
            value = flat(v)
            if value is True:
                out.attrs[k] = k
            elif value is not None and value is not False:
                out.attrs[k] = str(value)
        return [self.fill(out, self.process.content(node, content))]

    def omit(self, node, cls, content):
        return []

    def index(self, node, cls, content, type=None):  # noqa: A002
        return []

    def break_(self, node, cls, content, type=None, label=None):  # noqa: A002
        kind = param_text(type).lower()
        if kind == "page":
            return [self.element("span", cls, node, label)]
        return [self.element("div" if kind == "column" else "br", cls, None, None, data_n=param_text(label) or node.get("n") or None)]

    def anchor(self, node, cls, content, id=None):  # noqa: A002
        out = self.element("span", None, None, id=param_text(id) or None, class_=" ".join(cls))
        out.attrs |= language(node)
        return [out]

    def alternate(self, node, cls, content, default=None, alternate=None):
        pair = ("pb-popover", cls, "template") if self.process.webcomponents else ("span", [*cls, "alternate"], "span")
        out = self.element(pair[0], pair[1], None if self.process.webcomponents else node)
        slot = {"slot": "default"} if self.process.webcomponents else {}
        self.fill(out.add(self.element("span", None, None, **slot)), self.process.content(node, default or []))
        if alternate is not None:
            slot = {"slot": "alternate"} if self.process.webcomponents else {"class_": "altcontent"}
            self.fill(out.add(self.element(pair[2], None, None, **slot)), self.process.content(node, alternate))
        return [out]

    def glyph(self, node, cls, content):
        return [SOFT] if param_text(content) == "char:EOLhyphen" else []

    def text(self, node, cls, content):
        return [text_of(x) for x in content]

    def metadata(self, node, cls, content, key=None):
        found = next((t for n in node.walk() if n.tag == "titleStmt" for t in n.elements() if t.tag == "title"), None)
        out = self.element("head", cls, None)
        self.fill(out.add(self.element("title", None, None)), [found.string()] if found is not None else [])
        out.add(self.element("meta", None, None, charset="utf-8"))
        return [out]

    def title(self, node, cls, content):
        return [self.element("title", cls, node, content)]

    def match(self, node, cls, content):
        return [self.element("mark", cls, node, content)]

    def code(self, node, cls, content, language=None):
        out = self.element("pre", cls, node)
        inner = out.add(self.element("code", None, None, data_language=param_text(language) or None if not self.process.webcomponents else None))
        self.fill(inner, [self.raw(node, content)])
        return [out]

    def code_inline(self, node, cls, content):
        return [self.fill(self.element("code", cls, node), [self.raw(node, content)])]

    @staticmethod
    def raw(node: Node, content: list) -> str:
        """Content as it stands in the source: literal markup with local names, space kept."""
        return "".join("".join(map(serialise, x.children)) if x is node and x.elements() else x.string() if isinstance(x, Node) and not x.elements() else serialise(x) if isinstance(x, Node) else text_of(x) for x in content)

    def template(self, node, cls, content):
        return content

    def finish(self, pieces: list) -> str:
        return "\n".join(html(p) if isinstance(p, Node) else str(p) for p in pieces)


class Print(Html):
    """Paged media: notes stand where they are, as floats; alternates become notes."""

    name = "print"

    def footnote(self, node, cls, content, name, shown, foot, mark, where, ends):
        out = self.element("span", [*cls, "footnote"], None, None, id=f"fn_{name}", data_n=mark or None, data_range="end" if ends else None)
        return [self.fill(out, self.process.content(node, content))]

    def alternate(self, node, cls, content, default=None, alternate=None):
        return [*self.process.content(node, default or []), *(self.note(node, cls, alternate) if alternate else [])]


class Epub(Print):
    """Chapters of electronic books."""

    name = "epub"

    def footnote(self, node, cls, content, name, shown, foot, mark, where, ends):
        ref = self.element("a", ["noteref"], None, href=f"#fn_{name}", id=f"fnref_{name}")
        ref.attrs["epub:type"] = "noteref"
        body = self.element("aside", [*cls, "footnote"], None, None, id=f"fn_{name}")
        body.attrs["epub:type"] = "footnote"
        self.fill(body, [f"{foot} ", *self.process.content(node, content)])
        self.process.run.add(body, foot, mark or None, where, node)
        return [self.fill(ref, [shown])]

    def break_(self, node, cls, content, type=None, label=None):  # noqa: A002
        if param_text(type).lower() == "page":
            out = self.element("span", cls, node, label)
            out.attrs["epub:type"] = "pagebreak"
            return [out]
        return super().break_(node, cls, content, type, label)

    def webcomponent(self, node, cls, content, name=None, **more):
        href = flat(more.get("href"))
        tag = "a" if href else "div" if any(c.tag in ("p", "div", "list", "table") for c in node.elements()) else "span"
        return [self.fill(self.element(tag, [*cls, param_text(name)], None, None, id=node.id, href=href), self.process.content(node, content))]


class Docx(Html):
    """What the Word package is built from: web elements, deeper headings, no interaction."""

    name = "docx"

    def heading(self, node, cls, content, level=None):
        return [self.element(f"h{self.level(level, 9)}", cls, node, content)]

    def alternate(self, node, cls, content, default=None, alternate=None):
        return self.process.content(node, content)


class Plain:
    """Behaviours of channels that write text: blocks are set apart, everything else is its content."""

    name, copies_foreign, collects, records = "plain", False, False, False
    gap = "\n\n"

    def __init__(self, process: Process) -> None:
        self.process = process

    def run(self, text: str) -> str:
        text = _SOFT_SPACE.sub(SOFT, text) if SOFT in text else text
        if not text.strip():
            return "" if "\n" in text else " " if text else ""
        return _BLANKS.sub(" ", _LINE.sub(" ", text) if "\n" in text else text)

    def inner(self, node: Node, content: list | None) -> str:
        return joined(self.process.content(node, content or []))

    def foreign(self, node):
        return self.process.apply(node.children)

    unmatched = foreign

    def block(self, node, cls, content):
        return [self.inner(node, content).strip() + self.gap]

    paragraph = block

    def heading(self, node, cls, content, level=None):
        return [self.gap + self.inner(node, content).strip() + self.gap]

    def section(self, node, cls, content):
        return [self.inner(node, content).strip("\n") + self.gap]

    body = document = section

    def inline(self, node, cls, content):
        return [self.inner(node, content)]

    text = title = match = code_inline = inline

    def pass_through(self, node, cls, content):
        return self.process.content(node, content)

    def list(self, node, cls, content, type=None):  # noqa: A002
        return ["\n" + self.inner(node, content).strip("\n") + self.gap]

    def list_item(self, node, cls, content, n=None):
        return [self.inner(node, content).strip() + "\n"]

    def link(self, node, cls, content, uri=None, target=None):
        return [self.inner(node, content)]

    def table(self, node, cls, content):
        return [self.inner(node, content).strip() + self.gap]

    def row(self, node, cls, content):
        return [self.inner(node, content).strip() + "\n"]

    def cell(self, node, cls, content, type=None):  # noqa: A002
        return [self.inner(node, content).strip() + " "]

    def figure(self, node, cls, content, title=None):
        return [self.inner(node, content).strip() + self.gap]

    def graphic(self, node, cls, content, url=None, width=None, height=None, scale=None, title=None):
        return []

    def note(self, node, cls, content, place=None, label=None):
        return []

    def cit(self, node, cls, content, source=None):
        return [self.inner(node, content).strip() + self.gap]

    def webcomponent(self, node, cls, content, name=None, **more):
        return [self.inner(node, content)]

    def omit(self, node, cls, content):
        return []

    def index(self, node, cls, content, type=None):  # noqa: A002
        return []

    def metadata(self, node, cls, content, key=None):
        return []

    def break_(self, node, cls, content, type=None, label=None):  # noqa: A002
        return ["\n"]

    def anchor(self, node, cls, content, id=None):  # noqa: A002
        return []

    def alternate(self, node, cls, content, default=None, alternate=None):
        return [self.inner(node, default)]

    def glyph(self, node, cls, content):
        return [SOFT] if param_text(content) == "char:EOLhyphen" else []

    def code(self, node, cls, content, language=None):
        return [Html.raw(node, content) + self.gap]

    def template(self, node, cls, content):
        return [joined(content)]

    def place_notes(self, pieces: list, notes: list) -> list:
        return [*pieces, *[n["body"] for n in notes]]

    def finish(self, pieces: list) -> str:
        return _LINES.sub("\n\n", _TAIL.sub("\n", joined(pieces))).strip()


class Markdown(Plain):
    """Markdown with footnotes and pipe tables."""

    name, collects = "markdown", True

    def marked(self, node: Node, inner: str) -> str:
        """Emphasis: what the source asks for, else what the rule's style asks for, stacked."""
        rend = (node.get("rend") or "").split()
        style = self.process.style_of(node)
        marks = [m for m, words in (("**", ("bold", "b")), ("_", ("italic", "italics", "i"))) if any(w in rend for w in words)]
        marks = marks or [m for m, test in (("**", r"font-weight:\s*(bold|[6-9]00)"), ("_", r"font-style:\s*italic"), ("~~", "line-through"), ("`", "monospace")) if re.search(test, style)]
        if not inner.strip() or not marks:
            return inner
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return lead + "".join(marks) + inner.strip() + "".join(reversed(marks)) + tail + (" " if "margin-right" in style else "")

    def inline(self, node, cls, content):
        return [self.marked(node, self.inner(node, content))]

    def heading(self, node, cls, content, level=None):
        return [f"\n\n{'#' * Html.level(level, 6)} {' '.join(self.inner(node, content).split())}\n\n"]

    def list_item(self, node, cls, content, n=None):
        ordered = node.parent is not None and (node.parent.get("type") == "ordered" or node.parent.tag == "ol")
        place = 1 + sum(c.tag == node.tag and c.node_id < node.node_id for c in node.parent.elements()) if node.parent is not None else 1
        mark = f"{place}. " if ordered else "- "
        first, *more = self.inner(node, content).strip().split("\n")
        return [mark + first + "".join("\n" + (" " * len(mark) + x if x.strip() else "") for x in more) + "\n"]

    def link(self, node, cls, content, uri=None, target=None):
        to = Html.address(self, uri) or node.get("target") or ""
        return [f"[{self.inner(node, content).strip()}]({to})" if to else self.inner(node, content)]

    def row(self, node, cls, content):
        cells = self.inner(node, content)
        line = "|" + cells.rstrip() + "\n"
        rows = [c for c in node.parent.elements() if c.tag == node.tag] if node.parent is not None else [node]
        return [line + ("|" + " --- |" * cells.count(" |") + "\n" if rows and rows[0] is node else "")]

    def cell(self, node, cls, content, type=None):  # noqa: A002
        return [" " + " ".join(self.inner(node, content).split()).replace("|", "\\|") + " |"]

    def figure(self, node, cls, content, title=None):
        caption = self.inner(node, title).strip() if title else ""
        return ["\n\n" + self.inner(node, content).strip() + (f"\n\n{caption}" if caption else "") + "\n\n"]

    def graphic(self, node, cls, content, url=None, width=None, height=None, scale=None, title=None):
        return [f"![{param_text(title)}]({Html.address(self, url) or ''})"]

    def note(self, node, cls, content, place=None, label=None):
        mark, where = param_text(label), param_text(place)
        if where == "start":
            return [f"{mark}-"] if mark else []
        if not mark and not content:
            return []
        run = self.process.run
        name = mark or str(run.next_note())
        body = " ".join(self.inner(node, content).split())
        run.add(f"\n\n[^{name}]: {body}", name, mark or None, where, node)
        return [f"[^{name}]"]

    def cit(self, node, cls, content, source=None):
        lines = self.inner(node, content).strip().split("\n")
        cited = self.inner(node, source).strip() if source else ""
        return ["\n\n" + "\n".join(f"> {x}".rstrip() for x in [*lines, *([f"— {cited}"] if cited else [])]) + "\n\n"]

    def break_(self, node, cls, content, type=None, label=None):  # noqa: A002
        shown = self.inner(node, label).strip() if label else ""
        return [f"|{shown}|"] if param_text(type).lower() == "page" and shown else [] if param_text(type).lower() == "page" else ["  \n"]

    def anchor(self, node, cls, content, id=None):  # noqa: A002
        return [f'<a id="{param_text(id)}"></a>'] if param_text(id) else []

    def code(self, node, cls, content, language=None):
        return [f"\n\n```{param_text(language)}\n{Html.raw(node, content).strip(chr(10))}\n```\n\n"]

    def code_inline(self, node, cls, content):
        return [f"`{Html.raw(node, content)}`"]

    def finish(self, pieces: list) -> str:
        out = joined(pieces).replace("_ _", " ").replace("** **", " ")
        out = re.sub(r"[ \t]+\n(?=\n)", "\n", out)
        return re.sub(r"\n{3,}", "\n\n", out).strip()


class Typst(Plain):
    """Typst markup."""

    name = "typst"

    def run(self, text: str) -> str:
        return self.escaped(super().run(text))

    @staticmethod
    def escaped(text: str) -> str:
        """Markup characters, and what starts a comment or, at the start, a list or heading."""
        out = re.sub(r"([\\#$@*_\[\]<`~])", r"\\\1", text).replace("//", "\\/\\/")
        return re.sub(r"^(\s*)([-+=./])(?=\s|$)", r"\1\\\2", out)

    @staticmethod
    def size(value: str) -> str:
        """A length of CSS: pixels become points."""
        m = re.fullmatch(r"\s*([\d.]+)px\s*", value)
        return f"{float(m[1]) * 0.75:g}pt" if m else value.strip()

    def inline(self, node, cls, content):
        inner, style, rend = self.inner(node, content), self.process.style_of(node), (node.get("rend") or "").split()
        for name, words, test in (("strong", ("bold", "b"), r"font-weight:\s*bold"), ("emph", ("italic", "i"), r"font-style:\s*italic"), ("strike", (), "line-through"), ("underline", (), "underline")):
            if any(w in rend for w in words) or re.search(test, style):
                inner = f"#{name}[{inner}]"
        return [inner]

    def heading(self, node, cls, content, level=None):
        return [f"\n\n{'=' * Html.level(level, 6)} {' '.join(self.inner(node, content).split())}\n\n"]

    def list_item(self, node, cls, content, n=None):
        mark = "+ " if node.parent is not None and (node.parent.get("type") == "ordered" or node.parent.tag == "ol") else "- "
        first, *more = self.inner(node, content).strip().split("\n")
        return [mark + first + "".join("\n" + ("  " + x if x.strip() else "") for x in more) + "\n"]

    def link(self, node, cls, content, uri=None, target=None):
        to = Html.address(self, uri) or ""
        inner = self.inner(node, content)
        return [f"#link(<{to[1:]}>)[{inner}]" if to.startswith("#") else f'#link("{to}")[{inner}]' if to else inner]

    def table(self, node, cls, content):
        rows = [line for line in self.inner(node, content).split("\x1e") if line.strip()]
        cells = [[c for c in r.split("\x1f") if c.strip()] for r in rows]
        return [f"\n\n#table(columns: {max(map(len, cells), default=1)},\n" + "".join("  " + ", ".join(c.strip() for c in r) + ",\n" for r in cells) + ")\n\n"]

    def row(self, node, cls, content):
        return [self.inner(node, content) + "\x1e"]

    def cell(self, node, cls, content, type=None):  # noqa: A002
        return [f"[{' '.join(self.inner(node, content).split())}]\x1f"]

    def figure(self, node, cls, content, title=None):
        caption = f", caption: [{self.inner(node, title).strip()}]" if title else ""
        return [f"\n\n#figure([{self.inner(node, content).strip()}]{caption})\n\n"]

    def graphic(self, node, cls, content, url=None, width=None, height=None, scale=None, title=None):
        wide = f", width: {self.size(param_text(width))}" if param_text(width) else ""
        return [f'#image("{Html.address(self, url) or ""}"{wide})']

    def note(self, node, cls, content, place=None, label=None):
        if param_text(place) == "start" or not content:
            return []
        return [f"#footnote[{' '.join(self.inner(node, content).split())}]"]

    def cit(self, node, cls, content, source=None):
        cited = f", attribution: [{self.inner(node, source).strip()}]" if source else ""
        return [f"\n\n#quote(block: true{cited})[{self.inner(node, content).strip()}]\n\n"]

    def break_(self, node, cls, content, type=None, label=None):  # noqa: A002
        return {"page": ["\n#pagebreak(weak: true)\n"], "column": ["\n#colbreak()\n"]}.get(param_text(type).lower(), [" \\\n"])

    def anchor(self, node, cls, content, id=None):  # noqa: A002
        return [f"#metadata(none)<{param_text(id)}>"] if param_text(id) else []

    def metadata(self, node, cls, content, key=None):
        if param_text(key):
            self.process.run.metadata.setdefault(param_text(key), []).append(" ".join(self.inner(node, content).split()))
        return []

    def code(self, node, cls, content, language=None):
        return [f"\n\n```{param_text(language)}\n{Html.raw(node, content).strip(chr(10))}\n```\n\n"]

    def code_inline(self, node, cls, content):
        return [f"`{Html.raw(node, content)}`"]


class Records:
    """Decisions instead of output: a record for each node with its behaviour, rule, parameters and children."""

    name, copies_foreign, collects, records = "json", False, False, True

    def __init__(self, process: Process) -> None:
        self.process = process

    run = Plain.run

    def record(self, node: Node, behaviour: str | None, rule: str | None, params: dict, content: list | None, suppressed: bool = False) -> dict:
        out = {"behaviour": behaviour, "element": node.tag, "model": rule, "id": node.id, "xpath": node.xpath, "node_id": node.node_id}
        if shown := {k: v for k, x in params.items() if (v := flat(x)) is not None}:
            out["params"] = shown
        if suppressed:
            out["suppressed"] = True
        elif children := [p for p in (self.process.content(node, content) if content else []) if p != ""]:
            out["children"] = children
        return {k: v for k, v in out.items() if v is not None or k == "behaviour"}

    def foreign(self, node):
        return [text] if (text := self.run(node.string())) else []

    def unmatched(self, node):
        return [self.record(node, None, None, {}, [node])]

    def place_notes(self, pieces: list, notes: list) -> list:
        return pieces

    def finish(self, pieces: list) -> list:
        return pieces


CHANNELS = {c.name: c for c in (Html, Print, Epub, Docx, Plain, Markdown, Typst)}


def plain_item(x) -> bool:
    return not isinstance(x, Node | Attribute)
