"""Pages of documents whose divisions have a few shapes: each division's pages are made once a shape.

A document is what stands around its outermost divisions, and the divisions. Where rules look neither into numbers nor out of an
element's own content, the pages of a division follow from its shape, its numbers, and the shape of what is around it; only
numbers, neighbours and links of pages need the whole document. A division of a new shape is made by itself, and its document as
a whole too: if the two differ once, all further documents are made as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from quillspark.plans.rules import BEHAVIOURS
from quillspark.tree import nodes, pages, shapes
from quillspark.tree.nodes import Node
from quillspark.tree.process import Process
from quillspark.tree.xpath import tokens

_DIVISION = re.compile(r"""<div(?=[\s/>])(?:[^<>"']|"[^"<]*"|'[^'<]*')*>|</div\s*>""")
_UNFIT, _OUT, _SAFE = re.compile("[&-\U000F0000-\U000FFFFD\x01]|<[!?]"), re.compile("([\U000F0000-\U000FFFFD])"), re.compile(r"[\w.#/:~+-]*")
_LINK = 0xF0000
# Behaviours that look at an element's own content alone, beside those that numbers don't matter to.
_BEHAVIOURS = (shapes._BEHAVIOURS - {"list_item", "cell", "row", "note"}) | {"break", "document", "metadata"}
_OUTWARD = {"..", "/", "//", "ancestor", "ancestor-or-self", "parent", "following", "following-sibling", "preceding", "preceding-sibling", "last"}


def own(source: str) -> bool:
    """Whether an expression looks into no number and not out of the content of the element that it is asked of."""
    if shapes.blind(source) is None:
        return False
    found = tokens(source)
    return not any(t in _OUTWARD and k != "str" and (t not in ("/", "//") or not at or found[at - 1][0] == "op" and found[at - 1][1] not in ("]", ")", "*", ".")) for at, (k, t) in enumerate(found))


def own_rules(process: Process) -> bool:
    if process.order is not None or process.out.records or not shapes.free(process.env):
        return False
    for r in (r for rs in process.rules.rules.values() for r in rs):
        sources = [r.predicate, *(p[2] for p in r.path), *(None if s.strip() == "." else s for s in r.params.values())]
        behaviour = BEHAVIOURS.get(r.behaviour or "")
        if behaviour not in _BEHAVIOURS or (behaviour is None and r.behaviour) or any(s is not None and not own(s) for s in sources) or (behaviour in ("heading", "break") and r.params):
            return False
    return True


def cut(raw: str) -> tuple[str, list[str], str] | None:
    """What stands before the outermost divisions, these, and what stands behind them; None if they don't stand side by side."""
    depth, start, at, found = 0, 0, -1, []
    for m in _DIVISION.finditer(raw):
        tag = m[0]
        if tag[1] == "/":
            depth -= 1
        elif tag[-2] != "/":
            if not depth:
                start = m.start()
            depth += 1
            continue
        elif not depth:
            start = m.start()
        if depth < 0:
            return None
        if not depth:
            if found and start != at:
                return None
            at = m.end()
            found.append(raw[start:at])
    return (raw[: raw.index(found[0])], found, raw[at:]) if found and not depth else None


class _Page:
    """What the numbering of pages asks of one."""

    __slots__ = ("id", "xpath", "ident", "texts", "links", "output", "made")

    def __init__(self, id_: str | None, xpath: str, ident: str | None, texts: list[str]) -> None:
        self.id, self.xpath, self.ident, self.texts = id_, xpath, ident, texts

    def get(self, name: str) -> str | None:
        return self.ident


class Division:
    """The pages of a division's shape: for each whether it has an id and an ``ident``, its path, its numbers of ids, links and
    fragments; and all their texts in one form."""

    def __init__(self, found: list[tuple]) -> None:
        texts: list[str] = []
        self.pages = []
        for id_, ident, path, title, output, ids, links, fragments in found:
            own_ = [id_ or "", ident or "", title or "", output or "", *ids, *links, *fragments]
            self.pages.append((id_ is not None, ident is not None, title is not None, output is not None, path, len(ids), len(links), len(own_)))
            texts += own_
        self.form, self.pick = shapes.formed("\x01".join(texts))


class Divided:
    """Rows of pages of documents, by division. ``whole`` makes all rows of a tree; ``single`` makes of a tree, for each page, its
    element, title, pieces of output, ids and fragments."""

    def __init__(self, process: Process, settings: pages.PageSettings, whole: Callable[[str, Node], list[dict]], single: Callable[[Node], list[tuple]], made: set[str]) -> None:
        self.process, self.settings, self.whole, self.single, self.made = process, settings, whole, single, made
        fragments = all(f.get("scope", "document") == "page" and own(f["xpath"]) for f in settings.fragments.values()) or "fragments" not in made
        self.on = settings.selector == "divisions" and settings.link_pattern is None and "images" not in made and fragments and own_rules(process)
        self.known: dict[tuple, Division | None] = {}
        self.arounds: dict[tuple, int] = {}
        self.room = shapes.SHAPE_CHARS

    def __call__(self, key: str, raw) -> list[dict]:
        if not self.on or not isinstance(raw, str) or _UNFIT.search(raw) or (parts := cut(raw)) is None:
            return self.whole(key, nodes.read(raw))
        before, divisions, behind = parts
        around = (*shapes._DIGITS.split(before)[::2], None, *shapes._DIGITS.split(behind)[::2])
        mark = self.arounds.get(around)
        if mark is None:
            if len(self.arounds) >= 1000 or shapes.marked_tree(shapes._DIGITS.split(before + behind)) is None:
                return self.whole(key, nodes.read(raw))
            mark = self.arounds[around] = len(self.arounds)
        found, new = [], False
        for d in divisions:
            digits = shapes._DIGITS.split(d)
            shape = (mark, *digits[::2])
            held = self.known.get(shape, self)
            if held is self:
                if self.room <= 0:
                    return self.whole(key, nodes.read(raw))
                held = self.known[shape] = self.plan(before, digits, behind)
                self.room -= 4 * len(d) + 2 * len(held.form if held else "")
                new = True
            if held is None:
                return self.whole(key, nodes.read(raw))
            found.append((held, digits))
        rows = self.rows(key, found)
        if rows is None or new:
            whole = self.whole(key, nodes.read(raw))
            self.on = self.on and (rows is None or rows == whole)
            return whole
        return rows

    def plan(self, before: str, digits: list[str], behind: str) -> Division | None:
        """The pages of a division that stands alone, with marks in place of its numbers and links."""
        if shapes.marked_tree(digits) is None:
            return None
        tree = nodes.read(before + "".join(chr(shapes._FIRST + k // 2) if k % 2 else p for k, p in enumerate(digits)) + behind)
        if nodes.error_of(tree) is not None:
            return None
        outer = next((n for n in tree.walk() if n.kind == "e" and n.tag == "div"), None)
        if outer is None or not outer.xpath.endswith("/div[1]"):
            return None
        out, links = [], []
        for page, title, pieces, ids, fragments in self.single(tree):
            own_: list[str] = []
            for p in pieces or []:
                for n in p.walk() if isinstance(p, Node) else ():
                    if n.kind == "e" and n.tag == "pb-link":
                        return None
                    for name in ("href", "data-target") if n.kind == "e" else ():
                        if name in n.attrs:
                            own_.append(str(n.attrs[name]))
                            n.attrs[name] = chr(_LINK + len(links) + len(own_) - 1)
            links += own_
            output = None if pieces is None or "output" not in self.made else self.process.out.finish(pieces)
            out.append((page.id, page.get("ident"), (outer.xpath[:-2], page.xpath[len(outer.xpath) - 1 :]), title, output, ids, own_ if output is not None else [], fragments))
        return Division(out)

    def rows(self, key: str, found: list[tuple[Division, list[str]]]) -> list[dict] | None:
        """The rows of a document from its divisions; None where a link's text would have to be written in another way."""
        made, settings = [], self.settings
        for number, (division, digits) in enumerate(found, 1):
            texts = (division.form % division.pick(digits) if division.pick is not None else division.form).split("\x01")
            at, link = 0, 0
            for has_id, has_ident, has_title, has_output, path, n_ids, n_links, size in division.pages:
                own_ = texts[at : at + size]
                at += size
                page = _Page(own_[0] if has_id else None, f"{path[0]}{number}{path[1]}", own_[1] if has_ident else None, own_)
                page.made, page.output = (has_title, has_output, n_ids, n_links), link
                link += n_links
                made.append(page)
        rows = pages.metadata(made, settings, key)
        held: dict[str, str] = {}
        if self.made & {"output", "anchors"}:
            for r, page in zip(rows, made, strict=True):
                for x in page.texts[4 : 4 + page.made[2]]:
                    held.setdefault(x, r["file"])
        for r, page in zip(rows, made, strict=True):
            has_title, has_output, n_ids, n_links = page.made
            own_ = page.texts
            if has_output:
                output = own_[3]
                if n_links:
                    to = [pages.rewritten(x, r["file"], held) for x in own_[4 + n_ids : 4 + n_ids + n_links]]
                    if not all(map(_SAFE.fullmatch, to)):
                        return None
                    pieces = _OUT.split(output)
                    pieces[1::2] = [to[ord(m) - _LINK - page.output] for m in pieces[1::2]]
                    output = "".join(pieces)
                r["output"] = output
            if has_title:
                r["title"] = own_[2]
            if "fragments" in self.made:
                r["fragments"] = list(zip(settings.fragments, own_[4 + n_ids + n_links :], strict=True))
            if "anchors" in self.made:
                r["anchors"] = own_[4 : 4 + n_ids]
        return rows
