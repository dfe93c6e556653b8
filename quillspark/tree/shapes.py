"""Documents that differ in their numbers alone are rendered once.

Documents written from tables repeat a few shapes: equal markup and words, other numbers. For a shape that comes again the
rules are applied once to a document with a mark in place of each run of digits; the marks in its output tell where the
numbers of any other document of that shape belong. This holds where no rule looks into a number, which is decided from
its expressions and behaviours (``blind``), and where no number stands in a name or in an attribute that is looked into.
All other documents, and the first two of a shape, are rendered as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from operator import itemgetter

from quillspark.plans.rules import BEHAVIOURS
from quillspark.tree import nodes
from quillspark.tree.process import Process
from quillspark.tree.xpath import Env, XPathError, tokens

_DIGITS, _MARKS, _UNFIT = re.compile("([0-9]+)"), re.compile("([\uE000-\uF8FF])"), re.compile("[&\uE000-\uF8FF]|<[!?]")
_FIRST, _MOST = 0xE000, 0xF8FF - 0xE000
# Behaviours that treat a run of digits in content and parameters as any other word, functions that give
# nodes, texts or numbers of nodes, and attributes that are looked into or that make a class, of which equal ones are one.
_BEHAVIOURS = {"alternate", "anchor", "block", "body", "cell", "cit", "heading", "inline", "link", "list", "list_item", "match", "note", "omit", "paragraph", "row", "section", "table", "template", None}
_FUNCTIONS = {"concat", "count", "empty", "exists", "last", "local-name", "name", "node", "not", "string", "string-join", "text"}
_LOOKED_INTO = {"rend", "type", "xml:lang"}
#: Bounds of what one process keeps: characters of shapes and their outputs, of one document, and documents until it is judged.
SHAPE_CHARS, DOCUMENT_CHARS, TRIAL = 64 << 20, 32 << 10, 4096
#: Characters that a kept value, and a kept node of a tree, are reckoned at.
VALUE_CHARS, NODE_CHARS = 8, 200


def blind(source: str) -> str | None:
    """``number``, ``text`` or ``nodes`` if an expression's value follows from a document's markup and words, with its
    digits copied at most; None where it may look into a number, or where this is not known."""
    try:
        found = [*tokens(source), (None, None)]
    except XPathError:
        return None
    opened: list[str] = []
    value, simple = None, True  # the operand that has just ended, if any; whether it may be the whole expression
    for k, (kind, token) in enumerate(found[:-1]):
        before, (after_kind, after) = found[k - 1][1] if k else None, found[k + 1]
        if kind == "num" or kind == "str":
            if value is not None:
                return None
            value = "number" if kind == "num" else "text"
        elif token == ")" and opened and opened[-1] != "[" and (value is not None or before == "("):
            value = {"count": "number", "last": "number", "text": "nodes", "node": "nodes"}.get(opened.pop(), "text")
        elif value is None:  # an operand is due
            if kind == "name" and after == "(" and after_kind == "op":
                if token not in _FUNCTIONS:
                    return None
                opened.append(token)
            elif token == "(":
                if k == 0 or found[k - 1][0] != "name":
                    opened.append(token)
            elif kind == "name" and after == "::" and after_kind == "op":
                continue
            elif kind == "name" or token in (".", "..", "*"):
                value = "nodes"
            elif token not in ("@", "/", "//", "::"):
                return None
        elif token == "]" and opened and opened[-1] == "[":
            opened.pop()
            value = "nodes"
        elif token == "[" and value == "nodes":
            opened.append("[")
            value = None
        elif token in ("/", "//") and value == "nodes" or token == "," and opened and opened[-1] in _FUNCTIONS:
            value = None
        elif token in ("and", "or") or token in ("=", "!=") and after_kind == "str" and not re.search("[0-9]", after):
            simple &= bool(opened)
            value = None
        elif token in ("+", "-") and value == "number" and (after_kind == "num" or after == "count" and found[k + 2][1] == "("):
            value = None
        else:
            return None
    return None if opened or value is None else value if simple else "text"


def free(env: Env) -> bool:
    """Whether no project function stands in for one that ``blind`` knows."""
    return not _FUNCTIONS & set(env.functions)


def blind_rules(process: Process, records: bool = False) -> bool:
    """Whether the rules of a process look into no number. For ``records`` behaviours don't matter: they are named, not carried out."""
    if process.order is not None or process.out.records != records or not free(process.env):
        return False
    for r in (r for rs in process.rules.rules.values() for r in rs):
        sources = [r.predicate, *(p[2] for p in r.path), *(None if s.strip() == "." else s for s in r.params.values())]
        behaviour = BEHAVIOURS.get(r.behaviour or "")
        if any(s is not None and blind(s) is None for s in sources):
            return False
        if records:
            continue
        if behaviour not in _BEHAVIOURS or (behaviour is None and r.behaviour):
            return False
        if behaviour == "heading" and "level" in r.params and blind(r.params["level"]) != "number":
            return False
    return True


def marked_tree(parts: list[str]) -> tuple[str, nodes.Node] | None:
    """A document with a mark in place of each number, and its tree; None where a number is more than text or a value."""
    if len(parts) // 2 > _MOST or _UNFIT.search("".join(parts[::2])):
        return None
    marked = "".join(chr(_FIRST + k // 2) if k % 2 else p for k, p in enumerate(parts))
    tree = nodes.read(marked)
    if nodes.error_of(tree) is not None:
        return None
    for n in tree.walk():
        if n.kind == "e" and (_MARKS.search(" ".join([n.tag, n.ns or "", *n.attrs, *(v for k, v in n.attrs.items() if k in _LOOKED_INTO)])) or n.tag == "note" and "target" in n.attrs):
            return None
    return marked, tree


def formed(text: str) -> tuple[str, Callable | None]:
    """A text with marks as a form with places, and what picks the numbers for them from a document's parts."""
    pieces = _MARKS.split(text)
    places = [2 * (ord(m) - _FIRST) + 1 for m in pieces[1::2]]
    if not places:
        return text, None
    form = "%s".join(p.replace("%", "%%") for p in pieces[::2])
    return form, (lambda at: lambda parts: (parts[at],))(places[0]) if len(places) == 1 else itemgetter(*places)


class Rows:
    """The rows of one shape: columns with the cells that hold numbers, whose texts are filled in together."""

    __slots__ = ("columns", "size", "cells", "form", "pick", "tree", "sites")

    def __init__(self, rows: list[tuple], width: int) -> None:
        self.columns, self.size, self.cells, self.tree, self.sites = [[r[k] for r in rows] for k in range(width)], len(rows), [], None, []
        texts: list[str] = []
        for k, column in enumerate(self.columns):
            for at, value in enumerate(column):
                if (spec := self.spec(value, texts)) is not None:
                    self.cells.append((k, at, spec))
        self.form, self.pick = self.joined(texts)

    @staticmethod
    def joined(texts: list[str]) -> tuple[str, Callable | None]:
        return formed("\x01".join(texts)) if texts else ("", None)

    @staticmethod
    def spec(value, texts: list[str]):
        """Where a value's text is among the texts to fill in; of pairs, each value's place or the value itself."""
        if isinstance(value, str):
            if _MARKS.search(value):
                texts.append(value)
                return len(texts) - 1
        elif isinstance(value, list) and any(_MARKS.search(v) for _, v in value if isinstance(v, str)):
            return [(k, Rows.spec(v, texts), v) for k, v in value]
        return None

    def hold(self, tree: nodes.Node) -> None:
        """Keeps the tree too, whose texts and attributes are filled in beside the rows."""
        self.tree, texts = tree, self.form_texts()
        for n in tree.walk():
            if n.kind == "t" and (at := self.spec(n.text, texts)) is not None:
                self.sites.append((n, None, at))
            self.sites += [(n, k, at) for k, v in n.attrs.items() if (at := self.spec(v, texts)) is not None]
        self.form, self.pick = self.joined(texts)

    def form_texts(self) -> list[str]:
        """The texts with marks again."""
        if self.pick is None:
            return []
        marks = self.pick([chr(_FIRST + k // 2) for k in range(2 * _MOST)])
        return (self.form % marks).split("\x01")

    def fill(self, parts: list[str], out: list[list]) -> int:
        texts = (self.form % self.pick(parts)).split("\x01") if self.pick is not None else []
        base = len(out[0])
        for column, own in zip(out, self.columns, strict=True):
            column += own
        for k, at, spec in self.cells:
            out[k][base + at] = texts[spec] if isinstance(spec, int) else [(n, v if s is None else texts[s]) for n, s, v in spec]
        for n, k, at in self.sites:
            if k is None:
                n.text = texts[at]
            else:
                n.attrs[k] = texts[at]
        return self.size


class Filled:
    """What ``rows`` makes of documents, as columns; for a shape that comes again from its numbers alone. ``on`` tells whether
    ``rows`` copies numbers at most. ``more`` makes further rows of a tree, by looking into numbers: the shape's tree is kept.
    ``rows`` get no ``trees`` where they need none."""

    def __init__(self, rows: Callable[[str, nodes.Node | None], list[tuple]], width: int, on: bool = True, more: Callable[[nodes.Node], list[tuple]] | None = None, trees: bool = True) -> None:
        self.rows, self.width, self.on, self.more, self.trees = rows, width, on, more, trees
        self.known: dict[tuple, Rows | None] = {}
        self.once: set[int] = set()
        self.room, self.tried, self.met = SHAPE_CHARS, 0, 0

    def shape(self, raw) -> tuple[Rows | None, list[str] | None]:
        """The rows of a known shape and the document's parts; None for one that is to be taken by itself."""
        if not self.on or not isinstance(raw, str) or len(raw) > DOCUMENT_CHARS or "\x01" in raw:
            return None, None
        parts = _DIGITS.split(raw)
        key = tuple(parts[::2])
        self.tried += 1
        found = self.known.get(key, self)
        if found is not self:
            self.met += 1
            return found, parts
        if self.tried >= TRIAL and self.met * 8 < self.tried:
            self.on, self.known, self.once = False, {}, set()
        elif (mark := hash(key)) not in self.once:
            if len(self.once) < 1 << 17:
                self.once.add(mark)
        elif self.room > 0:
            self.once.discard(mark)
            made = self.known[key] = self.plan(parts, raw)
            self.room -= 2 * len(raw)
            if made is not None:
                self.room -= len(made.form) + VALUE_CHARS * made.size * self.width + NODE_CHARS * (sum(1 for _ in made.tree.walk()) if made.tree else 0)
        return None, parts

    def plan(self, parts: list[str], raw: str) -> Rows | None:
        """The rows of a shape; None where they are not those of the document itself."""
        marked = marked_tree(parts)
        if marked is None:
            return None
        made = Rows(self.rows(*marked), self.width)
        if self.more is not None:
            made.hold(marked[1])
        own, got = self.rows(raw, nodes.read(raw) if self.trees else None), [[] for _ in range(self.width)]
        made.fill(parts, got)
        return made if [list(c) for c in zip(*own, strict=True)] == got or not own and not got[0] else None

    def __call__(self, raw, out: list[list]) -> int:
        """Adds a document's rows to columns; gives their number."""
        found, parts = self.shape(raw)
        before = len(out[0])
        if found is not None:
            found.fill(parts, out)
            tree = found.tree
            if tree is not None:
                tree.index = None
            made = []
        else:
            tree = nodes.read(raw) if self.trees else None
            made = self.rows(raw, tree)
        if self.more is not None:
            made = [*made, *self.more(tree)]
        for r in made:
            for column, value in zip(out, r, strict=True):
                column.append(value)
        return len(out[0]) - before


class Shapes:
    """Renders documents by one process, those of a known shape from their numbers alone."""

    def __init__(self, process: Process, render: Callable[[str], dict]) -> None:
        self.render, self.on = render, blind_rules(process)
        self.known: dict[tuple, tuple | None] = {}
        self.once: set[int] = set()
        self.room, self.tried, self.met = SHAPE_CHARS, 0, 0

    def __call__(self, raw) -> dict:
        if not self.on or not isinstance(raw, str) or len(raw) > DOCUMENT_CHARS:
            return self.render(raw)
        parts = _DIGITS.split(raw)
        key = tuple(parts[::2])
        self.tried += 1
        found = self.known.get(key, self)
        if found is not self:
            self.met += 1
            if found is None:
                return self.render(raw)
            form, pick, rest = found
            return {"output": form % pick(parts) if pick is not None else form, **rest}
        if self.tried >= TRIAL and self.met * 8 < self.tried:
            self.on, self.known, self.once = False, {}, set()  # documents of their own: nothing to gain
            return self.render(raw)
        made = self.render(raw)
        if (mark := hash(key)) not in self.once:
            if len(self.once) < 1 << 17:
                self.once.add(mark)
        elif self.room > 0:
            self.once.discard(mark)
            plan = self.known[key] = self.plan(parts, made)
            self.room -= 2 * len(raw) + (len(plan[0]) if plan else 0)
        return made

    def plan(self, parts: list[str], made: dict) -> tuple | None:
        """The output of a shape, with places for numbers; None where numbers may matter. ``made`` is the document's own."""
        if made["error"] or made["metadata"] or (marked := marked_tree(parts)) is None:
            return None
        form, pick = formed(self.render(marked[0])["output"])
        rest = {k: v for k, v in made.items() if k != "output"}
        return (form, pick, rest) if (form % pick(parts) if pick is not None else form) == made["output"] else None


_JOBS: dict[str, Shapes | Filled] = {}


def of_job(job: str, make: Callable[[], Shapes | Filled]) -> Shapes | Filled:
    """The shapes of a job in this process, kept from task to task; those of the job before go."""
    if job not in _JOBS:
        _JOBS.clear()
        _JOBS[job] = make()
    return _JOBS[job]
