"""Passages of a document for retrieval: records rolled up to units, facets and child records, splits, stable ids."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from quillspark.tree.nodes import Node
from quillspark.tree.process import record_text

BOUNDARIES = {"section", "body", "document"}
HEADINGS = {"heading", "title"}
# Where the vocabularies keep a document's title (path of local names from any element).
TITLES = [["fileDesc", "titleStmt", "title"], ["info", "title"], ["article-meta", "title-group", "article-title"]]


def matches(record: dict, behaviours: list[str] = (), elements: list[str] = (), models: list[str] = ()) -> bool:
    return record.get("behaviour") in behaviours or record.get("element") in elements or record.get("model") in models


@dataclass
class Field:
    """Records to take out: as a facet of the open unit, or as records of their own. ``inline`` keeps their text in place too."""

    name: str
    behaviours: list[str] = field(default_factory=list)
    elements: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)
    metadata: bool = True
    inline: bool | None = None

    def takes(self, r: dict) -> bool:
        return matches(r, self.behaviours, self.elements, self.models)


@dataclass
class UnitKind:
    """Records that are units, in place of the default ones. Without ``emit`` they only set the heading of what follows."""

    name: str
    behaviours: list[str] = field(default_factory=list)
    elements: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)
    emit: bool = True
    min_chars: int | None = None

    def takes(self, r: dict) -> bool:
        return matches(r, self.behaviours, self.elements, self.models)


@dataclass
class Options:
    max_chars: int = 1500
    min_chars: int = 40
    overlap: int = 1
    fields: list[Field] = field(default_factory=list)
    units: list[UnitKind] = field(default_factory=list)


@dataclass
class Unit:
    xml_id: str | None
    xpath: str | None
    heading: str | None
    entry: str | None
    kind: str | None = None
    parent: Unit | None = None
    least: int | None = None
    parts: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    facets: dict[str, list[str]] = field(default_factory=dict)

    @property
    def text(self) -> str:
        return " ".join(" ".join(p[0] for p in self.parts).split())

    def name(self) -> tuple[str | None, str | None]:
        """Id and path: its own id, else the first part with one, else the path of the first part."""
        if self.xml_id:
            return self.xml_id, self.xpath
        named = next((p for p in self.parts if p[1]), None)
        return (named[1], named[2]) if named else (None, (self.parts[0][2] if self.parts else None) or self.xpath)


def heading_of(record: dict) -> str | None:
    """The text of the first direct heading with text."""
    return next((t for c in record.get("children", []) if isinstance(c, dict) and c.get("behaviour") in HEADINGS and (t := record_text(c))), None)


def roll_up(records: list, options: Options) -> tuple[list[Unit], list[Unit]]:
    """Units and taken-out records in document order. A text run belongs to the unit opened last."""
    units: list[Unit] = []
    taken: list[Unit] = []
    state: dict = {"open": None, "anchor": None, "heading": None}

    def close() -> None:
        if state["open"] is not None and state["open"].parts:
            units.append(state["open"])
        state["open"] = None

    def opened(r: dict, heading: str | None, kind: UnitKind | None = None) -> None:
        close()
        state["open"] = Unit(r.get("id"), r.get("xpath"), heading, state["anchor"], kind.name if kind else None, None, kind.min_chars if kind else None)

    def take(r: dict, f: Field) -> None:
        text = record_text(r)
        if text and f.metadata:
            if state["open"] is not None and text not in (held := state["open"].facets.setdefault(f.name, [])):
                held.append(text)
        elif text:
            taken.append(Unit(r.get("id"), r.get("xpath"), None, state["anchor"], f.name, state["open"], None, [(text, r.get("id"), r.get("xpath"))]))

    def below(r: dict) -> None:
        for c in r.get("children", []):
            if isinstance(c, dict):
                visit(c)
            elif (text := " ".join(c.split())) and state["open"] is not None:
                state["open"].parts.append((text, r.get("id"), r.get("xpath")))

    def visit(r: dict) -> None:
        if r.get("suppressed"):
            return
        state["anchor"] = r.get("id") or state["anchor"]
        fields = [f for f in options.fields if f.takes(r)]
        for f in fields:
            take(r, f)
        if fields and not any(f.metadata if f.inline is None else f.inline for f in fields):
            return
        kind = next((u for u in options.units if u.takes(r)), None)
        if kind is not None:
            own = record_text(r) if r.get("behaviour") in HEADINGS else heading_of(r)
            state["heading"] = own or state["heading"]
            if not kind.emit:
                close()
                return
            opened(r, own or state["heading"], kind)
            below(r)
            close()
        elif options.units:
            below(r)
        elif r.get("behaviour") in BOUNDARIES or heading_of(r) is not None:
            opened(r, heading_of(r))
            below(r)
        else:
            if state["open"] is None:
                opened(r, None)
            below(r)

    for r in records:
        if isinstance(r, dict):
            visit(r)
    close()
    return units, taken


def split(unit: Unit, most: int, overlap: int) -> list[tuple[str, str | None, str | None]]:
    """Greedy pieces: a piece closes when the next part would take it over ``most``, each part counting one more
    character; its last ``overlap`` parts open the next one. A single long part is never cut."""
    whole = unit.name()
    if len(unit.text) <= most:
        return [(unit.text, *whole)]
    out, held, size = [], [], 0

    def closed() -> tuple[str, str | None, str | None]:
        text = " ".join(" ".join(p[0] for p in held).split())
        named = next((p for p in held if p[1]), None)
        return (text, named[1], named[2]) if named else (text, whole[0], held[0][2])

    for part in unit.parts:
        if held and size + len(part[0]) + 1 > most:
            out.append(closed())
            held = held[-overlap:] if overlap else []
            size = sum(len(p[0]) + 1 for p in held)
        held.append(part)
        size += len(part[0]) + 1
    if held:
        out.append(closed())
    return out


def stable_id(stem: str, xml_id: str | None, path: str | None, scope: str | None = None) -> str:
    return f"{stem}#{xml_id}" if xml_id else f"{stem}#{hashlib.sha1(f'{scope or ''}|{path or ''}'.encode()).hexdigest()[:12]}"


def title_of(tree: Node) -> str | None:
    """A document's title, by the first vocabulary that has one."""
    for path in TITLES:
        for n in tree.walk():
            if n.kind == "e" and n.tag == path[-1]:
                above = [a.tag for a, _ in zip(n.ancestors(), path[:-1], strict=False)][::-1]
                if above == path[:-1] and (text := " ".join(n.string().split())):
                    return text
    return None


def rows(stem: str, records: list, options: Options, scope: str | None = None, title: str | None = None, href: dict[str, str] | None = None, file: str | None = None, used: dict[str, int] | None = None) -> list[dict]:
    """Passages of a document or page; taken-out records come last, so that their parents' ids exist.

    ``used`` counts ids over all pages of a document: the k-th repeat of one gets ``~k``. ``href`` maps ids to files.
    """
    units, taken = roll_up(records, options)
    used = {} if used is None else used
    out, first_id = [], {}
    for place, unit in enumerate([*units, *taken]):
        least = 0 if place >= len(units) else options.min_chars if unit.least is None else unit.least
        pieces = [p for p in split(unit, options.max_chars, options.overlap) if len(p[0]) >= least]
        for k, (text, xml_id, path) in enumerate(pieces):
            base = stable_id(stem, xml_id, path, scope)
            used[base] = used.get(base, -1) + 1
            name = base if not used[base] else f"{base}~{used[base]}"
            first_id.setdefault(id(unit), name)
            target = next((f"{href[a]}#{a}" for a in (xml_id, unit.entry) if a and href and a in href), file)
            out.append({
                "id": name, "document": text, "hash": hashlib.sha1(text.encode()).hexdigest()[:16], "doc": stem, "title": title, "heading": unit.heading, "kind": unit.kind, "parent": first_id.get(id(unit.parent)) if unit.parent is not None else None,
                "part": k, "n_parts": len(pieces), "xml_id": xml_id, "xpath": path, "entry": unit.entry, "href": target, "facets": [(n, v) for n, v in sorted(unit.facets.items())],
            })
    return out
