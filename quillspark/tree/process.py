"""Applying rules to one document: dispatch, parameters, templates, footnotes, suppression."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from quillspark.plans.rules import BEHAVIOURS, SUPPRESSED, Rule, RuleSet
from quillspark.tree import nodes, xpath
from quillspark.tree.behaviours import ACCEPTS, CHANNELS, Html, Records, flat, html, param_text
from quillspark.tree.nodes import Node
from quillspark.tree.xpath import Attribute, Env, text_of

_PLACE = re.compile(r"\[\[\s*([\w-]+)\s*\]\]")


@lru_cache(maxsize=1024)
def _template(source: str) -> Node:
    return nodes.read(f"<x>{source}</x>")


class Run:
    """What one output unit collects: footnotes, counters, metadata."""

    def __init__(self) -> None:
        self.notes: list[dict] = []
        self.note_no = self.id_no = 0
        self.metadata: dict[str, list[str]] = {}
        self.names: dict[int, str] = {}

    def next_note(self) -> int:
        self.note_no += 1
        return self.note_no

    def next_id(self) -> int:
        self.id_no += 1
        return self.id_no

    def add(self, body, marker: str, label: str | None, place: str, node: Node) -> None:
        self.notes.append({"body": body, "marker": marker, "label": label, "place": place or None, "node": node})


def labelled_first(notes: list[dict]) -> list[dict]:
    """A footnote order: marks that are no numbers first, otherwise as they came."""
    return sorted(notes, key=lambda n: n["marker"].isdigit())


def by_place(notes: list[dict]) -> list[dict]:
    """A footnote order: foot, end, the rest."""
    return sorted(notes, key=lambda n: {"foot": 0, "end": 1}.get(n["place"], 2))


class Plan:
    """What applying a rule needs, worked out once for a process."""

    __slots__ = ("key", "behaviour", "params", "needs_content", "classes", "css", "accepted", "method")

    def __init__(self, rule: Rule, out) -> None:
        self.key, self.behaviour = rule.key, BEHAVIOURS.get(rule.behaviour or "")
        self.params = [(name, None if source.strip() == "." else source) for name, source in rule.params.items()]
        self.needs_content = rule.template is not None and "content" not in rule.params and "content" in _PLACE.findall(rule.template)
        self.classes, self.css = [f"tei-{rule.element.replace(':', '_')}", rule.key], rule.css_class.split()
        self.accepted = None if self.behaviour == "webcomponent" else set(ACCEPTS.get(self.behaviour, []))
        self.method = None if self.behaviour is None or out.records else getattr(out, {"break": "break_"}.get(self.behaviour, self.behaviour))


class Process:
    """The rules of a channel over documents of one task.

    ``rules`` are all rules of a rule set; those of the channel are taken. ``order`` reorders the footnotes of a unit.
    """

    def __init__(self, rules: RuleSet, channel: str = "web", env: Env | None = None, order: Callable[[list[dict]], list[dict]] | None = None, webcomponents: bool = False, css: str = "") -> None:
        self.rules, self.env, self.order, self.webcomponents, self.css = rules.channel(channel), env or Env(), order, webcomponents, css
        kind = Records if channel.startswith("json") else CHANNELS[channel]
        self.out = kind(self)
        self.run = Run()
        self.chains = {e: self._chain(rs, 0) for e, rs in self.rules.rules.items()}
        self.prefixes = {uri: p for p, uri in rules.prefixes.items()}
        self.fired: dict[str, int] = {}
        self.matched: dict[int, Rule] = {}
        self.plans: dict[int, Plan] = {}

    # ------------------------------------------------------------ dispatch

    def _test(self, predicate: str) -> Callable[[Node], bool]:
        why = xpath.why_never(predicate, self.env)
        return (lambda n: False) if why else (lambda n: xpath.test(n, predicate, self.env))

    def _chain(self, rules: list[Rule], depth: int) -> Callable[[Node], list[Rule]]:
        """First match: predicates in order, else the first without one. A group is a chain of its own, a sequence all that hold."""
        blocks: list[tuple[tuple, list[Rule]]] = []
        for r in rules:
            if blocks and blocks[-1][0] == r.path[depth]:
                blocks[-1][1].append(r)
            else:
                blocks.append((r.path[depth], [r]))
        steps = []
        for (kind, _, group_predicate), members in blocks:
            predicate = members[0].predicate if kind == "m" else group_predicate
            if kind == "m":
                value = (lambda r: lambda n: [r])(members[0])
            elif kind == "g":
                value = self._chain(members, depth + 1)
            else:
                parts = [(self._test(m.predicate) if m.predicate else None, m) for m in members]
                value = (lambda parts: lambda n: [m for test, m in parts if test is None or test(n)])(parts)
            steps.append((self._test(predicate) if predicate else None, value))
        otherwise = next((v for t, v in steps if t is None), lambda n: [])
        tests = [] if steps and steps[0][0] is None else [s for s in steps if s[0] is not None]

        def choose(n: Node) -> list[Rule]:
            for test, value in tests:
                if test(n):
                    return value(n)
            return otherwise(n)

        return choose

    def key(self, node: Node) -> str | None:
        if (node.ns or "") == self.rules.ns:
            return node.tag
        return f"{self.prefixes[node.ns]}:{node.tag}" if node.ns in self.prefixes else None

    def style_of(self, node: Node) -> str:
        """The style that the rule being applied asks for."""
        rule = self.matched.get(id(node))
        return "" if rule is None else "; ".join(css for scope, css in rule.renditions if not scope)

    def apply(self, items: list) -> list:
        """Pieces of some nodes: text by the channel's treatment, elements by their rules."""
        out = []
        for x in items:
            if isinstance(x, Node):
                kind = x.kind
                if kind == "t":
                    out.append(self.out.run(x.text or ""))
                elif kind == "e":
                    if x.final:
                        out.append(x)
                    else:
                        out += self.dispatch(x)
                elif kind == "d":
                    out += [x] if x.final else self.apply(x.children)
            elif isinstance(x, dict):
                out.append(x)
            else:
                out.append(self.out.run(text_of(x)))
        return out

    def content(self, node: Node | None, items: list) -> list:
        """Pieces of a parameter: the node itself stands for its children."""
        if len(items) == 1 and items[0] is node and node is not None:
            return self.apply(node.children)
        out = []
        for x in items:
            if isinstance(x, Finished):
                out.append(str(x))
            elif x is node and node is not None:
                out += self.apply(node.children)
            else:
                out += self.apply([x])
        return out

    def dispatch(self, node: Node) -> list:
        key = self.key(node)
        if key is None:
            return self.out.foreign(node)
        chain = self.chains.get(key)
        found = chain(node) if chain is not None else []
        if not found:
            return self.out.unmatched(node)
        if len(found) == 1:
            return self.leaf(node, found[0])
        return [p for rule in found for p in self.leaf(node, rule)]

    def plan(self, rule: Rule) -> Plan:
        found = self.plans.get(id(rule))
        if found is None:
            found = self.plans[id(rule)] = Plan(rule, self.out)
        return found

    def parameters(self, node: Node, plan: Plan) -> dict[str, list]:
        values = {}
        for name, source in plan.params:
            values[name] = [node] if source is None else xpath.select_or_node(node, source, self.env) if name == "content" else xpath.select_all(node, source, self.env)
        return values

    def leaf(self, node: Node, rule: Rule) -> list:
        plan = self.plan(rule)
        self.fired[plan.key] = self.fired.get(plan.key, 0) + 1
        self.matched[id(node)] = rule
        behaviour = plan.behaviour
        values = self.parameters(node, plan) if plan.params else {}
        if plan.needs_content:
            values["content"] = [node]
        if self.out.records:
            return self.recorded(node, rule, behaviour, values)
        if rule.template is not None:
            made = self.template(node, rule.template, values)
            if behaviour is None or behaviour == "template":
                return self.out.template(node, [], made)
            values = values | {"content": [p if isinstance(p, Node) else Finished(p) for p in made]}
        if behaviour is None:
            return self.apply(node.children)
        if not values:
            return plan.method(node, self.classes(node, rule), [node])
        content, accepted = values.get("content", [node]), plan.accepted
        more = {k: v for k, v in values.items() if k != "content" and (accepted is None or k in accepted)}
        return plan.method(node, self.classes(node, rule), content, **more)

    def recorded(self, node: Node, rule: Rule, behaviour: str | None, values: dict) -> list:
        shown = {k: v for k, v in values.items() if k not in ("content", "default", "alternate")}
        content = values.get("default") if behaviour == "alternate" and "default" in values else values.get("content", [node])
        if behaviour is None and rule.template is None:
            return [self.out.record(node, None, self.plan(rule).key, shown, content)]
        if behaviour is None:
            behaviour = "template"
        made = self.out.record(node, behaviour, self.plan(rule).key, shown, content, behaviour in SUPPRESSED)
        if behaviour == "alternate" and values.get("alternate"):
            made["alternate_text"] = flat(values["alternate"])
        if rule.template is not None and behaviour != "template" and not made.get("suppressed"):
            made["children"] = [self.out.record(node, "template", rule.key, {}, content)]
        return [made]

    def classes(self, node: Node, rule: Rule) -> list[str]:
        plan = self.plan(rule)
        return [*plan.classes, *(node.attrs.get("rend") or "").split(), *plan.css]

    # ------------------------------------------------------------ templates

    def template(self, node: Node, source: str, values: dict[str, list]) -> list:
        """A template with its places filled: lists of pieces in text, strings in attributes; unreadable markup gives nothing."""
        tree = _template(source)
        if nodes.error_of(tree) is not None:
            return []

        def filled(text: str) -> list:
            out, at = [], 0
            for m in _PLACE.finditer(text):
                out += [Finished(text[at : m.start()]), *self.content(node, values.get(m[1], []))]
                at = m.end()
            return [p for p in [*out, Finished(text[at:])] if p != ""]

        def written(n: Node) -> list:
            if n.kind == "t":
                return filled(n.text or "")
            if n.kind != "e":
                return []
            out = Node("e", n.tag, attrs={k: _PLACE.sub(lambda m: " ".join(text_of(x) for x in values.get(m[1], [])), v) for k, v in n.attrs.items()})
            out.final = True
            return [Html.fill(out, [p for c in n.children for p in written(c)])]

        lines = [p for c in nodes.top(tree).children for p in written(c)]
        return lines

    # ------------------------------------------------------------ units

    def transform(self, roots: list[Node]):
        """One output unit: a string, or a list of records; footnotes go where the channel puts them."""
        self.run, self.matched = Run(), {}
        pieces = self.apply(roots)
        notes = self.run.notes if self.order is None else self.order(list(self.run.notes))
        return self.out.finish(self.out.place_notes(pieces, notes))

    def pieces(self, roots: list[Node]) -> list:
        """The same before it is written: output elements and strings."""
        self.run, self.matched = Run(), {}
        pieces = self.apply(roots)
        notes = self.run.notes if self.order is None else self.order(list(self.run.notes))
        return self.out.place_notes(pieces, notes)


class Finished(str):
    """Text that a template made: it is not treated again."""


def flat_records(found: list, parent: int | None = None, out: list | None = None) -> list[dict]:
    """Records of a document in order, with number, parent's number and own text."""
    out = [] if out is None else out
    for r in found:
        if isinstance(r, dict):
            number = len(out)
            out.append({k: v for k, v in r.items() if k != "children"} | {"record_no": number, "parent_no": parent, "own_text": " ".join(c.strip() for c in r.get("children", []) if isinstance(c, str) and c.strip())})
            flat_records(r.get("children", []), number, out)
    return out


def record_text(r: dict) -> str:
    """All text of a record, without suppressed ones."""
    return " ".join(" ".join(c if isinstance(c, str) else record_text(c) for c in r.get("children", []) if isinstance(c, str) or not c.get("suppressed")).split())


__all__ = ["Attribute", "Process", "Run", "by_place", "flat_records", "html", "labelled_first", "param_text", "record_text"]
