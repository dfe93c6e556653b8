"""Rule documents: parsing, inheritance, channels, static analysis, and compilation to one first-match classification."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import registry
from quillspark.plans.expressions import compile_parameter, compile_test
from quillspark.tree import xpath

TEI = "http://www.tei-c.org/ns/1.0"
# Behaviour names of rule documents.
_NAMES = [
    "alternate", "anchor", "block", "body", "break", "cell", "cit", "code", "code-inline", "document", "figure", "glyph", "graphic", "heading", "index", "inline", "link", "list", "listItem",
    "match", "metadata", "note", "omit", "paragraph", "pass-through", "row", "section", "table", "template", "text", "title", "webcomponent",
]
#: The record behaviours that they stand for.
BEHAVIOURS = {b: "list_item" if b == "listItem" else b.replace("-", "_") for b in _NAMES}
SUPPRESSED = {"omit", "index", "metadata"}
# What each output channel accepts. A channel of records accepts what the channel it records does.
_ACCEPTED = {"web": ["web"], "print": ["print", "web"], "epub": ["epub", "web"], "markdown": ["markdown", "plain"], "typst": ["typst", "plain"], "docx": ["docx"], "plain": ["plain"]}
CHANNELS = _ACCEPTED | {"json": ["json", "web"]} | {f"json-{c}": ["json", *a] for c, a in _ACCEPTED.items()}
#: The prefix of channel names in the file format (fixed value).
PREFIX = "opm-"


@dataclass
class Rule:
    """One model of an element, with its place in groups (g) and sequences (s) of the element's models."""

    element: str
    ordinal: int
    path: tuple[tuple[str, int], ...]
    output: str | None
    predicate: str | None
    behaviour: str | None
    params: dict[str, str]
    template: str | None
    css_class: str
    desc: str
    source: str
    renditions: list[tuple[str, str]] = field(default_factory=list)
    unsupported: str | None = None
    unreachable: str | None = None

    @property
    def key(self) -> str:
        return f"tei-{self.element.replace(':', '_')}{self.ordinal}"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class RuleSet:
    """The rules of a chain of documents, parents first."""

    def __init__(self, rules: dict[str, list[Rule]], ns: str, prefixes: dict[str, str] | None = None, own: set[str] | None = None) -> None:
        self.rules, self.ns, self.prefixes = rules, ns, prefixes or {}
        self.own = own if own is not None else set(rules)

    @classmethod
    def parse(cls, xml: str, name: str = "rules", load=None, _seen: tuple[str, ...] = ()) -> RuleSet:
        """Parse a rule document; ``load(source)`` gives the text of the document it inherits from.

        An element's models replace inherited ones whole, an element without models keeps them; a cycle is an error.
        A missing namespace means TEI, an empty one none. ``*`` and ``text()`` are ignored.
        """
        if name in _seen:
            raise ValueError(f"rule documents inherit in a cycle: {' > '.join((*_seen, name))}")
        root = ElementTree.fromstring(xml)
        spec = next((e for e in root.iter() if _local(e.tag) == "schemaSpec"), root)
        ns = spec.get("ns", TEI)
        merged: dict[str, list[Rule]] = {}
        if (source := spec.get("source")) and load and (text := load(source)) is not None:
            merged = dict(cls.parse(text, source, load, (*_seen, name)).rules)
        own = set()
        for element in spec.iter():
            ident = element.get("ident", "")
            if _local(element.tag) != "elementSpec" or ident in ("", "*", "text()"):
                continue
            own.add(ident)
            if found := cls._models(element, ident, name):
                merged[ident] = found
            elif element.get("mode") == "delete":
                merged.pop(ident, None)
        return cls(merged, ns, own=own)

    @staticmethod
    def _models(spec: ElementTree.Element, ident: str, source: str) -> list[Rule]:
        out: list[Rule] = []

        def walk(parent: ElementTree.Element, path: tuple[tuple[str, int], ...], output: str | None) -> None:
            for k, e in enumerate(parent):
                tag = _local(e.tag)
                if tag in ("modelGrp", "modelSequence"):
                    walk(e, (*path, (tag[5].lower(), k, e.get("predicate"))), e.get("output") or output)  # g or s
                elif tag == "model":
                    kids = {_local(c.tag): c for c in e}
                    params = {c.get("name", ""): c.get("value", "") for c in e if _local(c.tag) == "param" and not len(c)}
                    template = kids.get("template")
                    inner = None if template is None else (template.text or "") + "".join(ElementTree.tostring(c, "unicode") for c in template)
                    css = " ".join(filter(None, (e.get("cssClass"),)))
                    out.append(Rule(ident, len(out) + 1, (*path, ("m", k, None)), e.get("output") or output, e.get("predicate"), e.get("behaviour"), params, inner, css, "".join(kids["desc"].itertext()).strip() if "desc" in kids else "", source, [(c.get("scope", ""), (c.text or "").strip()) for c in e if _local(c.tag) == "outputRendition"]))

        walk(spec, (), None)
        return out

    def channel(self, mode: str) -> RuleSet:
        """The rules a channel uses: those without an output, or one that it accepts, with or without the format's prefix."""
        accepted = set(CHANNELS.get(mode, [mode]))
        keep = lambda r: r.output is None or any(o.removeprefix(PREFIX) in accepted for o in r.output.split())
        return RuleSet({e: [r for r in rs if keep(r)] for e, rs in self.rules.items()}, self.ns, self.prefixes, self.own)

    def analysed(self, variables: dict[str, object] | None = None) -> list[Rule]:
        """All rules with why their predicate can't be evaluated, and why they can't be reached."""
        out, env = [], xpath.Env(variables=variables or {}, namespaces=self.prefixes, functions=dict.fromkeys(registry.names()))
        for rs in self.rules.values():
            levels: dict[tuple, list[Rule]] = {}
            for r in rs:
                why = xpath.why_never(r.predicate, env) if r.predicate else None
                before = levels.setdefault(r.path[:-1], [])
                shadow = None
                if not any(p[0] == "s" for p in r.path):
                    # The first rule of a level wins at once without a predicate; a later one is the level's last resort,
                    # which only further ones without a predicate can't become.
                    if before and before[0].predicate is None:
                        shadow = "an earlier rule without a predicate always wins"
                    elif r.predicate is None and any(x.predicate is None for x in before):
                        shadow = "an earlier rule without a predicate is the last resort"
                before.append(r)
                out.append(replace(r, unsupported=why, unreachable=shadow or ("its predicate can never hold" if why else None)))
        return out

    def table(self, spark: SparkSession, variables: dict[str, object] | None = None) -> DataFrame:
        rows = [(r.element, r.key, r.ordinal, r.output, r.predicate, r.behaviour, r.params, r.template, r.css_class, r.desc, r.source, r.element in self.own, r.unsupported, r.unreachable) for r in self.analysed(variables)]
        return spark.createDataFrame(rows, "element string, rule_key string, ordinal int, output string, predicate string, behaviour string, params map<string,string>, template string, css_class string, desc string, source string, local boolean, unsupported string, unreachable string")

    # ------------------------------------------------------------ compilation

    def dispatch_key(self) -> Column:
        """The element name rules are found by: local in the home namespace, ``prefix:local`` in mapped ones, else null."""
        home = F.coalesce(F.col("ns"), F.lit("")) == F.lit(self.ns)
        key = F.when(home, F.col("tag"))
        for prefix, uri in self.prefixes.items():
            key = key.when(F.col("ns") == uri, F.concat(F.lit(prefix + ":"), F.col("tag")))
        return key

    def winners(self, variables: dict[str, object] | None = None) -> Column:
        """``array<struct<rule_key, behaviour, seq_no, params>>`` of a node: the first match, or all of a sequence.

        One ``CASE`` on the element's name holds one ``CASE`` per element, so a node tests only its own element's rules.
        """
        empty = F.array().cast("array<struct<rule_key:string,behaviour:string,params:map<string,string>,template:string>>")
        cases = None
        for element, rs in self.rules.items():
            chosen = self._chain(rs, (), variables, empty)
            cases = F.when(F.col("rule_element") == element, chosen) if cases is None else cases.when(F.col("rule_element") == element, chosen)
        return empty if cases is None else cases.otherwise(empty)

    def _leaf(self, r: Rule, variables) -> Column:
        params = dict(r.params)
        params.setdefault("content", ".")
        pairs = [x for k, v in params.items() for x in (F.lit(k), compile_parameter(v, variables))]
        behaviour = BEHAVIOURS.get(r.behaviour or "")
        return F.array(F.struct(F.lit(r.key).alias("rule_key"), F.lit(behaviour).cast("string").alias("behaviour"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("params"), F.lit(r.template).cast("string").alias("template")))

    def _chain(self, rs: list[Rule], prefix: tuple, variables, empty: Column) -> Column:
        depth = len(prefix)
        blocks: list[tuple[tuple, list[Rule]]] = []
        for r in rs:
            step = r.path[depth]
            if blocks and blocks[-1][0] == step:
                blocks[-1][1].append(r)
            else:
                blocks.append((step, [r]))
        conditions: list[tuple[Column | None, Column]] = []
        for step, members in blocks:
            kind, _, group_predicate = step
            predicate = members[0].predicate if kind == "m" else group_predicate
            if kind == "m":
                value = self._leaf(members[0], variables)
            elif kind == "g":
                value = self._chain(members, (*prefix, step), variables, empty)
            else:  # a sequence: all members whose predicate holds
                value = F.concat(*[F.when(compile_test(m.predicate, variables)[0], self._leaf(m, variables)).otherwise(empty) if m.predicate else self._leaf(m, variables) for m in members])
            conditions.append((compile_test(predicate, variables)[0] if predicate else None, value))
        if conditions and conditions[0][0] is None:
            return conditions[0][1]
        out, fallback = None, next((v for c, v in conditions if c is None), empty)
        for c, v in conditions:
            if c is not None:
                out = F.when(c, v) if out is None else out.when(c, v)
        return fallback if out is None else out.otherwise(fallback)

    def stylesheet(self, document: str | None = None, base: str = "") -> str:
        """CSS: a base sheet, the named renditions that a document's header declares, the rules' own renditions by rule key."""
        own = [f".{r.key}{':' + scope if scope else ''} {{ {css} }}" for rs in self.rules.values() for r in rs for scope, css in r.renditions if css]
        named = []
        if document:
            for e in ElementTree.fromstring(document).iter():
                name = e.get("{http://www.w3.org/XML/1998/namespace}id")
                if _local(e.tag) == "rendition" and name and (e.text or "").strip():
                    named.append(f".simple_{name}{':' + e.get('scope') if e.get('scope') else ''} {{ {' '.join(e.text.split())} }}")
        return "\n".join([*([base] if base else []), *named, *own])

    def typst_prelude(self) -> str:
        """Typst functions for classes whose styles have a counterpart: bold, italic, struck, underlined, coloured, sized, and
        what stands before or after."""
        out = []
        for rs in self.rules.values():
            for r in rs:
                style, body = "; ".join(css for scope, css in r.renditions if not scope), "body"
                for pattern, made in ((r"font-weight:\s*bold", "strong({})"), (r"font-style:\s*italic", "emph({})"), ("line-through", "strike({})"), ("underline", "underline({})")):
                    if re.search(pattern, style):
                        body = made.format(body)
                if m := re.search(r"(?<![-\w])color:\s*(#[0-9a-fA-F]{6})", style):
                    body = f'text(fill: rgb("{m[1]}"), {body})'
                if m := re.search(r"font-size:\s*([\d.]+)px", style):
                    body = f"text(size: {float(m[1]) * 0.75:g}pt, {body})"
                for scope, css in r.renditions:
                    if scope in ("before", "after") and (m := re.search(r"content:\s*['\"]([^'\"]*)", css)):
                        body = f"[{m[1]}] + {body}" if scope == "before" else f"{body} + [{m[1]}]"
                if body != "body":
                    out.append(f"#let {r.key}(body) = {body}")
        return "\n".join(out)

    def fingerprint(self, channel: str, base: str = "") -> str:
        """A key under which what is made of these rules for a channel may be kept."""
        facts = [channel, base, self.ns, *[f"{r.key}|{r.output}|{r.predicate}|{r.behaviour}|{sorted(r.params.items())}|{r.template}|{r.css_class}|{r.renditions}|{r.path}" for rs in self.rules.values() for r in rs]]
        return hashlib.sha256("\0".join(facts).encode()).hexdigest()


def load_rules(path: str) -> RuleSet:
    """Parse a rule file; sources are found beside it or by absolute path."""
    here = Path(path)

    def load(source: str) -> str | None:
        for p in (Path(source), here.parent / source):
            if p.is_file():
                return p.read_text(encoding="utf-8")
        return None

    return RuleSet.parse(here.read_text(encoding="utf-8"), here.name, load)


def css_classes(element: Column, key: Column, rend: Column, css: Column) -> Column:
    return text_join(F.concat(F.lit("tei-"), element), key, F.regexp_replace(rend, r"\s+", " "), css)


def text_join(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


