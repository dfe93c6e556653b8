"""The engine's API: a project's configuration and rules applied to collections of documents."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import registry
from quillspark.operators import documents, sites
from quillspark.plans.rules import RuleSet, load_rules
from quillspark.session import ship
from quillspark.sources.markup import read_corpus, shred
from quillspark.tree.pages import SELECTORS, PageSettings
from quillspark.tree.passages import Field, Options, UnitKind
from quillspark.tree.process import by_place, labelled_first

ORDERS = {"labelled-first": labelled_first, "by-place": by_place}


def _whole(table: dict, name: str, default: int) -> int:
    value = table.get(name, default)
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise ValueError(f"index.{name} must be a whole number, not {value!r}")
    return value


def _selectors(table: dict) -> dict[str, list[str]]:
    return {k: list(table.get(k, [])) for k in ("behaviours", "elements", "models")}


@dataclass
class Config:
    """Settings of a project file; a missing file gives the defaults. Paths are relative to the file."""

    rules: str | None = None
    setup: documents.Setup = field(default_factory=documents.Setup)
    pages: PageSettings | None = None
    options: Options = field(default_factory=Options)
    templates: dict[str, str] = field(default_factory=dict)
    name: str | None = None
    assets: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        p = Path(path)
        if not p.is_file():
            return cls()
        raw = tomllib.loads(p.read_text(encoding="utf-8"))
        here = lambda name: str(p.parent / name)
        project, context, index, chunking = (raw.get(k, {}) for k in ("project", "context", "index", "chunking"))
        fields = [Field(f["name"], **_selectors(f), metadata=f.get("metadata", True), inline=f.get("inline")) for f in index.get("fields", [])]
        units = [UnitKind(u["name"], **_selectors(u), emit=u.get("emit", True), min_chars=u.get("min_chars")) for u in index.get("units", [])]
        selector = chunking.get("selector")
        if selector and selector not in SELECTORS and "/" not in selector and "." in selector:
            selector = registry.resolve(selector)
        settings = PageSettings(selector, chunking.get("depth", 1), chunking.get("file_pattern", "{xml_id}.html"), chunking.get("link_pattern"), chunking.get("fragments", {})) if selector else None
        registers = {name: Path(here(file)).read_text(encoding="utf-8") for name, file in raw.get("registers", {}).items()}
        order = project.get("footnote_order")
        for module in project.get("functions", []):
            registry.register_module(module, plain=True)
        setup = documents.Setup(context, registers, raw.get("collections", {}), ORDERS.get(order) or (registry.resolve(order) if order else None), project.get("webcomponents", False), "\n".join(Path(here(f)).read_text(encoding="utf-8") for f in project.get("styles", [])))
        templates = {k: Path(here(f)).read_text(encoding="utf-8") for k, f in raw.get("templates", {}).items()}
        return cls(here(project["rules"]) if "rules" in project else None, setup, settings, Options(_whole(index, "max_chars", 1500), _whole(index, "min_chars", 40), _whole(index, "overlap", 1), fields, units), templates, project.get("document_name"), [here(a) for a in project.get("assets", [])])


class Engine:
    """Nodes, records, output, pages, passages, coverage and packages of documents, all as DataFrames.

    Each document is parsed once a call, in one task; see ``operators.documents``.
    """

    def __init__(self, spark: SparkSession, rules: RuleSet, config: Config | None = None) -> None:
        self.spark, self.rules, self.config = ship(spark), rules, config or Config()

    @classmethod
    def load(cls, spark: SparkSession, path: str, rules: str | None = None) -> Engine:
        """A project; rules given here win over the project's, these over none."""
        config = Config.load(path)
        chosen = rules or config.rules
        if not chosen:
            raise ValueError("the project names no rules")
        return cls(spark, load_rules(chosen), config)

    def with_config(self, **changes) -> Engine:
        return Engine(self.spark, self.rules, replace(self.config, **changes))

    def read(self, path: str, recursive: bool = False) -> DataFrame:
        """Documents below a path, named by the project's expression where it has one; none at all is an error."""
        docs = read_corpus(self.spark, path, recursive)
        if docs.isEmpty():
            raise ValueError(f"no documents in {path}")
        if self.config.name:
            names = documents.named(docs, self.config.name, self.config.setup)
            docs = docs.join(names, "doc_id").select(F.col("name").alias("doc_id"), "source", "raw")
        return docs

    def errors(self, docs: DataFrame) -> DataFrame:
        """Malformed documents, and rules whose predicates can never be evaluated."""
        bad = documents.rendered(docs, self.rules, "plain", self.config.setup).where("error is not null").select(F.col("doc_id").alias("where"), F.col("error").alias("message"))
        rules = [(r.key, r.unsupported) for r in self.rules.analysed(self.config.setup.variables) if r.unsupported]
        return bad.unionByName(self.spark.createDataFrame(rules, "where string, message string"))

    def check(self) -> None:
        """Raise if a predicate can never be evaluated."""
        if bad := [r.key for r in self.rules.analysed(self.config.setup.variables) if r.unsupported]:
            raise ValueError(f"rules with predicates that can't be evaluated: {', '.join(bad)}")

    def nodes(self, docs: DataFrame) -> DataFrame:
        return shred(docs)

    def records(self, docs: DataFrame, channel: str = "web", strict: bool = False) -> DataFrame:
        """Decision records of a channel. ``strict`` raises if a predicate can't be evaluated."""
        if strict:
            self.check()
        return documents.recorded(docs, self.rules, channel, self.config.setup)

    def render(self, docs: DataFrame, channel: str = "web") -> DataFrame:
        """``doc_id, output, error, metadata``."""
        return documents.rendered(docs, self.rules, channel, self.config.setup)

    def page(self, docs: DataFrame, template: str | None = None, channel: str = "web") -> DataFrame:
        """Rendered documents in a page template with ``$content``, ``$doc`` and ``$styles``."""
        shell = template or self.config.templates.get(channel, "$content")
        parts = Template(shell).safe_substitute(styles=self.rules.stylesheet() + self.config.setup.css).partition("$content")
        return self.render(docs, channel).select("doc_id", F.replace(F.concat(F.lit(parts[0]), "output", F.lit(parts[2])), F.lit("$doc"), F.col("doc_id")).alias("page"))

    def pages(self, docs: DataFrame, channel: str = "web") -> DataFrame:
        """Pages with navigation, output, fragments, the ids they hold and the images they show."""
        return documents.paged(docs, self.rules, self.config.pages or PageSettings(), channel, self.config.setup)

    def site(self, docs: DataFrame, folder: str, channel: str = "web") -> DataFrame:
        """Write pages, fragments and manifests below a folder; returns the collection's index."""
        found = self.pages(docs, channel)
        sites.write_pages(found, folder, self.config.templates.get(channel))
        return sites.collection_index(sites.manifest(found))

    def passages(self, docs: DataFrame) -> DataFrame:
        """Index records with stable ids, hashes, headings, kinds, parents, pages and facets."""
        return documents.indexed(docs, self.rules, self.config.options, self.config.pages, "web", self.config.setup)

    def coverage(self, docs: DataFrame, channel: str = "web") -> dict[str, DataFrame]:
        """What rules did to documents: counts from one pass over the documents, and what the rules alone tell."""
        total = sites.settled_table(documents.totals(documents.facts(docs, self.rules, channel, self.config.setup)), "coverage")
        table = self.rules.table(self.spark, self.config.setup.variables)
        kind = lambda name: total.where(F.col("fact") == name).drop("fact")
        hits = kind("model").select(F.col("key").alias("rule_key"), F.col("n").alias("hits"))
        present = kind("element").select(F.col("key").alias("element"))
        able = "local and unreachable is null and (behaviour is not null or template is not null)"
        value = lambda c, name: F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0)).alias(name)
        summary = total.agg(
            value((F.col("fact") == "records") & (F.col("key") == "all"), "records"), value((F.col("fact") == "records") & (F.col("key") == "suppressed"), "suppressed"), F.count_if(F.col("fact") == "model").alias("rules_fired"),
            F.count_if(F.col("fact") == "element").alias("elements"), F.count_if(F.col("fact") == "unmatched").alias("unmatched_elements"), F.count_if(F.col("fact") == "dropped").alias("dropped_elements"), F.count_if(F.col("fact") == "error").alias("errors"),
        )
        counts = table.agg(F.count("*").alias("rules"), F.count_if("local").alias("local_rules"), F.count_if(F.col("unreachable").isNotNull()).alias("unreachable"))
        return {
            "summary": summary.crossJoin(counts),  # one row each
            "behaviours": kind("behaviour"), "rules": hits, "elements": kind("element"), "unmatched": kind("unmatched"), "dropped": kind("dropped"), "errors": kind("error"),
            "unused": table.where(able).join(hits, "rule_key", "left_anti").join(present, "element", "left_semi"), "unused_specs": table.where("local").select("element").distinct().join(present, "element", "left_anti"),
            "unreachable": table.where("unreachable is not null"), "silent": table.where("behaviour is null and template is null"),
        }

    def epub(self, docs: DataFrame) -> DataFrame:
        """``doc_id, epub`` (BINARY); the same input gives the same bytes."""
        return documents.books(docs, self.rules, self.config.pages, self.config.setup)

    def docx(self, docs: DataFrame) -> DataFrame:
        return documents.word_files(docs, self.rules, self.config.setup)
