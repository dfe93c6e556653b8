"""Whole documents as rows: each is parsed once, in one task, and evaluated as a tree. Maps over rows: nothing is shuffled.

``docs`` has an id and a raw document. A malformed document gives what was read before the error, and the error. A
document's tree must fit in one task; register documents are sent to all tasks, so they must be small.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import registry
from quillspark.plans.rules import RuleSet
from quillspark.tree import nodes, packages, pages, passages, segments, shapes, xpath
from quillspark.tree.behaviours import param_text
from quillspark.tree.nodes import Node
from quillspark.tree.process import Process, flat_records

_TEXT, _INT, _MAP = T.StringType(), T.IntegerType(), T.MapType(T.StringType(), T.StringType())
#: Bytes of register documents that are sent to the tasks at most.
REGISTER_BYTES = 64 << 20


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


RECORDS = _schema(record_no=_INT, parent_no=_INT, node_id=_INT, element=_TEXT, behaviour=_TEXT, model=_TEXT, xml_id=_TEXT, xpath=_TEXT, params=_MAP, suppressed=T.BooleanType(), own_text=_TEXT, text=_TEXT)
PAGES = _schema(page_no=_INT, page_id=_TEXT, file=_TEXT, xml_id=_TEXT, xpath=_TEXT, prev=_TEXT, next=_TEXT, title=_TEXT, output=_TEXT, fragments=_MAP, anchors=T.ArrayType(_TEXT), images=T.ArrayType(_TEXT))
PASSAGES = _schema(id=_TEXT, document=_TEXT, hash=_TEXT, title=_TEXT, heading=_TEXT, kind=_TEXT, parent=_TEXT, part=_INT, n_parts=_INT, xml_id=_TEXT, xpath=_TEXT, entry=_TEXT, href=_TEXT, facets=T.MapType(_TEXT, T.ArrayType(_TEXT)))
FACTS = _schema(fact=_TEXT, key=_TEXT, detail=_TEXT, n=T.LongType(), first=_TEXT, at=_INT)


@dataclass
class Setup:
    """What documents are processed with, beside the rules. Everything here is sent to the tasks."""

    variables: dict = field(default_factory=dict)
    registers: dict[str, str] = field(default_factory=dict)
    collections: dict[str, list[str]] = field(default_factory=dict)
    order: Callable | None = None
    webcomponents: bool = False
    css: str = ""
    kind: str = "xml"

    def env(self, prefixes: dict[str, str] | None = None) -> xpath.Env:
        size = sum(map(len, self.registers.values()))
        if size > REGISTER_BYTES:
            raise ValueError(f"register documents of {size} bytes are too large to send to every task; join them as tables")
        return xpath.Env(dict(self.variables), dict(prefixes or {}), {k: nodes.read(v) for k, v in self.registers.items()}, dict(self.collections), registry.plain())


def mapped(docs: DataFrame, rows_of: Callable[[], Callable[[str, object], list[dict]]], schema: T.StructType, id_: str = "doc_id", raw: str = "raw") -> DataFrame:
    """``doc_id`` and the rows that a function makes of each document; ``rows_of`` is called once in a task to set it up."""
    whole = T.StructType([T.StructField("doc_id", T.StringType()), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, make = to_arrow_schema(whole), rows_of()
        rows: list[dict] = []
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [r | {"doc_id": key} for r in make(key, value)]
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select(F.col(id_).cast("string"), F.col(raw)).mapInArrow(run, whole)


def filled(docs: DataFrame, start: Callable[[], Callable[[object, list[list]], int]], schema: T.StructType, id_: str = "doc_id", raw: str = "raw") -> DataFrame:
    """``mapped`` for functions that add a document's rows to columns (``shapes.Filled``)."""
    whole = T.StructType([T.StructField("doc_id", T.StringType()), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, add = to_arrow_schema(whole), start()
        keys, columns = [], [[] for _ in schema]

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([keys, *columns], arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys += [key] * add(value, columns)
                if len(keys) >= 10_000:
                    yield packed()
                    keys, columns = [], [[] for _ in schema]
        if keys:
            yield packed()

    return docs.select(F.col(id_).cast("string"), F.col(raw)).mapInArrow(run, whole)


def dealt(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``docs`` dealt out to all cores. Spark sizes the partitions behind a join or an aggregation by bytes, but documents
    cost processor time: a table of some MB would be one task. For tables that a shuffle made, and for documents written from
    narrow columns: files are split by bytes too, and not inside a row group, so a file of 4 MB with 600,000 keys is one task."""
    return docs.repartition(partitions or 2 * docs.sparkSession.sparkContext.defaultParallelism)


def spread(table: DataFrame) -> int:
    """Partitions for a shuffle of a table, at least twice the cores, else in proportion to the table. Spark joins the partitions of a shuffle by
    their packed bytes; narrow rows pack so well that a task would get ever more of them. It keeps a number that is given."""
    return max(2 * table.sparkSession.sparkContext.defaultParallelism, 8 * table.rdd.getNumPartitions())


def evaluated(docs: DataFrame, expressions: dict[str, str], setup: Setup | None = None, **names: str) -> DataFrame:
    """``doc_id, name, item_no, value`` of the items that expressions give in each document; an error gives none. For documents
    of a known shape (``shapes``) expressions that look into no number are not evaluated, and the others on the shape's tree."""
    setup, job = setup or Setup(), uuid.uuid4().hex

    def start():
        env = setup.env()
        known = {n: s for n, s in expressions.items() if shapes.blind(s) is not None}
        others = {n: s for n, s in expressions.items() if n not in known}

        def items(sources: dict[str, str], tree: Node) -> list[tuple]:
            return [(n, k, xpath.text_of(x)) for n, source in sources.items() for k, x in enumerate(xpath.select_all(tree, source, env), 1)]

        if setup.kind != "xml":
            def make(value, out):
                found = items(expressions, nodes.read(value, setup.kind))
                for column, values in zip(out, zip(*found, strict=True), strict=False):
                    column += values
                return len(found)
            return make
        return shapes.of_job(job, lambda: shapes.Filled(lambda raw, tree: items(known, tree), 3, shapes.free(env), lambda tree: items(others, tree)))

    return filled(docs, start, _schema(name=_TEXT, item_no=_INT, value=_TEXT), **names)


def recorded(docs: DataFrame, rules: RuleSet, channel: str = "web", setup: Setup | None = None, columns: list[str] | None = None, **names: str) -> DataFrame:
    """Decision records of a channel, in document order: behaviour, rule, parameters, own text, parent. ``columns`` are made alone,
    where not all are asked for. A shape that comes again is worked out once (``shapes``)."""
    setup, job = setup or Setup(), uuid.uuid4().hex
    table = RECORDS if columns is None else T.StructType([RECORDS[c] for c in columns])

    def start():
        process = Process(rules, "json" if channel == "web" else f"json-{channel}", setup.env(rules.prefixes))

        def make(tree: Node) -> list[tuple]:
            found = process.transform([tree])
            texts: list[str] = []

            def collect(r: dict) -> str:
                """A record's text, and those of all below it, each worked out once."""
                at = len(texts)
                texts.append("")
                inner = [c if isinstance(c, str) else (collect(c), c.get("suppressed")) for c in r.get("children", [])]
                texts[at] = " ".join(" ".join(c if isinstance(c, str) else c[0] for c in inner if isinstance(c, str) or not c[1]).split())
                return texts[at]

            flat = flat_records(found)
            if "text" in table.names:
                for r in found:
                    if isinstance(r, dict):
                        collect(r)
            else:
                texts = [""] * len(flat)
            rows = [{"record_no": r["record_no"], "parent_no": r["parent_no"], "node_id": r["node_id"], "element": r.get("element"), "behaviour": r["behaviour"], "model": r.get("model"), "xml_id": r.get("id"), "xpath": r.get("xpath"), "params": [(k, xpath.text_of(v)) for k, v in sorted(r.get("params", {}).items())], "suppressed": bool(r.get("suppressed")), "own_text": r["own_text"], "text": t} for r, t in zip(flat, texts, strict=True)]
            return [tuple(r[c] for c in table.names) for r in rows]

        if setup.kind != "xml":
            def add(value, out):
                found = make(nodes.read(value, setup.kind))
                for column, values in zip(out, zip(*found, strict=True), strict=False):
                    column += values
                return len(found)
            return add
        return shapes.of_job(job, lambda: shapes.Filled(lambda raw, tree: make(tree), len(table), shapes.blind_rules(process, True)))

    return filled(docs, start, table, **names)


def record_trees(docs: DataFrame, rules: RuleSet, channel: str = "web", setup: Setup | None = None, **names: str) -> DataFrame:
    """One JSON document of nested records and the models that apply to its elements, for each document."""
    import json

    setup = setup or Setup()

    def start():
        process = Process(rules, "json" if channel == "web" else f"json-{channel}", setup.env(rules.prefixes))

        def make(key, value):
            tree = nodes.read(value, setup.kind)
            present = {n.tag for n in tree.walk() if n.kind == "e"}
            found = process.transform([tree])
            models = [{"key": r.key, "element": r.element, "behaviour": r.behaviour, "predicate": r.predicate, "desc": r.desc, "source": r.source} for e, rs in process.rules.rules.items() if e in present for r in rs]
            return [{"output": json.dumps({"document": found, "models": models}, ensure_ascii=False, indent=2)}]
        return make

    return mapped(docs, start, _schema(output=_TEXT), **names)


def rendered(docs: DataFrame, rules: RuleSet, channel: str = "web", setup: Setup | None = None, **names: str) -> DataFrame:
    """``doc_id, output, error, metadata``: each document in a channel. A shape that comes again is rendered once (``shapes``)."""
    setup, job = setup or Setup(), uuid.uuid4().hex

    def start():
        process = Process(rules, channel, setup.env(rules.prefixes), setup.order, setup.webcomponents, setup.css)

        def render(value) -> dict:
            tree = nodes.read(value, setup.kind)
            output = process.transform([tree])
            return {"output": output, "error": nodes.error_of(tree), "metadata": [(k, "; ".join(v)) for k, v in process.run.metadata.items()]}

        if setup.kind != "xml":
            return lambda key, value: [render(value)]
        made = shapes.of_job(job, lambda: shapes.Shapes(process, render))
        return lambda key, value: [made(value)]

    return mapped(docs, start, _schema(output=_TEXT, error=_TEXT, metadata=_MAP), **names)


def paged(docs: DataFrame, rules: RuleSet, settings: pages.PageSettings, channel: str = "web", setup: Setup | None = None, columns: list[str] | None = None, **names: str) -> DataFrame:
    """Pages of each document with navigation, output and fragments; links between them are rewritten. Of the costly columns
    (``title, output, fragments, anchors, images``) those that ``columns`` leaves out are null and cost nothing.

    A page is an output unit of its own: footnotes are numbered in it. Fragments are expressions with their own channel
    and parameters (project parameters, then the fragment's), evaluated once a document or once a page. Divisions of a shape that
    comes again are made once (``segments``).
    """
    setup, job = setup or Setup(), uuid.uuid4().hex
    made = {"title", "output", "fragments", "anchors", "images"} & set(columns if columns is not None else PAGES.names)

    def start():
        if setup.kind != "xml":
            _, whole, _ = prepared()
            return lambda key, value: whole(key, nodes.read(value, setup.kind))
        return shapes.of_job(job, lambda: divided(*prepared()))

    def divided(process: Process, whole: Callable, single: Callable) -> segments.Divided:
        return segments.Divided(process, settings, whole, single, made)

    def prepared():
        process = Process(rules, channel, setup.env(rules.prefixes), setup.order, setup.webcomponents, setup.css)
        kept: dict[str, Process] = {}
        for name, f in settings.fragments.items():
            env = setup.env(rules.prefixes)
            env.variables["parameters"] = dict(setup.variables.get("parameters", {})) | f.get("parameters", {})
            kept[name] = Process(rules, f.get("channel", channel), env, setup.order, setup.webcomponents)

        def fragment(name: str, base: Node) -> str:
            p = kept[name]
            picked = [x for x in xpath.select_all(base, settings.fragments[name]["xpath"], p.env) if isinstance(x, Node)]
            return p.out.finish(p.pieces(picked))

        def ids_of(page: Node) -> list[str]:
            return list(dict.fromkeys(x for n in page.walk() if n.kind == "e" and (x := n.id))) if made & {"output", "anchors"} else []

        def single(tree: Node) -> list[tuple]:
            out = []
            for page in pages.select(tree, settings, process.env):
                pieces = process.pieces([page]) if made & {"title", "output"} else None
                title = packages.chapter_title(pieces, page) if "title" in made else None
                out.append((page, title, pieces, ids_of(page), [fragment(n, page) for n in settings.fragments] if "fragments" in made else []))
            return out

        def make(key, tree):
            found = pages.select(tree, settings, process.env)
            rows = pages.metadata(found, settings, str(key))
            ids = [ids_of(page) for page in found]
            held: dict[str, str] = {}
            for r, own in zip(rows, ids, strict=False):
                for x in own:
                    held.setdefault(x, r["file"])

            whole = {n: fragment(n, tree) for n, f in settings.fragments.items() if f.get("scope", "document") == "document"} if "fragments" in made else {}
            for k, (r, page) in enumerate(zip(rows, found, strict=True)):
                pieces = process.pieces([page]) if made & {"title", "output", "images"} else []
                if "images" in made:
                    r["images"] = packages.images(pieces)
                if "output" in made:
                    r["output"] = process.out.finish(pages.rewrite(pieces, r["file"], held, settings.link_pattern))
                if "title" in made:
                    r["title"] = packages.chapter_title(pieces, page)
                if "fragments" in made:
                    r["fragments"] = [(n, whole[n] if n in whole else fragment(n, page)) for n in settings.fragments]
                if "anchors" in made:
                    r["anchors"] = ids[k]
            return rows
        return process, make, single

    return mapped(docs, start, PAGES, **names)


def indexed(docs: DataFrame, rules: RuleSet, options: passages.Options, settings: pages.PageSettings | None = None, channel: str = "web", setup: Setup | None = None, **names: str) -> DataFrame:
    """Passages of each document, page by page where it has pages, else of the whole."""
    setup = setup or Setup()

    def start():
        process = Process(rules, "json" if channel == "web" else f"json-{channel}", setup.env(rules.prefixes))

        def make(key, value):
            tree = nodes.read(value, setup.kind)
            if nodes.top(tree) is None:
                return []
            title, used, out = passages.title_of(tree), {}, []
            found = pages.select(tree, settings, process.env) if settings else []
            if not found:
                return passages.rows(str(key), process.transform([tree]), options, None, title, used=used)
            rows = pages.metadata(found, settings, str(key))
            held = pages.anchors(found, [r["file"] for r in rows])
            for r, page in zip(rows, found, strict=True):
                out += passages.rows(str(key), process.transform([page]), options, r["page_id"], title, held, r["file"], used)
            return out
        return make

    return mapped(docs, start, PASSAGES, **names).drop("doc")


def facts(docs: DataFrame, rules: RuleSet, channel: str = "web", setup: Setup | None = None, **names: str) -> DataFrame:
    """What a coverage report counts, by document: records, suppressed ones, behaviours, rule hits, elements with their
    first place, elements without a rule, outermost elements that no record shows, and failed expressions."""
    setup = setup or Setup()

    def start():
        _, of = _facts_of(rules, channel, setup)
        return lambda key, value: of(nodes.read(value, setup.kind))

    return mapped(docs, start, FACTS, **names)


def counted(docs: DataFrame, rules: RuleSet, channel: str = "web", setup: Setup | None = None, **names: str) -> DataFrame:
    """``fact, key, detail, n``: the numbers that ``totals`` gives of facts. Each task adds up its own documents', and a shape that
    comes again (``shapes``) is worked out once."""
    setup, job = setup or Setup(), uuid.uuid4().hex

    def shaped() -> shapes.Filled:
        process, of = _facts_of(rules, channel, setup)
        return shapes.Filled(lambda raw, tree: [(r["fact"], r["key"], r["detail"], r["n"]) for r in of(tree)], 4, setup.kind == "xml" and shapes.blind_rules(process, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shapes.of_job(job, shaped)
        times: dict[shapes.Rows, int] = {}
        sums: dict[tuple, int] = {}

        def add(found: Iterable[tuple], n: int) -> None:
            for *key, own in found:
                sums[tuple(key)] = sums.get(tuple(key), 0) + n * own

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                shape, _ = known.shape(raw)
                if shape is not None and not shape.cells:
                    times[shape] = times.get(shape, 0) + 1
                else:
                    add(known.rows(raw, nodes.read(raw, setup.kind)), 1)
        for shape, n in times.items():
            add(zip(*shape.columns, strict=True), n)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*sums, strict=True), list(sums.values())], (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["fact", "key", "detail", "n"])

    own = docs.select(F.col(names.get("raw", "raw"))).mapInArrow(run, "fact string, key string, detail string, n long")
    return own.groupBy("fact", "key", "detail").agg(F.sum("n").alias("n"))


def _facts_of(rules: RuleSet, channel: str, setup: Setup) -> tuple[Process, Callable[[Node], list[dict]]]:
    """What ``facts`` makes of a tree, and the process that it is made by."""
    env = setup.env(rules.prefixes)
    process = Process(rules, "json" if channel == "web" else f"json-{channel}", env)

    def make(tree: Node) -> list[dict]:
        env.errors.clear()
        found = flat_records(process.transform([tree]))
        out: dict[tuple, list] = {}

        def add(fact: str, name: str, detail: str | None = None, first: str | None = None, at: int = 0) -> None:
            entry = out.setdefault((fact, name, detail), [0, first, at])
            entry[0] += 1

        shown = {r["node_id"] for r in found}
        closed = {r["node_id"] for r in found if r.get("suppressed")}
        for r in found:
            add("records", "all")
            if r.get("suppressed"):
                add("records", "suppressed")
            add("behaviour", r["behaviour"] or "unmatched")
            if r.get("model"):
                add("model", r["model"])
            if r["behaviour"] is None:
                add("unmatched", r["element"], None, r["xpath"], r["node_id"])

        def walk(n: Node, hidden: bool) -> None:
            for c in n.elements():
                add("element", c.tag, None, c.xpath, c.node_id)
                lost = c.node_id not in shown
                if lost and not hidden:
                    add("dropped", c.tag, None, c.xpath, c.node_id)
                walk(c, hidden or lost or c.node_id in closed)

        walk(tree, False)
        for e in xpath.error_log(env):
            out["error", e["expression"], e["reason"]] = [e["n"], e["first"], 0]
        return [{"fact": f, "key": k, "detail": d, "n": n, "first": first, "at": at} for (f, k, d), (n, first, at) in out.items()]

    return process, make


def totals(found: DataFrame) -> DataFrame:
    """Facts over all documents: ``fact, key, detail, n, documents, first``, the first place in the first document."""
    return found.groupBy("fact", "key", "detail").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("documents"), F.min_by(F.struct("doc_id", F.col("first").alias("xpath")), F.struct("doc_id", "at")).alias("first"))


def ranked(total: DataFrame, fact: str, limit: int | None = 20) -> DataFrame:
    """One kind of fact, most frequent first, then by name; a report shows 20."""
    out = total.where(F.col("fact") == fact).orderBy(F.desc("n"), "key")
    return out if limit is None else out.limit(limit)


def books(docs: DataFrame, rules: RuleSet, settings: pages.PageSettings | None = None, setup: Setup | None = None, styles: list[str] = (), **names: str) -> DataFrame:
    """``doc_id, epub``: a book of each document. Page selectors give way to divisions of depth 3; without any, the text,
    the book or the whole document is the one chapter."""
    setup = setup or Setup()
    settings = settings or pages.PageSettings("divisions", 3)
    if settings.selector == "pages":
        settings = pages.PageSettings("divisions", 3, settings.file_pattern)

    def start():
        process = Process(rules, "epub", setup.env(rules.prefixes), setup.order)

        def make(key, value):
            tree = nodes.read(value, setup.kind)
            whole = nodes.top(tree)
            if whole is None:
                return []
            found = pages.select(tree, settings, process.env) or [next((n for n in tree.walk() if n.kind == "e" and n.tag in ("text", "book")), whole)]
            chapters = []
            for page in found:
                pieces = process.pieces([page])
                chapters.append((page.id, packages.chapter_title(pieces, page), pieces))
            title = passages.title_of(tree) or str(key)
            return [{"epub": packages.epub(str(key), title, packages.people(tree), whole.get("xml:lang") or "en", chapters, [*styles, rules.stylesheet(), setup.css])}]
        return make

    return mapped(docs, start, _schema(epub=T.BinaryType()), **names)


def word_files(docs: DataFrame, rules: RuleSet, setup: Setup | None = None, styles: dict[str, str] | None = None, **names: str) -> DataFrame:
    """``doc_id, docx``: a Word document of each document."""
    setup = setup or Setup()

    def start():
        process = Process(rules, "docx", setup.env(rules.prefixes), setup.order)
        return lambda key, value: [{"docx": packages.docx(process.pieces([nodes.read(value, setup.kind)]), styles)}]

    return mapped(docs, start, _schema(docx=T.BinaryType()), **names)


def named(docs: DataFrame, source: str, setup: Setup | None = None, **names: str) -> DataFrame:
    """``doc_id, name``: names of documents by an expression, unsafe characters replaced. An empty or repeated name is an error."""
    setup = setup or Setup()

    def start():
        env = setup.env()

        def make(key, value):
            found = xpath.select_all(nodes.read(value, setup.kind), source, env)
            return [{"name": "".join("-" if c in '/\\:*?"<>|' or ord(c) < 32 else c for c in param_text(found))}]
        return make

    out = mapped(docs, start, _schema(name=_TEXT), **names)
    bad = out.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1 or name = ''").limit(1).collect()
    if bad:
        raise ValueError(f"document {bad[0]['doc_id']} has the name {bad[0]['name']!r}, which is empty or not its own")
    return out
