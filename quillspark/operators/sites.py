"""Sites made of pages: files, manifests, parts, collection indexes, links over several runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.session import shared_table


def settled_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that several reports read one result."""
    return shared_table(df, name)


def manifest(pages: DataFrame) -> DataFrame:
    """``doc_id, pages, anchors``: what a run made of each document, pages in order, and the file of each id (first page wins)."""
    names = ["page_no", "page_id", "file", "xml_id", "xpath", "prev", "next", "title"]
    # Pages are rendered where they are read, so they are read once: the anchors travel with their page.
    found = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names, F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors")))).alias("all_"))
    held = F.flatten(F.transform("all_", lambda p: F.transform(p["anchors"], lambda a: F.struct(a.alias("anchor"), p["page_no"].alias("page_no"), p["file"].alias("file")))))
    found = found.select("doc_id", F.transform("all_", lambda p: F.struct(*[p[n].alias(n) for n in names])).alias("pages"), F.array_sort(held).alias("held_"))
    first = F.filter("held_", lambda h, k: (k == 0) | (h["anchor"] != F.get("held_", k - 1)["anchor"]))
    anchors = F.map_from_entries(F.transform(first, lambda h: F.struct(h["anchor"].alias("anchor"), h["file"].alias("file"))))
    return found.select("doc_id", "pages", F.when(F.size("held_") > 0, anchors).alias("anchors"))


def merged_pages(runs: list[DataFrame]) -> DataFrame:
    """Pages of several runs over the same documents, appended in the order of the runs and numbered anew."""
    both = None
    for k, r in enumerate(runs):
        r = r.withColumn("run", F.lit(k))
        both = r if both is None else both.unionByName(r)
    w = Window.partitionBy("doc_id").orderBy("run", "page_no")
    return both.withColumn("page_no", F.row_number().over(w))


def merged(runs: list[DataFrame], key: list[str], keep: str = "first") -> DataFrame:
    """Rows of several runs by key: of fragments the first run's stays, of anchors the last run's."""
    both = None
    for k, r in enumerate(runs):
        r = r.withColumn("run", F.lit(k))
        both = r if both is None else both.unionByName(r)
    order = F.col("run") if keep == "first" else F.desc("run")
    return both.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("k = 1").drop("k", "run")


def collection_index(manifests: DataFrame) -> DataFrame:
    """One entry for each document: title of its first page, that page, number of pages."""
    first = F.try_element_at("pages", F.lit(1))
    return manifests.select("doc_id", F.coalesce(first["title"], text.humanise(F.col("doc_id"))).alias("title"), F.concat_ws("/", "doc_id", first["file"]).alias("href"), F.size("pages").alias("n_pages"))


def part_key(parameters: Column) -> Column:
    """The key of a part of a page by its parameters."""
    return text.parameter_key(parameters)


def parts(pages: DataFrame) -> DataFrame:
    """Parts for viewers that load them one by one: ``doc_id, key, file, content``, for each page and each fragment.

    ``content`` is JSON with the output and the ids of the neighbouring parts.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    # Pages are rendered where they are read, so they are read once: a page gives its own part, without a name, and its fragments.
    part = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    own = F.array(part(F.lit(None).cast("string"), F.col("output")))
    made = F.when(F.col("fragments").isNull(), own).otherwise(F.concat(own, F.transform(F.map_entries("fragments"), lambda e: part(e["key"], e["value"]))))
    rows = pages.select("doc_id", "xml_id", "file", "prev", "next", F.inline(made))
    whole = F.col("name").isNull()
    key = lambda what, value: part_key(F.create_map(F.lit("id"), F.col("xml_id"), F.lit(what), value))
    return rows.select(
        "doc_id", F.when(whole, key("view", F.lit("page"))).otherwise(key("part", F.col("name"))).alias("key"),
        F.concat(stem(F.col("file")), F.when(whole, "").otherwise(F.concat(F.lit("-"), text.file_stem(F.col("name")))), F.lit(".json")).alias("file"),
        F.to_json(F.struct(F.col("value").alias("content"), F.when(whole, F.col("prev")).alias("previousId"), F.when(whole, F.col("next")).alias("nextId"))).alias("content"),
    )


def write_files(rows: DataFrame, folder: str) -> int:
    """Write ``path, content`` rows as files below a folder of any file system that Spark reaches; returns their number.

    Each task writes its own rows; a file is complete or absent, since it is renamed into place.
    """
    spark = rows.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    local = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"
    root = place.toUri().getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs

        system = fs.LocalFileSystem() if local else fs.FileSystem.from_uri(folder)[0]
        base = root if local else fs.FileSystem.from_uri(folder)[1]
        n = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} would lie outside the folder")
                target = f"{base.rstrip('/')}/{path}"
                system.create_dir(os.path.dirname(target), recursive=True)
                beside = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as f:
                    f.write(content if isinstance(content, bytes) else content.encode())
                system.move(beside, target)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_pages(pages: DataFrame, folder: str, template: str | None = None) -> int:
    """Pages as ``<document>/<file>``, their parts, a manifest for each document and the collection's index."""
    before, _, after = (template or "$content").partition("$content")
    stem = text.file_stem(F.col("doc_id"))
    at = lambda name: F.concat(stem, F.lit("/"), name)
    files = pages.select(at(F.col("file")).alias("path"), F.concat(F.lit(before), "output", F.lit(after)).alias("content"))
    made = manifest(pages)
    files = files.unionByName(parts(pages).select(at(F.concat(F.lit("parts/"), "file")).alias("path"), "content"))
    files = files.unionByName(made.select(at(F.lit("manifest.json")).alias("path"), F.to_json(F.struct("pages", "anchors"), {"ignoreNullFields": "false"}).alias("content")))
    index = collection_index(made).agg(F.to_json(F.array_sort(F.collect_list(F.struct("title", "doc_id", "href", "n_pages")))).alias("content")).select(F.lit("index.json").alias("path"), F.coalesce("content", F.lit("[]")).alias("content"))
    return write_files(files.unionByName(index), folder)


def page_links(records: DataFrame, anchors: DataFrame, partitions: int | None = None) -> DataFrame:
    """``href`` of index records ``doc_id, xml_id, entry, file``: the page that holds their id, else that of the id they were
    entered by, else their own page. ``partitions`` (``documents.spread``) holds for each shuffle, so that what a task sorts does not grow."""
    dealt = lambda df, name: df if partitions is None else df.repartition(partitions, "doc_id", name)
    by = lambda name: dealt(anchors, "anchor").select("doc_id", F.col("anchor").alias(name), F.col("file").alias(f"{name}_file"))
    met = dealt(records, "xml_id").join(by("xml_id"), ["doc_id", "xml_id"], "left")
    met = dealt(met, "entry").join(by("entry"), ["doc_id", "entry"], "left")
    link = lambda name: F.concat(f"{name}_file", F.lit("#"), name)
    return met.withColumn("href", F.coalesce(link("xml_id"), link("entry"), "file")).drop("xml_id_file", "entry_file")


def zipped(fragments: DataFrame, pages: DataFrame) -> DataFrame:
    """Fragments and pages of a document by place, where they are equally many: ``doc_id, place, fragment, page``."""
    number = lambda df, c, name: df.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(c)).alias("place"), F.col(c).alias(name), F.count("*").over(Window.partitionBy("doc_id")).alias(f"n_{name}"))
    met = number(fragments, "fragment_no", "fragment").join(number(pages, "page_no", "page"), ["doc_id", "place"])
    return met.where("n_fragment = n_page").drop("n_fragment", "n_page")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests below a folder, by document in order: ``doc_id, pages, anchors``; unreadable ones are skipped."""
    schema = "pages array<struct<page_no:int,page_id:string,file:string,xml_id:string,xpath:string,prev:string,next:string,title:string>>, anchors map<string,string>"
    files = spark.read.text(f"{folder.rstrip('/')}/*/manifest.json", wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("m"))
    name = F.element_at(F.split("path", "/"), -2)
    return files.where("m.pages is not null").select(F.call_function("url_decode", name).alias("doc_id"), "m.pages", "m.anchors").orderBy("doc_id")


def index_page(index: DataFrame, template: str | None = None) -> DataFrame:
    """The collection's index as a web page: ``path, content``, one entry for each document."""
    entry = F.concat(F.lit('<li><a href="'), "href", F.lit('">'), F.col("title"), F.lit("</a> ("), F.col("n_pages").cast("string"), F.lit(")</li>"))
    before, _, after = (template or "<html><body>$content</body></html>").partition("$content")
    rows = index.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "doc_id", entry.alias("e")))), lambda x: x["e"]), "").alias("items"))
    return rows.select(F.lit("index.html").alias("path"), F.concat(F.lit(f"{before}<ul>"), "items", F.lit(f"</ul>{after}")).alias("content"))


def pictures(pages: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, image, path, content``: pictures that pages show, from beside their document, else from ``images/`` there.

    ``docs`` has ``doc_id, source``; ``folder`` is where the documents lie. Only local relative addresses count; missing
    pictures give no row. Wanted files are joined by path, and contents are read for these only.
    """
    spark = pages.sparkSession
    home = F.regexp_replace("source", r"/[^/]*$", "")
    shown = pages.select("doc_id", F.explode("images").alias("image")).distinct().join(docs.select("doc_id", home.alias("home")), "doc_id")
    places = shown.select("doc_id", "image", F.posexplode(F.array(F.concat_ws("/", "home", "image"), F.concat_ws("/", "home", F.lit("images"), "image"))).alias("rank", "file"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,svg,webp,PNG,JPG,JPEG,GIF,SVG}").load(folder)
    met = places.join(files.select(F.col("path").alias("file"), "content"), "file")
    first = Window.partitionBy("doc_id", "image").orderBy("rank")
    return met.withColumn("k", F.row_number().over(first)).where("k = 1").select("doc_id", "image", F.concat_ws("/", text.file_stem(F.col("doc_id")), "image").alias("path"), "content")


def search_names(pages: DataFrame) -> DataFrame:
    """``path, content``: one JSON document of names and the pages that hold them, for a site's search."""
    held = pages.select(F.explode("anchors").alias("name"), F.concat_ws("/", "doc_id", "file").alias("page")).groupBy("name").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return held.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "pages"))))).alias("content")).select(F.lit("idents.json").alias("path"), F.coalesce("content", F.lit("{}")).alias("content"))
