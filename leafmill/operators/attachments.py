"""Attachments: matching, classification, incremental analysis, text of SVGs, and enrichment of Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import asset_path, checksum, display_type, extension, is_drawio, join_lists, mime_type, no_blank, strip, truncate
from leafmill.operators.common import cut, distinct_ordered, first_n
from leafmill.operators.markup import attribute, texts_of, tokens

# The heading of inserted sections, texts for attachments without content, and known extensions.
NO_ERD = "Data Model Summary\n\nStructured ERD extraction is unavailable because no deterministic diagram metadata was found."
NO_CONTENT = "Searchable Content:\n\nNo visual content extracted because image analysis is disabled or unavailable."
# Fixed value: the heading that marks enriched pages.
ENRICHMENT_HEADING = "### Extracted Attachment Information"
KNOWN = ("drawio", "vsdx", "vsd", "svg", "pdf", "pptx", "ppt", "png", "jpg", "jpeg", "gif", "webp", "bmp")
DIAGRAM_EXTENSIONS = ("drawio", "xml")


def resolve_images(refs: DataFrame, attachments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): refs(page_id, name) with the first attachment (by ord) of their page and title, and those without one."""
    first = attachments.groupBy("page_id", "title").agg(F.min_by(F.struct(*[c for c in attachments.columns if c not in ("page_id", "title")]), "ord").alias("attachment")).withColumnRenamed("title", "name")
    return refs.join(first, ["page_id", "name"]), refs.join(first, ["page_id", "name"], "left_anti")


def resolve_diagrams(refs: DataFrame, attachments: DataFrame, allowed: tuple[str, ...] = DIAGRAM_EXTENSIONS) -> DataFrame:
    """refs(page_id, diagram_id, diagram_name, attachment_name, xml) with the content and source that come first: embedded XML, the named
    attachment, the diagram's name plus an allowed extension in that order. An attachment counts with an allowed extension and
    diagram content only."""
    usable = attachments.where(extension(F.col("title")).isin(list(allowed)) & is_drawio(F.col("content"))).select("page_id", F.col("title").alias("want"), F.col("content").alias("found"))
    names = F.array(F.struct(F.lit(1).alias("k"), F.col("attachment_name").alias("want")), *[F.struct(F.lit(2 + i).alias("k"), F.concat("diagram_name", F.lit(f".{e}")).alias("want")) for i, e in enumerate(allowed)])
    wanted = refs.select("page_id", "diagram_id", F.explode(names).alias("w")).select("page_id", "diagram_id", "w.k", "w.want").where("want is not null")
    by_name = wanted.join(usable, ["page_id", "want"]).select("page_id", "diagram_id", "k", F.col("found").alias("content"))
    own = refs.where("xml is not null").select("page_id", "diagram_id", F.lit(0).alias("k"), F.col("xml").alias("content"))
    best = own.unionAll(by_name).groupBy("page_id", "diagram_id").agg(F.min_by(F.struct("k", "content"), F.struct("k", "content")).alias("b"))
    source = F.when(F.col("b.k") == 0, "embedded").when(F.col("b.k") == 1, "named").when(F.col("b.k").isNotNull(), "guessed")
    return refs.join(best, ["page_id", "diagram_id"], "left").select("page_id", "diagram_id", source.alias("source"), F.col("b.content").alias("content"))


def with_asset_meta(files: DataFrame, assets: DataFrame) -> DataFrame:
    """files with the download facts of their page and name, the last (by ord) of several."""
    cols = [c for c in assets.columns if c not in ("page_id", "file_name", "ord")]
    last = assets.groupBy("page_id", "file_name").agg(F.max_by(F.struct(*cols), "ord").alias("m"))
    return files.join(last, ["page_id", "file_name"], "left").select(*files.columns, *[F.col("m")[c].alias(f"asset_{c}") for c in cols])


def asset_headings(lines: DataFrame) -> DataFrame:
    """(page_id, asset, heading_path): the heading at the first image link of each asset; lines(page_id, pos, line, heading_path)."""
    found = lines.select("page_id", "pos", "heading_path", F.explode(F.regexp_extract_all("line", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("a"))
    return found.withColumn("asset", asset_path(F.col("a"))).groupBy("page_id", "asset").agg(F.min_by("heading_path", "pos").alias("heading_path"))


def with_heading_path(attachments: DataFrame, headings: DataFrame) -> DataFrame:
    """attachments with heading_path by relative path, else by file name."""
    by = lambda name: headings.select("page_id", F.col("asset").alias(name), F.col("heading_path").alias(f"_{name}"))
    out = attachments.withColumn("p", asset_path(F.col("relative_path"))).join(by("p"), ["page_id", "p"], "left").withColumn("f", F.col("file_name")).join(by("f"), ["page_id", "f"], "left")
    return out.select(*attachments.columns, F.coalesce("_p", "_f").alias("heading_path"))


def size_guard(attachments: DataFrame, max_mb: int = 20, max_bytes: int | None = None) -> DataFrame:
    """attachments with skip_reason for contents of over max_mb MiB, or over max_bytes where that is given."""
    limit, named = (max_mb << 20, f"{max_mb} MB") if max_bytes is None else (max_bytes, f"{max_bytes} bytes")
    return attachments.withColumn("skip_reason", F.when(F.length("content") > limit, F.lit(f"File exceeds {named} limit")))


def classify(attachments: DataFrame, xml_diagrams: bool = False) -> DataFrame:
    """attachments(file_name, declared_mime, content) with mime_type, detected_type, detection_method and requires_vision.

    An extension that isn't known decides for OTHER; then diagram sources, drawings, SVG, PDF and presentations by extension, type or
    first bytes, then any image, else UNKNOWN. xml_diagrams: let .xml files with diagram content be diagrams.
    """
    ext, mime, text = F.col("_ext"), F.col("mime_type"), F.decode(F.substring("content", 1, 4096), "UTF-8")
    known = [*KNOWN, *(["xml"] if xml_diagrams else [])]
    rules = [
        ((ext != "") & ~ext.isin(known), "OTHER", "EXTENSION"),
        ((ext == "drawio") | ((ext == "xml") & is_drawio(text)) | (mime == "application/vnd.jgraph.mxfile"), "DRAWIO_SOURCE", "EXTENSION"),
        (ext.isin("vsdx", "vsd") | mime.contains("visio"), "VISIO_SOURCE", "EXTENSION"),
        ((ext == "svg") | (mime == "image/svg+xml"), "SVG_DIAGRAM", "EXTENSION"),
        (ext == "pdf", "PDF_DOCUMENT", "EXTENSION"),
        (mime == "application/pdf", "PDF_DOCUMENT", "MIME_TYPE"),
        (F.hex(F.substring("content", 1, 4)) == "25504446", "PDF_DOCUMENT", "MAGIC_BYTES"),
        (ext.isin("pptx", "ppt"), "PRESENTATION", "EXTENSION"),
        (mime.rlike("presentationml|ms-powerpoint"), "PRESENTATION", "MIME_TYPE"),
        (mime.startswith("image/"), "GENERIC_IMAGE", "MIME_TYPE"),
    ]
    kind, method = F.lit("UNKNOWN"), F.lit(None).cast("string")
    for cond, k, m in reversed(rules):
        hit = F.coalesce(cond, F.lit(False))
        kind, method = F.when(hit, k).otherwise(kind), F.when(hit, m).otherwise(method)
    out = attachments.withColumn("_ext", extension(F.col("file_name"))).withColumn("mime_type", mime_type(F.col("file_name"), F.col("declared_mime"), F.col("content")))
    out = out.withColumn("detected_type", kind).withColumn("detection_method", method)
    return out.withColumn("requires_vision", F.col("detected_type").isin("GENERIC_IMAGE", "UNKNOWN")).drop("_ext")


def extraction_status(skip_reason: Column, error: Column, summary: Column) -> Column:
    return F.when(skip_reason.isNotNull(), "SKIPPED").when(error.isNotNull(), "FAILED").when(no_blank(summary).isNotNull(), "SUCCESS").otherwise("PARTIAL")


def split_cached(files: DataFrame, previous: DataFrame, schema_version: int, vision_model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reused, to do): files(page_id, relative_path, content) of which previous has a result for the same path, checksum, schema version
    and, where it names one, vision model; reused rows are previous's with the method CACHED."""
    now = files.withColumn("checksum", checksum(F.col("content")))
    same = previous.where((F.col("schema_version") == schema_version) & (F.col("vision_model").isNull() | F.col("vision_model").eqNullSafe(F.lit(vision_model))))
    key = ["page_id", "relative_path", "checksum"]
    return same.join(now.select(*key), key, "left_semi").withColumn("detection_method", F.lit("CACHED")), now.join(same.select(*key), key, "left_anti")


def analyze_incremental(files: DataFrame, previous: DataFrame, analyze: Callable[[DataFrame], DataFrame], schema_version: int = 1) -> DataFrame:
    """The reused results and those of analyze on files that are new or changed."""
    reused, rest = split_cached(files, previous, schema_version)
    return reused.unionByName(analyze(rest), allowMissingColumns=True)


def svg_text(attachments: DataFrame, most: int = 8) -> DataFrame:
    """(page_id, title, description, ids, visible_text, summary) of SVGs attachments(page_id, html).

    An element's text is all that is below it. visible_text holds the texts of text elements, then of tspan elements, each once; the summary
    names the title, or the first `most` of them. Without a title or description these are null, without texts or ids the lists are.
    """
    toks = cut(tokens(attachments))
    flat = lambda text: strip(F.regexp_replace(text, "\n", " "))
    first = lambda tag, name: texts_of(toks, tag).groupBy("page_id").agg(F.min_by(strip(F.col("text")), "ix").alias(name))
    ids = distinct_ordered(toks.select("page_id", no_blank(strip(attribute(F.col("attrs"), "id"))).alias("t"), "ix").where("t is not null"), ["page_id", "t"], "ix")
    texts = [texts_of(toks, tag).select("page_id", flat(F.col("text")).alias("t"), F.struct(F.lit(k).alias("k"), "ix").alias("ix")) for k, tag in enumerate(("text", "tspan"))]
    shown = distinct_ordered(texts[0].unionByName(texts[1]).where("t <> ''"), ["page_id", "t"], "ix")
    listed = lambda df, name: df.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "t"))), lambda x: x["t"]).alias(name))
    out = attachments.select("page_id")
    for part in (first("title", "title"), first("desc", "description"), listed(ids, "ids"), listed(shown, "visible_text")):
        out = out.join(part, "page_id", "left")
    named = F.coalesce(no_blank(F.col("title")), no_blank(F.array_join(first_n(F.col("visible_text"), most), ", ")))
    return out.withColumn("summary", F.concat_ws(": ", F.lit("SVG diagram"), named))


METADATA = "title string, description string, ids array<string>, visible_text array<string>, labels array<string>, components array<string>, relationships array<string>, flow array<string>, diagram_type string, node_count bigint, edge_count bigint, label_count bigint, warnings array<string>"


def attachment_metadata(parts: DataFrame) -> DataFrame:
    """parts with the columns of METADATA gathered in one struct `metadata`; missing ones are null."""
    have = set(parts.columns)
    fields = [F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in METADATA.split(", "))]
    names = {c.split(" ", 1)[0] for c in METADATA.split(", ")}
    return parts.select(*[c for c in parts.columns if c not in names], F.struct(*fields).alias("metadata"))


def match_links(lines: DataFrame, attachments: DataFrame) -> DataFrame:
    """(page_id, pos, k, relative_path): attachments that a line links as images, each once a line in the order of its links. A link
    meets an attachment by path, else by file name, else by path without 'assets/'."""
    links = lines.select("page_id", "pos", F.posexplode(F.regexp_extract_all("line", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("k", "link")).withColumn("path", asset_path(F.col("link")))
    keys = attachments.select("page_id", "relative_path", asset_path(F.col("relative_path")).alias("key"), F.lit(0).alias("by")).unionAll(attachments.select("page_id", "relative_path", asset_path(F.col("file_name")), F.lit(1))).where("key is not null and key <> ''")
    best = keys.groupBy("page_id", "key").agg(F.min_by("relative_path", F.struct("by", "relative_path")).alias("relative_path"))
    tries = links.select("page_id", "pos", "k", F.posexplode(F.array_compact(F.array(F.col("path"), F.when(F.col("path").startswith("assets/"), F.expr("substring(path, 8)"))))).alias("t", "key"))
    found = tries.join(best, ["page_id", "key"]).groupBy("page_id", "pos", "k").agg(F.min_by("relative_path", "t").alias("relative_path"))
    return found.groupBy("page_id", "pos", "relative_path").agg(F.min("k").alias("k"))


def _section(title: str, body: Column) -> Column:
    return F.when(no_blank(body).isNotNull(), F.concat(F.lit(f"{title}:\n\n"), strip(body)))


def render_attachment(attachments: DataFrame, diagrams: DataFrame | None = None) -> DataFrame:
    """(page_id, relative_path, section): an attachment's facts as Markdown.

    attachments(page_id, relative_path, file_name, detected_type, summary, labels, components, relationships), and of title, description,
    visible_text, flow and warnings those that there are. diagrams(relative_path, sections): ready sections of diagram attachments.
    """
    have = set(attachments.columns)
    bullets = lambda c, n: F.array_join(F.transform(F.slice(F.filter(c, lambda s: s.rlike(r"\S")), 1, n), lambda s: F.concat(F.lit("- "), s)), "\n")
    is_diagram = F.col("detected_type").rlike("DIAGRAM|DRAWIO|FLOWCHART")
    rows = attachments.withColumn("sections", F.lit(None).cast("string")) if diagrams is None else attachments.join(diagrams, "relative_path", "left")
    has = no_blank(F.col("summary")).isNotNull() | F.col("sections").isNotNull() | join_lists(F.col("labels"), F.col("components"), F.col("relationships")).isNotNull()
    is_erd = (F.col("detected_type") == "GENERIC_IMAGE") & F.lower("file_name").rlike("erd|er-diagram|schema|database")
    head = F.concat_ws("\n", F.concat(F.lit("File: "), F.col("file_name")), F.concat(F.lit("Attachment Type: "), display_type(F.col("detected_type"))))
    diagram = F.concat_ws("\n\n", _section("Diagram Summary", F.col("summary")), _section("Key Labels", bullets("labels", 20)), _section("Components", bullets("components", 40)), _section("Relationships", bullets("relationships", 40)))
    text = [_section(t, F.col(c)) for t, c in (("Title", "title"), ("Description", "description")) if c in have]
    lists = [("Extracted Text", "visible_text"), ("Labels", "labels"), ("Components", "components"), ("Relationships", "relationships"), ("Flow", "flow"), ("Warnings", "warnings")]
    plain = F.concat_ws("\n\n", _section("Summary", F.col("summary")), *text, *[_section(t, bullets(c, 200)) for t, c in lists if c in have])
    missing = F.when(is_erd, F.lit(NO_ERD)).otherwise(F.lit(NO_CONTENT))
    body = F.when(has, F.when(is_diagram, F.coalesce("sections", diagram)).otherwise(plain)).otherwise(missing)
    return rows.select("page_id", "relative_path", F.concat_ws("\n\n", F.lit(ENRICHMENT_HEADING), head, body, F.lit("---")).alias("section"))


def enrich_markdown(md: DataFrame, attachments: DataFrame, diagrams: DataFrame | None = None) -> DataFrame:
    """(page_id, md, enriched): after each line that links attachments as images, their sections; pages without any stay as they are."""
    lines = md.select("page_id", F.posexplode(F.split("md", "\n")).alias("pos", "line"))
    sections = match_links(lines, attachments).join(render_attachment(attachments, diagrams), ["page_id", "relative_path"])
    added = sections.groupBy("page_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "section"))), lambda x: F.concat(F.lit("\n\n"), x["section"])), "").alias("added"))
    rows = lines.join(added, ["page_id", "pos"], "left").withColumn("line", F.concat("line", F.coalesce("added", F.lit(""))))
    body = rows.groupBy("page_id").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("new"), F.bool_or(F.col("added").isNotNull()).alias("enriched"))
    return md.join(body, "page_id").select("page_id", F.when(F.col("enriched"), F.col("new")).otherwise(F.col("md")).alias("md"), "enriched")


def analysis_error(error: Column) -> Column:
    return truncate(error, 500)
