"""Heading-scoped chunks of Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import join_lists, named, no_blank, strip
from leafmill.operators.attachments import ENRICHMENT_HEADING

MAX_CHARACTERS = 4000
# Attachment types that get chunks for their parts too.
DIAGRAMS = ("DRAWIO_DIAGRAM", "DRAWIO_SOURCE", "STATE_DIAGRAM", "CLASS_DIAGRAM", "ER_DIAGRAM", "GENERIC_DIAGRAM", "ARCHITECTURE_DIAGRAM", "FLOWCHART", "SEQUENCE_DIAGRAM", "SVG_DIAGRAM", "VISIO_DIAGRAM")


def lines(md: DataFrame) -> DataFrame:
    """(page_id, pos, line, level, title): level 1-6 and title for headings, else null."""
    rows = md.select("page_id", F.posexplode(F.split("md", "\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1)
    title = strip(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2))
    is_heading = marks != ""
    return rows.select("page_id", "pos", "line", F.when(is_heading, F.length(marks)).alias("level"), F.when(is_heading, title).alias("title"))


def heading_paths(rows: DataFrame) -> DataFrame:
    """rows of lines() with section (number of headings so far) and heading_path, the titles that hold at the line, joined by ' > '."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("section", F.count("level").over(w))
    last = [F.last(F.when(F.col("level") == n, F.struct("pos", "title")), ignorenulls=True).over(w).alias(f"h{n}") for n in range(1, 7)]
    out = out.select("*", *last)
    titles = []
    for n in range(1, 7):
        above = [F.coalesce(F.col(f"h{n}.pos") > F.col(f"h{m}.pos"), F.lit(True)) for m in range(1, n)]
        titles.append(F.when(reduce(lambda a, b: a & b, above, F.lit(True)), no_blank(F.col(f"h{n}.title"))))
    return out.select(*rows.columns, "section", F.array_join(F.filter(F.array(*titles), lambda t: t.isNotNull()), " > ").alias("heading_path"))


def _sections() -> Column:
    """array<struct<section, heading_path, body>> of the column md: the stretches between headings that aren't blank.

    A page stays in its row, so that its text is shuffled nowhere.
    """
    lines_, mark = F.split("md", "\n"), r"^(#{1,6})\s+(.+)$"
    heading = lambda line, i: F.when(line.startswith("#") & line.rlike(mark), F.struct(i.alias("pos"), F.length(F.regexp_extract(line, mark, 1)).alias("level"), strip(F.regexp_extract(line, mark, 2)).alias("title")))
    headings = lambda ls: F.filter(F.transform(ls, heading), lambda h: h.isNotNull())

    def holding(state: Column, h: Column) -> Column:
        """The titles of levels 1 to 6 that hold from a heading on, and the paths so far."""
        held = F.transform(state["held"], lambda t, i: F.when(i < h["level"] - 1, t).when(i == h["level"] - 1, no_blank(h["title"])))
        return named(held, lambda t: F.struct(t.alias("held"), F.concat(state["paths"], F.array(F.array_join(t, " > "))).alias("paths")))

    def parts(ls: Column, hs: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(None).cast("string"), 6).alias("held"), F.array(F.lit("")).alias("paths"))
        paths = F.aggregate(hs, start, holding, lambda s: s["paths"])
        begins = F.concat(F.array(F.lit(0)), F.transform(hs, lambda h: h["pos"] + 1))
        ends = F.concat(F.transform(hs, lambda h: h["pos"]), F.array(F.size(ls)))
        body = lambda z, i: F.struct(i.cast("long").alias("section"), z["path"].alias("heading_path"), strip(F.array_join(F.slice(ls, z["from"] + 1, z["to"] - z["from"]), "\n")).alias("body"))
        return F.filter(F.transform(F.arrays_zip(paths.alias("path"), begins.alias("from"), ends.alias("to")), body), lambda s: s["body"] != "")

    return named(lines_, lambda ls: named(headings(ls), lambda hs: parts(ls, hs)))


def sections(md: DataFrame) -> DataFrame:
    """(page_id, section, heading_path, body) for each stretch between headings that isn't blank."""
    return md.where("md is not null").select("page_id", F.inline(_sections()))


def pack(body: Column, most: int = MAX_CHARACTERS) -> Column:
    """array<string>: the body's paragraphs packed greedily to at most `most` characters; longer paragraphs are sliced, and what follows a
    slice begins a new part."""
    paragraphs = F.filter(F.transform(F.split(body, "\n\n"), strip), lambda p: p != "")

    def slices(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most)), lambda i: strip(F.substring(p, (i * most + 1).cast("int"), F.lit(most))))

    def add(state: Column, p: Column) -> Column:
        parts, open_ = state["parts"], state["open"]
        closed = F.when(open_ == "", parts).otherwise(F.concat(parts, F.array(open_)))
        return (
            F.when((open_ != "") & (F.length(open_) + 2 + F.length(p) <= most), F.struct(parts.alias("parts"), F.concat(open_, F.lit("\n\n"), p).alias("open")))
            .when(F.length(p) <= most, F.struct(closed.alias("parts"), p.alias("open")))
            .otherwise(F.struct(F.concat(closed, slices(p)).alias("parts"), F.lit("").alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("open"))
    folded = F.aggregate(paragraphs, start, add, lambda s: F.when(s["open"] == "", s["parts"]).otherwise(F.concat(s["parts"], F.array(s["open"]))))
    return F.when(F.length(body) <= most, F.array(body)).otherwise(folded)


def chunk_pages(md: DataFrame, most: int = MAX_CHARACTERS) -> DataFrame:
    """(chunk_id, page_id, heading_path, chunk_index, text): chunks of md(page_id, md), numbered from 0 in page order."""
    parts = F.flatten(F.transform(_sections(), lambda s: F.transform(pack(s["body"], most), lambda t: F.struct(s["heading_path"].alias("heading_path"), t.alias("text")))))
    rows = md.where("md is not null").select("page_id", F.posexplode(parts).alias("chunk_index", "c"))
    return rows.select(F.concat_ws("-", "page_id", "chunk_index").alias("chunk_id"), "page_id", "c.heading_path", "chunk_index", "c.text")


def chunk_metadata(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """(page_id, title, web_url, space_key, version): the page document's where there is one, else the manifest's with version 0."""
    doc = documents.select("page_id", F.struct("title", "web_url", "space_key", "version").alias("d"))
    has = F.col("d").isNotNull()
    pick = lambda c: no_blank(F.when(has, F.col("d")[c]).otherwise(F.col(c)))
    out = manifest.select("page_id", "title", "web_url").join(doc, "page_id", "left")
    return out.select("page_id", pick("title").alias("title"), pick("web_url").alias("web_url"), F.when(has, no_blank(F.col("d.space_key"))).alias("space_key"), F.when(has, F.coalesce("d.version", F.lit(0))).otherwise(F.lit(0)).alias("version"))


def attachment_counts(pages: DataFrame, attachments: DataFrame) -> DataFrame:
    """pages with attachment_count, null for pages without an attachment list."""
    return pages.join(attachments.groupBy("page_id").agg(F.count("relative_path").alias("attachment_count")), "page_id", "left")


def image_chunks(attachments: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Chunks of attachments(page_id, ord, relative_path, heading_path, detected_type, status, summary, components, labels,
    relationships, user_actions, flow): one for each with a summary that isn't skipped, and for diagrams one per kind of content that
    they have. Numbers go on from start(page_id, start_ix)."""
    usable = attachments.where((F.col("status") != "SKIPPED") & F.col("summary").rlike(r"\S"))
    is_diagram = F.col("detected_type").isin(list(DIAGRAMS))
    texts = [(None, F.col("summary"), F.lit(True)), ("SUMMARY", F.col("summary"), is_diagram), ("COMPONENTS", join_lists(F.col("components"), F.col("labels")), is_diagram), ("RELATIONSHIPS", join_lists(F.col("relationships")), is_diagram), ("FLOW", join_lists(F.col("user_actions"), F.col("flow")), is_diagram)]
    kinds = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(kind).cast("string").alias("semantic_type"), F.when(on, text).alias("text")) for i, (kind, text, on) in enumerate(texts)])
    rows = usable.select("page_id", "ord", "relative_path", "heading_path", "detected_type", F.explode(F.filter(kinds, lambda x: x["text"].rlike(r"\S"))).alias("c"))
    if start is not None:
        rows = rows.join(start, "page_id", "left")
    first = F.coalesce("start_ix", F.lit(0)) if start is not None else F.lit(0)
    ix = (F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "c.k")) - 1 + first).cast("int")
    rows = rows.withColumn("chunk_index", ix)
    name = F.concat(F.col("page_id").cast("string"), F.lit("-img-"), F.col("chunk_index").cast("string"), F.coalesce(F.concat(F.lit("-"), F.col("c.semantic_type")), F.lit("")))
    return rows.select(name.alias("chunk_id"), "page_id", "heading_path", "chunk_index", F.col("c.text").alias("text"), F.lit("IMAGE").alias("chunk_type"), F.col("c.semantic_type").alias("semantic_type"), F.col("detected_type").alias("asset_type"), F.col("relative_path").alias("asset_path"))


def all_chunks(md_chunks: DataFrame, img_chunks: DataFrame, md: DataFrame) -> DataFrame:
    """Markdown chunks and image chunks; pages of md(page_id, md) whose text holds their attachments already get no image chunks."""
    enriched = md.where(F.col("md").contains(ENRICHMENT_HEADING)).select("page_id")
    return md_chunks.unionByName(img_chunks.join(enriched, "page_id", "left_anti"), allowMissingColumns=True)
