"""Column functions: names, paths, labels, markup text and metadata values. Every function takes and returns Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an extension or the first bytes of a file stand for.
MIME_BY_EXTENSION = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "svg": "image/svg+xml", "drawio": "application/vnd.jgraph.mxfile", "vsdx": "application/vnd.ms-visio.drawing",
    "vsd": "application/vnd.visio", "pdf": "application/pdf",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
MAGIC = (("89504E47", "image/png"), ("FFD8", "image/jpeg"), ("474946", "image/gif"), ("25504446", "application/pdf"), ("504B0304", "application/zip"))

# Labels of an image model and the types they stand for.
VISION_TYPES = {
    "ui_screenshot": "UI_SCREENSHOT", "architecture_diagram": "ARCHITECTURE_DIAGRAM", "state_diagram": "STATE_DIAGRAM",
    "class_diagram": "CLASS_DIAGRAM", "er_diagram": "ER_DIAGRAM", "generic_diagram": "GENERIC_DIAGRAM", "flowchart": "FLOWCHART",
    "sequence_diagram": "SEQUENCE_DIAGRAM", "table": "TABLE_IMAGE", "photo": "PHOTO", "generic_image": "GENERIC_IMAGE", "other": "OTHER",
}


# Patterns of labels in diagrams.
RAW_ID = r"^[0-9a-fA-F-]{6,}$"
MULTIPLICITY = r"^(0\.\.1|0\.\.\*|1\.\.\*|1|\*|many|one)$"
ATTRIBUTE_TYPED_AFTER = r"^[-+#~]?\s*([A-Z][A-Za-z0-9_<>?, ]+\s+)?[a-z][A-Za-z0-9_]*\s*:\s*[A-Z][A-Za-z0-9_<>?, ]+$"
ATTRIBUTE_TYPED_BEFORE = r"^[-+#~]?\s*([A-Z][A-Za-z0-9_<>?, ]*|(Collection|List|Set|Map)<[^>]+>)\s+[a-z][A-Za-z0-9_]*$"
COLUMN_ONLY = r" pk| fk|primary key|foreign key|\b(id|uuid|created_at|updated_at)\b"
DIAGRAM_MARK = r"(?i)<mx(file|GraphModel)\b"


def strip(x: Column) -> Column:
    """x without blanks at its ends; not only spaces."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))  # a pattern would be tried at each blank of a long text


def named(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once, however often it is used."""
    return F.get(F.transform(F.array(x), use), 0)


def lower(x: Column) -> Column:
    """x in lower case; short names that are so already, as most tags, aren't given to Unicode's rules."""
    return F.when(x.rlike(r"[^a-z0-9:/<>_-]"), F.lower(x)).otherwise(x)


def no_blank(x: Column) -> Column:
    """x, or null where it is blank."""
    return F.when(x.rlike(r"\S"), x)


def _first(x: Column, pattern: str) -> Column:
    found = F.regexp_extract(x, pattern, 1)
    return F.when(found != "", found)


def page_id_of(target: Column) -> Column:
    """The page id in a target: all digits, ?pageId=n, or /pages/n."""
    t = strip(target)
    return F.coalesce(_first(t, r"^(\d+)$"), _first(t, r"[?&]pageId=(\d+)"), _first(t, r"/pages/(\d+)"))


def is_space_key(target: Column) -> Column:
    return strip(target).rlike(r"^[A-Za-z][A-Za-z0-9_~.-]*$")


def web_url(base: Column, path: Column, page_id: Column) -> Column:
    """path made absolute with base; without a path the page's view address."""
    root = F.regexp_replace(base, "/+$", "")
    absolute = F.when(path.rlike("(?i)^https?://"), path).when(path.startswith("/"), F.concat(root, path)).otherwise(F.concat(root, F.lit("/"), path))
    return F.when(path.rlike(r"\S"), absolute).otherwise(F.concat(root, F.lit("/pages/viewpage.action?pageId="), page_id.cast("string")))


def safe_name(name: Column) -> Column:
    """A file name without characters that file systems refuse; 'attachment' for blank ones."""
    return F.coalesce(no_blank(strip(F.regexp_replace(name, r'[<>:"/\\|?*\x00]', "_"))), F.lit("attachment"))


def extension(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1), F.lit(""))


def src_name(src: Column) -> Column:
    """The attachment's name in an image address."""
    path = F.regexp_extract(src, r"/attachments/[^/]+/[^/]+/([^/?#]+)", 1)
    last = F.regexp_extract(src, r"([^/]*)$", 1)
    name = F.when(path != "", path).otherwise(last)
    return no_blank(F.replace(F.replace(name, F.lit("%20"), F.lit(" ")), F.lit("%2F"), F.lit("/")))


def asset_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(path), r"\\", "/"), r"^(\./)+", "")


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def escape_cell(text: Column) -> Column:
    return strip(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\n", " "))


def span(attr: Column) -> Column:
    """A row or column span: 1 where it is missing or not a number, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(strip(attr).try_cast("int"), F.lit(1)))


def _char(code: Column) -> Column:
    """The character of a code point as UTF-8 bytes; null outside of 1 ... 10FFFF and for surrogates."""
    tail = lambda shift: F.lit(128) + F.shiftright(code, shift).bitwiseAND(F.lit(63))
    hexed = lambda *b: F.concat(*[F.lpad(F.hex(x), 2, "0") for x in b])
    head = lambda base, shift: F.lit(base) + F.shiftright(code, shift)
    data = F.when(code < 128, hexed(code)).when(code < 2048, hexed(head(192, 6), tail(0))).when(code < 65536, hexed(head(224, 12), tail(6), tail(0))).otherwise(hexed(head(240, 18), tail(12), tail(6), tail(0)))
    return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(data), "UTF-8"))


def decode_entities(x: Column) -> Column:
    """Named entities of the formats and numeric ones (&#8211; &#x2013;) as characters; others stay."""
    number = r"&#(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});"
    code = lambda e: F.coalesce(F.conv(F.regexp_extract(e, "&#[xX]([0-9a-fA-F]+);", 1), 16, 10).try_cast("int"), F.regexp_extract(e, r"&#(\d+);", 1).try_cast("int"))
    # Each text between two numbers, followed by the number after it.
    parts = F.split(x, number)
    found = F.concat(F.transform(F.regexp_extract_all(x, F.lit(number), F.lit(0)), lambda e: F.coalesce(_char(code(e)), e)), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(parts, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = F.when(x.rlike(number), joined).otherwise(x)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(x.contains("&"), out).otherwise(x)  # most texts hold none


# Tags that part words; the text beside any other tag runs on.
_BLOCK_TAGS = "br|hr|p|div|ul|ol|li|dl|dt|dd|table|caption|thead|tbody|tfoot|tr|td|th|h[1-6]|pre|blockquote|section|article|header|footer|center"


def clean_label(value: Column) -> Column:
    """A diagram label as plain text: entities decoded and line ends, with blanks beside them, made a blank each. Where it holds markup, tags are dropped and blanks squeezed;
    otherwise runs of blanks stay, since they part a class's members."""
    text = decode_entities(F.coalesce(value, F.lit("")))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(name), F.lit(char))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, f"(?i)</?(?:{_BLOCK_TAGS})\\b[^>]*>", " "), "(?s)<!--.*?-->|</?[A-Za-z][^>]*>", "")
    return named(text, lambda t: strip(F.when(t.contains("<"), F.regexp_replace(named(bare(t), decode_entities), r"\s+", " ")).otherwise(F.regexp_replace(t, r"\s*\n\s*", " "))))


def display_type(kind: Column) -> Column:
    return F.initcap(F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))


def truncate(text: Column, n: int) -> Column:
    """At most n characters and '...' where more were cut; '' for null."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def score_of(score: Column, distance: Column) -> Column:
    return F.coalesce(score, F.when(distance.isNotNull(), F.greatest(F.lit(0.0), 1 - distance)))


def meta_string(value: Column, fallback: Column) -> Column:
    return F.coalesce(no_blank(value), fallback)


def meta_int(value: Column) -> Column:
    return strip(value.cast("string")).try_cast("int")


def meta_double(value: Column) -> Column:
    return strip(value.cast("string")).try_cast("double")


def hit_title(title: Column, path: Column) -> Column:
    name = F.coalesce(title, F.lit("Untitled"))
    return F.when(path.rlike(r"\S"), F.concat(name, F.lit(" › "), path)).otherwise(name)


def join_lists(*lists: Column) -> Column:
    """The items of the lists joined by '; ', blank ones dropped; null where none is left."""
    items = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    joined = F.array_join(F.transform(F.filter(items, lambda s: s.rlike(r"\S")), strip), "; ")
    return F.when(joined != "", joined)


def is_meaningful(label: Column) -> Column:
    return F.coalesce(label.rlike(r"\S") & ~label.rlike(RAW_ID), F.lit(False))


def is_multiplicity(label: Column) -> Column:
    return F.coalesce(strip(label).rlike(MULTIPLICITY), F.lit(False))


def is_attribute(label: Column) -> Column:
    return F.coalesce(strip(label).rlike(ATTRIBUTE_TYPED_AFTER) | strip(label).rlike(ATTRIBUTE_TYPED_BEFORE), F.lit(False))


def is_class_member(label: Column) -> Column:
    return is_attribute(label) | F.coalesce(label.contains("(") & label.contains(")"), F.lit(False))


def is_raw_id(label: Column) -> Column:
    return F.coalesce(label.rlike(RAW_ID), F.lit(False))


def is_column_only(label: Column) -> Column:
    return F.coalesce(F.lower(label).rlike(COLUMN_ONLY), F.lit(False))


def mime_by_extension(name: Column) -> Column:
    ext = extension(name)
    out = F.lit(None).cast("string")
    for e, mime in MIME_BY_EXTENSION.items():
        out = F.when(ext == e, F.lit(mime)).otherwise(out)
    return out


def mime_by_magic(content: Column) -> Column:
    """Type by the first bytes of binary content; null for less than 4 bytes."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("image/webp"))
    for start, mime in MAGIC:
        out = out.when(head.startswith(start), F.lit(mime))
    return F.when(F.length(content) >= 4, out)


def mime_type(name: Column, declared: Column, content: Column) -> Column:
    return F.coalesce(no_blank(declared), mime_by_extension(name), mime_by_magic(content))


def is_drawio(text: Column) -> Column:
    return F.coalesce(text.rlike(DIAGRAM_MARK), F.lit(False))


def placeholder(kind: str, ident: Column) -> Column:
    """kind: table, diagram, unavailable or image."""
    form = {"table": "[TABLE:%1$s](assets/tables/%1$s.json)", "diagram": "[DIAGRAM:%1$s](assets/diagrams/%1$s.json)", "unavailable": "[DIAGRAM:%1$s (unavailable)]", "image": "![%1$s](assets/%1$s)"}[kind]
    return F.format_string(form, ident.cast("string"))


def vision_type(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in VISION_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(label, F.lit(""))))), F.lit("UNKNOWN"))


def allowed_extension(name: Column, allowed: tuple[str, ...]) -> Column:
    return extension(name).isin(list(allowed))
