"""Page markup as a table of tokens, and Markdown, tables and references made from it."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from leafmill.functions.text import decode_entities, escape_cell, lower, named, no_blank, placeholder, safe_name, span, src_name, strip
from leafmill.operators.common import cut, distinct_ordered

VOID = ("br", "hr", "img", "meta", "link", "input")
_TOKEN = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<[^>]+>|[^<]+"
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _written(attrs: Column, name: str) -> Column:
    """The value of an attribute as it is written, null where it is missing."""
    found = F.regexp_extract(attrs, rf"""(?s)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return named(found, lambda x: F.when(x != "", F.substring(x, F.lit(2), F.length(x) - 2)))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute in a tag's text, null where it is missing."""
    return named(_written(attrs, name), decode_entities)


def _is_mark(raw: Column) -> Column:
    """Whether a token is a comment or a declaration."""
    return reduce(lambda x, y: x | y, (raw.startswith(f"<{c}") & ~raw.startswith(f"<{c}[CDATA") for c in "!?"))


def _parsed(rows: DataFrame) -> DataFrame:
    """rows with a token each in `raw`, but comments and declarations, with kind, tag, attrs and text."""
    in_tag = F.col("raw").startswith("<")  # looked at first, so that patterns never run over long texts
    rows = rows.where(~_is_mark(F.col("raw")))
    tag = F.when(in_tag, named(F.regexp_extract("raw", r"^</?([A-Za-z][^\s/>]*)", 1), lower))
    is_cdata = F.col("raw").startswith("<![CDATA[")
    kind = F.when(is_cdata, "cdata").when(F.col("raw").startswith("</"), "close").when(~in_tag, "text").when(F.col("raw").endswith("/>") | tag.isin(list(VOID)), "void").otherwise("open")
    rows = rows.withColumn("kind", kind).withColumn("tag", F.when(F.col("kind").isin("open", "close", "void"), tag))
    text = F.when(F.col("kind") == "text", decode_entities(F.col("raw"))).when(F.col("kind") == "cdata", F.regexp_extract("raw", r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1))
    attrs = F.when(F.col("kind").isin("open", "void"), F.regexp_extract("raw", r"(?s)^<[^\s/>]+(.*?)/?>$", 1))
    return rows.withColumns({"attrs": attrs, "text": text})


def _outline(heads: list[str], out: tuple[list, ...]) -> None:
    """Adds depth, parent, tables, rows and cells of each token of a page to the lists of out, by its head ('<p', '</p', '<p/' or '' for text)."""
    size, last, counts = 0, {}, [0, 0, 0]
    depth, parent, *open_parts = (x.append for x in out)
    for ix, head in enumerate(heads):
        ends = head.startswith("</")
        opens = head != "" and not ends and head[-1] != "/"
        part = _PARTS.get(head)
        if part is not None:
            counts[part] += opens - ends
        size -= ends
        depth(size + (head != ""))
        parent(last.get(size))
        for add, n in zip(open_parts, counts):
            add(n)
        if opens:
            size += 1
            last[size] = ix


_PARTS = {f"{mark}{tag}": i for mark in ("<", "</") for tag, i in (("table", 0), ("tr", 1), ("td", 2), ("th", 2))}
_OUTLINE = ("depth", "parent", "tables", "rows", "cells")


def _outlines(heads: pa.Array) -> pa.Array:
    out = tuple([] for _ in _OUTLINE)
    for page in heads:
        _outline(page.as_py(), out)
    ends = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.list_value_length(heads).cast(pa.int64()))]).cast(pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in out], names=list(_OUTLINE))


def _raws() -> Column:
    """The tokens of html as they are written. Content that doesn't begin with a tag is put into a paragraph."""
    html = F.coalesce("html", F.lit(""))
    fragment = F.when(html.rlike(r"^\s*<"), html).otherwise(F.concat(F.lit("<p>"), html, F.lit("</p>")))
    return F.regexp_extract_all(fragment, F.lit(_TOKEN), F.lit(0))


def _cdata(raw: Column) -> Column:
    return F.when(raw.endswith("]]>"), F.substring(raw, F.lit(10), F.length(raw) - 12)).otherwise("")


def _attrs(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)^<[^\s/>]+(.*?)/?>$", 1)


def tokens(pages: DataFrame) -> DataFrame:
    """(page_id, ix, kind, tag, attrs, text, depth, parent, tables, rows, cells) of pages(page_id, html); kind: open, close, void, text, cdata.

    depth: 1 for top-level elements; a closing and a void tag have the depth of their element. parent: the ix of the element that holds the
    token, null at the top; tables, rows, cells: how many of them are open. Content that doesn't begin with a tag is put into a paragraph.
    Missing ends aren't put in (see raw_tokens for raw pages). A page's outline is made where the page is split, before any shuffle.
    """
    name = lambda r: named(F.regexp_extract(r, r"^</?[A-Za-z][^\s/>]*", 0), lower)
    void = lambda r, n: F.when(r.endswith("/>") | n.isin([f"<{t}" for t in VOID]), F.concat(F.coalesce(n, F.lit("<")), F.lit("/"))).otherwise(F.when(n == "", "<").otherwise(n))
    tagged = lambda r: named(name(r), lambda n: F.when(r.startswith("</"), F.when(n == "", "</").otherwise(n)).otherwise(void(r, n)))
    heads = F.transform("raws", lambda r: F.when(~r.startswith("<") | r.startswith("<!") | _is_mark(r), F.lit("")).otherwise(tagged(r)))
    split = pages.select("page_id", _raws().alias("raws")).select("page_id", "raws", heads.alias("heads"))
    rows = split.select("page_id", "raws", "heads", F.arrow_udf(_outlines, StructType([StructField(c, ArrayType(IntegerType())) for c in _OUTLINE]))("heads").alias("o")).select("page_id", F.posexplode(F.arrays_zip("raws", "heads", *[F.col(f"o.{c}").alias(c) for c in _OUTLINE])).alias("ix", "t"))
    rows = rows.select("page_id", "ix", F.col("t.raws").alias("raw"), F.col("t.heads").alias("head"), *[F.col("t")[c].alias(c) for c in _OUTLINE]).where(~_is_mark(F.col("raw")))
    raw, head = F.col("raw"), F.col("head")
    kind = F.when(head == "", F.when(raw.startswith("<![CDATA["), "cdata").otherwise("text")).when(head.startswith("</"), "close").when(head.endswith("/"), "void").otherwise("open")
    tag = F.when(head != "", F.btrim(head, F.lit("</")))
    text = F.when(F.col("kind") == "text", decode_entities(raw)).when(F.col("kind") == "cdata", _cdata(raw))
    has_more = (F.length(raw) > F.length("tag") + 2) | (F.col("tag") == "")
    attrs = F.when(F.col("kind").isin("open", "void"), F.when(has_more, _attrs(raw)).otherwise(""))
    return rows.withColumn("kind", kind).withColumn("tag", tag).select("page_id", "ix", "kind", "tag", attrs.alias("attrs"), text.alias("text"), *_OUTLINE)


# Fixed values of the markup standard: what an opening tag ends, looked for no further out than the innermost of the elements named after.
_CELLS, _ROWS = ("td", "th"), ("tbody", "thead", "tfoot")
_PARAGRAPH = (("p",), ("table", "td", "th", "caption", "button", "object"))
_AFTER_P = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
_ENDS = {t: [_PARAGRAPH] for t in _AFTER_P} | {
    "li": [(("li",), ("ul", "ol")), _PARAGRAPH], "dt": [(("dt", "dd"), ("dl",)), _PARAGRAPH], "dd": [(("dt", "dd"), ("dl",)), _PARAGRAPH],
    "option": [(("option",), ("select",))], "body": [(("head",), ())], "td": [(_CELLS, ("table",))], "th": [(_CELLS, ("table",))],
    "tr": [((*_CELLS, "tr"), ("table",))], **{t: [((*_CELLS, "tr", *_ROWS), ("table",))] for t in _ROWS},
}
_RAW = r"(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>|[^<]+|<"


def _nested(heads: list[str]) -> list[int]:
    """The depth of each token of a page by its head ('<p', '</p', '<p/' or '' for text), as in tokens; -1 for an end of nothing."""
    stack, places, out = [], defaultdict(list), []

    def innermost(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def leave(size: int) -> None:
        while len(stack) > size:
            places[stack.pop()].pop()

    for head in heads:
        tag = head.strip("</")
        if not head:
            out.append(len(stack))
        elif head.startswith("</"):
            # An end tag ends its innermost element, but never one outside of the table cell that it stands in; ends of table parts stay in their table.
            fence = () if tag == "table" else ("table",) if tag in ("tr", *_CELLS, *_ROWS, "caption") else (*_CELLS, "caption")
            at = innermost((tag,))
            if at <= innermost(fence):
                out.append(-1)
                continue
            leave(at)
            out.append(at + 1)
        else:
            for ended, fence in _ENDS.get(tag, ()):
                beyond = innermost(fence)
                leave(min((at for t in ended for at in places[t] if at > beyond), default=len(stack)))
            if tag not in VOID and not head.endswith("/"):
                places[tag].append(len(stack))
                stack.append(tag)
                out.append(len(stack))
            else:
                out.append(len(stack) + 1)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _depths(heads: pd.Series) -> pd.Series:
    return heads.map(_nested)


def raw_tokens(pages: DataFrame) -> DataFrame:
    """tokens of raw web pages, whose paragraphs, list items, table rows and cells may lack an end, and whose ends may lack a beginning.

    Elements are ended as the markup standard says for these; others that are left open end with the one that holds them. Ends of nothing,
    scripts, styles and comments go; a lone '<' is text. A page's tokens are nested where they are split, before any shuffle.
    """
    bare = _without(F.coalesce("html", F.lit("")), ("script", "style"))
    raws = F.transform(F.regexp_extract_all(bare, F.lit(_RAW), F.lit(0)), lambda r: F.when(r == "<", F.lit("&lt;")).otherwise(r))
    shut = lambda r: F.when(r.startswith("<") & r.endswith("/>"), F.lit("/")).otherwise(F.lit(""))
    heads = F.transform("raws", lambda r: F.concat(F.lower(F.regexp_extract(r, r"^</?[A-Za-z][^\s/>]*", 0)), F.when(r.rlike("^<[A-Za-z]"), shut(r)).otherwise(F.lit(""))))
    split = pages.select("page_id", raws.alias("raws")).select("page_id", "raws", _depths(heads).alias("depths"))
    rows = split.select("page_id", F.posexplode(F.arrays_zip("raws", "depths")).alias("ix", "t")).select("page_id", "ix", F.col("t.raws").alias("raw"), F.col("t.depths").alias("depth"))
    return _parsed(rows.where("depth >= 0")).select("page_id", "ix", "kind", "tag", "attrs", "text", "depth")


def _without(html: Column, tags: tuple[str, ...]) -> Column:
    """html without comments and the elements with these tags."""
    return reduce(lambda c, tag: F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}>", ""), tags, F.regexp_replace(html, "(?s)<!--.*?-->", ""))


def blocks(toks: DataFrame) -> DataFrame:
    """Tokens of top-level elements with block, the element's number in its page, and top, its tag; top-level text outside of elements
    goes."""
    w = Window.partitionBy("page_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("depth") == 1) & F.col("kind").isin("open", "void")
    out = toks.withColumn("block", F.sum(starts.cast("int")).over(w))
    out = out.where((F.col("block") > 0) & ~((F.col("depth") == 0) & F.col("kind").isin("text", "cdata")))
    # An element's first token is its tag.
    return out.withColumn("top", F.first("tag").over(Window.partitionBy("page_id", "block").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)))


def _within(items: DataFrame, openers: DataFrame, name: str) -> DataFrame:
    """items(page_id, lvl, ix, ...) with `name`: the last of openers(page_id, lvl, ix, o) of their page and level that comes before them.

    Elements of one depth never overlap, so the last opening of a depth before a token is the element that holds it.
    """
    cols = [c for c in items.columns if c not in ("page_id", "lvl", "ix")]
    kind = openers.schema["o"].dataType
    rows = items.select("page_id", "lvl", "ix", F.struct(F.lit(True).alias("_is"), *cols).alias("it"), F.lit(None).cast(kind).alias("o"))
    both = rows.unionByName(openers.select("page_id", "lvl", "ix", "o"), allowMissingColumns=True)
    before = Window.partitionBy("page_id", "lvl").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("o", F.last("o", ignorenulls=True).over(before)).where("it is not null").select("page_id", "lvl", "ix", *[F.col("it")[c].alias(c) for c in cols], F.col("o").alias(name))


def nodes(toks: DataFrame) -> DataFrame:
    """(page_id, ix, parent, level, kind, tag, attrs, text): elements (at their opening), void elements and texts, each with the ix of the element
    that holds it, null at the top, and its level, 1 at the top."""
    level = F.when(F.col("kind").isin("text", "cdata"), F.col("depth") + 1).otherwise(F.col("depth"))
    if "parent" in toks.columns:
        return toks.where("kind <> 'close'").select("page_id", "ix", "parent", level.alias("level"), "kind", "tag", "attrs", "text")
    rows = toks.where("kind <> 'close'").withColumn("lvl", level - 1).drop("depth")
    opens = toks.where("kind = 'open'").select("page_id", F.col("depth").alias("lvl"), "ix", F.col("ix").alias("o"))
    return _within(rows, opens, "parent").select("page_id", "ix", "parent", (F.col("lvl") + 1).alias("level"), "kind", "tag", "attrs", "text")


def texts_of(toks: DataFrame, tag: str) -> DataFrame:
    """(page_id, ix, text) of every element with the tag, in or outside of others with it: all text below it as written, '' where there is none."""
    so_far = Window.partitionBy("page_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("tag") == tag, F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1)).otherwise(0)
    held = toks.withColumn("n", F.sum(step).over(so_far).cast("int"))
    opens = held.where((F.col("tag") == tag) & (F.col("kind") == "open")).select("page_id", F.col("n").alias("lvl"), "ix", F.col("ix").alias("o"))
    inside = _within(_each(held.where((F.col("n") > 0) & F.col("text").isNotNull()).select("page_id", "ix", "text", "n"), F.col("n")), opens, "at")
    texts = inside.groupBy("page_id", F.col("at").alias("ix")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ix").alias("k"), "text"))), lambda x: x["text"]), "").alias("text"))
    return opens.select("page_id", "ix").join(texts, ["page_id", "ix"], "left").select("page_id", "ix", F.coalesce("text", F.lit("")).alias("text"))


def _spaced() -> Column:
    """What a token adds to an element's text: texts as they are, a blank where a block begins or ends or a line breaks."""
    return F.when(F.col("kind").isin("text", "cdata"), F.col("text")).when(F.col("tag").isin(*_BLOCKS), F.lit(" ")).otherwise(F.lit(""))


def _squeezed(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


# Elements that part words in an element's text.
_BLOCKS = "br hr p div ul ol li table caption thead tbody tfoot tr td th pre blockquote section article h1 h2 h3 h4 h5 h6".split()


_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)", re.ASCII)
_LITERAL = ("ac:plain-text-body", "plain-text-body")


def _read_tag(raw: str) -> tuple:
    """name (None for text), whether it opens or ends an element, whether it parts words, and the part of a table that it is."""
    name = ((found := _NAME.match(raw)) and found[1] or "").lower() if raw else None
    ends = raw.startswith("</")
    return name, raw != "" and not ends and not raw.endswith("/>") and name not in VOID, ends, name in _BLOCKS, _PARTS.get(f"<{name}")


class _Shape:
    """What a page's tags say: its nodes by level and place, so that those of a level, and those that an element holds, are a slice each; the cells,
    rows and tables, as in table_cells; and the tokens (-1: a blank) in the texts of cells, in their order, and of other elements in refs."""

    def __init__(self, tags: list[tuple], depths: list[int] | None) -> None:
        self.cell_at, self.texts, self.nested, self.rows, self.table_at = [], [], [], [], {}
        self.levels: list[list[list]] = []  # of [place, name, first of the nodes in it, number of these]
        levels, size, holders, counts, last = self.levels, 0, {}, [0, 0, 0], ({}, {}, {})
        for ix, (name, opens, ends, is_block, part) in enumerate(tags):
            if part is not None and (opens or ends):
                counts[part] += 1 if opens else -1
            if counts[0] > 0:
                if name is None or is_block:
                    for level in range(1, counts[2] + 1):
                        if level in last[2]:
                            self.texts[last[2][level]].append(ix if name is None else -1)
                if opens and part is not None:
                    self._open_part(ix, part, counts, last)
            if ends:
                size -= 1
                continue
            level = size + 1 if depths is None else depths[ix] + (name is None)
            size += opens
            if level < 1:
                continue
            while len(levels) < level:
                levels.append([])
            here = levels[level - 1]
            if level > 1 and (at := holders.get(level - 1)) is not None:
                holder = levels[level - 2][at]
                if not holder[3]:
                    holder[2] = len(here)
                holder[3] += 1
            if opens:
                holders[level] = len(here)
            here.append([ix, name, 0, 0])

    def _open_part(self, ix: int, part: int, counts: list[int], last: tuple[dict, dict, dict]) -> None:
        tables, rows, cells = last
        if part == 0:
            for level in range(1, counts[0]):
                if level in tables:
                    self.nested[tables[level]] = True
            tables[counts[0]] = self.table_at[ix] = len(self.nested)
            self.nested.append(False)
            self.rows.append({})
        elif part == 1:
            rows[counts[1]] = ix, counts[0]
        else:
            for level in range(1, counts[1] + 1):
                row, around = rows.get(level, (None, 0))
                for table in range(1, around + 1):
                    if table in tables:
                        self.rows[tables[table]].setdefault(row, []).append(len(self.cell_at))
            cells[counts[2]] = len(self.cell_at)
            self.cell_at.append(ix)
            self.texts.append([])

    def _below(self, level: int, node: list) -> Iterator[tuple[int, list | None]]:
        """The nodes in a node as they are written, each with its level; an element that parts words comes a second time, as None, where it ends."""
        left = [(level + 1, x) for x in reversed(self.levels[level][node[2] : node[2] + node[3]])] if node[3] else []
        while left:
            level, node = left.pop()
            yield level, node
            if node is not None:
                if node[1] in _BLOCKS:
                    left.append((level, None))
                if node[3]:
                    left += [(level + 1, x) for x in reversed(self.levels[level][node[2] : node[2] + node[3]])]

    def _text(self, level: int, node: list) -> int:
        inside = ((x is None or x[1] is not None, x) for _, x in self._below(level, node) if x is None or x[1] is None or x[1] in _BLOCKS)
        self.texts.append([-1 if is_blank else x[0] for is_blank, x in inside])
        return len(self.texts) - 1

    def ref(self, level: int, node: list) -> int:
        """Where a node's value lies beside what it holds: of a link or image the place of its page or file, of a table its number, of literal text its
        number in texts; -1 if nowhere."""
        name = node[1]
        if name in ("ac:link", "ac:image"):
            own = "ri:page" if name == "ac:link" else "ri:attachment"
            return next((x[0] for _, x in self._below(level, node) if x is not None and x[1] == own), -1)
        if name == "table":
            return self.table_at.get(node[0], -1)
        if name == "code" or level == 1 and name == "pre":
            return self._text(level, node)
        if level == 1 and name == "ac:structured-macro":
            return self._text(*next(((at, x) for at, x in self._below(level, node) if x is not None and x[1] in _LITERAL), (level, node)))
        return -1


_REFERRING = {"ac:link", "ac:image", "table", "code", "pre", "ac:structured-macro"}
_INTS = pa.list_(pa.int32())
_SHAPES = {"at": _INTS, "tag": pa.list_(pa.string()), "first": _INTS, "n": _INTS, "ref": _INTS, "start": _INTS, "size": _INTS, "cell_at": _INTS, "texts": pa.list_(_INTS), "nested": pa.list_(pa.bool_()), "rows": pa.list_(pa.list_(_INTS))}
_SHAPE = "at array<int>, tag array<string>, first array<int>, n array<int>, ref array<int>, start array<int>, size array<int>, cell_at array<int>, texts array<array<int>>, nested array<boolean>, rows array<array<array<int>>>"


def _shapes(tags: pa.Array, depths: pa.Array) -> pa.Array:
    """The shape of each page by its tokens' tags ('' for text), and by their depths where these are known. Each distinct tag is read once."""
    held = tags.flatten().dictionary_encode()
    read = [_read_tag(raw) for raw in held.dictionary.to_pylist()]
    ends = pc.cumulative_sum(pc.list_value_length(tags)).to_numpy().tolist()
    made = lambda out: pa.StructArray.from_arrays([pa.array(out[name], kind) for name, kind in _SHAPES.items()], names=list(_SHAPES))
    parts, out, begin, since = [], defaultdict(list), 0, 0
    for end, depth in zip(ends, depths):
        shape = _Shape([read[c] for c in held.indices[begin:end].to_numpy().tolist()], depth.as_py())
        begin, sizes = end, [len(x) for x in shape.levels]
        nodes = [(*x, shape.ref(level, x) if x[1] in _REFERRING else -1) for level, found in enumerate(shape.levels, 1) for x in found]
        for name, values in zip(("at", "tag", "first", "n", "ref"), zip(*nodes) if nodes else [()] * 5):
            out[name].append(values)
        out["start"].append([1 + x for x in accumulate(sizes[:-1], initial=0)][::-1] if sizes else [])
        out["size"].append(sizes[::-1])
        out["rows"].append([[cells for _, cells in sorted(rows.items())] for rows in shape.rows])
        for name in ("cell_at", "texts", "nested"):
            out[name].append(getattr(shape, name))
        if end - since >= 100_000:  # no more tokens' numbers and a page's are held as Python's at once
            parts.append(made(out))
            out, since = defaultdict(list), end
    return pa.concat_arrays([*parts, made(out)])


def _words(raws: Column, shape: Column, ref: Column) -> Column:
    """A text of the shape, put together."""
    return F.array_join(F.transform(F.get(shape["texts"], ref), lambda at: F.coalesce(F.get(raws, at), F.lit(" "))), "")


def _tables(raws: Column, shape: Column) -> Column:
    """rows (arrays of cells) of a page's tables, in their order, and whether a pipe table can't show them."""
    spans = lambda raw: F.when(raw.contains("="), F.transform(F.array(*[_written(_attrs(raw), c) for c in ("colspan", "rowspan")]), lambda a: span(decode_entities(a))))
    one = lambda found, k: F.coalesce(F.get(found, k), F.lit(1))
    cell = lambda at, i: named(spans(F.get(raws, at)), lambda n: F.struct(_squeezed(_words(raws, shape, i)).alias("text"), one(n, 0).alias("wide"), (F.greatest(one(n, 0), one(n, 1)) > 1).alias("spanned")))
    wide = lambda row: F.aggregate(row, F.lit(0).cast("long"), lambda n, c: n + c["wide"])
    hard = lambda rows, nested: (F.size(rows) > 0) & (nested | F.exists(rows, lambda row: F.exists(row, lambda c: c["spanned"])) | (F.size(F.array_distinct(F.transform(rows, wide))) > 1))
    rows = lambda cells: F.transform(shape["rows"], lambda t: F.transform(t, lambda r: F.transform(r, lambda i: F.get(cells, i))))
    return F.zip_with(named(F.transform(shape["cell_at"], cell), rows), shape["nested"], lambda t, nested: F.struct(t.alias("rows"), hard(t, nested).alias("hard")))


def _pipe(rows: Column) -> Column:
    line = lambda texts: F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))
    rule = lambda row: F.concat(F.lit("\n"), line(F.transform(row, lambda c: F.lit("---"))))
    return F.array_join(F.transform(rows, lambda row, i: F.concat(line(F.transform(row, lambda c: escape_cell(c["text"]))), F.when(i == 0, rule(row)).otherwise(""))), "\n")


def _argument(raws: Column, node: Column) -> Column:
    """The one attribute that counts in rendering a link or an image."""
    tag, attrs = node["tag"], lambda at: _attrs(F.get(raws, at))
    file = named(attrs(node["ref"]), lambda a: F.coalesce(no_blank(_written(a, "ri:filename")), _written(a, "filename")))
    found = F.when(tag == "a", _written(attrs(node["at"]), "href")).when(node["ref"] < 0, None).when(tag == "ac:link", _written(attrs(node["ref"]), "ri:content-title")).otherwise(file)
    return named(found, decode_entities)


def _value(raws: Column, shape: Column, hard: Column, node: Column, kids: Column) -> Column:
    """The Markdown of a node that holds kids; hard: the numbers of complex tables, from 1."""
    tag, ref, inner = node["tag"], node["ref"], F.array_join(kids, "")
    bare, number = strip(inner), F.array_position(hard, ref + 1)
    marks = {"strong": "**", "b": "**", "em": "*", "i": "*"}

    def referring(arg: Column) -> Column:
        link = F.when(no_blank(arg).isNull(), bare).otherwise(F.concat(F.lit("["), F.coalesce(no_blank(bare), arg), F.lit("]("), arg, F.lit(")")))
        return F.when(tag == "a", link).when(tag == "ac:link", F.coalesce(no_blank(bare), arg, F.lit(""))).otherwise(placeholder("image", safe_name(F.coalesce(no_blank(arg), F.lit("image")))))

    out = F.when(tag.isNull(), F.get(raws, node["at"])).when(tag == "table", F.when(number > 0, placeholder("table", F.concat(F.lit("table-"), number))).otherwise(inner)).when(tag == "br", F.lit("\n"))
    for name, mark in marks.items():
        out = out.when(tag == name, F.concat(F.lit(mark), bare, F.lit(mark)))
    return out.when(tag == "code", F.concat(F.lit("`"), _squeezed(_words(raws, shape, ref)), F.lit("`"))).when(tag.isin("a", "ac:link", "ac:image"), named(_argument(raws, node), referring)).otherwise(inner)


def _block(raws: Column, shape: Column, tables: Column, node: Column, kids: Column, tags: Column, value: Column) -> Column:
    """The Markdown of a top-level element that holds kids with these tags; value: that of the element anywhere else."""
    tag, ref, inner = node["tag"], node["ref"], strip(F.array_join(kids, ""))
    items = F.filter(F.zip_with(tags, kids, lambda t, k: F.when(t == "li", strip(k))), lambda k: k.isNotNull())
    lines = F.transform(items, lambda x, i: F.concat(F.when(tag == "ol", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x))
    fenced = F.concat(F.lit("```\n"), strip(_words(raws, shape, ref)), F.lit("\n```"))
    table = F.when(ref >= 0, F.get(tables, ref))
    macro = attribute(_attrs(F.get(raws, node["at"])), "ac:name")
    return (
        F.when(tag.isin(*_HEADINGS), F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "), inner))
        .when(tag.isin("ul", "ol"), strip(F.array_join(lines, "\n")))
        .when((tag == "table") & ~table["hard"] & (F.size(table["rows"]) > 0), _pipe(table["rows"]))
        .when(tag == "pre", fenced)
        .when(tag == "blockquote", named(inner, lambda x: F.when(x != "", F.concat(F.lit("> "), F.regexp_replace(x, r"\n", "\n> ")))))
        .when(tag == "hr", F.lit("---"))
        .when((tag == "ac:structured-macro") & (F.lower(macro) == "code"), fenced)
        .when(tag.isin("table", "ac:image"), value)
        .otherwise(inner)
    )


def _rendered(raws: Column, shape: Column) -> Column:
    """block (the place of the opening), tag and text of the top-level elements of a page that aren't empty; a page's levels are put together from the
    innermost outwards."""

    def assembled(tables: Column, hard: Column, nodes: Column) -> Column:
        held = lambda below, node: F.slice(below, node["first"] + 1, node["n"])
        values = lambda below, level: F.transform(F.slice(nodes, level["start"], level["size"]), lambda node: _value(raws, shape, hard, node, held(below, node)))
        none = F.array().cast("array<string>")
        levels = F.arrays_zip(shape["start"].alias("start"), shape["size"].alias("size"))
        done = F.aggregate(levels, F.struct(none.alias("below"), none.alias("here")), lambda done, level: F.struct(done["here"].alias("below"), values(done["here"], level).alias("here")))
        tags = lambda top, node: F.transform(F.slice(nodes, top + node["first"] + 1, node["n"]), lambda kid: kid["tag"])
        block = lambda done, node, value: F.struct(node["at"].alias("block"), node["tag"].alias("tag"), named(held(done["below"], node), lambda kids: _block(raws, shape, tables, node, kids, tags(F.size(done["here"]), node), value)).alias("text"))
        return named(done, lambda done: F.zip_with(F.slice(nodes, 1, F.size(done["here"])), done["here"], lambda node, value: F.when(node["tag"].isNotNull(), block(done, node, value))))

    nodes = F.arrays_zip(*[shape[c].alias(c) for c in ("at", "tag", "first", "n", "ref")])
    hard = lambda tables: F.filter(F.transform(tables, lambda t, i: F.when(t["hard"], i + 1)), lambda i: i.isNotNull())
    blocks = named(_tables(raws, shape), lambda tables: named(hard(tables), lambda h: named(nodes, lambda n: assembled(tables, h, n))))
    return F.filter(blocks, lambda b: b["text"].rlike(r"\S"))


def _pages(rows: DataFrame) -> DataFrame:
    """rows of a page's tokens (raws: texts, and tags as they are written; tags: '' for texts; depths, or null) with blocks instead of these."""
    more = [c for c in rows.columns if c not in ("raws", "tags", "depths")]
    shaped = rows.select(*more, "raws", F.arrow_udf(_shapes, _SHAPE)("tags", "depths").alias("shape"))
    return shaped.select(*more, _rendered(F.col("raws"), F.col("shape")).alias("blocks"))


def render_blocks(toks: DataFrame) -> DataFrame:
    """(page_id, block, tag, text) for each top-level element that isn't empty: headings, paragraphs, lists, code, quotes, rules, tables (as pipe
    tables), images and code macros; any other element gives its inline content. Complex tables give their placeholder at any depth.

    A page's tokens are brought together once and rendered in its row, where what an element holds is known when its marks are put around it.
    """
    is_text, none = F.col("kind").isin("text", "cdata"), F.lit("")
    tag = F.concat(F.when(F.col("kind") == "close", "</").otherwise("<"), F.coalesce("tag", none), F.coalesce(F.when(F.col("tag") != "", F.col("attrs")), none), F.when(F.col("kind") == "void", " />").otherwise(">"))
    read = toks.select("page_id", F.struct("ix", F.when(is_text, F.col("text")).otherwise(tag).alias("raw"), F.when(is_text, none).otherwise(tag).alias("tag"), "depth").alias("t"))
    rows = read.groupBy("page_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    rows = rows.select("page_id", F.col("t.ix").alias("ixs"), F.col("t.raw").alias("raws"), F.col("t.tag").alias("tags"), F.col("t.depth").alias("depths"))
    blocks = _pages(rows).select("page_id", "ixs", F.explode("blocks").alias("b"))
    return blocks.select("page_id", F.get("ixs", F.col("b.block")).alias("block"), "b.tag", "b.text")


def markdown(pages: DataFrame) -> DataFrame:
    """(page_id, md) of pages(page_id, title, html): the title as a heading, then the blocks, blank lines between them.

    Pages are split and rendered where they lie: neither texts nor tokens are shuffled or written.
    """
    split = pages.select("page_id", "title", F.filter(_raws(), lambda r: ~_is_mark(r)).alias("raws"))
    tags = F.transform("raws", lambda r: F.when(r.startswith("<") & ~r.startswith("<!"), r).otherwise(F.lit("")))
    read = F.transform("raws", lambda r: F.when(r.startswith("<![CDATA["), _cdata(r)).when(r.startswith("<"), r).otherwise(decode_entities(r)))
    done = _pages(split.select("page_id", "title", read.alias("raws"), tags.alias("tags"), F.lit(None).cast("array<int>").alias("depths")))
    title, body = F.concat(F.lit("# "), strip(F.col("title"))), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    return done.select("page_id", F.concat_ws("\n\n", F.when(no_blank(F.col("title")).isNotNull(), title), named(body, no_blank)).alias("md"))


# ---------------------------------------------------------------- tables


def _levels(toks: DataFrame) -> DataFrame:
    """toks with the numbers of tables, rows and cells that are open at each token."""
    if "cells" in toks.columns:
        return toks
    so_far = Window.partitionBy("page_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    step = lambda tags: F.sum(F.when(F.col("tag").isin(*tags), F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1)).otherwise(0)).over(so_far).cast("int")
    return toks.withColumns({"tables": step(["table"]), "rows": step(["tr"]), "cells": step(["td", "th"])})


def _each(df: DataFrame, levels: Column) -> DataFrame:
    """A row of df for each level 1 ... levels; none where there is none."""
    return df.withColumn("lvl", F.explode(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))))).where(F.col("lvl") <= levels)


def table_cells(toks: DataFrame) -> DataFrame:
    """(page_id, table_ix, row_ix, col_ix, text, colspan, rowspan, header, nested) of tables at any depth, a row a cell; table_ix is the place of the
    table's opening.

    A table inside a cell is a table of its own, and its rows and cells belong to the tables and rows around it too. nested: the table holds
    another one. Rows are numbered among those that have cells.
    """
    held = cut(_levels(toks).where("tables > 0"))  # read five times, and little of most pages
    opens = lambda tags, level, *more: held.where(F.col("tag").isin(*tags) & (F.col("kind") == "open")).select("page_id", F.col(level).alias("lvl"), "ix", F.struct("ix", *more).alias("o"))
    tables, rows, cells = opens(["table"], "tables"), opens(["tr"], "rows", "tables"), opens(["td", "th"], "cells")
    # A cell's text is that of all tokens inside it.
    inside = _within(_each(held.where((F.col("cells") > 0) & (_spaced() != "")).select("page_id", "ix", _spaced().alias("s"), "cells"), F.col("cells")), cells, "cell")
    texts = inside.where("cell is not null").groupBy("page_id", F.col("cell.ix").alias("ix")).agg(_squeezed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ix").alias("at"), "s"))), lambda x: x["s"]), "")).alias("text"))
    found = held.where(F.col("tag").isin("td", "th") & (F.col("kind") == "open")).select("page_id", "ix", "tag", "attrs", "rows")
    found = _within(_each(found, F.col("rows")), rows, "row").drop("lvl").where("row is not null")
    found = _within(_each(found, F.col("row.tables")), tables, "table").drop("lvl").where("table is not null")
    inner = held.where("tag = 'table' and kind = 'open' and tables > 1").select("page_id", "ix", "tables")
    inner = _within(_each(inner, F.col("tables") - 1), tables, "table").select("page_id", F.col("table.ix").alias("table_ix")).distinct().withColumn("nested", F.lit(True))
    out = found.join(texts, ["page_id", "ix"], "left").withColumn("table_ix", F.col("table.ix")).join(inner, ["page_id", "table_ix"], "left")
    row_no, col_no = Window.partitionBy("page_id", "table_ix").orderBy("row.ix"), Window.partitionBy("page_id", "table_ix", "row.ix").orderBy("ix")
    return out.select("page_id", "table_ix", (F.dense_rank().over(row_no) - 1).alias("row_ix"), (F.row_number().over(col_no) - 1).alias("col_ix"), F.coalesce("text", F.lit("")).alias("text"), span(attribute(F.col("attrs"), "colspan")).alias("colspan"), span(attribute(F.col("attrs"), "rowspan")).alias("rowspan"), (F.col("tag") == "th").alias("header"), F.coalesce("nested", F.lit(False)).alias("nested"))


def table_shapes(cells: DataFrame) -> DataFrame:
    """Per table: rows, columns (most of a row, spans counted), ragged (rows of different numbers of columns), spanned and nested flags."""
    per = cells.groupBy("page_id", "table_ix", "row_ix").agg(F.sum("colspan").cast("int").alias("wide"), F.bool_or((F.col("colspan") > 1) | (F.col("rowspan") > 1)).alias("spanned"), F.bool_or("nested").alias("nested"))
    return per.groupBy("page_id", "table_ix").agg(F.count("*").cast("int").alias("row_count"), F.max("wide").alias("column_count"), (F.countDistinct("wide") > 1).alias("ragged"), F.bool_or("spanned").alias("spanned"), F.bool_or("nested").alias("nested"))


def complex_tables(cells: DataFrame) -> DataFrame:
    """Shapes of the tables that a pipe table can't show."""
    return table_shapes(cells).where("nested or ragged or spanned")


def _numbered(hard: DataFrame) -> DataFrame:
    """Complex tables with table_id, by their openings' order in the page."""
    return hard.withColumn("table_id", F.concat(F.lit("table-"), F.row_number().over(Window.partitionBy("page_id").orderBy("table_ix")).cast("string")))


def pipe_tables(cells: DataFrame) -> DataFrame:
    """(page_id, table_ix, pipe): Markdown of the tables that aren't complex; the first row is the header."""
    simple = cells.join(complex_tables(cells).select("page_id", "table_ix"), ["page_id", "table_ix"], "left_anti")
    rows = simple.groupBy("page_id", "table_ix", "row_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_ix", escape_cell(F.col("text")).alias("t")))), lambda x: x["t"]).alias("c"))
    line = F.concat(F.lit("| "), F.array_join("c", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: F.lit("---")), " | "), F.lit(" |"))
    lines = rows.withColumn("l", F.when(F.col("row_ix") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line))
    return lines.groupBy("page_id", "table_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "l"))), lambda x: x["l"]), "\n").alias("pipe"))


def extract_tables(toks: DataFrame) -> DataFrame:
    """(page_id, table_id, row_count, column_count, caption, rows) of complex tables at any depth, numbered by their openings in page order."""
    toks = cut(toks)
    cells = cut(table_cells(toks))
    hard = complex_tables(cells)
    per_row = cells.groupBy("page_id", "table_ix", "row_ix").agg(F.array_sort(F.collect_list(F.struct("col_ix", "text", "colspan", "rowspan", "header"))).alias("cells"))
    rows = per_row.groupBy("page_id", "table_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "cells"))), lambda r: r["cells"]).alias("rows"))
    out = _numbered(hard).join(rows, ["page_id", "table_ix"]).join(captions(toks), ["page_id", "table_ix"], "left")
    return out.select("page_id", "table_id", "row_count", "column_count", "caption", "rows")


def captions(toks: DataFrame) -> DataFrame:
    """(page_id, table_ix, caption) of tables: the first caption inside each, null where it is blank."""
    held = _levels(toks)
    tables = held.where("tag = 'table' and kind = 'open'").select("page_id", F.col("tables").alias("lvl"), "ix", F.struct("ix").alias("o"))
    marks = held.withColumn("in", F.sum(F.when(F.col("tag") == "caption", F.when(F.col("kind") == "open", 1).otherwise(-1)).otherwise(0)).over(Window.partitionBy("page_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)))
    marks = marks.withColumn("at", F.last(F.when((F.col("tag") == "caption") & (F.col("kind") == "open"), F.col("ix")), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)))
    texts = marks.where(F.col("in") > 0).groupBy("page_id", F.col("at").alias("ix")).agg(no_blank(_squeezed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", _spaced().alias("s")))), lambda x: x["s"]), ""))).alias("caption"), F.min_by("tables", "ix").alias("tables"))
    return _within(_each(texts, F.col("tables")), tables, "table").groupBy("page_id", F.col("table.ix").alias("table_ix")).agg(F.min_by("caption", "ix").alias("caption"))


# ---------------------------------------------------------------- references


def image_refs(toks: DataFrame) -> DataFrame:
    """(page_id, name, ix): names of attached images, of macros and of img tags, each once at its first place."""
    macro = attribute(F.col("attrs"), "ri:filename")
    img = src_name(attribute(F.col("attrs"), "src"))
    name = F.when(F.col("tag") == "ri:attachment", macro).when(F.col("tag") == "img", img)
    found = toks.where(F.col("kind").isin("open", "void")).select("page_id", name.alias("name"), "ix").where("name is not null")
    return distinct_ordered(found, ["page_id", "name"], "ix")


def diagram_refs(toks: DataFrame) -> DataFrame:
    """(page_id, diagram_id, diagram_name, attachment_name, xml) of diagram macros, numbered in page order."""
    w = Window.partitionBy("page_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("tag") == "ac:structured-macro") & (F.col("kind") == "open") & (attribute(F.col("attrs"), "ac:name") == "drawio")
    rows = toks.withColumn("macro", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w)).withColumn("param", F.last(F.when((F.col("tag") == "ac:parameter") & (F.col("kind") == "open"), attribute(F.col("attrs"), "ac:name")), ignorenulls=True).over(w))
    rows = rows.where("macro > 0")
    value = lambda p: F.min_by("text", F.when((F.col("param") == p) & (F.col("kind") == "text"), F.col("ix")))
    out = rows.groupBy("page_id", "macro").agg(no_blank(value("diagramName")).alias("diagram_name"), F.min_by(attribute(F.col("attrs"), "ri:filename"), F.when(F.col("tag") == "ri:attachment", F.col("ix"))).alias("attachment_name"), F.min_by("text", F.when((F.col("kind") == "cdata") & F.col("text").rlike(r"(?i)<mx(file|GraphModel)\b"), F.col("ix"))).alias("xml"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("macro"))
    return out.select("page_id", F.concat(F.lit("diagram-"), n.cast("string")).alias("diagram_id"), "diagram_name", "attachment_name", "xml")


def inline_diagrams(refs: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, diagram_id, md): a placeholder line and a list of the diagram's labels(page_id, diagram_id, ord, label)."""
    listed = labels.groupBy("page_id", "diagram_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: F.concat(F.lit("- "), x["label"])), "\n").alias("l"))
    out = refs.join(listed, ["page_id", "diagram_id"], "left")
    head = F.when(F.col("l").isNotNull(), placeholder("diagram", F.col("diagram_id"))).otherwise(placeholder("unavailable", F.col("diagram_id")))
    return out.select("page_id", "diagram_id", F.concat_ws("\n\n", head, "l").alias("md"))


# ---------------------------------------------------------------- raw web pages


def article_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, text): the article of raw web pages, cut at paragraph, heading and break tags; scripts, styles, comments, navigation
    and footers go. Works on unclosed tags."""
    bare = _without(F.coalesce("html", F.lit("")), ("script", "style", "nav", "footer"))
    article = F.regexp_extract(bare, r"(?is)<article[^>]*>(.*?)</article>", 1)
    parts = pages.select("page_id", F.posexplode(F.split(article, r"(?i)</?(?:p|h1|h2|h3|br|li|ul|ol|div)\b[^>]*>")).alias("pos", "raw"))
    text = strip(decode_entities(F.regexp_replace("raw", "<[^>]+>", "")))
    return parts.select("page_id", "pos", text.alias("text")).where("text <> ''")


def page_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, md) of raw web pages: the article's blocks with blank lines between them."""
    return article_blocks(pages).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("md"))


def heading_tokens(pages: DataFrame) -> DataFrame:
    """(page_id, tags, headings): open tags of a page and its h1 text."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.size(F.regexp_extract_all(html, F.lit(r"<[a-zA-Z][^>]*>"), F.lit(0))).alias("tags"), strip(F.regexp_extract(html, r"(?is)<h1>(.*?)</h1>", 1)).alias("heading"))
