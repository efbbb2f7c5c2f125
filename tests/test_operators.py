"""Operators against plain loops and literal cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import chunks, diagrams, manifest, markup, tree, vectors


def plain_chunks(md, most):
    """The chunker as a loop over lines."""
    sections, titles, buffer = [], [None] * 6, ""

    def flush():
        nonlocal buffer
        if buffer:
            sections.append((" > ".join(t for t in titles if t and t.strip()), buffer))
        buffer = ""

    strip = lambda s: re.sub(r"^\s+|\s+$", "", s)
    for line in md.split("\n"):
        m = re.fullmatch(r"(#{1,6})[ \t]+(.+)", line)
        if m:
            flush()
            level = len(m[1])
            titles[level - 1 :] = [strip(m[2])] + [None] * (6 - level)
        else:
            buffer = buffer + "\n" + line if buffer else line
    flush()
    out = []
    for path, body in sections:
        body = strip(body)
        if not body:
            continue
        if len(body) <= most:
            out.append((path, body))
            continue
        open_ = ""
        for p in filter(None, map(strip, body.split("\n\n"))):
            if open_ and len(open_) + 2 + len(p) <= most:
                open_ += "\n\n" + p
                continue
            if open_:
                out.append((path, open_))
            open_ = ""
            if len(p) <= most:
                open_ = p
            else:
                out += [(path, strip(p[i : i + most])) for i in range(0, len(p), most)]
        if open_:
            out.append((path, open_))
    return out


def test_chunks_equal_a_plain_loop(spark):
    rng, docs = random.Random(5), []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(["# A", "## B b", "### C", "#### D", "#x", "", "", "word " * rng.randint(1, 30), "x" * rng.randint(1, 120), "  y  "]))
        docs.append((i, "\n".join(parts)))
    got = chunks.chunk_pages(spark.createDataFrame(docs, "page_id long, md string"), 80).collect()
    for i, md in docs:
        mine = [(r.heading_path, r.text) for r in sorted((r for r in got if r.page_id == i), key=lambda r: r.chunk_index)]
        assert mine == plain_chunks(md, 80), md


def test_crawl_order_equals_a_stack_walk(spark):
    rng = random.Random(2)
    kids = {}
    for child in range(1, 120):
        kids.setdefault(rng.randint(0, child - 1), []).append(child)
    edges = spark.createDataFrame([(p, c, i) for p, cs in kids.items() for i, c in enumerate(cs)], "parent_id long, child_id long, position int")
    order, stack = [0], [0]
    while stack:
        below = kids.get(stack.pop(), [])
        order += below
        stack += below[::-1]
    got = [r.page_id for r in tree.crawl_order(edges, 0).orderBy("crawl_order").collect()]
    assert got == order


def test_cycles_end(spark):
    edges = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (2, 1, 0)], "parent_id long, child_id long, position int")
    assert sorted(r.page_id for r in tree.crawl_rows(edges, 0).collect()) == [0, 1, 2]


def test_crawl_order_is_numbered_in_ranges(spark):
    edges = spark.range(1, 60).selectExpr("(id - 1) div 3 as parent_id", "id as child_id", "cast(id % 3 as int) as position")
    plan = tree.crawl_order(edges, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan


def test_a_chain_of_100000_takes_a_bounded_number_of_jobs(spark):
    sc, n = spark.sparkContext, 100_000
    edges = spark.range(n).selectExpr("id as parent_id", "id + 1 as child_id", "0 as position")
    sc.setJobGroup("chain", "chain")
    try:
        got = tree.crawl_order(edges, 0)
        assert got.where("page_id = crawl_order and depth = page_id").count() == n + 1
        assert len(sc.statusTracker().getJobIdsForGroup("chain")) < 500
    finally:
        sc.setJobGroup("rest", "rest")


def test_forests_with_cycles_ties_and_hot_parents(spark):
    rng = random.Random(4)
    rows = [(0, 1, None)] + [(1, c, 0) for c in range(2, 60)] + [(rng.randint(2, c - 1), c, rng.randint(0, 2)) for c in range(60, 160)]
    rows += [(500, 501, 0), (501, 500, 0), (501, 502, 0), (700, 701, 0), (160, 0, 0), (159, 160, 0), (None, 800, 0), (5, None, 0)]
    edges = spark.createDataFrame(rows, "parent_id long, child_id long, position int")
    kids = {}
    for p, c, at in sorted((r for r in rows if None not in r[:2] and r[1]), key=lambda r: (r[2] is not None, r[2], r[1])):
        kids.setdefault(p, []).append(c)
    order, stack = [(0, 0)], [(0, 0)]
    while stack:
        page, depth = stack.pop()
        below = [(c, depth + 1) for c in kids.get(page, [])]
        order += below
        stack += below[::-1]
    assert [(r.page_id, r.depth) for r in tree.crawl_order(edges, 0).orderBy("crawl_order").collect()] == order
    assert sorted((r.page_id, r.depth) for r in tree.descendants(edges, 0).collect()) == sorted(order[1:])
    assert tree.descendants(edges, 999).count() == 0 and [r.page_id for r in tree.crawl_rows(edges, 999).collect()] == [999]
    assert [r.page_id for r in tree.crawl_rows(edges.limit(0), 0).collect()] == [0]


def test_deep_trees_and_cells_are_whole(spark):
    edges = spark.range(105).selectExpr("id as parent_id", "id + 1 as child_id", "0 as position")
    assert sorted(r.depth for r in tree.descendants(edges, 0).select("depth").collect()) == list(range(1, 106))
    deep = spark.range(80).selectExpr("'d' as diagram_id", "concat('c', id) as cell_id", "if(id < 79, concat('c', id + 1), null) as parent_id", "if(id = 79, 'Top', '') as value")
    loop = spark.createDataFrame([("d", "x", "y", ""), ("d", "y", "x", "")], deep.schema)
    cells = deep.unionAll(loop).selectExpr("*", "true as vertex", "false as edge", "'' as style", "null as source_id", "null as target_id", "0 as ord")
    types = spark.createDataFrame([("d", "FLOWCHART")], "diagram_id string, type string")
    nodes = spark.createDataFrame([("d", "Top")], "diagram_id string, label string")
    got = diagrams.resolve_endpoints(cells, types, nodes).collect()
    assert len(got) == 80 and {r.node for r in got} == {"Top"}


def test_effective_retries(spark):
    df = spark.createDataFrame([(0, "e"), (0, " "), (3, None), (-1, None), (None, "e")], "n int, e string")
    assert [r[0] for r in df.select(manifest.effective_retries(F.col("n"), F.col("e"))).collect()] == [1, 0, 3, 0, 1]


def test_markdown_of_storage_markup(spark):
    html = (
        "<h1>Top &amp; more</h1><p>a <em>b</em> <code> c </code><br/>d</p><ul><li>x</li><li>y <strong>z</strong></li></ul><!-- no --><blockquote>q</blockquote>"
        "<table><tbody><tr><th>A</th><th>B</th></tr><tr><td>1|2</td><td>3</td></tr></tbody></table>"
        '<table><tbody><tr><td colspan="2">w</td></tr><tr><td>1</td><td>2</td></tr></tbody></table>'
    )
    pages = spark.createDataFrame([(1, "T", html), (2, None, "plain text"), (3, "E", None)], "page_id long, title string, html string")
    md = {r.page_id: r.md for r in markup.markdown(pages).collect()}
    assert md[1] == "# T\n\n# Top & more\n\na *b* `c`\nd\n\n- x\n- y **z**\n\n> q\n\n| A | B |\n| --- | --- |\n| 1\\|2 | 3 |\n\n[TABLE:table-1](assets/tables/table-1.json)"
    assert md[2] == "plain text" and md[3] == "# E"


def test_diagram_parents_are_climbed(spark):
    cells = [("d", "a", None, "Alpha Service", True, False, None, None, "", 0), ("d", "a1", "a", "", True, False, None, None, "", 1), ("d", "b", None, "Beta Client", True, False, None, None, "", 2), ("d", "e", None, "calls", False, True, "a1", "b", "", 3), ("d", "f", None, "", False, True, "a", "a1", "", 4)]
    df = spark.createDataFrame(cells, "diagram_id string, cell_id string, parent_id string, value string, vertex boolean, edge boolean, source_id string, target_id string, style string, ord int")
    types = diagrams.classify_diagrams(df)
    edges = diagrams.diagram_edges(df, types, diagrams.diagram_nodes(df, types)).collect()
    assert [(e.source, e.target, e.label) for e in edges] == [("Alpha Service", "Beta Client", "calls")]


def test_relationship_types(spark):
    styles = [("endArrow=block;dashed=1",), ("endArrow=block",), ("startArrow=diamond",), ("dashed=1",), ("",)]
    df = spark.createDataFrame(styles, "s string").select(diagrams.relationship(F.col("s")))
    assert [r[0] for r in df.collect()] == ["implements", "extends", "aggregation", "dependency", "association"]


def test_search_in_blocks_equals_one_pass(spark, sf_dir):
    from leafmill.plans.queries import _sides

    q, v = _sides(spark, sf_dir)
    rows = lambda **o: sorted((r.query_id, r.rank, r.chunk_id) for r in vectors.search(q, v, 3, **o).collect())
    assert rows() == rows(query_block=3, vector_block=40)
    assert rows(scoped=True) == rows(scoped=True, query_block=1, vector_block=7)


def test_search_with_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    kind = "long, root_id long, embedding array<float>"
    q = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, None), (3, None, [0.0, 1.0]), (4, 1, [1.0, 0.0, 0.0]), (5, 1, [0.0, 0.0]), (6, 1, [nan, 1.0]), (7, 1, [None, 1.0])], f"query_id {kind}")
    rows = [("a", 1, [2.0, 0.0]), ("b", 1, [1.0, 1.0]), ("c", 1, None), ("d", 1, [0.0, 0.0]), ("e", None, [0.0, 3.0]), ("f", 1, [0.0, 0.0, 5.0]), ("g", 1, [inf, 1.0]), ("h", 1, [nan, 0.0]), ("i", 1, []), ("0", 1, [4.0, 0.0])]
    v = spark.createDataFrame(rows, "chunk_id string, root_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.chunk_id, round(r.score, 3)) for r in vectors.search(q, v, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "0", 1.0), (1, 2, "a", 1.0), (3, 1, "e", 1.0), (3, 2, "b", 0.707), (4, 1, "f", 0.0)]
    assert [(r.query_id, r.chunk_id) for r in vectors.search(q, v, 1, scoped=True).orderBy("query_id").collect()] == [(1, "0"), (3, "e"), (4, "f")]
    assert vectors.search(q.limit(0), v).collect() == [] and vectors.search(q, v.limit(0)).collect() == []


@pytest.mark.parametrize("k, threshold, centres", [(1, -1.0, 7), (3, 0.3, 256), (200, -1.0, 40)])
def test_search_in_cells_equals_search(spark, sf_dir, k, threshold, centres):
    from leafmill.plans.queries import _sides

    q, v = _sides(spark, sf_dir)
    nan = float("nan")
    odd = [("c0", 1, None), ("c1", 1, []), ("c2", None, [0.0, 0.0]), ("c3", 1, [nan, 1.0]), ("c4", 1, [None, 1.0]), (None, 2, [3.0, 4.0]), ("c5", 1, [1.0] * 5), ("c6", 1, [1.0] * 5)]
    v = v.select("chunk_id", "root_id", "embedding").unionByName(spark.createDataFrame(odd, "chunk_id string, root_id long, embedding array<float>"))
    v = v.unionByName(v.limit(50))
    q = q.unionByName(spark.createDataFrame([(None, 1, [3.0, 4.1]), (-1, 1, [1.0, 2.0, 1.0, 1.0, 1.0]), (-2, 1, [0.0])], "query_id long, root_id long, embedding array<float>"))
    rows = lambda df: sorted((str(r.query_id), r["rank"], str(r.chunk_id), r.root_id, r.score) for r in df.collect())
    found = vectors.cell_centres(v.where("size(embedding) > 5 or size(embedding) = 2"), centres)
    cells = vectors.in_cells(v, found)
    hits, met = vectors.search_cells(q, cells, found, k, threshold, query_block=4, vector_block=30)
    assert rows(hits) == rows(vectors.search(q, v, k, threshold))
    assert vectors.search_cells(q.limit(0), cells, found)[0].collect() == [] and vectors.search_cells(q, cells.limit(0), found)[0].collect() == []


def test_search_in_cells_leaves_groups_out(spark):
    r = np.random.default_rng(3)
    axes = r.normal(size=(20, 24))
    x = (axes[r.integers(0, 20, 3000)] + 0.05 * r.normal(size=(3000, 24))).tolist()
    v = spark.createDataFrame([(f"{i:04}", 0, e) for i, e in enumerate(x)], "chunk_id string, root_id long, embedding array<double>")
    q = v.where("chunk_id like '%0'").withColumn("query_id", F.col("chunk_id")).drop("chunk_id")
    found = vectors.cell_centres(v)
    hits, met = vectors.search_cells(q, vectors.in_cells(v, found), found, 5)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    assert rows(hits) == rows(vectors.search(q, v, 5))
    assert met.groupBy().sum("n").first()[0] < 0.2 * 300 * 3000


def test_lsh_finds_most_pairs(spark, sf_dir):
    from leafmill.plans.queries import _sides

    q, v = _sides(spark, sf_dir)
    x = {r.chunk_id: np.array(r.embedding) for r in v.collect()}
    want = {(r.query_id, c) for r in q.collect() for c, e in x.items() if np.linalg.norm(np.array(r.embedding) - e) < 0.9}
    got = {(r.query_id, r.chunk_id) for r in vectors.lsh_candidates(q, v, 0.9).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_numeric_entities(spark):
    from leafmill.functions.text import decode_entities

    df = spark.createDataFrame([("a&#8211;b &#x1F600; &lt;&#39;&amp;#65; &#0; &#xD800; &#233;",), (None,), ("&#65;",)], "s string")
    assert [r[0] for r in df.select(decode_entities(F.col("s"))).collect()] == ["a–b 😀 <'&#65; &#0; &#xD800; é", None, "A"]


def test_wide_cells_do_not_make_a_table_ragged(spark):
    html = "<table><tr><td colspan=\"2\">a</td></tr><tr><td>b</td><td>c</td></tr></table><table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>"
    shapes = markup.table_shapes(markup.table_cells(markup.tokens(spark.createDataFrame([(1, html)], "page_id long, html string")))).orderBy("table_ix").collect()
    assert [(r.column_count, r.ragged, r.spanned) for r in shapes] == [(2, False, True), (2, True, False)]


def test_style_types(spark):
    df = spark.createDataFrame([("whiteSpace=wrap;shape=cloud;rounded=1",), ("swimlane;x=1",), ("ellipse",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(diagrams.style_type(F.col("s"))).collect()] == ["shape=cloud", "swimlane", None, None, None]


def test_views_of_the_session_stay(spark, sf_dir):
    from leafmill.plans.queries import QUERIES

    spark.range(3).createOrReplaceTempView("documents")
    QUERIES["manifest_summary"](spark, sf_dir).collect()
    assert spark.table("documents").count() == 3
    spark.catalog.dropTempView("documents")


def test_class_diagram_members_and_edges(spark):
    rows = [
        ("d", "k", None, "Order Service", True, False, None, None, "swimlane", 0),
        ("d", "k1", "k", "+ total : Long", True, False, None, None, "", 1),
        ("d", "k2", "k", "close()", True, False, None, None, "", 2),
        ("d", "p", None, "Item", True, False, None, None, "swimlane", 3),
        ("d", "p1", "p", "open()", True, False, None, None, "", 4),
        ("d", "e", None, "1 to many", False, True, "k1", "p", "endArrow=diamond", 5),
        ("d", "f", None, "", False, True, "k", "k1", "", 6),
        ("d", "x", None, "String name", True, False, None, None, "", 7),
    ]
    cells = spark.createDataFrame(rows, "diagram_id string, cell_id string, parent_id string, value string, vertex boolean, edge boolean, source_id string, target_id string, style string, ord int")
    types = diagrams.classify_diagrams(cells)
    assert types.first()["type"] == "CLASS_DIAGRAM"
    nodes = diagrams.diagram_nodes(cells, types)
    got = {r.label: (r.type, r.attributes, r.methods) for r in nodes.collect()}
    assert got == {"Order Service": ("class", ["+ total : Long"], ["close()"]), "Item": ("class", [], ["open()"])}
    e = diagrams.diagram_edges(cells, types, nodes).collect()
    assert [(r.source, r.target, r.relationship_type, r.label, r.source_multiplicity, r.target_multiplicity) for r in e] == [("Order Service", "Item", "aggregation", "aggregation one-to-many", "1", "many")]
    text = diagrams.diagram_sections(types, cells, nodes, diagrams.diagram_edges(cells, types, nodes)).first()["sections"]
    assert "| Order Service | Class | + total : Long |" in text and "| Order Service | aggregation one-to-many | Item |" in text


def test_state_diagram_marks(spark):
    rows = [
        ("s", "a", None, "", True, False, None, None, "ellipse;fillColor=#000000", 0),
        ("s", "b", None, "WAIT", True, False, None, None, "", 1),
        ("s", "c", None, "APPROVED", True, False, None, None, "", 2),
        ("s", "z", None, "", True, False, None, None, "shape=endState", 3),
        ("s", "e1", None, "", False, True, "a", "b", "", 4),
        ("s", "e2", None, "approve", False, True, "b", "c", "", 5),
        ("s", "e3", None, "", False, True, "c", "z", "", 6),
    ]
    cells = spark.createDataFrame(rows, "diagram_id string, cell_id string, parent_id string, value string, vertex boolean, edge boolean, source_id string, target_id string, style string, ord int")
    types = diagrams.classify_diagrams(cells)
    nodes = diagrams.diagram_nodes(cells, types)
    assert {(r.label, r.type) for r in nodes.collect()} == {("START", "state-start"), ("WAIT", "state"), ("APPROVED", "state"), ("END", "state-end")}
    edges = diagrams.diagram_edges(cells, types, nodes)
    assert diagrams.diagram_summary(types, cells, nodes, edges).first()["summary"] == "Workflow begins in WAIT and can move to WAIT, APPROVED."
