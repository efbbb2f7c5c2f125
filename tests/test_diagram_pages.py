"""Diagram files of several pages, and labels that hold a class's members."""

from pyspark.sql import functions as F

from leafmill.functions.text import clean_label
from leafmill.operators import diagrams


def page(name, *pairs):
    cells = "".join(f'<mxCell id="{i}" value="{v}" vertex="1" parent="1"/>' for i, v in (("a", pairs[0]), ("b", pairs[1])))
    return f'<diagram name="{name}"><mxGraphModel>{cells}<mxCell id="e" edge="1" source="a" target="b"/></mxGraphModel></diagram>'


def test_pages_of_a_file_are_diagrams_of_their_own(spark):
    two = f"<mxfile>{page('One', 'A', 'B')}{page('Two', 'C', 'D')}</mxfile>"
    df = spark.createDataFrame([("x.drawio", two), ("y.drawio", "<mxGraphModel><mxCell id='a' value='Z'/></mxGraphModel>"), ("z.drawio", '<mxfile><diagram name=" "/></mxfile>')], "diagram_id string, xml string")
    cells = diagrams.diagram_cells(df)
    types = diagrams.classify_diagrams(cells)
    edges = diagrams.diagram_edges(cells, types, diagrams.diagram_nodes(cells, types)).collect()
    assert sorted((e.diagram_id, e.source, e.target) for e in edges) == [("x.drawio", "A", "B"), ("x.drawio#page-1", "C", "D")]
    assert sorted((r.file_id, r.page_ix, r.diagram_name or "") for r in diagrams.diagram_pages(df).collect()) == [("x.drawio", 0, "One"), ("x.drawio", 1, "Two"), ("y.drawio", 0, ""), ("z.drawio", 0, "")]


def test_the_page_that_fits_the_file_name_is_analysed(spark):
    two = f"<mxfile>{page('One', 'A', 'B')}{page('Two', 'WAIT', 'APPROVED')}</mxfile>"
    rows = [("p/state.drawio", two), ("p/one.drawio", two), ("p/two.drawio", two), ("p/approved.drawio", two), ("p/x.drawio", two), ("p/empty.drawio", "<mxfile/>")]
    got = {r.diagram_id: (r.page_ix, r.diagram_name, r.type, r.node_count, r.edge_count) for r in diagrams.analyze_diagrams(spark.createDataFrame(rows, "diagram_id string, xml string")).collect()}
    second = (1, "Two", "STATE_DIAGRAM", 2, 1)
    assert got == {"p/state.drawio": second, "p/two.drawio": second, "p/approved.drawio": second, "p/one.drawio": (0, "One", "GENERIC_DIAGRAM", 2, 1), "p/x.drawio": (0, "One", "GENERIC_DIAGRAM", 2, 1), "p/empty.drawio": (0, None, "GENERIC_DIAGRAM", 0, 0)}
    assert diagrams.analyze_diagrams(spark.createDataFrame([], "diagram_id string, xml string")).collect() == []


def test_labels_keep_runs_of_blanks_unless_they_hold_markup(spark):
    raw = ["Invoice  +id: Long  +total()", "a&#10;b", "&lt;b&gt;A&lt;/b&gt;B&lt;br&gt; C   D", "x &lt; y  z", "&amp;lt;i&amp;gt;q&amp;lt;/i&amp;gt;", "  s  ", None]
    df = spark.createDataFrame([(v,) for v in raw], "v string").select(clean_label(F.col("v")))
    assert [r[0] for r in df.collect()] == ["Invoice  +id: Long  +total()", "a b", "AB C D", "x < y z", "q", "s", ""]


def test_members_in_a_class_label_are_split(spark):
    rows = [("d", "k", None, "Invoice  +id: Long  String name", True, False, None, None, "swimlane", 0), ("d", "m", None, "Order  +total()  +id: Long", True, False, None, None, "swimlane", 1), ("d", "n", "k", "close()", True, False, None, None, "", 2)]
    cells = spark.createDataFrame(rows, "diagram_id string, cell_id string, parent_id string, value string, vertex boolean, edge boolean, source_id string, target_id string, style string, ord int")
    got = {r.cell_id: (r.attributes, r.methods) for r in diagrams.class_members(cells).collect()}
    assert got["k"] == (["+id: Long", "String name"], ["close()"]) and got["m"] == (["+id: Long"], ["+total()"])


def test_class_diagrams_without_nodes_have_no_endpoints(spark):
    cells = spark.createDataFrame([("d", "a", None, "x()", True, False, None, None, "", 0)], "diagram_id string, cell_id string, parent_id string, value string, vertex boolean, edge boolean, source_id string, target_id string, style string, ord int")
    none = spark.createDataFrame([], "diagram_id string, label string")
    for kind, found in (("CLASS_DIAGRAM", 0), ("GENERIC_DIAGRAM", 1)):
        types = spark.createDataFrame([("d", kind)], "diagram_id string, type string")
        assert diagrams.resolve_endpoints(cells, types, none).count() == found
