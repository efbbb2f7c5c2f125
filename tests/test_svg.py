"""Texts of SVG elements."""

from leafmill.operators import attachments


def test_text_is_all_that_an_element_holds(spark):
    rows = [
        (1, '<?xml version="1.0"?><svg id=" s "><title> T </title><title>U</title><desc>d</desc><text id="t">a<tspan>b</tspan>c</text><text>a\nb</text><text> </text></svg>'),
        (2, "<svg><text>q</text><g><text>r<tspan>r</tspan></text><text>q</text></g></svg>"),
        (3, "<svg><title></title><title>late</title></svg>"),
        (4, "<svg>" + "".join(f"<text>n{i}</text>" for i in range(10)) + "</svg>"),
    ]
    got = {r.page_id: r for r in attachments.svg_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert (got[1].title, got[1].description, got[1].ids, got[1].visible_text, got[1].summary) == ("T", "d", ["s", "t"], ["abc", "a b", "b"], "SVG diagram: T")
    assert (got[2].visible_text, got[2].summary) == (["q", "rr", "r"], "SVG diagram: q, rr, r")
    assert (got[3].title, got[3].visible_text, got[3].summary) == ("", None, "SVG diagram")
    assert got[4].summary == "SVG diagram: " + ", ".join(f"n{i}" for i in range(8)) and len(got[4].visible_text) == 10
