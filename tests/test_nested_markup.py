"""Rendering of nested elements, and tables at any depth."""

from leafmill.operators import markup

PAGES = "page_id long, title string, html string"
CASES = [
    ('<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">java</ac:parameter><ac:plain-text-body><![CDATA[ int  x; ]]></ac:plain-text-body></ac:structured-macro>', "```\nint  x;\n```"),
    ('<ac:structured-macro ac:name="info"><ac:rich-text-body><p>Take <strong> care </strong></p></ac:rich-text-body></ac:structured-macro>', "Take **care**"),
    ('<p>See <ac:link><ri:page ri:content-title="Home"/></ac:link>.</p>', "See Home."),
    ('<p><ac:link><ri:page ri:content-title="Home"/><ac:plain-text-link-body><![CDATA[there]]></ac:plain-text-link-body></ac:link></p>', "there"),
    ('<p><a>plain</a> <a href=" ">b</a> <a href="http://u"></a> <a href="http://v"> v </a></p>', "plain b [http://u](http://u) [v](http://v)"),
    ("<p><em> a </em><i>b <b> c </b></i></p>", "*a**b **c***"),
    ("<p>2 ** 3 and <b>x</b></p>", "2 ** 3 and **x**"),
    ("<p><code> a  b<br/>c </code></p>", "`a b c`"),
    ('<p><ac:image><ri:attachment ri:filename="a:b?.png"/></ac:image></p>', "![a_b_.png](assets/a_b_.png)"),
    ("<ac:image><ri:url/></ac:image>", "![image](assets/image)"),
    ('<p><img src="x.png"/></p><p>y</p>', "y"),
    ("<ul><li>a<ul><li>b</li></ul></li><li> <strong>c</strong> </li></ul><ol><li>x</li><li>y</li></ol>", "- ab\n- **c**\n\n1. x\n2. y"),
    ("<pre> a\n b </pre>", "```\na\n b\n```"),
    ("<blockquote>q1<br/>q2</blockquote><h3></h3><hr/>", "> q1\n> q2\n\n### \n\n---"),
    ('<div><p>before</p><table><tr><td colspan="2">w</td></tr><tr><td>1</td><td>2</td></tr></table></div>', "before[TABLE:table-1](assets/tables/table-1.json)"),
    ("<table><tr><th>A<b>B</b></th><th>C</th></tr><tr><td>1<p>2</p></td><td>a|b</td></tr></table>", "| AB | C |\n| --- | --- |\n| 1 2 | a\\|b |"),
    ("<ac:layout><ac:layout-cell><table><tr><td>1</td></tr></table></ac:layout-cell></ac:layout>", "1"),
    ("<table><tr><td><table><tr><td>in</td></tr></table></td></tr></table>", "[TABLE:table-1](assets/tables/table-1.json)"),
]


def test_elements_are_rendered_with_what_they_hold(spark):
    df = spark.createDataFrame([(i, None, html) for i, (html, _) in enumerate(CASES)], PAGES)
    got = {r.page_id: r.md for r in markup.markdown(df).collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][1]] == []


def test_tables_at_any_depth(spark):
    wide = '<table><caption> Wide </caption><tr><td colspan="2">w</td></tr><tr><td>1</td><td>2</td></tr></table>'
    html = f"<div>{wide}</div><table><tr><td>a</td><td>{wide}</td></tr></table><ac:layout><ac:layout-section>{wide}</ac:layout-section></ac:layout><table><tr><td>s</td></tr></table>"
    rows = markup.extract_tables(markup.tokens(spark.createDataFrame([(1, html)], "page_id long, html string"))).orderBy("table_id").collect()
    texts = [(r.table_id, r.row_count, r.column_count, r.caption, [[c.text for c in row] for row in r.rows]) for r in rows]
    own = [["w"], ["1", "2"]]
    assert texts == [
        ("table-1", 2, 2, "Wide", own),
        ("table-2", 3, 6, "Wide", [["a", "Wide w 1 2", "w", "1", "2"], ["w"], ["1", "2"]]),
        ("table-3", 2, 2, "Wide", own),
        ("table-4", 2, 2, "Wide", own),
    ]
    assert [r.rows[1][1].text for r in rows if r.table_id == "table-1"] == ["2"] and rows[0].rows[0][0].colspan == 2


def test_parents_of_nodes(spark):
    df = spark.createDataFrame([(1, "<p>a<b>c<i/></b>d</p><hr/>")], "page_id long, html string")
    got = {r.ix: (r.parent, r.level, r.tag, r.text) for r in markup.nodes(markup.tokens(df)).collect()}
    assert got == {0: (None, 1, "p", None), 1: (0, 2, None, "a"), 2: (0, 2, "b", None), 3: (2, 3, None, "c"), 4: (2, 3, "i", None), 6: (0, 2, None, "d"), 8: (None, 1, "hr", None)}


def test_empty_pages(spark):
    assert markup.markdown(spark.createDataFrame([], PAGES)).collect() == []
    assert [r.md for r in markup.markdown(spark.createDataFrame([(1, None, None), (2, "T", " ")], PAGES)).orderBy("page_id").collect()] == ["", "# T"]
