"""Tokens of markup with missing ends against a plain stack parser, which looks through the whole stack at each tag."""

import random
import re

from leafmill.operators import markup
from leafmill.sources.files import load

TABLE = {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
GROUPS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
GROUPS |= {t: ({"td", "th"}, {"table"}) for t in ("td", "th")} | {"tr": ({"td", "th", "tr"}, {"table"})}
GROUPS |= {t: ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")}
AFTER_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split())
SCOPE = {"table", "td", "th", "caption", "button", "object"}


def ended(stack, tags, fence):
    low = len(stack)
    for i in range(len(stack) - 1, -1, -1):
        if stack[i] in fence:
            break
        if stack[i] in tags:
            low = i
    return stack[:low]


def plain(html):
    html = re.sub(r"(?s)<!--.*?-->", "", html)
    for t in ("script", "style"):
        html = re.sub(rf"(?is)<{t}\b.*?</{t}>", "", html)
    stack, out = [], []
    for raw in re.findall(r"(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>|[^<]+|<", html):
        m = re.match(r"(</?)([A-Za-z][^\s/>]*)", raw)
        if raw.startswith(("<!", "<?")):
            continue
        if not m:
            out.append(("text", None, len(stack)))
            continue
        tag = m[2].lower()
        if m[1] == "</":
            fence = set() if tag == "table" else {"table"} if tag in TABLE else {"td", "th", "caption"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == tag:
                    out.append(("close", tag, i + 1))
                    stack = stack[:i]
                    break
                if stack[i] in fence:
                    break
            continue
        if tag in GROUPS:
            stack = ended(stack, *GROUPS[tag])
        if tag in AFTER_P:
            stack = ended(stack, {"p"}, SCOPE)
        void = tag in markup.VOID or raw.endswith("/>")
        out.append(("void" if void else "open", tag, len(stack) + 1))
        stack = stack if void else [*stack, tag]
    return out


def found(df):
    out = {}
    for r in markup.raw_tokens(df).orderBy("page_id", "ix").collect():
        out.setdefault(r.page_id, []).append((r.kind, r.tag, r.depth))
    return out


def test_pages_equal_a_plain_parser(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    assert found(pages) == {r.page_id: plain(r.html) for r in pages.collect() if plain(r.html or "")}


def test_tag_soup_equals_a_plain_parser(spark):
    rng = random.Random(8)
    tags = "p div b a li ul ol table tr td th tbody thead caption br img hr dl dt dd select option h2 span BUTTON".split()
    soups = ["".join(rng.choice([f"<{t}>", f"<{t}>", f"</{t}>", "x", " < ", f"<{t} a='1'/>", "<!-- <p> -->"]) for t in rng.choices(tags, k=rng.randint(1, 120))) for _ in range(300)]
    soups += ["", "<p>a<p>b", "<td>x</b></td>", "<b><table><tr><td></b>y", "<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>"]
    df = spark.createDataFrame(list(enumerate(soups)) + [(-1, None)], "page_id long, html string")
    assert found(df) == {i: plain(s) for i, s in enumerate(soups) if plain(s)}


def test_literal_cases(spark):
    df = spark.createDataFrame([(1, "<ul><li>a<li>b</ul><p>c<table><tr><td>1<td>2<tr><td>3</table>d")], "page_id long, html string")
    tree = {r.ix: r for r in markup.nodes(markup.raw_tokens(df)).collect()}
    holders = {r.text: (tree[r.parent].tag if r.parent is not None else None, r.level) for r in tree.values() if r.kind == "text"}
    assert holders == {"a": ("li", 3), "b": ("li", 3), "c": ("p", 2), "1": ("td", 4), "2": ("td", 4), "3": ("td", 4), "d": (None, 1)}


def test_many_open_elements_take_linear_time(spark):
    df = spark.createDataFrame([(1, "<b>" * 200_000 + "</i>" * 200_000)], "page_id long, html string")
    assert markup.raw_tokens(df).agg({"depth": "max"}).first()[0] == 200_000
