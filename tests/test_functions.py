"""Column functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as fn


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("target", "want"), [("123", "123"), (" 7 ", "7"), ("http://w/x?pageId=42&a=1", "42"), ("http://w/spaces/K/pages/99/T", "99"), ("KEY", None), (None, None)])
def test_page_id(spark, target, want):
    assert value(spark, fn.page_id_of(F.col("t")), t=target) == want


@pytest.mark.parametrize(("name", "want"), [("a.PNG", "png"), ("a.", ""), ("a", ""), ("a.b.c", "c"), (None, "")])
def test_extension(spark, name, want):
    assert value(spark, fn.extension(F.col("n")), n=name) == want


@pytest.mark.parametrize(("name", "want"), [("a:b/c", "a_b_c"), ("  ", "attachment"), (None, "attachment"), (" x ", "x")])
def test_safe_name(spark, name, want):
    assert value(spark, fn.safe_name(F.col("n")), n=name) == want


@pytest.mark.parametrize(("src", "want"), [("/download/attachments/1/2/a%20b.png?v=1", None), ("/attachments/1/2/a%20b.png?v=1", "a b.png"), ("http://h/p/c.png?x=1", "c.png?x=1")])
def test_src_name(spark, src, want):
    want = "a b.png" if want is None else want
    assert value(spark, fn.src_name(F.col("s")), s=src) == want


@pytest.mark.parametrize(("attr", "want"), [("2", 2), ("0", 1), ("-3", 1), ("x", 1), (" ", 1), (None, 1)])
def test_span(spark, attr, want):
    assert value(spark, fn.span(F.col("a")), a=attr) == want


@pytest.mark.parametrize(("text", "n", "want"), [("abc", 3, "abc"), ("abcd", 3, "abc..."), (None, 3, "")])
def test_truncate(spark, text, n, want):
    assert value(spark, fn.truncate(F.col("t"), n), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("&lt;b&gt;A&lt;/b&gt; x", "A x"), (" a \n b ", "a b"), ("<i>q</i>", "q"), (None, "")])
def test_clean_label(spark, text, want):
    assert value(spark, fn.clean_label(F.col("t")), t=text) == want


@pytest.mark.parametrize(("label", "want"), [("0..*", True), ("many", True), ("one to", False), (None, False)])
def test_multiplicity(spark, label, want):
    assert value(spark, fn.is_multiplicity(F.col("t")), t=label) is want


@pytest.mark.parametrize(("label", "want"), [("name : String", True), ("- count : Integer", True), ("String name", True), ("Service", False), ("run()", False)])
def test_attribute(spark, label, want):
    assert value(spark, fn.is_attribute(F.col("t")), t=label) is want


@pytest.mark.parametrize(("content", "want"), [(b"\x89PNG1234", "image/png"), (b"\xff\xd8\x00\x00", "image/jpeg"), (b"GIF89a", "image/gif"), (b"RIFF0000WEBP", "image/webp"), (b"%PDF-", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"xx", None), (b"abcd", None)])
def test_magic(spark, content, want):
    assert value(spark, fn.mime_by_magic(F.col("c")), c=content) == want


def test_score_and_lists(spark):
    df = spark.createDataFrame([(None, 0.25), (0.5, 0.1), (None, None), (None, 3.0)], "s double, d double")
    assert [r[0] for r in df.select(fn.score_of(F.col("s"), F.col("d"))).collect()] == [0.75, 0.5, None, 0.0]
    df = spark.createDataFrame([(["a", " "], ["b"]), ([], None), (None, None)], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(fn.join_lists(F.col("x"), F.col("y"))).collect()] == ["a; b", None, None]
    df = spark.createDataFrame([("table",), (" Photo ",), ("zzz",), (None,)], "l string")
    assert [r[0] for r in df.select(fn.vision_type(F.col("l"))).collect()] == ["TABLE_IMAGE", "PHOTO", "UNKNOWN", "UNKNOWN"]


def test_urls_and_titles(spark):
    df = spark.createDataFrame([("/x", "1"), ("http://a/b", "1"), (None, "9")], "p string, i string")
    assert [r[0] for r in df.select(fn.web_url(F.lit("http://w/"), F.col("p"), F.col("i"))).collect()] == ["http://w/x", "http://a/b", "http://w/pages/viewpage.action?pageId=9"]
    df = spark.createDataFrame([("T", "P"), (None, " "), ("T", None)], "t string, p string")
    assert [r[0] for r in df.select(fn.hit_title(F.col("t"), F.col("p"))).collect()] == ["T › P", "Untitled", "T"]
