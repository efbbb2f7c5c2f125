"""Sources and sinks: what is written comes back."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.sources import files


def test_chunks_round_trip_and_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7.jsonl").write_text('{"chunk_id": "7-0", "root_id": 1, "page_id": 7, "heading_path": "", "chunk_index": 0, "text": "a"}\n\n')
    (tmp_path / "in" / "8.jsonl").write_text('{"chunk_id": "8-0", "root_id": 1, "page_id": 8, "chunk_index": 0, "text": "b"}\n{broken\n')
    good, failed = files.read_chunks(spark, str(tmp_path / "in"))
    assert [r.chunk_id for r in good.collect()] == ["7-0"] and [r.page_id for r in failed.collect()] == [8]
    old = spark.createDataFrame([("7-0", 1, 7, "", 0, "old"), ("7-1", 1, 7, "", 1, "old"), ("9-0", 1, 9, "", 0, "kept")], files.CHUNK)
    path = str(tmp_path / "out")
    assert files.read_store(spark, path) is None
    files.write_chunks(old, path)
    other = spark.createDataFrame([("5-0", 2, 5, "", 0, "other root")], files.CHUNK)
    files.write_chunks(other, path)
    for _ in range(2):  # the same write again changes nothing
        files.write_chunks(good, path)
        assert sorted((r.chunk_id, r.text) for r in files.read_store(spark, path).collect()) == [("5-0", "other root"), ("7-0", "a"), ("9-0", "kept")]


def test_vectors_latest_of_repeated_rows_stays(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([("a", [1.0], 1), ("a", [2.0], 3), ("a", [3.0], 2), ("b", None, 1)], "chunk_id string, embedding array<float>, batch int")
    files.write_vectors(rows, path)
    files.write_vectors(rows.where("chunk_id = 'b'").withColumn("batch", F.lit(7)), path)
    assert sorted((r.chunk_id, r.embedding, r.batch) for r in files.read_store(spark, path).collect()) == [("a", [2.0], 3), ("b", None, 7)]


def test_manifest_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, "t", None, True, False, False, None, 0), (1, 3, "u", "x", False, False, False, "e", 2), (4, 5, "v", "y", False, True, False, None, 1)], f"root_id bigint, {files.MANIFEST_PAGE}")
    path = files.write_manifest(pages, str(tmp_path / "m"))
    back = files.read_manifest(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, pages.collect()), key=str)


def test_attachments_last_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"attachments": [{"page_id": 1, "relative_path": "x", "summary": "old"}, {"page_id": 1, "relative_path": "x", "summary": "new"}]}')
    assert [(r.relative_path, r.summary) for r in files.read_attachments(spark, str(tmp_path)).collect()] == [("x", "new")]


def test_markdown_prefers_the_page_file(spark, tmp_path):
    for page, name, text in (("5", "5.md", "new"), ("5", "page.md", "old"), ("6", "page.md", "legacy"), ("6", "other.md", "no")):
        (tmp_path / page).mkdir(exist_ok=True)
        (tmp_path / page / name).write_text(text)
    assert sorted((r.page_id, r.md) for r in files.read_markdown(spark, str(tmp_path)).collect()) == [(5, "new"), (6, "legacy")]


def test_assets_without_tables(spark, tmp_path):
    for name in ("p/a.png", "p/tables/t.txt", "p/b.json"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    assert [r.path.rpartition("/")[2] for r in files.read_assets(spark, str(tmp_path)).collect()] == ["a.png"]


def test_page_documents(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    tables = spark.createDataFrame([(1, "table-1"), (1, "table-2")], "page_id long, table_id string")
    rows = {r.page_id: r.tables for r in files.page_documents(pages, tables=tables).collect()}
    assert [t.table_id for t in rows[1]] == ["table-1", "table-2"] and rows[2] is None
    assert [r.value for r in files.artifacts(tables, ["page_id"]).orderBy("value").collect()] == ['{"page_id":1,"table_id":"table-1"}', '{"page_id":1,"table_id":"table-2"}']


def _ids(df):
    return sorted((r.id, r.v) for r in df.collect())


def test_a_store_grows_its_buckets_and_reads_the_touched_ones_only(spark, tmp_path):
    path = str(tmp_path / "s")
    want = {}
    for low, high, v in ((0, 50, 1), (40, 90, 2), (60, 500, 3), (7, 9, 4)):
        files.upsert_store(spark.range(low, high).withColumn("v", F.lit(v)), path, ["id"], bucket_rows=40)
        want |= {i: v for i in range(low, high)}
        assert _ids(files.read_store(spark, path)) == sorted(want.items())
    state = files._state(spark, path, 4)
    assert state["buckets"] >= 16 and state["buckets"] & (state["buckets"] - 1) == 0 and sum(state["rows"].values()) == 500
    parts = {b: v for b, v in files._state(spark, path, 3)["parts"].items() if v != state["parts"][b]}
    assert 1 <= len(parts) <= 2 and len(set(state["parts"].values())) == 2  # two keys were written, the other buckets are where they were
    some = files.read_store(spark, path, spark.createDataFrame([(7,)], "id int"))  # as the store's type, whatever the caller's
    assert len(some.inputFiles()) == 1 and (7, 4) in _ids(some)
    assert files.read_store(spark, path, spark.createDataFrame([], "id long")).collect() == []
    with pytest.raises(ValueError, match="keys"):
        files.upsert_store(spark.range(1).withColumn("v", F.lit(1)), path, ["v"])
    gone = files.vacuum(spark, path)
    assert len([n for n in gone if n.startswith("_versions")]) == 3 and len(gone) > 3
    assert _ids(files.read_store(spark, path)) == sorted(want.items()) and files.vacuum(spark, path) == []


def test_a_write_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    files.upsert_store(spark.range(20).withColumn("v", F.lit(1)), path, ["id"], bucket_rows=4)
    old = files.read_store(spark, path)
    new = spark.range(10, 30).withColumn("v", F.lit(2))
    with monkeypatch.context() as m:
        m.setattr(files, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            files.upsert_store(new, path, ["id"], bucket_rows=4)
    assert _ids(files.read_store(spark, path)) == [(i, 1) for i in range(20)]
    files.upsert_store(new, path, ["id"], bucket_rows=4)
    assert _ids(files.read_store(spark, path)) == [(i, 1 if i < 10 else 2) for i in range(30)]
    assert _ids(old) == [(i, 1) for i in range(20)]  # a reader of the version before still has it
    with pytest.raises(Exception, match="exist"):  # another writer was faster
        files._publish(spark, path, 2, files._state(spark, path, 2))


def test_null_keys_empty_writes_and_latest_rows(spark, tmp_path):
    path, kind = str(tmp_path / "s"), "id long, v int"
    files.upsert_store(spark.createDataFrame([], kind), path, ["id"])
    assert files.read_store(spark, path).columns == ["id", "v", "bucket"] and files.read_store(spark, path).count() == 0
    for _ in range(2):
        files.upsert_store(spark.createDataFrame([(None, 1), (1, 1), (1, 2)], kind), path, ["id"])
        assert sorted((str(r.id), r.v) for r in files.read_store(spark, path).collect()) == [("1", 1), ("1", 2), ("None", 1)]
    files.upsert_store(spark.createDataFrame([(None, 0), (1, 3), (2, None)], kind), path, ["id"], latest="v")
    assert sorted((str(r.id), r.v or -1) for r in files.read_store(spark, path).collect()) == [("1", 3), ("2", -1), ("None", 1)]


def test_files_are_written_whole_and_again(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.bin", b"\x00\xff"), ("a/c d.txt", None), ("e.txt", b"x" * 3_000_000)], "name string, content binary")
    for _ in range(2):
        files.write_files(rows, f"file:{tmp_path}")
        held = {str(f.relative_to(tmp_path)): f.read_bytes() for f in tmp_path.rglob("*") if f.is_file()}
        assert held == {"a/b.bin": b"\x00\xff", "a/c d.txt": b"", "e.txt": b"x" * 3_000_000}
    files.write_files(rows.limit(0), str(tmp_path / "none"))
    for bad in (None, "", "/x", "a/../../x"):
        with pytest.raises(Exception, match="no name of a file"):
            files.write_files(spark.createDataFrame([(bad, b"x")], rows.schema), str(tmp_path))


def test_page_files_leave_empty_lists_out(spark, tmp_path):
    pages = spark.createDataFrame([(1, 5, "# a", "t"), (1, 6, None, None)], "root_id long, page_id long, md string, title string")
    tables = spark.createDataFrame([(5, "table-1", True)], "page_id long, id string, complex boolean")
    files.write_pages(files.page_documents(pages, tables=tables), str(tmp_path))
    assert json.loads((tmp_path / "1/5/metadata.json").read_text()) == {"root_id": 1, "page_id": 5, "title": "t", "tables": [{"id": "table-1", "complex": True}]}
    assert json.loads((tmp_path / "1/6/metadata.json").read_text()) == {"root_id": 1, "page_id": 6}
    assert sorted((r.page_id, r.md) for r in files.read_markdown(spark, str(tmp_path)).collect()) == [(5, "# a")]  # page 6 is an empty file
