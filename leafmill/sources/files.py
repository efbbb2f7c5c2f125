"""Sources and sinks: fixture tables, manifests, chunks, attachments, Markdown files and artifacts."""

from __future__ import annotations

import functools
import json
import os
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.operators.common import kept

MANIFEST_PAGE = "page_id bigint, title string, web_url string, markdown_extracted boolean, chunked boolean, vector_ingested boolean, last_error string, no_of_retries int"
MANIFEST = f"root_id bigint, version int, base_url string, created_at timestamp, updated_at timestamp, total_pages int, pages array<struct<{', '.join(c.replace(' ', ': ', 1) for c in MANIFEST_PAGE.split(', '))}>>"
CHUNK = "chunk_id string, root_id bigint, page_id bigint, heading_path string, chunk_index int, text string"
ATTACHMENT = "page_id bigint, file_name string, relative_path string, mime_type string, checksum string, detected_type string, detection_method string, status string, summary string, schema_version int"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, failed pages) of JSON lines. Blank lines are skipped; a line that is no JSON fails the page its file is named after."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1).alias("file_page"))
    rows = kept(lines.select("file_page", F.from_json("value", f"{CHUNK}, _corrupt_record string").alias("r")).select("file_page", "r.*"))  # parsed once for all that read them
    failed = rows.where("_corrupt_record is not null").select(F.expr("try_cast(file_page as bigint)").alias("page_id"), F.lit("unreadable chunk line").alias("last_error")).distinct()
    bad, good = failed.select("page_id").where("page_id is not null"), rows.where("_corrupt_record is null").drop("_corrupt_record", "file_page")
    return good if bad.isEmpty() else good.join(bad, "page_id", "left_anti"), failed


def replace_pages(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the pages that new rewrites, and new. Null keys are keys like others."""
    pages = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = functools.reduce(lambda x, y: x & y, [old[k].eqNullSafe(pages[f"_{k}"]) for k in keys])
    return old.join(pages, same, "left_anti").unionByName(new.select(*old.columns))


def write_version(df: DataFrame, path: str, partition: str | None = None, form: str = "parquet", **options) -> str:
    """Writes df as a new version folder under path and returns it; earlier versions stay readable."""
    target = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    writer = df.write.format(form).options(**options)
    (writer.partitionBy(partition) if partition else writer).save(target)
    return target


#: Rows that a bucket of a store holds at most, on average; a store that outgrows its buckets is dealt into at least twice as many.
BUCKET_ROWS = 1_000_000


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and its class of paths."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    return paths(path).getFileSystem(spark._jsc.hadoopConfiguration()), paths


def _below(spark: SparkSession, path: str) -> list[str]:
    store, paths = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(paths(path))) if store.exists(paths(path)) else []


def _pointers(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in _below(spark, f"{path}/_versions") if re.fullmatch(r"\d{10}\.json", n)]


def _state(spark: SparkSession, path: str, number: int) -> dict:
    store, paths = _file_system(spark, path)
    source = store.open(paths(f"{path}/_versions/{number:010}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def _publish(spark: SparkSession, path: str, number: int, state: dict) -> None:
    """Makes state the store's version `number` by a rename that fails if another writer has published that number."""
    store, paths = _file_system(spark, path)
    hidden, target = f"{path}/_versions/.{uuid.uuid4().hex}", f"{path}/_versions/{number:010}.json"
    out = store.create(paths(hidden))
    out.write(bytearray(json.dumps(state), "utf-8"))
    out.close()
    moves = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        moves.rename(paths(hidden), paths(target), spark._sc._gateway.new_array(kinds, 0))
    except Exception:
        store.delete(paths(hidden), False)
        raise


def _held(spark: SparkSession, path: str, state: dict, only: set[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets: other buckets' folders aren't even listed."""
    schema = StructType.fromJson(state["schema"]).add("bucket", "integer")
    found = [f"{path}/version={v}/bucket={b}" for b, v in state["parts"].items() if only is None or int(b) in only]
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", path).schema(StructType(schema.fields).add("version", "string")).parquet(*found)
    return rows.select(*schema.names)


def read_store(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame | None:
    """The last published version of a store, with its column `bucket`; None if there is none yet.

    keys: rows with the store's key columns; only the buckets that can hold them are read.
    """
    path = path.rstrip("/")
    numbers = _pointers(spark, path)
    if not numbers:
        return None
    state = _state(spark, path, numbers[-1])
    return _held(spark, path, state, None if keys is None else _touched(_bucketed(_typed(keys.select(*state["keys"]), state), state)))


def _typed(rows: DataFrame, state: dict) -> DataFrame:
    """rows with the store's types, on which hashes depend, in the order of its columns."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromJson(state["schema"]) if f.name in rows.columns])


def _bucketed(rows: DataFrame, state: dict) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int"))


def _touched(rows: DataFrame) -> set[int]:
    """At most as many numbers as the store has buckets."""
    return {r["bucket"] for r in rows.select("bucket").distinct().collect()}


def _latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    cols = [c for c in rows.columns if c not in keys and c != "bucket"]
    return rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*[F.col("r")[c].alias(c) if c in cols else F.col(c) for c in rows.columns])


def upsert_store(new: DataFrame, path: str, keys: list[str], latest: str | None = None, bucket_rows: int = BUCKET_ROWS) -> None:
    """Replaces in the store at path the rows with the keys of new by the rows of new; latest: of all rows with one key, the store's too, the
    one with the greatest such column stays.

    Rows lie in hash buckets of the keys, so that no key that many rows share in part (a root) is one folder. Only buckets that new touches
    are read, and written into a new version folder; a numbered pointer names the folder of each bucket. It is published last, by a rename:
    until then readers, and all after a write that failed, see the version before, whole. Of two writers that began from one version the second fails and may
    call again. The number of buckets is a power of two that grows with the store: if they hold more than bucket_rows rows on average, the
    store is dealt anew, which happens once in a doubling. The same call again gives the same rows. See vacuum for what old versions leave.
    """
    spark, path = new.sparkSession, path.rstrip("/")
    numbers = _pointers(spark, path)
    state = _state(spark, path, numbers[-1]) if numbers else {"schema": json.loads(new.schema.json()), "keys": keys, "buckets": 1, "parts": {}, "rows": {}}
    if state["keys"] != keys:
        raise ValueError(f"the store's keys are {state['keys']}, not {keys}")
    store, paths = _file_system(spark, path)
    waiting = f"{path}/_write-{uuid.uuid4().hex}"
    try:
        _typed(new, state).write.parquet(waiting)  # counted and asked for its buckets before it is written
        _commit(spark.read.schema(StructType.fromJson(state["schema"])).parquet(waiting), path, state, numbers[-1] if numbers else 0, latest, bucket_rows)
    finally:
        store.delete(paths(waiting), True)


def _commit(new: DataFrame, path: str, before: dict, number: int, latest: str | None, bucket_rows: int) -> None:
    """Version number + 1 of the store: version `number`, which is `before`, with the rows of new."""
    spark, keys, count = new.sparkSession, before["keys"], new.count()
    if number and not count:
        return
    total = sum(before["rows"].values()) + count
    anew = total > before["buckets"] * bucket_rows
    state = {**before, "buckets": 1 << (2 * total // bucket_rows).bit_length() if anew else before["buckets"]}
    new = _bucketed(new, state)
    if before["parts"]:
        old = _held(spark, path, before) if anew else _held(spark, path, before, _touched(new))
        old = _bucketed(old.drop("bucket"), state)
        new = old.unionByName(new) if latest else replace_pages(old, new, ["bucket", *keys])
    if latest:
        new = _latest(new, keys, latest)
    version = uuid.uuid4().hex
    folder, parts, rows = f"{path}/version={version}", {}, {}
    if count:
        new.repartition("bucket").sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(folder)
        counts = spark.read.schema("bucket int").parquet(folder).groupBy("bucket").count().collect()  # from the files' footers
        parts, rows = {str(r["bucket"]): version for r in counts}, {str(r["bucket"]): r["count"] for r in counts}
    if not anew:
        parts, rows = {**before["parts"], **parts}, {**before["rows"], **rows}
    _publish(spark, path, number + 1, {**state, "parts": parts, "rows": rows})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes all that the last `keep` versions of a store don't need and returns the names of the deleted folders and pointers.

    Call it when no reader of older versions and no writer is at work: a writer's folder that isn't published yet goes too.
    """
    path = path.rstrip("/")
    store, paths = _file_system(spark, path)
    numbers = _pointers(spark, path)
    used = {f"version={v}" for n in numbers[-keep:] for v in _state(spark, path, n)["parts"].values()}
    gone = [f"_versions/{n:010}.json" for n in numbers[:-keep]] + [n for n in _below(spark, path) if n.startswith(("version=", "_write-")) and n not in used]
    for name in gone:
        store.delete(paths(f"{path}/{name}"), True)
    return gone


def write_chunks(new: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """Chunks of the pages of new in place of those that the store has of these pages."""
    upsert_store(new, path, ["root_id", "page_id"], bucket_rows=bucket_rows)


def write_vectors(new: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """The collection: vectors(chunk_id, ...) in place of those with their chunk_id; of several new rows with one the latest stays where
    there is a column `batch`, else the largest."""
    cols = [c for c in new.columns if c != "chunk_id"]
    row = F.struct(*sorted(cols, key=lambda c: c != "batch"))
    one = new.groupBy("chunk_id").agg(F.max(row).alias("r")).select("chunk_id", *[F.col("r")[c].alias(c) for c in cols])
    upsert_store(one, path, ["chunk_id"], bucket_rows=bucket_rows)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per page of manifests that hold a pages array."""
    return read_json(spark, path, MANIFEST).selectExpr("root_id", "inline(pages)")


def manifest_documents(pages: DataFrame, version: int = 1) -> DataFrame:
    """A document per root with the recomputed number of pages, as JSON can hold it."""
    cols = [c.split(" ")[0] for c in MANIFEST_PAGE.split(", ")]
    held = F.array_sort(F.collect_list(F.struct(*cols)))
    return pages.groupBy("root_id").agg(F.count("*").cast("int").alias("total_pages"), held.alias("pages")).withColumn("version", F.lit(version)).withColumn("updated_at", F.current_timestamp())


def write_manifest(pages: DataFrame, path: str) -> str:
    """A JSON file per root."""
    return write_version(manifest_documents(pages), path, form="json", maxRecordsPerFile=1)


def write_files(files: DataFrame, path: str) -> None:
    """A file below path per row of files(name, content), for layouts that other programs read; name is a relative path, content binary.

    Tasks write each file under another name and then move it, so that readers see whole files only and a task that runs again gives the
    same ones. Of rows with one name any may stay. A null content is an empty file; a name that is null, empty or leads out of path fails.
    """
    root = re.sub("^file:/+", "/", path).rstrip("/")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for part in parts:
            for name, content in zip(part.column("name").to_pylist(), part.column("content")):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"no name of a file below the folder: {name!r}")
                target = posixpath.join(base, name)
                folder = posixpath.dirname(target)
                store.create_dir(folder, recursive=True)
                hidden = posixpath.join(folder, f".{uuid.uuid4().hex}")
                with store.open_output_stream(hidden, compression=None) as out:
                    out.write(content.as_buffer() or b"")
                store.move(hidden, target)
            yield pa.record_batch({"n": pa.array([part.num_rows], pa.int64())})

    files.selectExpr("cast(name as string) as name", "cast(content as binary) as content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_pages(pages: DataFrame, path: str) -> None:
    """{root_id}/{page_id}/{page_id}.md with the Markdown of pages(root_id, page_id, md, ...), beside it metadata.json with the other columns.

    Null columns are left out of the metadata, so that page_documents' empty lists are.
    """
    folder = F.concat_ws("/", F.col("root_id").cast("string"), F.col("page_id").cast("string"))
    text = pages.select(F.concat(folder, F.lit("/"), F.col("page_id").cast("string"), F.lit(".md")).alias("name"), F.encode("md", "UTF-8").alias("content"))
    meta = F.to_json(F.struct(*[c for c in pages.columns if c != "md"]))
    write_files(text.unionByName(pages.select(F.concat(folder, F.lit("/metadata.json")).alias("name"), F.encode(meta, "UTF-8").alias("content"))), path)


def _located(path: str) -> tuple[str, str]:
    """What a path has before its folders ('file:', 'hdfs://host'), and the rest."""
    found = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*:)(//[^/]*)?(/.*)", path.rstrip("/"))
    scheme, host, rest = found.groups("") if found else ("file:", "", os.path.abspath(path))
    return scheme + ("" if host == "//" else host), re.sub("^/+", "/", rest)


def _opened(prefix: str, path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if prefix == "file:" else prefix + path)


def _entries(prefix: str, folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """(name, is a folder, length, time) of what lies in a folder; of a file itself with an empty name."""
    store, base = _opened(prefix, folder)
    if isinstance(store, fs.LocalFileSystem) and os.path.isdir(base):
        with os.scandir(base) as found:  # handed on one by one, however many there are
            for e in found:
                yield e.name, e.is_dir(), e.stat().st_size, e.stat().st_mtime
        return
    here = store.get_file_info(base)
    for e in [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base)):
        yield "" if e is here else e.base_name, e.type == fs.FileType.Directory, e.size or 0, e.mtime.timestamp()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of the files at or below path, but empty ones and those whose or whose folder's name begins with . or _
    (with = in it, only .).

    path may end in parts with * and ?, which then must fit. Tasks list the folders, a job a level, so that no list of files goes through
    the driver, as Spark's own readers have it.
    """
    prefix, whole = _located(path)
    parts = whole.split("/")
    fixed = next((i for i, x in enumerate(parts) if re.search(r"[*?\[{]", x)), len(parts))
    if re.search(r"[\[{]", "/".join(parts[fixed:])):
        raise ValueError(f"only * and ? are read as patterns: {path}")
    wanted = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in "/".join(["", *parts[fixed:]]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        pack = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                for name, is_dir, length, time in _entries(prefix, folder):
                    if not (name.startswith(".") or (name.startswith("_") and "=" not in name)) and (is_dir or length):
                        rows.append((posixpath.join(folder, name) if name else folder, is_dir, int(time * 1e6), length))
                    if len(rows) >= 10_000:
                        yield pack()
                        rows.clear()
        if rows:
            yield pack()

    names, kinds = ["folder", "is_dir", "modificationTime", "length"], [pa.string(), pa.bool_(), pa.timestamp("us", "UTC"), pa.int64()]
    folders, found, count = spark.createDataFrame([("/".join(parts[:fixed]) or "/",)], "folder string"), [], 1
    while count:
        here = kept(_dealt(folders, count).mapInArrow(look, "folder string, is_dir boolean, modificationTime timestamp, length long"))
        found.append(here.where("not is_dir"))
        folders = here.where("is_dir").select("folder")
        count = folders.count()
    rows = functools.reduce(DataFrame.union, found)
    fits = F.col("folder").substr(F.lit(len("/".join(parts[:fixed])) + 1), F.length("folder")).rlike(f"^{wanted}(/.*)?$")
    return rows.where(fits).select(F.concat(F.lit(prefix), "folder").alias("path"), "modificationTime", "length")


def _dealt(rows: DataFrame, count: int) -> DataFrame:
    """rows, of which there are `count`, dealt out for work on files."""
    return rows.repartition(max(1, min(-(-count // 200), 4 * rows.sparkSession.sparkContext.defaultParallelism)))


def read_contents(files: DataFrame) -> DataFrame:
    """files(path, ...) of list_files with `content`, read by tasks, some megabytes at a time."""
    files = kept(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, size = 0, [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                store, base = _opened(*_located(path))
                with store.open_input_stream(base, compression=None) as source:
                    held.append(source.read())
                size += len(held[-1])
                if size > 8_000_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                    begin, held, size = i + 1, [], 0

    return _dealt(files, files.count()).mapInArrow(read, ", ".join(f"`{n}` {t}" for n, t in [*files.dtypes, ("content", "binary")]))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of files below path that hold a JSON object, or an array of some, each."""
    held = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)
    return read_contents(list_files(spark, path)).select(F.inline(F.from_json(F.col("content").cast("string"), f"array<struct<{held}>>")))


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the attachment files under path, but table artifacts, JSON and empty files."""
    return read_contents(list_files(spark, path).where(~F.col("path").contains("/tables/") & ~F.lower("path").endswith(".json")))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, md): {id}.md of a page's folder, else its page.md. Empty files have no row."""
    named = list_files(spark, path).where(F.col("path").endswith(".md")).withColumn("page", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("legacy", F.col("path").endswith("/page.md"))
    named = named.where(F.col("legacy") | F.col("path").endswith(F.concat(F.lit("/"), F.col("page"), F.lit(".md"))))
    best = named.groupBy("page").agg(F.min(F.struct("legacy", "path")).alias("first")).select("page", "first.path")  # chosen before any is read
    return read_contents(best).select(F.expr("try_cast(page as bigint)").alias("page_id"), F.col("content").cast("string").alias("md"))


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """Attachment rows of per-page manifests; of rows with one relative path the last stays."""
    rows = read_json(spark, path, f"attachments array<struct<{', '.join(c.replace(' ', ': ', 1) for c in ATTACHMENT.split(', '))}>>")
    placed = rows.select(F.posexplode("attachments")).select("pos", "col.*")
    last = placed.groupBy("page_id", "relative_path").agg(F.max_by(F.struct(*[c for c in placed.columns if c not in ("pos", "page_id", "relative_path")]), "pos").alias("r"))
    return last.select("page_id", "relative_path", "r.*")


def write_attachments(new: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """Attachments of the pages of new in place of those that the store has of these pages."""
    upsert_store(new, path, ["page_id"], bucket_rows=bucket_rows)


def artifacts(df: DataFrame, keys: list[str]) -> DataFrame:
    """A JSON text per row of df, beside its keys."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("value"))


def write_artifacts(df: DataFrame, kind: str, path: str) -> str:
    """Rows as JSON lines, a folder per page with one file, in a new version folder, which is returned; see read_artifacts.

    Tasks write a page's lines one after another and move the file when it is whole, so that no folder of a page is known to the driver.
    """
    target = f"{path.rstrip('/')}/{kind}/v-{uuid.uuid4().hex}"
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = artifacts(df, ["page_id"]).select(page.alias("page"), "value")
    prefix, whole = _located(target)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(prefix, whole)
        at, out, hidden, n = None, None, "", 0

        def end() -> None:
            if out:
                out.close()
                store.move(hidden, posixpath.join(base, f"page={at}", "lines.txt"))

        for batch in batches:
            for name, value in zip(batch.column("page").to_pylist(), batch.column("value").to_pylist()):
                if name != at:
                    end()
                    at, hidden = name, posixpath.join(base, f"page={name}", f".{uuid.uuid4().hex}")
                    store.create_dir(posixpath.dirname(hidden), recursive=True)
                    out = store.open_output_stream(hidden, compression=None)
                out.write(f"{value}\n".encode())
                n += 1
        end()
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    rows.repartition("page").sortWithinPartitions("page").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return target


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(value): the JSON lines of a folder that write_artifacts made."""
    lines = F.explode(F.split(F.col("content").cast("string"), "\n"))
    return read_contents(list_files(spark, path)).select(lines.alias("value")).where("value <> ''")


def page_documents(pages: DataFrame, **parts: DataFrame) -> DataFrame:
    """pages with an array column per part (DataFrames with page_id), in the order of the parts' rows; null where a page has none."""
    out = pages
    for name, df in parts.items():
        cols = [c for c in df.columns if c != "page_id"]
        out = out.join(df.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), "page_id", "left")
    return out
