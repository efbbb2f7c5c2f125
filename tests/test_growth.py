"""Steps whose time or traffic must not grow faster than their input."""

import os

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from leafmill.operators import chunks, markup, vectors
from leafmill.operators.common import shared_dir
from leafmill.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def checkpoints(spark):
    return shared_dir(spark).removeprefix("file:")


def test_outlines_are_made_before_any_shuffle(spark):
    html = "<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table></p><P x='1'>c<br><1a>d</1a><![CDATA[e]]><!-- f --></p>"
    toks = markup.tokens(spark.createDataFrame([(1, html), (2, None), (3, "x")], "page_id long, html string"))
    assert "Exchange" not in plan(markup.nodes(toks)) and "Exchange" not in plan(markup._levels(toks))
    bare = toks.select("page_id", "ix", "kind", "tag", "attrs", "text", "depth")  # from these, parents and levels come by windows
    same = lambda x, y: sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.select(*x.columns).collect()), key=str)
    assert same(markup.nodes(bare), markup.nodes(toks)) and same(markup._levels(bare), toks)


def test_chunks_are_made_where_the_page_lies(spark):
    md = "intro\n# A\n\n## B\r\nx\n### C  \ny\n#no\n####### no\n## \n## D\nz\n# E\n\n## F\n" + "w" * 5000
    df = spark.createDataFrame([(1, md), (2, None), (3, ""), (4, "# only"), (5, "a\n\nb")], "page_id long, md string")
    for made in (chunks.sections(df), chunks.chunk_pages(df)):
        assert "Exchange" not in plan(made)
    body = chunks.heading_paths(chunks.lines(df)).where("level is null")  # section and path of each line by windows
    want = {(r.page_id, r.section, r.heading_path) for r in body.where("line rlike '\\\\S'").collect()}
    assert {(r.page_id, r.section, r.heading_path) for r in chunks.sections(df).collect()} == want
    got = chunks.chunk_pages(df).where("page_id = 1").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and [len(r.text) for r in got][-2:] == [4000, 1000]


def test_chunk_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "7.jsonl").write_text('{"chunk_id": "7-0", "root_id": 1, "page_id": 7, "heading_path": "", "chunk_index": 0, "text": "a"}\n')
    good, _ = files.read_chunks(spark, str(tmp_path))
    assert "from_json" not in plan(good).lower() and "jsontostructs" not in plan(good).lower() and "Join" not in plan(good)
    assert [r.text for r in good.collect()] == ["a"]


def test_equal_queries_are_asked_once(spark, monkeypatch):
    met, meet = [], vectors._meet
    monkeypatch.setattr(vectors, "_meet", lambda asked, *rest, **more: met.append(asked) or meet(asked, *rest, **more))
    kind = "root_id long, embedding array<double>"
    q = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [1.0, 0.0]), (None, 1, [1.0, 0.0]), ("c", 1, [0.0, 1.0])], f"query_id string, {kind}")
    v = spark.createDataFrame([("x", 1, [2.0, 0.1]), ("y", 2, [0.1, 1.0])], f"chunk_id string, {kind}")
    hits = lambda **more: sorted((str(r.query_id), r.chunk_id, r["rank"]) for r in vectors.search(q, v, k=1, **more).collect())
    assert hits() == [("None", "x", 1), ("a", "x", 1), ("b", "x", 1), ("c", "y", 1)]
    assert hits(scoped=True) == [("None", "x", 1), ("a", "x", 1), ("b", "y", 1), ("c", "x", 1)]
    assert [m.count() for m in met] == [2, 3]  # by root where scoped


def test_files_are_listed_by_tasks(spark, tmp_path):
    texts = {"1/5/5.md": "new", "1/5/page.md": "old", "2/6/page.md": "b c", "2/6/.x.md": "hidden", "_no/7/7.md": "hidden", "a=1/8/8.md": "é", "1/9/9.md": ""}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    pages = files.read_markdown(spark, str(tmp_path))
    assert sorted(map(tuple, pages.collect())) == [(5, "new"), (6, "b c"), (8, "é")]
    assert not [f for f in pages.inputFiles() if f.endswith(".md")]
    names = lambda path: sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in files.list_files(spark, path).collect())
    assert names(f"file:{tmp_path}/?/*/page.md") == ["1/5/page.md", "2/6/page.md"] and names(f"{tmp_path}/1/*") == ["1/5/5.md", "1/5/page.md"]
    assert names(f"{tmp_path}/1/5/5.md") == ["1/5/5.md"]
    assets = files.read_assets(spark, f"{tmp_path}/1")
    assert {(r.length, bytes(r.content)) for r in assets.collect()} == {(3, b"new"), (3, b"old")} and not [f for f in assets.inputFiles() if f.endswith(".md")]


def test_reading_assets_needs_no_task_per_folder(spark, tmp_path):
    def tasks(n):
        for i in range(n):
            (tmp_path / f"{n}/{i}/assets").mkdir(parents=True)
            (tmp_path / f"{n}/{i}/assets/f.png").write_text("x")
        spark.sparkContext.setJobGroup(f"assets-{n}", "")
        try:
            assert files.read_assets(spark, str(tmp_path / str(n))).count() == n
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        seen = spark.sparkContext.statusTracker()
        stages = {s for j in seen.getJobIdsForGroup(f"assets-{n}") for s in seen.getJobInfo(j).stageIds}
        return sum(found.numTasks for s in stages if (found := seen.getStageInfo(s)))

    few, many = tasks(40), tasks(400)  # what a task sends to the driver has a bound, so their number says how that grows
    assert 0 < few and many - few < 60


def test_artifacts_lie_in_a_file_per_page(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3 or None, i) for i in range(30)], "page_id long, n int").repartition(5)
    path = files.write_artifacts(rows, "kind", str(tmp_path))
    assert sorted(f.parent.name for f in tmp_path.rglob("*.txt")) == ["page=1", "page=2", "page=__HIVE_DEFAULT_PARTITION__"]
    got = files.read_artifacts(spark, path)
    assert sorted(r.value for r in got.collect()) == sorted(r.value for r in files.artifacts(rows, []).collect()) and not [f for f in got.inputFiles() if f.endswith(".txt")]


def test_bucket_pairs_by_blocks_are_those_of_the_join(spark):
    rng = np.random.default_rng(3)
    v = [(f"v{i}", x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))] + [("nan", [float("nan")] * 4), ("none", None)]
    held = spark.createDataFrame(v, "chunk_id string, embedding array<double>")
    asked = held.where("chunk_id like 'v%0' or chunk_id = 'nan'").withColumnRenamed("chunk_id", "query_id")
    got = vectors.lsh_candidates(asked, held, 1.0, tables=3, width=0.5, query_block=7, vector_block=40)
    vec = lambda df: df.where("embedding is not null").withColumn("v", array_to_vector("embedding"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=3, seed=5).fit(vec(held))
    want = model.approxSimilarityJoin(vec(asked), vec(held), 1.0, "distance").select("datasetA.query_id", "datasetB.chunk_id", "distance")
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.distance, 9)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 100


def test_pages_are_rendered_where_they_lie(spark):
    html = '<p>a <b> b </b></p><table><tr><td>c</td><td>d</td></tr></table><table><tr><td colspan="2">e</td></tr><tr><td>f</td><td>g</td></tr></table><ul><li>h</li></ul>'
    df = spark.createDataFrame([(i, "T", html) for i in range(20)], "page_id long, title string, html string")
    before = set(os.listdir(checkpoints(spark)))
    md = markup.markdown(df)
    assert {r.md for r in md.collect()} == {"# T\n\na **b**\n\n| c | d |\n| --- | --- |\n\n[TABLE:table-1](assets/tables/table-1.json)\n\n- h"}
    assert "Exchange" not in plan(md) and "Join" not in plan(md) and set(os.listdir(checkpoints(spark))) == before
    blocks = markup.render_blocks(markup.tokens(df))
    assert blocks.count() == 80 and plan(blocks).count("Exchange hashpartitioning") == 1


def test_blocks_of_tokens_are_those_of_pages(spark):
    odd = [
        '<!-- x --><p>a<!-- y -->b &lt;i&gt;</p>text<hr/><br><![CDATA[c]]>', "<TD>1<td>2</tr></table>", "<table><tr><td>a<tr><td>b</td></tr></table><p>c</p>", "</b>", "<", "<1a>x</1a>",
        '<ac:structured-macro ac:name="code"><p>a</p>b<br/>c</ac:structured-macro>', "<div><code>a<p>b</p></code></div>", "<b>" * 50 + "x" + "</b>" * 50, None, "",
    ]
    df = spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").withColumn("title", F.lit(None).cast("string"))
    rows = markup.render_blocks(markup.tokens(df)).orderBy("page_id", "block").collect()
    got = {i: "\n\n".join(r.text for r in rows if r.page_id == i) for i in range(len(odd))}
    assert {r.page_id: r.md for r in markup.markdown(df).collect()} == got
    assert (got[0], got[2], got[6], got[7]) == ("ab <i>\n\n---", "[TABLE:table-1](assets/tables/table-1.json)", "```\na b  c\n```", "`a b`") and [(r.block, r.tag) for r in rows if r.page_id == 0] == [(1, "p"), (7, "hr")]
