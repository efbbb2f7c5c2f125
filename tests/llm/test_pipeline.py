"""The pipeline's stages on the small tables, against plain versions of their decisions."""

import collections

from test_llm_operators import plain_components, plain_fingerprint, plain_repeats

import corpus_pipeline
from leafmill.llm.rules import quality_rules


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    first = corpus_pipeline.quality_classifier(spark, docs, sf_dir).cache()
    ids = {r.doc_id for r in first.collect()}
    known = {i: q for i, q in quality.items()}
    assert sum((i in ids) == (q == 1) for i, q in known.items()) / len(known) > 0.95
    second = corpus_pipeline.rules(spark, first, sf_dir).cache()
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in quality_rules(first).collect() if r.verdict.kept}
    third = corpus_pipeline.near_duplicates(spark, second, sf_dir).cache()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in second.collect()}
    assert {r.doc_id for r in third.collect()} == {i for i, c in plain_components(fps).items() if i == c}
    fourth = corpus_pipeline.substrings(spark, third, sf_dir).cache()
    before = {r.doc_id: r.text for r in third.collect()}
    gone = plain_repeats(before, 20)
    for r in fourth.collect():
        ws = before[r.doc_id].encode().split()
        want = b" ".join(w for k, w in enumerate(ws) if k not in gone[r.doc_id]).decode() if gone[r.doc_id] else before[r.doc_id]
        assert r.text == want and r.n_chars == len(want)
    rows = corpus_pipeline.packing(spark, fourth, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(before)
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_run_on_an_empty_table_and_on_odd_texts(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    text = " ".join(f"the w{i} of" for i in range(400))
    odd = spark.createDataFrame([(1, text, None, None, 1), (2, None, "en", "s", None), (3, "", "en", None, 0), (None, text + " tail", "en", "s", 5), (None, None, None, None, None), (4, text, "de", "s", 1)], empty.schema)
    for name, docs in (("empty", empty), ("odd", odd)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert (rows == []) == (name == "empty")
        assert {r.doc_id for r in rows} <= {1, None}  # of equal texts the first stays; null and blank ones break rules
