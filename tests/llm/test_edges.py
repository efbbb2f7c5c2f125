"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import lattice, lm, mil, packing, pieces, rules, sharding, simhash, substring, warc

LONG = " ".join(f"w{i % 5000} the" for i in range(60_000))
CLASHES = {"key": "1", "n": "1", "at": "2", "ranges": "null", "found_ranges": "3", "range_id": "4", "kept_id": "5", "fp": "6", "rep": "7", "verdict": "'v'", "kept": "8", "row": "9", "held_out": "true", "words": "10", "size": "11", "name": "12", "shard": "13", "length": "14", "_at": "15", "quality": "16"}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, LONG), (5, LONG), (6, LONG + " tail"), (None, "no id at all"), (None, None), (7, "x" * 200_000), (8, "the of " * 40), (9, "the of " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.expr(e) for c, e in CLASHES.items()})


MODEL = packing.tokenizer_path("byte_bpe_50k.json")
SPIECE = packing.tokenizer_path("piece_bpe_32k.model")
OPERATORS = {
    "lm": lm.score_documents,
    "quality": lambda d: mil.score_quality(d, mil.fit(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))),
    "substring": substring.remove_repeats,
    "sharding": sharding.shard_documents,
    "pieces": lambda d: pieces.encode_pieces(d, SPIECE),
    "rules": rules.quality_rules,
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_every_row(odd, name):
    out = OPERATORS[name](odd).collect()
    assert len(out) == 12
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_results_on_odd_rows(odd):
    s = {r.doc_id: r for r in substring.remove_repeats(odd).collect()}
    assert s[1].n_words == s[2].n_words == s[3].n_words == 0 and s[6].n_removed >= 119_000 and s[9].n_removed == 80
    f = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert f[1].fp == f[2].fp == f[3].fp == 0 and f[3].component_id == 1 and f[9].component_id == 8 and f[6].component_id == 5
    r = {r.doc_id: r.verdict for r in rules.quality_rules(odd).collect()}
    assert r[1].base_failed and not r[1].kept and r[8].measures.n_repeat_words == 80
    p = {r.doc_id: r for r in pieces.encode_pieces(odd, SPIECE).collect()}
    assert p[1].ids == p[2].ids == [1, 2] and p[4].decoded == "one" and p[7].decoded == "x" * 200_000


def test_packing_odd_rows(odd):
    rows = packing.pack_documents(odd, MODEL).collect()
    assert {str(r.doc_id) for r in rows} == {str(r.doc_id) for r in odd.select("doc_id").collect()}
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 1024
    assert packing.pack_documents(odd.limit(0), MODEL).collect() == []


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, None], 1), (9, [], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1)).withColumn("v", F.lit(2))
    out = lattice.near_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == sorted([("1", 2, "1"), ("2", 2, "1"), ("2", 2, "1"), *[(str(i), 0, str(i)) for i in (3, 4, 5, 6, 7, 8, 9, 10)], ("None", 0, "None")])
    assert lattice.near_vectors(df.limit(0)).collect() == []


def test_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive_pages(empty, str(tmp_path / "w"))
    assert warc.archived_pages(spark, str(tmp_path / "w")).collect() == []
    odd = spark.createDataFrame([(1, "a\r\nWARC-Type: x", "h"), (1, "a", "h"), (2, "é ü", "h\r\n\r\nWARC/1.1")], "page_id long, url string, html string").withColumn("first", F.lit(0)).withColumn("record_type", F.lit("z"))
    warc.archive_pages(odd, str(tmp_path / "v"))
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in warc.archived_pages(spark, str(tmp_path / "v")).collect()) == [(1, "response", 1), (1, "response", 1), (2, "response", 13)]


def test_stages_keep_columns(spark, odd, tmp_path):
    spark.createDataFrame([(4, 1, 0), (8, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r.verdict == "v" and r.key == 1 for r in rows)
    kept = corpus_pipeline.near_duplicates(spark, odd, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "4", "5", "7", "8", "None", "None"])
    cut = {r.doc_id: r.text for r in corpus_pipeline.substrings(spark, odd, "").collect()}
    assert cut[1] is None and cut[4] == "one" and cut[9] == ""
