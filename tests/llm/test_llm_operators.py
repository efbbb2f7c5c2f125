"""Each operator against a plain version on small tables."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
import xxhash
from duck import same_rows

from leafmill.llm import fm, lattice, lm, mil, packing, pieces, queries, sharding, simhash, substring, warc

DOCS = "doc_id long, text string"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)


# ---------------------------------------------------------------- 1


def test_lm_base_is_exact_and_model_is_better(spark, sf_dir, texts):
    rows = lm.op1_lm_scoring(spark, sf_dir).collect()
    toks = {i: [w.lower() for w in words(t)] + [b" "] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    count = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for r in rows:
        ws = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def plain_scores(texts, order, folds=5, held=1):
    """{doc_id: score} by dictionaries of word tuples: the same counts, levels, weights and interpolation without hashes, filter or Spark."""
    bases = [1.25] + [2.0] * (order - 1)

    def level(c, base):
        return 1 + math.floor(math.log(c) / math.log(base) + 1e-9) if c else 0

    def stands_for(lev, base):
        low = math.ceil(base ** (lev - 1) - 1e-6)
        return math.sqrt(low * max(low, math.ceil(base**lev - 1e-6) - 1)) if lev else 0.0

    toks = {i: [w.lower() for w in words(t)] + ["</s>"] for i, t in texts.items()}
    learn = [i for i in toks if zlib.crc32(str(i).encode()) % folds != held]
    grams = lambda ws, k: [tuple((["</s>"] * k + ws)[j + 1 : j + k + 1]) for j in range(len(ws))]
    count = collections.Counter(g for i in learn for k in range(1, order + 1) for g in grams(toks[i], k))
    for k in range(2, order):
        count[("</s>",) * k] = round(stands_for(level(count[("</s>",)], bases[0]), bases[0]))
    n, v = sum(len(toks[i]) for i in learn), sum(len(g) == 1 for g in count)
    quantised = lambda g: stands_for(level(count[g], bases[len(g) - 1]), bases[len(g) - 1])
    weights = []

    def probability(g, minus, upto):
        p = (max(quantised(g[-1:]) - minus, 0) + 0.5) / (n + 0.5 * (v + 1))
        for k in range(2, upto + 1):
            after, group = relative(g[-k:], minus)
            p = weights[k - 2][group] * after + (1 - weights[k - 2][group]) * p
        return p

    def relative(g, minus):
        before = quantised(g[:-1])
        return min(max(quantised(g) - minus, 0) / max(before - minus, 1), 1.0), math.ceil(math.log2(before + 1))

    for k in range(2, order + 1):
        rows = collections.Counter()
        for i in learn:
            for g in grams(toks[i], order):
                rows[(*relative(g[-k:], 1), min(127, round(-8 * math.log10(probability(g, 1, k - 1)))))] += 1
        group = collections.Counter()
        for (_, c, _), times in rows.items():
            group[c] += times
        w = dict.fromkeys(range(64), 0.3)
        for _ in range(30):
            share = collections.Counter()
            for (after, c, shorter), times in rows.items():
                share[c] += times * w[c] * after / max(w[c] * after + (1 - w[c]) * 10 ** (-shorter / 8), 1e-300)
            w = {c: (share[c] + 0.5) / (group[c] + 5) if group[c] else 0.0 for c in w}
        weights.append(w)
    return {i: sum(math.log10(probability(g, 0, order)) for g in grams(ws, order)) for i, ws in toks.items()}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores_equal_a_plain_model(docs, texts, order):
    some = docs.where("doc_id % 2 = 0")
    want = plain_scores({i: t for i, t in texts.items() if i % 2 == 0}, order)
    ways = [{}, {"broadcast_mb": 0, "block_mb": 1, "bunch_mb": 1}]
    for way in ways:
        got = {r.doc_id: r.score for r in lm.score_documents(some, order=order, bits=64, probes=20, **way).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)


def test_lm_scores_are_the_same_whether_the_filter_is_broadcast_or_not(docs):
    one, other = ({r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score_documents(docs, block_mb=1, bunch_mb=1, broadcast_mb=mb).collect()} for mb in (0, 32))
    assert one.keys() == other.keys() and all(math.isclose(x, y, rel_tol=1e-9) for i in one for x, y in zip(one[i], other[i]))


def test_word_hashes():
    data = b"One two\x0b\x0cTWO one  " + b"x" * 600_000 + b" one\tab ba\n" + "é É".encode() + b" two" * 100_000
    hashes, places = lm.word_hashes(data)
    assert len(hashes) == len(data.split()) and [data[p] for p in places[:3].tolist()] == [79, 116, 84]
    name = {}
    for w, h in zip(data.lower().split(), hashes.tolist()):
        assert name.setdefault(w, h) == h
    assert len(set(name.values())) == len(name)


def test_count_filter_reads_counts_back():
    rng = np.random.default_rng(0)
    names, counts = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 2000, 5000)
    f = lm.CountFilter.of(names, lm._levels(counts, 1.25))
    assert (f.level(names) >= lm._levels(counts, 1.25)).all()  # never too low
    assert (f.level(names) == lm._levels(counts, 1.25)).mean() > 0.97
    assert (f.level(rng.integers(0, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.03


def test_a_filter_block_keeps_every_ngram():
    names = np.random.default_rng(1).integers(0, 2**63, 3_000_000).astype(np.uint64)
    assert lm.CountFilter.of(names, np.ones(len(names), np.int64)).level(names).min() >= 1


def test_lm_weights_come_from_all_training_texts(spark):
    plain = spark.range(1500).selectExpr("id as doc_id", "concat('a b c', id % 7) as text")
    late = spark.range(1500, 4000).where("crc32(cast(cast(id as string) as binary)) % 5 <> 1").orderBy(F.xxhash64("id").desc()).first()[0]
    twice = spark.createDataFrame([(late, "zz yy " * 300)], "doc_id long, text string")
    r = lm.score_documents(plain.unionAll(twice)).where(F.col("doc_id") == late).first()
    assert r.score / r.n_tokens > -0.2  # 'yy' always follows 'zz'


def test_lm_scores_texts_that_occur_twice_apart(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(1000 * rng.random() ** 3)}" for _ in range(200))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in rows[:40]]
    r = {x.doc_id: x.score / x.n_tokens for x in lm.score_documents(spark.createDataFrame(rows, DOCS)).where("not held_out").collect()}
    both = [r[i] for i in range(40) if i in r and 1000 + i in r]
    once = [x for i, x in r.items() if 40 <= i < 1000]
    assert min(both) > max(once)


# ---------------------------------------------------------------- 2


def test_warc_pushes_header_tests_and_skips_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "one"), (2, "http://b/y", "one"), (3, None, None), (4, "http://a/z", "é" * 100_000), (None, "q", "n")], "page_id long, url string, html string")
    warc.archive_pages(pages, str(tmp_path / "w"))
    reader = warc.WarcReader(str(tmp_path / "w"), "all", 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), StringStartsWith(("target_uri",), "http://a/"), GreaterThan(("payload_bytes",), 5)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["record_id"] for r in found) == ["urn:page:1", "urn:page:4"] and all(r["digest_ok"] for r in found)
    back = {r.page_id: r for r in warc.archived_pages(spark, str(tmp_path / "w")).collect()}
    assert (back[2].record_type, back[2].refers_to, back[2].payload_bytes) == ("revisit", 1, 3)
    assert back[3].payload_bytes == 0 and back[4].payload_bytes == 200_000 and back[None].record_type == "response"
    assert back[1].payload_digest == back[2].payload_digest == warc.digest_of(b"one")
    plan = spark.read.format("warc").load(str(tmp_path / "w")).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")


def test_warc_reads_plain_and_foreign_gzip(tmp_path):
    import gzip

    records = [warc.record("response", f"urn:page:{i}", "u", "d", b"WARC/1.1\r\n\r\n" * i, None) for i in range(6)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(warc.member, records)))
    reader = warc.WarcReader(str(tmp_path), "none", 1)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(reader.partitions()) == 3 and sorted(r["payload_bytes"] for r in rows) == sorted(12 * i for i in range(6) for _ in range(3))
    assert all(r["payload"] is None for r in rows)
    assert gzip.decompress(warc.member(records[3])) == records[3]


def _read_all(path, payload="all", pushed=()):
    reader = warc.WarcReader(str(path), payload, 1 << 20)
    list(reader.pushFilters(list(pushed)))
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def _some_records():
    texts = [b"", b"one", b"\r\n\r\nWARC/1.1\r\n", b"x" * 300_000, np.random.default_rng(3).bytes(400_000), b"last"]
    return texts, [warc.record("response", f"urn:page:{i}", "http://h/" + "u" * (1_500_000 if i == 2 else 5), "1970-01-01T00:00:00Z", t, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("form", ["plain", "a member a record", "skippable members", "one member", "two members"])
def test_warc_reads_every_record(tmp_path, form):
    import gzip

    texts, records = _some_records()
    data = {
        "plain": lambda: b"".join(records),
        "a member a record": lambda: b"".join(map(gzip.compress, records)),
        "skippable members": lambda: b"".join(map(warc.member, records)),
        "one member": lambda: gzip.compress(b"".join(records)),
        "two members": lambda: gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:])) + b"\0" * 100,
    }[form]()
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(data)
    rows = _read_all(tmp_path)
    assert [r["payload"] for r in rows] == texts and all(r["digest_ok"] for r in rows)
    assert [r["payload_digest"] for r in _read_all(tmp_path, "none")] == [warc.digest_of(t) for t in texts]
    from pyspark.sql.datasource import EqualTo

    assert [r["payload"] for r in _read_all(tmp_path, "all", [EqualTo(("record_id",), "urn:page:5")])] == [b"last"]
    starts = [r["offset"] for r in rows]
    assert len(set(starts)) == {"one member": 1, "two members": 2}.get(form, 6) and all(data[x : x + 2] in (b"\x1f\x8b", b"WA") for x in starts)


def test_broken_archives_raise(tmp_path):
    import gzip

    _, records = _some_records()
    whole = b"".join(records)
    bad = {
        "cut in a block": whole[:-20],
        "cut in headers": whole + records[0][:50],
        "cut in a member": gzip.compress(whole)[:-500],
        "cut in a skippable member": b"".join(map(warc.member, records))[:-30],
        "broken member": gzip.compress(whole) + b"no gzip",
        "length": records[0].replace(b"Content-Length: ", b"Content-Length: x") + whole,
        "no record": records[0] + b"something else\r\n\r\n" + whole,
    }
    for name, data in bad.items():
        folder = tmp_path / name.replace(" ", "-")
        folder.mkdir()
        (folder / ("b.warc.gz" if data[:2] == b"\x1f\x8b" else "b.warc")).write_bytes(data)
        with pytest.raises(ValueError, match=r"b\.warc"):
            _read_all(folder)
    for payload in ("all", "none"):
        (folder / "b.warc").write_bytes(warc.member(records[4])[:-100_000])
        with pytest.raises(ValueError, match=r"b\.warc"):
            _read_all(folder, payload)


# ---------------------------------------------------------------- 3


def test_classifier_is_right_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in mil.op3_quality_mil(spark, sf_dir).collect()}
    held = [(rows[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())


def test_attention_gradient_finds_the_odd_passage():
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 1, (5, 6)) for _ in range(200)]
    y = np.array([i % 2 for i in range(200)], float)
    for b, label in zip(bags, y):
        if label:
            b[rng.integers(5), 0] += 6
    heads = np.arange(0, 1000, 5)
    model = mil.train(np.concatenate(bags), heads, y, steps=300)
    assert ((model.scores(np.concatenate(bags), heads) > 0.5) == y).mean() > 0.95


def _small_model():
    rng = np.random.default_rng(8)
    sizes = [1, 4, 2, 7, 1, 3]
    x, heads, y = rng.normal(size=(sum(sizes), 5)), np.cumsum([0, *sizes[:-1]]), np.array([1.0, 0, 0, 1, 1, 0])
    shape = {"W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": (1,)}
    return {k: rng.normal(size=n) for k, n in shape.items()}, x, heads, sizes, y


def test_attention_pooling_equals_plain_loops():
    w, x, heads, sizes, _ = _small_model()
    got = mil._forward(w, x, heads)["p"]
    for h, n, p in zip(heads, sizes, got):
        hidden = [[math.tanh(sum(x[i][q] * w["W"][q][k] for q in range(5)) + w["b"][k]) for k in range(4)] for i in range(h, h + n)]
        energy = [sum(w["w"][j] * math.tanh(sum(v[k] * w["V"][k][j] for k in range(4))) / (1 + math.exp(-sum(v[k] * w["U"][k][j] for k in range(4)))) for j in range(3)) for v in hidden]
        share = [math.exp(e) / sum(map(math.exp, energy)) for e in energy]
        pooled = [sum(a * v[k] for a, v in zip(share, hidden)) for k in range(4)]
        assert math.isclose(p, 1 / (1 + math.exp(-sum(c * z for c, z in zip(w["c"], pooled)) - w["d"][0])), rel_tol=1e-9)


def test_gradient_equals_finite_differences():
    w, x, heads, _, y = _small_model()

    def loss():
        p = mil._forward(w, x, heads)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, g in mil._gradient(w, x, heads, y).items():
        for at in np.ndindex(w[k].shape):
            held = w[k][at]
            w[k][at] = held + 1e-5
            up = loss()
            w[k][at] = held - 1e-5
            down = loss()
            w[k][at] = held
            assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-4, abs_tol=1e-8), (k, at)


# ---------------------------------------------------------------- 4


def plain_repeats(texts, window):
    seen, gone = set(), {}
    for i in sorted(texts):
        ws = words(texts[i])
        gone[i] = set()
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s : s + window])
            if key in seen:
                gone[i] |= set(range(s, s + window))
            seen.add(key)
    return gone


@pytest.mark.parametrize(("window", "anchor"), [(4, 2), (8, 3)])
def test_substrings_equal_a_plain_loop(spark, monkeypatch, window, anchor):
    rng = random.Random(window)
    base = [rng.choice("abcdefg") + rng.choice("xy") for _ in range(400)]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randrange(380)
            parts += base[s : s + rng.randint(1, 20)] if rng.random() < 0.5 else ["z" * rng.randint(1, 2)] * rng.randint(1, 25)
        texts[i] = " ".join(parts)
    for hot_min in (3, 1000):  # with and without anchors that are handled window by window
        monkeypatch.setattr(substring, "HOT_MIN", hot_min)
        got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(list(texts.items()), DOCS).repartition(5), window=window, anchor=anchor, shard_words=300).collect()}
        want = plain_repeats(texts, window)
        for i, t in texts.items():
            kept = [w for k, w in enumerate(words(t)) if k not in want[i]]
            assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(words(t)), len(want[i]), b" ".join(kept).decode())
            assert got[i].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()


def test_fm_index_finds_the_earliest_window():
    rng = np.random.default_rng(3)
    for depth in (2, 5, 20):
        text, streamed = [], []
        base = rng.integers(1, 5, 300)
        for i in range(80):
            n, s = int(rng.integers(1, depth + 9)), int(rng.integers(0, 270))
            x = base[s : s + n] if rng.random() < 0.7 else rng.integers(1, 5, n)
            if rng.random() < 0.3:
                x = np.concatenate((x, rng.integers(1, 9, 3), x))  # symbols that the text lacks, and matches that end
            streamed.append(x)
            if i < 40:
                text += [*x.tolist(), 0]
        t = np.array(text)
        held = {}
        for i in range(len(t) - depth + 1):
            held.setdefault(tuple(t[i : i + depth].tolist()), i)
        for x, found in zip(streamed, fm.FmIndex(t, depth).earliest(streamed)):
            assert found.tolist() == [held.get(tuple(x[j : j + depth].tolist()), -1) for j in range(len(x) - depth + 1)]


def test_fm_index_is_compressed():
    rng = np.random.default_rng(5)
    text = np.concatenate([np.append(rng.integers(1, 5000, 60), 0) for _ in range(2000)] * 2)
    assert fm.FmIndex(text, 20).nbytes() < 1.1 * 8 * len(text)  # the suffix array alone has 8 bytes a symbol


# ---------------------------------------------------------------- 5


def test_lattice_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    x = np.concatenate([c + rng.normal(scale=s, size=(30, 64)) for c, s in zip(centres, np.linspace(0.02, 0.25, 12))] + [np.repeat(centres[:1], 40, 0)]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    rows = [(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(1))
    for block, span in ((2000, 2), (16, 2), (2000, 1), (2000, 3)):  # also with cells spread over tasks, and with other spans
        got = {r.vec_id: r for r in lattice.near_vectors(df, block=block, span=span).collect()}
        n = np.array([got[i].n_links for i in range(len(x))])
        assert (n <= link.sum(1)).all() and n.sum() >= 0.97 * link.sum(), (block, span)
        if n.sum() == link.sum():
            assert [got[i].component_id for i in range(len(x))] == comp.tolist()
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_e8_decoding_is_nearest():
    x = np.random.default_rng(6).normal(scale=2, size=(300, 8))
    p = lattice.decode_e8(x)
    d = ((x - p) ** 2).sum(1)
    for v in lattice._NEAR:
        assert (d <= ((x - p - v) ** 2).sum(1) + 1e-9).all()
    assert (np.abs(p * 2 - np.rint(p * 2)) < 1e-9).all() and (np.rint(p.sum(1)) % 2 == 0).all()


# ---------------------------------------------------------------- 6


def test_shards_are_even_and_groups_stay(spark, docs):
    rows = sharding.op6_sharding(spark, "/root/testdata/sf0.01").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    groups = collections.defaultdict(set)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
        groups[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 7


def test_group_larger_than_a_shard_spreads(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(400)], DOCS)
    rows = sharding.shard_documents(df).collect()
    count = collections.Counter(r.shard for r in rows)
    assert set(count.values()) == {50}
    assert len({r.shard for r in rows if r.doc_id % 2}) <= 6


# ---------------------------------------------------------------- 7


def test_pieces_equal_the_library(texts):
    import public_tokenizers

    enc = pieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    vocabulary = list(enc.code)
    cases = [t for t in texts.values()][:60] + ["", " ", "  ", "a  b", " ▁▁ x", "\n\t", "\x00", "🙂é中", "<s></s><0x41>", "a" * 5000, " " * 999]
    for _ in range(1500):
        cases.append("".join(rng.choice(vocabulary).replace("▁", rng.choice("▁ ")) for _ in range(rng.randint(0, 9))))
        cases.append("".join(rng.choice("ab dest inhr\n▁é中") for _ in range(rng.randint(0, 30))))
    for t in cases:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.model.encode(t), repr(t)


def test_pieces_query_decodes(spark, sf_dir, texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in pieces.op7_sentencepiece(spark, sf_dir).collect():
        ids = [1, *model.encode(texts[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


# ---------------------------------------------------------------- 9


def plain_fingerprint(text):
    ws = [w.lower() for w in words(text)]
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, bits=3):
    ids = sorted(fps)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query_equals_brute_force(spark, sf_dir, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps)
    for r in simhash.op9_simhash(spark, sf_dir).collect():
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize("block", [4096, 8])
def test_ring_keys_lose_no_link(spark, monkeypatch, block):
    rng = random.Random(9)
    fps = {}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                f ^= 1 << b
            fps[len(fps)] = f
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, k: docs)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"), block=block).collect()}
    assert got == plain_components(fps)


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("n", [1, 2, 17, 3000])
def test_spanning_edges_have_no_hub(n):
    ids = list(range(5, 5 + 3 * n, 3))
    forest = simhash._Forest(fan=16)
    for x in random.Random(n).sample(ids, n):
        forest.join(x, 5)
    forest.join(1_000_000, 1_000_001)
    edges = forest.take()
    assert len(edges) == n and not forest.take()
    degree = collections.Counter(x for e in edges for x in e)
    assert max(degree.values()) <= 17
    again = simhash._Forest()
    for a, b in edges:
        again.join(a, b)
    assert {again.find(x) for x in ids[1:]} == ({5} if n > 1 else set()) and again.find(1_000_001) == 1_000_000


@pytest.mark.parametrize("histogram", [{100: 1000}, {300: 1000, 500: 1000}, {1: 10000}, {2: 5000, 3: 5000}, {341: 300, 342: 300, 700: 100}, {1024: 5, 7: 3}])
def test_every_histogram_is_packed_by_configurations(histogram):
    demand = np.zeros(1025, np.int64)
    for n, k in histogram.items():
        demand[n] = k
    below = demand.copy()
    below[1024] = 0
    plan = packing._solve(below, 1024, 2500, 1.0, 2.0)
    assert plan and all(sum(n * a for n, a in c) <= 1024 for c in plan)
    out = packing.configurations(histogram)
    assert sum(b for _, b in out) <= sum(b for _, b in packing._best_fit(demand, 1024))
    held = collections.Counter()
    for config, bins in out:
        assert sum(n * a for n, a in config) <= 1024
        for n, a in config:
            held[n] += a * bins
    assert held == collections.Counter(histogram)


def test_configurations_beat_best_fit():
    assert sum(b for _, b in packing.configurations({341: 300, 342: 300, 700: 100})) < 350  # best fit needs 350


def test_packing_keeps_clashing_columns(spark):
    pieces = spark.createDataFrame([(1, 0, 3, "a", 9), (2, 0, 3, "b", 9)], "doc_id long, piece int, length long, _at string, offset int")
    rows = packing.pack(pieces).collect()
    assert sorted((r._at, r.offset) for r in rows) == [("a", 0), ("b", 3)]


def test_packing_is_tight_and_complete(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    rows = packing.op10_packing(spark, sf_dir).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        ps = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and all(p.length == 1024 for p in ps[1:]) and len(ps) == -(-len(ids) // 1024)
        for p, start in zip(ps, itertools.accumulate([0] + [p.length for p in ps])):
            assert p.start == start and p.ids_crc32 == zlib.crc32(np.array(ids[start : start + p.length], "<u4").tobytes())
    for ps in by_seq.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == list(itertools.accumulate([0] + [p.length for p in ps]))[:-1] and ps[-1].offset + ps[-1].length <= 1024
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 1024) + 2


@pytest.mark.parametrize("seed", range(4))
def test_configurations_hold_the_histogram(seed):
    rng = random.Random(seed)
    h = {n: rng.randint(1, 50 ** rng.randint(1, 3)) for n in rng.sample(range(1, 101), rng.randint(1, 60))}
    configs, held = packing.configurations(h, 100), collections.Counter()
    for config, bins in configs:
        assert sum(n * k for n, k in config) <= 100
        for n, k in config:
            held[n] += k * bins
    assert held == h
    demand = np.zeros(101, np.int64)
    for n, k in h.items():
        demand[n] = k
    assert sum(b for _, b in configs) <= sum(b for _, b in packing._best_fit(demand, 100))


def test_encoder_equals_the_library():
    enc = packing.ByteEncoder(packing.tokenizer_path("byte_bpe_50k.json"))
    assert enc.fast is not None
    rng = random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice("ab é ñ中 \n\t'sll've1２三　.,#<|>") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.whole.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode("a<|endoftext|> b"), "<u4").tolist() == enc.whole.encode("a<|endoftext|> b", add_special_tokens=False).ids
