"""Phrases, byte passages and alignment: against plain versions, with hot keys and small shards, and on odd rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import align, lpf, packing, phrases

A, B = packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 5000} the" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t", "en"), (4, "one", "und"), (5, LONG, "en us"), (5, LONG, "en us"), (6, LONG + " tail", "en us"), (None, "no id at all", None), (7, "x" * 3000, "fr"), (8, "the of " * 90, "fr"), (9, "the of " * 90, "fr"), (10, "é▁ü", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(1) for c in "key n at ranges wanted again bunch slot digest copies phrase words rank size body text_".split()})


# ---------------------------------------------------------------- suffix arrays


def test_factors_equal_a_plain_search():
    rng = random.Random(1)
    for _ in range(150):
        depth, text = rng.choice([9, 16, 17, 20]), bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 120)))
        starts = np.arange(0, len(text) - depth + 1, rng.choice([1, 1, 3]))
        f = lpf.Factors(np.frombuffer(text, np.uint8), starts, depth)

        def common(i, j):
            return next((k for k in range(depth) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), depth)

        for i, before, after in zip(starts.tolist(), f.previous().tolist(), f.next().tolist()):
            assert before == max((common(i, j) for j in starts.tolist() if j < i), default=0)
            assert after == max((common(i, j) for j in starts.tolist() if j > i), default=0)


def test_anchors_depend_on_the_window_alone():
    text = np.frombuffer(random.Random(2).randbytes(300_000), np.uint8)
    first, n, value = lpf.anchors(text, 200, 64)
    assert first[0] == 0 and n.sum() == len(text) - 199
    per = np.repeat(value, n)
    for at in (0, 131_071, 131_072, 200_000):
        part = lpf.anchors(text[at : at + 700], 200, 64)
        assert (np.repeat(part[2], part[1]) == per[at : at + 501]).all()


def plain_removal(texts, window, first_stays):
    seen = collections.defaultdict(list)
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        for at in range(len(data) - window + 1):
            seen[data[at : at + window]].append((i, at))
    gone = collections.defaultdict(set)
    for places in seen.values():
        for i, at in places[1:] if first_stays else places if len(places) > 1 else []:
            gone[i].update(range(at, at + window))
    return {i: bytes(b for at, b in enumerate((t or "").encode()) if at not in gone[i]) for i, t in texts.items()}


@pytest.mark.parametrize("first_stays", [True, False])
@pytest.mark.parametrize("options", [{}, {"hot_min": 2, "hot_share": 10**9, "shard_bytes": 4000}, {"anchor": 40}])
def test_passages_equal_a_plain_search(docs, first_stays, options):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_removal(texts, 60, first_stays)
    rows = lpf.remove_repeated_bytes(docs, 60, first_stays=first_stays, **{"anchor": 24} | options).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == want
    assert all(r.n_bytes - len(r.kept) == sum(s.end - s.begin for s in r.removed) for r in rows)


def test_passages_of_odd_rows(odd):
    got = collections.defaultdict(list)
    for r in lpf.remove_repeated_bytes(odd).collect():
        got[r.doc_id].append(bytes(r.kept))
    assert got[1] == got[2] == [b""] and got[4] == [b"one"] and got[None] == [b"no id at all"]
    assert got[5][0] == got[5][1] and len(got[5]) == 2 and len(got[6][0]) < 300 and got[9] == [b""] and got[7] == [b"x"]
    none = {r.doc_id: bytes(r.kept) for r in lpf.remove_repeated_bytes(odd, first_stays=False).collect()}
    assert none[8] == none[9] == none[7] == none[5] == b"" and none[6] == b"tail"
    assert lpf.remove_repeated_bytes(odd.limit(0)).collect() == []


# ---------------------------------------------------------------- phrases


def test_quicksort_counts_equal_a_counter():
    rng = np.random.default_rng(3)
    for n in (10, 3000, 30_000):
        words = [np.minimum(rng.zipf(1.3, n), 50) - (1 if d else 0) for d in range(3)]
        words[2] = np.where(words[1] == 0, 0, words[2])
        weight = rng.integers(1, 4, n)
        want = collections.Counter()
        for *row, w in zip(*(x.tolist() for x in words), weight.tolist()):
            for d in range(3):
                if row[d]:
                    want[tuple(row[: d + 1])] += w
                else:
                    break
        got = {}
        for found, counts in phrases.frequent(words, weight, 10):
            got |= {tuple(p): c for p, c in zip(found.tolist(), counts.tolist())}
        assert got == {k: c for k, c in want.items() if c >= 10}


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_routing_and_shards_change_nothing(docs, longest):
    want = sorted(map(tuple, phrases.collocations(docs, longest=longest, top=None).collect()))
    assert sorted(map(tuple, phrases.collocations(docs, longest=longest, top=None, hot_share=40, hot_min=5, shard=2000).collect())) == want
    plain = collections.Counter()
    for r in docs.collect():
        for piece in phrases._FOLD and r.text.encode().translate(phrases._FOLD).split(b"\xff"):
            ws = piece.split()
            plain.update((r.lang, b" ".join(ws[i : i + longest]).decode()) for i in range(len(ws) - longest + 1))
    assert {(x[0], x[2]): x[3] for x in want if x[2].count(" ") == longest - 1} == {k: c for k, c in plain.items() if c >= 10}


def test_phrases_of_odd_rows(odd):
    rows = phrases.collocations(odd).collect()
    assert [(r.phrase, r.a, r["rank"]) for r in rows if r.lang == "fr"] == [("of the of", 178, 1), ("the of the", 178, 2)]
    assert not [r for r in rows if r.lang == "und"] and len({r["rank"] for r in rows if r.lang == "en us"}) == 2000
    assert phrases.collocations(odd.limit(0)).collect() == []


# ---------------------------------------------------------------- alignment


def plain_alignment(rows):
    one, two, found = align.ByteTokens(A), align.PieceTokens(B), []
    for i, t in rows:
        a, b = (one.model.encode(" " + t, add_special_tokens=False).ids, two.model.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not a or b"".join(one.bytes[x] for x in a) != whole or b"".join(two.bytes[x] for x in b) != whole:
            found.append((i, None))
            continue
        ends = []
        for ids, table in ((a, one.bytes), (b, two.bytes)):
            ends.append(list(np.cumsum([len(table[x]) for x in ids])))
        groups, x, y = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            to_x, to_y = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[x:to_x], b[y:to_y]))
            x, y = to_x, to_y
        found.append((i, groups))
    held = collections.Counter()
    for _, groups in found:
        held.update({(p, q) for ga, gb in groups or [] for p in ga for q in gb})
    best = collections.Counter()
    for (p, _), c in held.items():
        best[p] = max(best[p], c)
    out = []
    for i, groups in found:
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(p, q) for ga, gb in groups for p in ga for q in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bunch", [1, 30_000, 1 << 22])
def test_alignment_equals_a_plain_version(spark, docs, bunch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    odd = [None, "", "▁x", " a  b", "<|endoftext|> </s><s>", "x" * 3000, "日本語のテキスト🎉 \x00\x01", "a\n\n  b\t", "é" * 50, "x" * 3000, rows[0][1]]
    rows += [(10**6 + i, t) for i, t in enumerate(odd)] + [(None, "one two"), (10**6 + 3, " a  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, align.aligned_documents(df, A, B, bunch_bytes=bunch).collect()), key=str) == plain_alignment(rows)


def test_wide_groups_count_every_link():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 30, 500), rng.integers(0, 30, 700)
    group_a, group_b = np.sort(rng.integers(0, 20, 500)), np.sort(rng.integers(0, 20, 700))
    want = collections.Counter((int(x) << 32) | int(y) for x, g in zip(a, group_a) for y, h in zip(b, group_b) if g == h)
    pairs, times = align.links(a, b, group_a, group_b, 20)
    assert dict(zip(pairs.tolist(), times.tolist())) == want


def test_alignment_of_odd_rows(odd):
    rows = align.aligned_documents(odd, A, B).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.n_a for r in rows}[10] == 0
    assert align.aligned_documents(odd.limit(0), A, B).collect() == []
