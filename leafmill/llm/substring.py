"""Removal of repeated word passages: FM-index shards matched by backward search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import fresh, load, stored
from leafmill.llm.fm import FmIndex

WINDOW = 20
#: Words of an anchor, the part of a window that decides its shard.
ANCHOR = 6
#: Anchors seen this often or less are never treated as hot.
HOT_MIN = 1000
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs of the word hashes h."""
    n = len(h) - k + 1
    g = h[:n].copy()
    for j in range(1, k):
        g = g * _M + h[j : j + n]
    return _mix(g)


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, value) of each run of windows with one anchor: the leftmost smallest hash of a window's anchor-word runs.

    Equal windows have equal anchors, so windows of one anchor are all there is to compare them with.
    """
    g = _grams(h, anchor)
    per = window - anchor + 1
    n = len(h) - window + 1
    place = np.empty(n, np.int64)
    for at in range(0, n, 1 << 16):
        end = min(n, at + (1 << 16))
        place[at:end] = np.lib.stride_tricks.sliding_window_view(g[at : end + per - 1], per).argmin(axis=1) + np.arange(at, end)
    first = np.nonzero(np.concatenate(([True], place[1:] != place[:-1])))[0]
    return first, np.diff(np.append(first, n)), g[place[first]]


def _anchor_rows(window: int, anchor: int):
    """(key, doc_id, at) per anchor, at being 4 * place + kind. Kind 0: seen once in the batch; 1: seen more often, so surely repeated,
    under a spread key; 2: the stand-in of such an anchor, with its count in place of the doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, at, value = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(words) >= window:
                    first, _, v = _anchors(_hashes(words), window, anchor)
                    docs.append(np.full(len(first), doc, np.int64))
                    at.append(first)
                    value.append(v)
            if not docs:
                continue
            docs, at, value = np.concatenate(docs), np.concatenate(at), np.concatenate(value)
            order = np.argsort(value, kind="stable")
            docs, at, value = docs[order], at[order], value[order]
            head = np.nonzero(np.concatenate(([True], value[1:] != value[:-1])))[0]
            count = np.diff(np.append(head, len(value)))
            many = np.repeat(count > 1, count)
            spread = _mix(docs.view(np.uint64) * _M + at.view(np.uint64))
            stand = head[count > 1]
            cols = [
                np.concatenate((np.where(many, spread, value), value[stand])).view(np.int64),
                np.concatenate((docs, count[count > 1])),
                np.concatenate((4 * at + many, np.full(len(stand), 2))),
            ]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["key", "doc_id", "at"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: (doc_id, at) of repeated anchors, and (key, n), once, of keys with their total count n."""
    held: list[tuple[np.ndarray, ...]] = []

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, doc, at = cols
        kind, at = at & 3, at >> 2
        counted, n = kind != 1, np.where(kind == 2, doc, 1)
        head = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
        rows, total = np.add.reduceat(counted.astype(np.int64), head), np.add.reduceat(np.where(counted, n, 0), head)
        size = np.diff(np.append(head, len(key)))
        emit = (kind == 1) | ((kind == 0) & np.repeat(total > 1, size))
        big = (rows > 0) & (total > 63)  # those that may be hot
        cols = [
            pa.array(np.concatenate((doc[emit], np.zeros(big.sum(), np.int64)))),
            pa.array(np.concatenate((at[emit], np.zeros(big.sum(), np.int64)))),
            pa.array(np.concatenate((np.zeros(emit.sum(), np.int64), key[head][big]))),
            pa.array(np.concatenate((np.zeros(emit.sum(), np.int64), total[big]))),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "at", "key", "n"])

    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(3)]
        if not b.num_rows:
            continue
        if held:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last key may go on in the next batch
        if last:
            yield solve([c[:last] for c in cols])
        held = [c[last:] for c in cols]
    if held:
        yield solve(held)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _runs_of(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(doc_id, at, n) with stretches that follow each other put together."""
    if not found:
        return found
    doc, at, n = (np.array(c, np.int64) for c in zip(*sorted(found)))
    head = np.nonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1]))))[0]
    last = np.append(head[1:], len(doc)) - 1
    return list(zip(doc[head].tolist(), at[head].tolist(), (at[last] + n[last] - at[head]).tolist()))


def _passages(window: int, anchor: int, hot_keys):
    """Stretches of text around repeated anchors: (key, doc_id, at, n, words); for stretches that the batch holds at an earlier place too
    the verdict at once, words being null and the key spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_keys.value
        for b in batches:
            best: dict[bytes, tuple] = {}
            done, out = [], []
            for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                h = _hashes(words)
                first, size, value = _anchors(h, window, anchor)
                hit = np.nonzero(_among(first, np.sort(wanted.values.to_numpy())))[0]
                is_hot = _among(value[hit], hot)
                whole = _grams(h, window) if is_hot.any() else None
                for i, alone in zip(hit.tolist(), is_hot.tolist()):
                    s, n = int(first[i]), int(size[i])
                    for at, m, key in [(j, 1, whole[j]) for j in range(s, s + n)] if alone else [(s, n, value[i])]:
                        body = b" ".join(words[at : at + m + window - 1])
                        row = (int(key), doc, at, m)
                        kept = best.get(body)
                        if kept is None:
                            best[body] = row
                        elif kept[1:3] <= row[1:3]:
                            if kept[1:3] < row[1:3]:
                                done.append(row[1:])
                        else:
                            done.append(kept[1:])
                            best[body] = row
            done = _runs_of(done)
            rows = [(k - (1 << 64) if k >> 63 else k, d, a, m, body) for body, (k, d, a, m) in best.items()] + [(d * 1_000_003 + a & (1 << 62) - 1, d, a, m, None) for d, a, m in done]
            for at in range(0, len(rows), 100_000):
                part = rows[at : at + 100_000]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], ["key", "doc_id", "at", "n", "words"])

    return run


def _judge(rows: list[tuple], window: int) -> list[tuple[int, int, int]]:
    """(doc_id, at, n): n windows from `at` on whose words occur earlier, for stretches (doc_id, at, n, words) that share their anchors.

    The index is built of the distinct stretches, each at its first place; all stretches are matched against it, equal ones at once.
    """
    rows.sort(key=lambda r: (r[0], r[1]))
    ids: dict[bytes, int] = {}
    places: dict[bytes, list[tuple[int, int]]] = {}
    for doc, at, _, body in rows:
        places.setdefault(body, []).append((doc, at))
    patterns = [np.array([ids.setdefault(w, len(ids) + 1) for w in body.split(b" ")], np.int64) for body in places]
    begin = np.cumsum([0, *[len(p) + 1 for p in patterns]])[:-1]
    index = FmIndex(np.concatenate([np.append(p, 0) for p in patterns]), window)
    out = []
    for where, here, earliest in zip(places.values(), begin.tolist(), index.earliest(patterns)):
        own = here + np.arange(len(earliest))
        for doc, at in dict.fromkeys(where):
            # Text order is the order of first places, so a smaller place is earlier; a copy comes after its first place itself.
            late = (earliest >= 0) & (earliest < own + ((doc, at) > where[0]))
            if late.any():
                edge = np.diff(np.concatenate(([0], late.astype(np.int8), [0])))
                out += [(doc, at + int(s), int(e - s)) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return out


def _shards(window: int, shard_words: int):
    """For stretches sorted by key: one FM-index per about shard_words words of whole keys, each stretch matched against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last, begun = 0, None, 0

        def verdicts(found: list[tuple]) -> pa.RecordBatch:
            found = _runs_of(found)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["doc_id", "at", "n"])

        for b in batches:
            known: list[tuple] = []
            for key, doc, at, n, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if body is None:
                    known.append((doc, at, n))
                    continue
                if key != last:
                    if size >= shard_words:
                        yield verdicts(_judge(rows, window))
                        rows, size = [], 0
                    elif len(rows) - begun == 1:  # a key with one stretch has nothing to be compared with
                        size -= rows[begun][2] + window
                        rows.pop()
                    last, begun = key, len(rows)
                rows.append((doc, at, n, body))
                size += n + window
            yield verdicts(known)
        if rows:
            yield verdicts(_judge(rows, window))

    return run


def kept_words(text: str | None, ranges: list[tuple[int, int]], window: int) -> tuple[int, list[bytes]]:
    """(number of words, words that no window of the ranges (first window, windows) covers)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not ranges:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    r = np.array(ranges, np.int64)
    np.add.at(edge, r[:, 0], 1)
    np.add.at(edge, np.minimum(r[:, 0] + r[:, 1] + window - 1, len(words)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), [w for w, g in zip(words, gone.tolist()) if not g]


def repeated_ranges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = 400_000, hot_share: int = 4_000_000) -> DataFrame:
    """(doc_id, ranges) of the documents with repeats; ranges is array<struct<at, n>>: from word window `at` on, n windows of which each
    also begins earlier.

    Earlier: in a document of smaller doc_id, or before in the same document. Passes:
    1. Each run of windows that share an anchor gives a row; anchors that occur once in all texts are dropped. Rows of one anchor in
       one batch go as one row, so an anchor that every document holds gives as many rows as there are batches.
    2. The stretches of words around repeated anchors go to shards by anchor. Anchors with a share of over 1 / hot_share (and over
       HOT_MIN) go window by window, by the hash of the whole window; there are at most hot_share of them, so their list may be broadcast.
    3. In each shard an FM-index is built of the distinct stretches, and all its stretches are matched against it by backward search; the
       windows found earlier are reported. Equal stretches of one batch of texts go as one, the first of them: the others are known to
       come later.

    Null and blank texts have no words. Rows with a null doc_id are left whole. doc_id names a text: rows that repeat one get the same
    ranges, none of them counts as earlier than the other. An empty table gives no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    named = _texts(docs).where("doc_id is not null")
    seen = named.mapInArrow(_anchor_rows(window, anchor), "key long, doc_id long, at long")
    again = stored(seen.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "doc_id long, at long, key long, n long"))
    total = again.where("n = 0").count()
    hot = again.where(F.col("n") > max(HOT_MIN, total // hot_share)).select("key").toPandas()["key"].to_numpy(np.int64)  # at most hot_share keys
    hot_keys = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)))
    wanted = again.where("n = 0").groupBy("doc_id").agg(F.collect_list("at").alias("wanted"))
    near = named.join(wanted, "doc_id").select("doc_id", "text", "wanted")
    found = near.mapInArrow(_passages(window, anchor, hot_keys), "key long, doc_id long, at long, n long, words binary")
    late = found.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(window, shard_words), "doc_id long, at long, n long")
    return late.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id and text; plain columns where the types are right already, so that equal plans stay equal and Spark can share a shuffle."""
    kinds = {"doc_id": "bigint", "text": "string"}
    have = dict(docs.dtypes)
    return docs.select(*[F.col(c) if have[c] == k else F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def _applied(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ranges in zip(b.column(1), b.column(2)):
                n, kept = kept_words(text.as_py(), [(r["at"], r["n"]) for r in ranges.as_py() or []], window)
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode("utf-8", "surrogatepass")))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): the words that no repeated window covers, joined by one space."""
    rows = _texts(docs)
    ranges = repeated_ranges(rows, window, **options)
    # The join's left side is the one that repeated_ranges shuffles too, so that Spark shuffles the texts once.
    both = rows.where("doc_id is not null").join(ranges, "doc_id", "left").select("doc_id", "text", "ranges")
    both = both.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    return both.mapInArrow(_applied(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def cut_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """docs with the repeated passages cut out of text, and n_chars, where there is such a column, counted anew; other columns stay.

    Texts in which nothing repeats stay as they are, null ones null; in others the kept words are joined by one space. No row is dropped;
    rows with a null doc_id are left whole. An empty table gives an empty one.
    """
    ident, found_in = fresh(docs, "range_id"), fresh(docs, "found_ranges")
    ranges = repeated_ranges(docs, window, **options).select(F.col("doc_id").alias(ident), F.col("ranges").alias(found_in))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            texts = []
            for text, found in zip(cols["text"], cols[found_in]):
                r = found.as_py()
                texts.append(b" ".join(kept_words(text.as_py(), [(x["at"], x["n"]) for x in r], window)[1]).decode("utf-8", "surrogatepass") if r else text.as_py())
            cols["text"] = pa.array(texts, cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if not r.as_py() else len(t or "") for n, t, r in zip(cols["n_chars"].to_pylist(), texts, cols[found_in])], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return docs.join(ranges, F.col("doc_id") == F.col(ident), "left").select(*names, found_in).mapInArrow(run, docs.schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes repeated passages from all documents; see repeated_ranges for nulls, repeated rows and empty tables."""
    return remove_repeats(load(spark, sf_dir, "documents")).drop("kept_text")


OP4_SQL = """
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, unnest(range(1, len(ws) - 18)) as i, ws from w where len(ws) >= 20),
g as (select doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) as h from s),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as k from g) where k > 1),
x as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from r)),
gone as (select doc_id, count(*) as n, list(p) as ps from x group by doc_id),
j as (select w.doc_id, ws, coalesce(n, 0) as n from w left join gone on w.doc_id = gone.doc_id),
u as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
k as (select u.doc_id, string_agg(word, ' ' order by u.p) as t from u left join x on u.doc_id = x.doc_id and u.p = x.p where x.p is null group by u.doc_id)
select j.doc_id, len(ws)::bigint as n_words, n::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from j left join k on j.doc_id = k.doc_id
"""
