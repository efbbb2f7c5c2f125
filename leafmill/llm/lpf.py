"""Removal of repeated byte passages: longest previous and next factors from suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import load, stored

WINDOW = 200
#: Bytes of an anchor, the part of a window that decides its shard.
ANCHOR = 64
#: Anchors seen this often or less are never treated as hot.
HOT_MIN = 1000
_BLOCK = 1 << 17
_M = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


# ---------------------------------------------------------------- suffix order


class Factors:
    """Suffix order of byte strings up to `depth` bytes, and the longest previous and next factors read off it.

    Suffixes are ordered by prefix doubling: first by 8 bytes, then by twice as many in each round, only those still tied. starts are the
    places whose suffixes count. For each of them the nearest suffixes in suffix order that begin earlier in the text (previous and next
    smaller positions) hold its longest earlier match, the nearest that begin later its longest later match. Lengths end at `depth`.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, depth: int) -> None:
        n, self.depth = len(text), depth
        padded = np.concatenate((text, np.zeros(depth + 8, np.uint8)))
        self.equal: list[tuple[int, np.ndarray]] = [(1, padded)]
        key = padded[: n + depth + 1].astype(np.uint64)
        for h in (1, 2, 4):  # values of 2, 4 and 8 bytes in text order
            value = (key[:-h] << np.uint64(8 * h)) | key[h:]
            key = np.concatenate((value, np.zeros(h, np.uint64)))
            if h < 4:
                self.equal.append((2 * h, key.astype(np.uint32)))
        order = np.argsort(key[:n])
        rank, tied = np.zeros(n + depth + 8, np.int64), order
        rank[order], tied = self._heads(key[order], np.zeros(n, np.int64), np.arange(n), order)
        self.equal.append((8, rank.astype(np.int32)))
        h = 8
        while h < depth:
            step = min(h, depth - h)  # the last round makes the length `depth` exactly
            key = (rank[tied] << 32) | rank[tied + step]
            o = np.argsort(key)
            at, key = tied[o], key[o]
            group = key >> 32
            head = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
            first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else np.zeros(0, np.int64)
            new, tied = self._heads(key, group, np.arange(len(at)) - first, at)
            rank[at] = new
            h += step
            self.equal.append((h, rank.astype(np.int32)))
        ties = np.lexsort((starts, rank[starts]))
        #: The places in suffix order, equal suffixes in text order.
        self.order = starts[ties]
        self.slot = ties

    @staticmethod
    def _heads(key: np.ndarray, base: np.ndarray, within: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of sorted keys (base + the place of the first equal one), and those of `at` that share theirs."""
        if not len(key):
            return base, at
        change = key[1:] != key[:-1]
        head = np.concatenate(([True], change))
        last = np.concatenate((change, [True]))
        return (base + within[np.flatnonzero(head)[np.cumsum(head) - 1]]), at[~(head & last)]

    def _nearest(self, values: np.ndarray) -> np.ndarray:
        """Index of the nearest smaller value to the left of each, -1 if none: indices that aren't smaller pass on their own nearest."""
        n = len(values)
        near, open_ = np.arange(-1, n - 1), np.arange(n)
        while True:
            at = near[open_]
            open_ = open_[(at >= 0) & (values[np.maximum(at, 0)] > values[open_])]
            if not len(open_):
                return near
            near[open_] = near[near[open_]]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, up to depth."""
        n, whole = np.full(len(a), self.depth), self.equal[-1][1]
        rest = np.flatnonzero(whole[a] != whole[b])
        a, b, m = a[rest], b[rest], np.zeros(len(rest), np.int64)
        for h, rank in self.equal[-2::-1]:
            ok = m + h <= self.depth
            m += np.where(ok & (rank[np.where(ok, a + m, 0)] == rank[np.where(ok, b + m, 0)]), h, 0)
        n[rest] = m
        return n

    def _longest(self, values: np.ndarray, of: np.ndarray | None) -> np.ndarray:
        """Longest match of each start (or those of the mask `of`) with one of smaller value, by both neighbours in suffix order."""
        found = np.zeros(len(values), np.int64)
        for way in (slice(None), slice(None, None, -1)):
            order, slot, near = self.order[way], self.slot[way], self._nearest(values[way])
            some = np.flatnonzero(near >= 0 if of is None else (near >= 0) & of[slot])
            found[slot[some]] = np.maximum(found[slot[some]], self._common(order[some], order[near[some]]))
        return found

    def previous(self, of: np.ndarray | None = None) -> np.ndarray:
        """Longest previous factor of each start, or of those in the mask."""
        return self._longest(self.order, of)

    def next(self, of: np.ndarray | None = None) -> np.ndarray:
        """Longest factor of each start that also begins later."""
        return self._longest(-self.order, of)


# ---------------------------------------------------------------- anchors


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` bytes: those of a power of two by doubling, put together by the bits of size."""
    n = len(text) - size + 1
    power, length = text.astype(np.uint64) + np.uint64(1), 1
    out, have = None, 0
    while length <= size:
        if size & length:
            out = power[: len(text) - length + 1] if out is None else out[: len(text) - have - length + 1] * np.uint64(pow(_M, length, 1 << 64)) + power[have : len(text) - length + 1]
            have += length
        if 2 * length <= size:
            power = power[:-length] * np.uint64(pow(_M, length, 1 << 64)) + power[length:]
        length *= 2
    return _mixed(out[:n])


def anchors(text: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, value) of each run of windows with one anchor: the leftmost of a window's runs of `anchor` bytes with the smallest hash.

    Equal windows have equal anchors, so windows of one anchor are all there is to compare them with. Long texts go in blocks.
    """
    per, total = window - anchor + 1, len(text) - window + 1
    firsts, places, values, last = [], [], [], -1
    for at in range(0, total, _BLOCK):
        count = min(_BLOCK, total - at)
        g = gram_hashes(text[at : at + count + window - 1], anchor)  # count + per - 1 of them
        low = np.uint64((1 << 18) - 1)
        v = np.full(-(-(len(g)) // per) * per, _WRAP, np.uint64)
        v[: len(g)] = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        rows = v.reshape(-1, per)
        ahead, behind = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:count], ahead[per - 1 : per - 1 + count]) & low).astype(np.int64)
        head = np.flatnonzero(np.concatenate(([place[0] + at != last], place[1:] != place[:-1])))
        firsts.append(head + at)
        values.append(g[place[head]])
        last = int(place[-1]) + at
    first = np.concatenate(firsts)
    return first, np.diff(np.append(first, total)), np.concatenate(values)


def _tally(docs: np.ndarray, at: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """(key, doc_id, at) with at = 4 * place + kind. Kind 0: seen once here, under its value; 1: seen more often, so surely repeated, under a
    spread key; 2: the stand-in of such a value, its count in place of the doc_id. A value that all texts hold gives one row a batch under its key."""
    order = np.argsort(value, kind="stable")
    docs, at, value = docs[order], at[order], value[order]
    head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    count = np.diff(np.append(head, len(value)))
    many = np.repeat(count > 1, count)
    spread = _mixed(docs.view(np.uint64) * np.uint64(_M) + at.view(np.uint64))
    stand = head[count > 1]
    key = np.concatenate((np.where(many, spread, value), value[stand])).view(np.int64)
    cols = [key, np.concatenate((docs, count[count > 1])), np.concatenate((4 * at + many, np.full(len(stand), 2)))]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["key", "doc_id", "at"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of _tally's rows sorted by key: (doc_id, at) of repeated values with n = 0, and (key, n), once, of values seen n times in all, n over 63."""
    held: list[tuple[np.ndarray, ...]] = []

    def solve(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        kind, at = at & 3, at >> 2
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(head, len(key)))
        total = np.add.reduceat(np.where(kind == 1, 0, np.where(kind == 2, doc, 1)), head)
        emit = (kind == 1) | ((kind == 0) & np.repeat(total > 1, size))
        big = total > 63
        none, zero = np.zeros(big.sum(), np.int64), np.zeros(emit.sum(), np.int64)
        cols = [(doc[emit], none), (at[emit], none), (zero, key[head][big]), (zero, total[big])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["doc_id", "at", "key", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(3)]
        if held:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last key may go on in the next batch
        if last:
            yield solve(*(c[:last] for c in cols))
        held = [c[last:] for c in cols]
    if held:
        yield solve(*held)


def _counted(rows: DataFrame) -> DataFrame:
    """(doc_id, at, key, n), stored; see _repeated."""
    return stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "doc_id long, at long, key long, n long"))


def _bytes(cell: pa.Scalar) -> np.ndarray:
    data = cell.as_py()
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _in_batches(found: Iterator[tuple[np.ndarray, ...]], most: int = 2_000_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of texts put together to some `most` rows."""
    held, size = [], 0
    for cols in found:
        held.append(cols)
        size += len(cols[0])
        if size >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def _anchor_rows(window: int, anchor: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            for doc, cell in zip(b.column(0).to_pylist(), b.column(1)):
                text = _bytes(cell)
                if len(text) >= window:
                    first, _, value = anchors(text, window, anchor)
                    yield np.full(len(first), doc, np.int64), first, value

    return lambda batches: (_tally(*cols) for cols in _in_batches(each(batches)))


def _window_rows(window: int, anchor: int, hot_keys):
    """_tally's rows of the windows whose anchors are hot, by the hash of the whole window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        hot = hot_keys.value
        for b in batches:
            for doc, cell in zip(b.column(0).to_pylist(), b.column(1)):
                text = _bytes(cell)
                if len(text) < window:
                    continue
                first, size, value = anchors(text, window, anchor)
                is_hot = _among(value, hot)
                if is_hot.any():
                    for s, e in _spans(first[is_hot], size[is_hot]):
                        yield np.full(e - s, doc, np.int64), np.arange(s, e), gram_hashes(text[s : e + window - 1], window)

    return lambda batches: (_tally(*cols) for cols in _in_batches(each(batches)))


def _spans(at: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the maximal runs of the sorted intervals [at, at + n)."""
    if not len(at):
        return []
    end = np.maximum.accumulate(at + n)
    head = np.flatnonzero(np.concatenate(([True], at[1:] > end[:-1])))
    return list(zip(at[head].tolist(), end[np.append(head[1:], len(at)) - 1].tolist()))


# ---------------------------------------------------------------- shards

_ROW = {"key": pa.int64(), "n": pa.int32(), "doc_id": pa.int64(), "at": pa.int64(), "last_id": pa.int64(), "last_at": pa.int64(), "body": pa.binary()}


def _stretches(window: int, anchor: int, hot_keys, bytes_a_batch: int = 1 << 25):
    """Stretches of text around repeated anchors, each distinct one of a batch once, with its first and its last place; under hot anchors the
    repeated windows, one a stretch. A place between a first and a last one has equals before and behind it: (doc_id, at, n) without a body."""

    def emitted(best: dict[tuple[int, bytes], list], known: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = [(k, len(body) - window + 1, *p, *q, body) for (k, body), (p, q) in best.items()]
        rows += [((d * 1_000_003 + a) & ((1 << 62) - 1), n, d, a, d, a, None) for d, a, n in _joined(known)]
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(_ROW.values())], [*_ROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_keys.value
        best: dict[tuple[int, bytes], list] = {}
        known: list[tuple] = []
        size = 0

        def add(key: int, body: bytes, place: tuple[int, int]) -> None:
            nonlocal size
            two = best.get((key, body))
            if two is None:
                best[(key, body)] = [place, place]
                size += len(body) + 100
                return
            middle = place
            if place < two[0]:
                two[0], middle = place, two[0]
            elif place > two[1]:
                two[1], middle = place, two[1]
            if two[0] < middle < two[1]:
                known.append((*middle, len(body) - window + 1))
                size += 100

        for b in batches:
            for doc, cell, wanted, again in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                data = cell.as_py()
                text = np.frombuffer(data, np.uint8)
                first, n, value = anchors(text, window, anchor)
                hit = np.flatnonzero(_among(first, np.sort(wanted.values.to_numpy())))
                is_hot = _among(value[hit], hot)
                for i in hit[~is_hot].tolist():
                    s, e = int(first[i]), int(first[i] + n[i] + window - 1)
                    add(int(value[i].view(np.int64)), data[s:e], (doc, s))
                if again.is_valid:
                    places = np.sort(again.values.to_numpy())
                    for s, e in _spans(places, np.ones(len(places), np.int64)):
                        for j, h in enumerate(gram_hashes(text[s : e + window - 1], window).view(np.int64).tolist()):
                            add(h, data[s + j : s + j + window], (doc, s + j))
                if size >= bytes_a_batch:
                    yield from emitted(best, known)
                    best, known, size = {}, [], 0
        yield from emitted(best, known)

    return run


def _joined(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(doc_id, at, n) with runs that touch or overlap put together."""
    if not found:
        return []
    doc, at, n = (np.array(c, np.int64) for c in zip(*sorted(found)))
    out, edges = [], np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
    for s, e in zip(edges, edges[1:]):
        out += [(int(doc[s]), a, z - a) for a, z in _spans(at[s:e], n[s:e])]
    return out


def judge(rows: list[tuple], window: int, first_stays: bool) -> list[tuple[int, int, int]]:
    """(doc_id, at, n): n windows from `at` on that are repeated, of stretches (key, n, doc_id, at, last_id, last_at, body).

    The text of the index is the distinct stretches in the order of their first places. A window is repeated if its longest previous factor
    is a whole window, or, unless the first of equals stays, its longest next factor. A stretch's later places repeat its first.
    """
    places: dict[bytes, list] = {}
    for _, _, d, a, d2, a2, body in rows:
        places.setdefault(body, []).extend([(d, a), (d2, a2)])
    bodies = sorted(places, key=lambda x: min(places[x]))
    begin = np.cumsum([0, *map(len, bodies)])
    count = [len(x) - window + 1 for x in bodies]
    starts = np.concatenate([np.arange(b, b + c) for b, c in zip(begin.tolist(), count)])
    index = Factors(np.frombuffer(b"".join(bodies), np.uint8), starts, window)
    late = index.previous() >= window
    twice = late if first_stays else late | (index.next(of=~late) >= window)
    out, at = [], 0
    for body, n in zip(bodies, count):
        own, (first, *others) = twice[at : at + n], sorted(set(places[body]))
        at += n
        edge = np.diff(np.concatenate(([0], own.astype(np.int8), [0])))
        if others and not first_stays:
            others.append(first)
        elif own.any():
            out += [(first[0], first[1] + int(s), int(e - s)) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        out += [(d, a, n) for d, a in others]
    return out


def _shards(window: int, first_stays: bool, shard_bytes: int):
    """For stretches sorted by key: one suffix array per about shard_bytes bytes of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last, begun = 0, None, 0

        def verdicts(found: list[tuple]) -> pa.RecordBatch:
            found = _joined(found)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["doc_id", "at", "n"])

        def alone() -> bool:
            """Whether the last key has one stretch at one place, which has nothing to be compared with."""
            return len(rows) - begun == 1 and rows[begun][2:4] == rows[begun][4:6]

        for b in batches:
            known: list[tuple] = []
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if row[6] is None:
                    known.append((row[2], row[3], row[1]))
                    continue
                if row[0] != last:
                    if last is not None and alone():
                        size -= len(rows.pop()[6])
                    if size >= shard_bytes:
                        yield verdicts(judge(rows, window, first_stays))
                        rows, size = [], 0
                    last, begun = row[0], len(rows)
                rows.append(row)
                size += len(row[6])
            if known:
                yield verdicts(known)
        if rows and not (len(rows) == 1 and alone()):
            yield verdicts(judge(rows, window, first_stays))

    return run


# ---------------------------------------------------------------- operator


def repeated_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, first_stays: bool = True, shard_bytes: int = 1 << 20, hot_share: int = 4_000_000, hot_min: int = HOT_MIN) -> DataFrame:
    """(doc_id, ranges) of the documents with repeats; ranges is array<struct<at, n>>: n windows of `window` bytes from byte `at` on that repeat.

    first_stays: a window repeats if it also begins earlier (smaller doc_id, or before in the same document). Otherwise if it begins anywhere
    else. Matches never cross documents. Passes:
    1. Each run of windows that share an anchor gives a row; anchors that occur once in all texts are dropped.
    2. Windows under anchors with a share of over 1 / hot_share (and over hot_min) are counted by the hash of the whole window, and those that
       occur once are dropped. There are at most hot_share such anchors, so their list may be broadcast.
    3. Stretches around repeated anchors go to shards by anchor, windows under hot ones by window. A shard orders its suffixes and reads off
       the longest previous and next factors.

    Null texts are empty. Rows with a null doc_id are left whole. doc_id names a text: rows that repeat one count once and get the same ranges.
    Texts shorter than a window repeat nothing. An empty table gives no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    named = _texts(docs).where("doc_id is not null")
    again = _counted(named.mapInArrow(_anchor_rows(window, anchor), "key long, doc_id long, at long"))
    total = again.where("n = 0").count()
    hot = again.where(F.col("n") > max(hot_min, total // hot_share)).select("key").toPandas()["key"].to_numpy(np.int64)  # at most hot_share keys
    hot_keys = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)))
    wanted = again.where("n = 0").groupBy("doc_id").agg(F.collect_list("at").alias("wanted"))
    near = named.join(wanted, "doc_id").select("doc_id", "text", "wanted")
    if len(hot):
        windows = _counted(near.select("doc_id", "text").mapInArrow(_window_rows(window, anchor, hot_keys), "key long, doc_id long, at long"))
        near = near.join(windows.where("n = 0").groupBy("doc_id").agg(F.collect_list("at").alias("again")), "doc_id", "left").select("doc_id", "text", "wanted", "again")
    else:
        near = near.withColumn("again", F.lit(None).cast("array<long>"))
    kinds = "key long, n int, doc_id long, at long, last_id long, last_at long, body binary"
    found = near.mapInArrow(_stretches(window, anchor, hot_keys), kinds)
    twice = found.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(window, first_stays, shard_bytes), "doc_id long, at long, n long")
    return twice.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text's UTF-8 bytes, null ones empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def kept_bytes(data: bytes, ranges: list[tuple[int, int]], window: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that no window of the ranges covers, and (begin, end) of the maximal removed runs."""
    if not ranges:
        return data, []
    at, n = (np.array(c, np.int64) for c in zip(*sorted(ranges)))
    gone = _spans(at, n + window - 1)
    cuts = [0, *(x for s in gone for x in s), len(data)]
    return b"".join(data[s:e] for s, e in zip(cuts[::2], cuts[1::2])), gone


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, first_stays: bool = True, **options) -> DataFrame:
    """(doc_id, n_bytes, kept binary, removed array<struct<begin, end>>): each text without the bytes that repeated windows cover.

    A row for each row of docs. Kept bytes may begin or end inside a character. See repeated_bytes for nulls, repeated rows and empty tables.
    """
    rows = _texts(docs)
    ranges = repeated_bytes(docs, window, first_stays=first_stays, **options)
    both = rows.where("doc_id is not null").join(ranges, "doc_id", "left").select("doc_id", "text", "ranges")
    both = both.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cell, found in zip(b.column(1), b.column(2)):
                data = cell.as_py()
                kept, gone = kept_bytes(data, [(r["at"], r["n"]) for r in found.as_py() or []], window)
                out.append((len(data), kept, [{"begin": s, "end": e} for s, e in gone]))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[i] for o in out], k) for i, k in enumerate([pa.int64(), pa.binary(), span])]], ["doc_id", "n_bytes", "kept", "removed"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, kept binary, removed array<struct<begin: long, end: long>>")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents without any copy of a repeated passage of 200 bytes; see repeated_bytes."""
    out = remove_repeated_bytes(load(spark, sf_dir, "documents"), first_stays=False)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k from (select doc_id, h, unnest(range(0, len(h) // 2 - 199)) as i from b where len(h) >= 400)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as c from w) where c > 1),
p as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from r),
g as (select doc_id, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) as run from p),
x as (select doc_id, min(i) as s, max(i) + 200 as e from g group by doc_id, run),
k as (select doc_id, coalesce(lag(e) over (partition by doc_id order by s), 0) as s, s as e from x union all select doc_id, max(e), 1000000000 from x group by doc_id),
t as (select k.doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' order by s) as kept from k join b on k.doc_id = b.doc_id group by k.doc_id),
n as (select doc_id, sum(e - s) as removed, count(*) as spans from x group by doc_id)
select b.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from b left join n on b.doc_id = n.doc_id left join t on b.doc_id = t.doc_id
"""
