"""Language-model scoring from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import fold_of, load, stored

#: Words of the longest n-grams.
ORDER = 3
#: Filter bits and probes per entry.
BITS, PROBES = 10, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)


def _base(kind: int) -> float:
    """Ratio of neighbouring count levels: finer for single words (kind 1) than for longer n-grams."""
    return 1.25 if kind == 1 else 2.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- tokens

_SPAN = 1 << 18
_GAP = re.compile(rb"[ \t-\r]")
_IS_GAP = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r")).astype(np.int8)
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _A)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
END = _mix(np.zeros(1, np.uint64) + _B)  # no word has this hash but by chance of one in 2**64
_power: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0, 1, ... n - 1 of an odd number modulo 2**64, and of its inverse."""
    if not _power or len(_power[0]) < n:
        m = 0x9E3779B97F4A7C15
        _power[:] = [np.multiply.accumulate(np.concatenate(([_ONE], np.full(n - 1, x, np.uint64)))) for x in (m, pow(m, -1, 1 << 64))]
    return _power


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the words, A-Z taken as a-z: differences of running polynomial sums, so that no word is handled alone."""
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + _SPAN, len(data))
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        raw = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(_IS_GAP[raw], prepend=1, append=1))
        up, down = _powers(max(len(raw) + 1, _SPAN))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
        start, stop = edge[::2], edge[1::2]
        hashes.append(_mix((total[stop] - total[start]) * down[start]))
        places.append(start + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def tokens_in(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, first token of each text, tokens of each text) of texts of `sizes` bytes, each followed by a newline in data. A text's
    tokens are its words and an end."""
    words, places = word_hashes(data)
    counts = np.bincount(np.searchsorted(np.cumsum(sizes + 1), places, "right"), minlength=len(sizes)) + 1
    heads = np.cumsum(counts) - counts
    ends = np.zeros(int(counts.sum()), bool)
    ends[heads + counts - 1] = True
    tokens = np.empty(len(ends), np.uint64)
    tokens[ends], tokens[~ends] = END, words
    return tokens, heads, counts


def shifted(values: np.ndarray, heads: np.ndarray, first: np.ndarray | int) -> np.ndarray:
    """Each place's value before it; `first` before the first token of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[heads] = first
    return out


def ngrams(tokens: np.ndarray, heads: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, n = 1 ... order; an end stands before each text."""
    out, first = [tokens], END
    for _ in range(order - 1):
        out.append(_mix(shifted(out[-1], heads, first) * _A + tokens))
        first = _mix(first * _A + END)
    return out


# ---------------------------------------------------------------- the filter


def _levels(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base(count)), 0 for none; a small addend keeps whole powers on their level."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9), 0).astype(np.int64)


def _count_of(levels: np.ndarray, base: float) -> np.ndarray:
    """The count a level stands for, the middle (in logarithms) of its whole numbers; 0 for level 0."""
    low = np.ceil(base ** (levels - 1.0) - 1e-6)
    high = np.maximum(low, np.ceil(base ** (levels.astype(float)) - 1e-6) - 1)
    return np.where(levels > 0, np.sqrt(low * high), 0.0)


@dataclass
class CountFilter:
    """Bloom filter in blocks, which the top bits of an n-gram's name choose. It holds entries (name, level) for each level up to that of
    the n-gram's count; the count is read back by asking for level 1, 2, ... until one is missing."""

    shift: int  # of a name, to its block
    start: np.ndarray  # first bit of each block
    bits: np.ndarray  # bits of each block, under 2**32
    probes: int
    data: np.ndarray  # packed bits

    def _places(self, names: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(names ^ (np.full(1, level, np.uint64) * _B))
        block = (names >> np.uint64(self.shift)).astype(np.int64) if len(self.bits) > 1 else np.zeros(len(names), np.int64)
        return h, _mix(h + _A) | _ONE, self.start[block], self.bits[block].astype(np.uint64)

    def level(self, names: np.ndarray, most: int = 127) -> np.ndarray:
        out, at = np.zeros(len(names), np.int64), np.arange(len(names))
        for level in range(1, most + 1):
            h, step, start, bits = self._places(names[at], level)
            alive = np.flatnonzero(bits)
            for _ in range(self.probes):
                x = h[alive]
                place = start[alive] + (((x >> np.uint64(32)) * bits[alive]) >> np.uint64(32)).astype(np.int64)
                alive = alive[((self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)]
                h[alive] += step[alive]
            at = at[alive]
            if not len(at):
                break
            out[at] = level
        return out

    @classmethod
    def of(cls, names: np.ndarray, levels: np.ndarray, bits: int = BITS, probes: int = PROBES) -> CountFilter:
        """One block that holds all the names."""
        size = max(8, -(-int(levels.sum()) * bits // 8) * 8) if len(names) else 0
        if size >> 32:
            raise ValueError("a block of the filter has 2**32 bits or more: use smaller blocks")
        data, out = np.zeros(size, bool), cls(64, np.zeros(1, np.int64), np.array([size]), probes, np.zeros(0, np.uint8))
        for level in range(1, int(levels.max(initial=0)) + 1):
            h, step, _, n = out._places(names[levels >= level], level)
            for _ in range(probes):
                data[(((h >> np.uint64(32)) * n) >> np.uint64(32)).astype(np.int64)] = True
                h += step
        out.data = np.packbits(data, bitorder="little")
        return out

    @classmethod
    def joined(cls, blocks: dict[int, bytes], log2: int, shift: int, probes: int) -> CountFilter:
        sizes = np.array([len(blocks.get(b, b"")) for b in range(1 << log2)], np.int64)
        return cls(shift, 8 * (np.cumsum(sizes) - sizes), 8 * sizes, probes, np.frombuffer(b"".join(blocks[b] for b in sorted(blocks)) + b"\0", np.uint8))


# ---------------------------------------------------------------- counting


_squeezer, _opener = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    """The bytes of the numbers, all first bytes before all second ones and so on, compressed."""
    return _squeezer.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).data)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(_opener.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, the first from 0."""
    return np.diff(x, prepend=x.dtype.type(0))


_BUNCH = "bunch string, ids array<bigint>, held array<boolean>, sizes array<bigint>, texts binary"


def _gathered(most_bytes: int):
    """Stretches of rows of about most_bytes of text, compressed, under a random name, which is fixed by storing them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, parts, size = [], [], [], 0

        def packed() -> pa.RecordBatch:
            texts = zstandard.ZstdCompressor(level=3).compress(b"".join(p + b"\n" for p in parts))
            cols = [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([texts], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _BUNCH.split(", ")])

        for b in batches:
            for doc_id, is_held, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text")):
                ids.append(doc_id)
                held.append(is_held)
                parts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                size += len(parts[-1])
                if size >= most_bytes or len(ids) >= 1 << 16:
                    yield packed()
                    ids, held, parts, size = [], [], [], 0
        if ids:
            yield packed()

    return run


def _opened(sizes: list[int], texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tokens_in(_opener.decompress(texts), np.array(sizes, np.int64))


def _width(kind: int, log2: int) -> int:
    """Bits of a name: all but one for single words, whose counts must be exact; for others 32 in a block, so that about one in
    a few thousand shares its name, far fewer than the filter takes for others anyway."""
    return 63 if kind == 1 else log2 + 32


def _named(hashes: np.ndarray, kind: int, log2: int) -> np.ndarray:
    return hashes >> np.uint64(64 - _width(kind, log2))


def _counted(log2: int, order: int):
    """Rows (kind, block, bunch, names, trained): a bunch's distinct n-grams of `kind` words and their counts in training texts."""
    names = ["kind", "block", "bunch", "names", "trained"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bunch, held, sizes, texts in zip(*(b.column(c) for c in ("bunch", "held", "sizes", "texts"))):
                tokens, heads, counts = _opened(sizes.as_py(), texts.as_py())
                learn = np.repeat(~np.array(held.as_py(), bool), counts).astype(np.uint64)
                for kind, hashes in enumerate(ngrams(tokens, heads, order), 1):
                    key = _named(hashes, kind, log2) << _ONE | learn
                    key.sort()
                    name = key >> _ONE
                    head = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
                    unique, trained = name[head], np.add.reduceat(key & _ONE, head).astype(np.uint32)
                    block = (unique >> np.uint64(_width(kind, log2) - log2)).astype(np.int64)
                    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                    if kind > 1:
                        unique = unique.astype(np.uint32)  # the block tells the rest
                    out = [(kind, int(block[s]), bunch.as_py(), _packed(_steps(unique[s:e])), _packed(trained[s:e])) for s, e in zip(cut, np.append(cut[1:], len(unique)))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return run


_MERGED = "bunch string, kind int, block long, levels binary, counts binary, types long, data binary"


def _merged(log2: int, bits: int, probes: int, keep: bool):
    """One block: its filter, which holds all its n-grams, and for each bunch the levels that the filter gives for the bunch's names, in
    their order; for words the exact counts too. keep: the filter itself in place of the levels."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, block = int(key[0]), int(key[1])
        size = "<u8" if kind == 1 else "<u4"
        low = [np.cumsum(_unpacked(x, size), dtype=size) for x in rows.names]
        names = np.concatenate(low).astype(np.uint64)
        if kind > 1:
            names |= np.uint64(block) << np.uint64(32)
        order = np.argsort(names, kind="stable")
        ordered = names[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        head = np.flatnonzero(first)
        learned = np.add.reduceat(np.concatenate([_unpacked(x, "<u4") for x in rows.trained]).astype(np.int64)[order], head)
        place = np.empty(len(names), np.int64)
        place[order] = np.cumsum(first) - 1
        unique, seen = ordered[head], learned > 0
        counts = CountFilter.of(unique[seen], _levels(learned[seen], _base(kind)), bits, probes)
        level = None if keep else counts.level(unique).astype(np.uint8)
        out, at = [[f"types {block % 1024}", kind, block, None, None, int(seen.sum()) if kind == 1 else 0, counts.data.tobytes() if keep else None]], 0
        for bunch, n in zip(rows.bunch, map(len, low)):
            where = place[at : at + n]
            out.append([bunch, kind, block, None if keep else _packed(level[where]), _packed(learned[where].astype("<u8")) if kind == 1 else None, 0, None])
            at += n
        return pd.DataFrame(out, columns=[c.split()[0] for c in _MERGED.split(", ")])

    return run


# ---------------------------------------------------------------- scoring

#: Places of a rounded logarithm of a probability, of the level of what stands before, and of the n-gram's level in a code.
_CODES = 1 << 20


@dataclass
class Model:
    """Interpolation of relative frequencies: each n-gram's with the probability of the shorter one's, down to add-0.5 for words."""

    n: int
    v: int
    weights: list[np.ndarray] = field(default_factory=list)  # of the relative frequency, by bit length of the context's count; for pairs, ...

    def alone(self, level: np.ndarray, minus: int) -> np.ndarray:
        return (np.maximum(_count_of(level, _base(1)) - minus, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))

    @staticmethod
    def after(kind: int, previous: np.ndarray, level: np.ndarray, minus: int) -> tuple[np.ndarray, np.ndarray]:
        """(relative frequency after the context, class of the context's count), by level; minus: occurrences to leave out."""
        seen = _count_of(np.arange(128), _base(kind - 1))
        both = np.maximum(_count_of(np.arange(128), _base(kind)) - minus, 0)
        group = np.minimum(np.ceil(np.log2(seen + 1)), 63).astype(np.int64)
        return np.minimum(both[level] / np.maximum(seen[previous] - minus, 1), 1.0), group[previous]

    def probability(self, levels: list[np.ndarray], heads: np.ndarray, minus: int = 0) -> np.ndarray:
        """Probability of each token by all weights fitted so far."""
        p = self.alone(np.arange(128), minus)[levels[0]]
        for kind, weight in enumerate(self.weights, 2):
            after, group = self.after(kind, _contexts(levels, heads, kind), levels[kind - 1], minus)
            w = weight[group]
            p = w * after + (1 - w) * p
        return p

    def fit(self, codes: np.ndarray, times: np.ndarray, rounds: int = 30) -> None:
        """Adds the weights of the next longer n-grams by expectation maximisation over all training tokens, given as codes with how often
        each occurs; each token's own occurrence is left out. Classes without training tokens have no weight."""
        kind = len(self.weights) + 2
        after, group = self.after(kind, (codes >> 6) & 127, codes & 63, 1)
        shorter, n = 10.0 ** (-(codes >> 13) / 8), np.bincount(group, times, 64)
        weight = np.full(64, 0.3)
        for _ in range(rounds):
            w = weight[group]
            share = w * after / np.maximum(w * after + (1 - w) * shorter, 1e-300)
            weight = np.where(n > 0, (np.bincount(group, share * times, 64) + 0.5) / (n + 5.0), 0.0)
        self.weights.append(weight)


def _contexts(levels: list[np.ndarray], heads: np.ndarray, kind: int) -> np.ndarray:
    """Levels of what stands before each token in its n-gram of `kind` words; before a text stands an end."""
    end = levels[0][heads[1] - 1 if len(heads) > 1 else -1]  # every text ends with it
    if kind > 2:
        end = _levels(np.round(_count_of(np.array([end]), _base(1))), _base(2))[0]
    return shifted(levels[kind - 2], heads, end)


def _histogram(model: Model):
    """Rows (code, times) over the training texts for the next weights of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(_CODES, np.int64)
        kind = len(model.weights) + 2
        for b in batches:
            for held, sizes, levels in zip(*(b.column(c) for c in ("held", "sizes", "levels"))):
                found, heads, learn = _level_arrays(held, sizes, levels)
                shorter = np.clip(np.round(-8 * np.log10(model.probability(found, heads, 1))), 0, 127).astype(np.int64)
                code = shorter << 13 | _contexts(found, heads, kind).astype(np.int64) << 6 | np.minimum(found[kind - 1], 63)
                times += np.bincount(code[learn], minlength=_CODES)
        code = np.nonzero(times)[0]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times[code])], ["code", "times"])

    return run


def _level_arrays(held: pa.Scalar, sizes: pa.Scalar, levels: pa.Scalar) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    counts = np.array(sizes.as_py(), np.int64)
    return [np.frombuffer(x, np.uint8) for x in levels.as_py()], np.cumsum(counts) - counts, np.repeat(~np.array(held.as_py(), bool), counts)


_CODED = "ids array<bigint>, held array<boolean>, sizes array<bigint>, known array<bigint>, base array<double>, levels array<binary>, trained long, types long"


def _coded(log2: int, order: int, filters):
    """For a bunch and its answers: per text the number of known words and the sum of log10(count + 0.5), per token the levels of its n-grams,
    from the answers or, where they are given, from the filters that were broadcast."""
    names = [c.split()[0] for c in _CODED.split(", ")]
    lists = [pa.list_(t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())]

    def row(values: list, trained: int, types: int) -> pa.Table:
        return pa.Table.from_arrays([*[pa.array([v], t) for v, t in zip(values, lists)], pa.array([trained]), pa.array([types])], names)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:  # the rows that count word types
            return row([None] * 6, 0, sum(answers.column("types").to_pylist()))
        held = texts.column("held")[0].as_py()
        tokens, heads, sizes = _opened(texts.column("sizes")[0].as_py(), texts.column("texts")[0].as_py())
        kind, block = (answers.column(c).to_numpy() for c in ("kind", "block"))
        parts = {k: [int(i) for i in np.lexsort((block, kind)) if kind[i] == k] for k in range(1, order + 1)}
        levels, base, known = [], None, None
        for k, hashes in enumerate(ngrams(tokens, heads, order), 1):
            name = _named(hashes, k, log2)
            if filters and k > 1:
                levels.append(filters.value[k].level(name).astype(np.uint8))
                continue
            by = np.argsort(name)
            first = np.concatenate(([True], name[by][1:] != name[by][:-1]))
            where = np.empty(len(name), np.int64)
            where[by] = np.cumsum(first) - 1
            if k == 1:
                counts = np.concatenate([_unpacked(answers.column("counts")[i].as_py(), "<u8") for i in parts[k]]).astype(np.int64)
                base, known = np.add.reduceat(np.log10(counts + 0.5)[where], heads), np.add.reduceat((counts > 0).astype(np.int64)[where], heads)
            if filters:
                levels.append(filters.value[k].level(name[by][first]).astype(np.uint8)[where])
            else:
                levels.append(np.concatenate([_unpacked(answers.column("levels")[i].as_py(), "<u1") for i in parts[k]])[where])
        trained = int(sizes[~np.array(held, bool)].sum())
        return row([texts.column("ids")[0].as_py(), held, sizes, known, base, [x.tobytes() for x in levels]], trained, 0)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.log10(model.n + 0.5 * (model.v + 1))
        for b in batches:
            for i in range(b.num_rows):
                found, heads, _ = _level_arrays(*(b.column(c)[i] for c in ("held", "sizes", "levels")))
                ids, held, sizes, known, base = (b.column(c)[i].values for c in ("ids", "held", "sizes", "known", "base"))
                score = np.add.reduceat(np.log10(model.probability(found, heads)), heads)
                yield pa.RecordBatch.from_arrays([ids, held, sizes, known, pa.array(base.to_numpy() - sizes.to_numpy() * lookup), pa.array(score)], [c.split()[0] for c in _SCORED.split(", ")])

    return run


def score_documents(
    docs: DataFrame, folds: int = 5, held: int = 1, order: int = ORDER, broadcast_mb: int = 32, block_mb: int = 8, bunch_mb: int = 6, bits: int = BITS, probes: int = PROBES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of the whole texts.

    Learns from rows whose crc32(doc_id) mod `folds` is not `held`. score interpolates relative frequencies of n-grams of 2 ... `order`
    words, each with the shorter one's probability, down to the word's own add-0.5 probability. All counts are read off the filter by
    repeated probes. The weights, by the count of the context, are fitted to all training texts. base_score uses exact counts.

    Every n-gram is in the filter, which grows with the input and lies in blocks by hash. Up to broadcast_mb of text it is broadcast; it
    has then at most 2 * order entries of `bits` bits a token. Beyond, each block is asked where its n-grams are counted: texts go in
    bunches of about bunch_mb, the distinct n-grams of a bunch go to their blocks (of about block_mb of text) once and their levels
    come back. Both ways give the same scores. A word that every bunch holds gives its block as many rows as there are bunches.

    Null texts count as empty: one token, the end. A null doc_id counts as the empty text when folds are drawn. Repeated rows stay and
    are counted as often. Very long texts make a bunch of their own. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", fold_of(F.col("doc_id"), folds) == held)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = max(0, int(np.ceil(np.log2(max(1, size / (block_mb << 20))))))
    checks = {f"parquet.{x}.size.row.check.{y}": 2 for x in ("page", "block") for y in ("min", "max")}  # few rows, large ones
    bunches = stored(rows.mapInArrow(_gathered(bunch_mb << 20), _BUNCH), **checks)
    counted = bunches.mapInArrow(_counted(log2, order), "kind int, block long, bunch string, names binary, trained binary")
    small = size <= broadcast_mb << 20
    merged = counted.groupBy("kind", "block").applyInPandas(_merged(log2, bits, probes, small), _MERGED)
    filters = None
    if small:
        merged = stored(merged)
        found: dict[int, dict[int, bytes]] = {k: {} for k in range(1, order + 1)}
        for r in merged.where("data is not null").select("kind", "block", "data").collect():  # bounded by broadcast_mb
            found[r["kind"]][r["block"]] = bytes(r["data"])
        filters = spark.sparkContext.broadcast({k: CountFilter.joined(v, log2, _width(k, log2) - log2, probes) for k, v in found.items()})
    answers = merged.select("bunch", "kind", "block", "levels", "counts", "types")
    coded = stored(bunches.groupBy("bunch").cogroup(answers.groupBy("bunch")).applyInArrow(_coded(log2, order, filters), _CODED), compression="zstd", **checks)
    sums = coded.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("trained", "types")]).first()
    model = Model(int(sums[0]), int(sums[1]))
    texts = coded.where("ids is not null")
    for _ in range(order - 1):
        times = texts.select("held", "sizes", "levels").mapInArrow(_histogram(model), "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).toPandas()  # _CODES at most
        times = times.sort_values("code")
        model.fit(times.code.to_numpy(np.int64), times.times.to_numpy(np.int64))
    return texts.mapInArrow(_scored(model), _SCORED).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see score_documents for nulls, empty and long texts, repeated rows and empty tables."""
    return score_documents(load(spark, sf_dir, "documents"))
