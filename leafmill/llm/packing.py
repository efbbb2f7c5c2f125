"""Best-fit packing of token sequences: a configuration program over the length histogram, solved by multiplicative weights."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import cut, fresh, load

CAPACITY = 1024
END_ID = 2


# ---------------------------------------------------------------- tokens


# Fixed value: the pre-tokenisation pattern of byte-level vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteEncoder:
    """Token ids of a byte-level BPE vocabulary file, as the tokenizers library gives them without special tokens.

    The file's vocabulary is ranked by id, which is the order of its merges, and run by tiktoken, which needs a fifth of the time.
    Files that don't fit this (another pre-tokeniser or ids out of order) and texts that hold a special token's name go to tokenizers.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, self.fast = spec.get("pre_tokenizer") or {}, spec["model"], None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merged = [byte_pair if isinstance(byte_pair, str) else "".join(byte_pair) for byte_pair in model.get("merges", [])]
        order = [model["vocab"][m.replace(" ", "")] for m in merged]
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and order == sorted(order):
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast is None or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row per piece of at most `capacity` ids of a document."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(tokenizer)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for doc, text in zip(ids, b.column(1)):
                data = memoryview(encoder.encode(text.as_py() or "") + end)
                n = len(data) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(doc, i, s, e - s, zlib.crc32(data[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the configuration program

#: What a free place costs, in values of the dearest place.
WASTE = 8.0


def _price(value: np.ndarray, most: np.ndarray, waste: float) -> dict[int, int]:
    """The configuration {length: copies} of most value less `waste` for each place left free, copies at most `most`; {} if there are no
    items.

    A knapsack by dynamic programming over used capacity; copies of a length are tried in groups of 1, 2, 4, ... and the rest.
    """
    capacity = len(value) - 1
    items = []
    for n in np.nonzero(most)[0][::-1].tolist():
        left, k = min(int(most[n]), capacity // n), 1
        while left > 0:
            items.append((n, min(k, left)))
            left -= k
            k *= 2
    best, took = np.full(capacity + 1, -np.inf), np.zeros((len(items), capacity + 1), bool)
    best[0] = 0
    for i, (n, k) in enumerate(items):
        with_it = best[: capacity + 1 - n * k] + k * value[n]
        took[i, n * k :] = with_it > best[n * k :] + 1e-12
        np.copyto(best[n * k :], with_it, where=took[i, n * k :])
    out: dict[int, int] = {}
    c = int(np.argmax(best + waste * np.arange(capacity + 1)))
    for i in range(len(items) - 1, -1, -1):
        if took[i, c]:
            n, k = items[i]
            out[n] = out.get(n, 0) + k
            c -= n * k
    return out


def _solve(demand: np.ndarray, capacity: int, rounds: int, rate: float, lean: float) -> dict[tuple, float]:
    """Fractional configurations {((length, copies), ...): bins} that cover the demand without exceeding it.

    Each length has a weight that falls as its demand is covered ahead of the others' and, by `lean`, is larger for longer items,
    which fit in fewer places. A round prices the best configuration under the weights, a free place costing as much as the dearest
    ones hold, and takes as many bins of it as the demand allows, at most a 96th of the goal.
    """
    n, size, plan = demand.astype(float), np.arange(len(demand), dtype=float), {}
    left, goal, used = n.copy(), float((size * n).sum() / capacity), 0.0
    for _ in range(rounds):
        lag = used / max(goal, 1e-9) - 1 + left / np.maximum(n, 1)
        weight = np.exp(rate * np.clip(lag, -1, 1) + lean * size / capacity)
        config = _price(size * weight, np.floor(left + 1e-9).astype(np.int64), WASTE * float(weight.max()))
        if not config:
            break
        step = min(max(goal / 96, 1.0), *(left[k] / a for k, a in config.items()))
        key = tuple(sorted(config.items(), reverse=True))
        plan[key] = plan.get(key, 0.0) + step
        used += step
        for k, a in config.items():
            left[k] -= a * step
    return plan


def _best_fit(demand: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing on the histogram: equal bins are one group and are filled together."""
    groups: dict[int, list[tuple[tuple, int]]] = {}
    for n in range(capacity, 0, -1):
        left = int(demand[n])
        room = n
        while left:
            while room <= capacity and not groups.get(room):
                room += 1
            if room > capacity:
                per = capacity // n
                full, rest = divmod(left, per)
                for copies, bins in ((per, full), (rest, 1)):
                    if copies and bins:
                        groups.setdefault(capacity - copies * n, []).append((((n, copies),), bins))
                break
            content, bins = groups[room].pop()
            per = min(room // n, left)
            take = min(bins, left // per)
            if bins > take:
                groups[room].append((content, bins - take))
            groups.setdefault(room - per * n, []).append((content + ((n, per),), take))
            left -= per * take
    return [x for g in groups.values() for x in g]


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 2500, rate: float = 1.0, lean: float = 2.0) -> list[tuple[tuple, int]]:
    """[(((length, copies), ...), bins)] that hold exactly the histogram's items in few bins of `capacity`.

    The program is solved fractionally, each configuration's bins are rounded down, and what is then left goes by best fit. If best fit
    alone needs fewer bins, its result is taken. Work depends on the capacity, not on counts.
    """
    rest = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        if not 1 <= n <= capacity:
            raise ValueError(f"length {n} is outside 1..{capacity}")
        rest[n] += k
    plain = _best_fit(rest, capacity)
    out: list[tuple[tuple, int]] = []
    if rest[capacity]:
        out.append((((capacity, 1),), int(rest[capacity])))
        rest[capacity] = 0
    for config, x in _solve(rest, capacity, rounds, rate, lean).items():
        if bins := min(int(x + 1e-9), *(int(rest[n]) // a for n, a in config)):
            out.append((config, bins))
            for n, a in config:
                rest[n] -= a * bins
    out += _best_fit(rest, capacity)
    return out if sum(b for _, b in out) <= sum(b for _, b in plain) else plain


def _plan(configs: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """Rows that place items sorted by length: items from `first` on go `copies` to a bin, from bin `bin` and place `offset` on."""
    rows, at = [], 0
    for config, bins in configs:
        offset = 0
        for n, copies in config:
            rows.append((n, at, copies, offset, bins * copies))
            offset += n * copies
        at += bins
    rows.sort()
    first = np.concatenate(([0], np.cumsum([r[4] for r in rows])[:-1])) if rows else np.zeros(0)
    cols = list(zip(*[r[:4] for r in rows])) or [()] * 4
    return {"first": first.astype(np.int64)} | {k: np.array(v, np.int64) for k, v in zip(("length", "bin", "copies", "offset"), cols)}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, length, ...) with sequence_id and offset: few sequences, each at most `capacity` long and gapless from 0.

    The histogram (at most `capacity` rows) goes to the driver, which plans configurations of equal sequences; the plan's size depends
    on the capacity alone. Pieces are sorted by (length, doc_id, piece), so that very many equal lengths spread over partitions, and
    each finds its place from its rank. Ties and repeated rows get places of their own. An empty table gives no rows. Other columns stay,
    but ones named sequence_id or offset are replaced. A length outside 1..capacity raises ValueError.
    """
    pieces = pieces.drop("sequence_id", "offset")
    keys, at_name = ["length", "doc_id", "piece"], fresh(pieces, "at")
    spark = pieces.sparkSession
    ranked = cut(pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at_name, F.monotonically_increasing_id()))
    part = F.shiftright(at_name, 33)
    sizes = {r[0]: r[1] for r in ranked.groupBy(part.alias("p")).count().collect()}  # a row per partition
    histogram = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}  # at most `capacity` rows
    before, total = np.zeros(max(sizes, default=0) + 1, np.int64), 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    plan = spark.sparkContext.broadcast(_plan(configurations(histogram, capacity)) | {"before": before})
    schema = pieces.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            rank = p["before"][at >> 33] + (at & ((1 << 33) - 1))
            row = np.searchsorted(p["first"], rank, "right") - 1
            t = rank - p["first"][row]
            where = [p["bin"][row] + t // p["copies"][row], p["offset"][row] + t % p["copies"][row] * p["length"][row]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, where)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{schema},sequence_id:bigint,offset:bigint".replace(":", " "))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenises docs(doc_id, text) and packs the pieces: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null texts count as empty and give one piece of the end id. A document of over `capacity` ids is cut so that all pieces but the
    first are full. Other columns are ignored. Rows with a null doc_id are packed like others, repeated rows as often as they occur. An
    empty table gives no rows.
    """
    return pack(cut(token_pieces(docs, tokenizer, capacity, end_id)), capacity)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; see pack_documents for nulls, long texts and empty tables."""
    return pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
