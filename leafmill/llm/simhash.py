"""SimHash near-duplicates with pigeonring filtering of candidate fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import blocks_of, components, cut, fresh, load

SEED = 42
SEGMENTS = 4
SEGMENT_BITS = 16


def _bit_sums(words: list[bytes], k: int) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of the k-word shingles; at index 64 the number of shingles."""
    out = np.zeros(65, np.int64)
    if not words:
        return out
    text, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    k = min(k, len(words))
    stops, digest = ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(stops))
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        out[:64] += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    out[64] = len(hashes)
    return out


def fingerprint(text: str | None, k: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's k-word shingles; 0 for null and blank texts."""
    sums, carry = np.zeros(65, np.int64), []
    for block in blocks_of((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + block.split()
        if len(words) >= k:
            sums += _bit_sums(words, k)
            carry = words[-(k - 1) :] if k > 1 else []
        else:
            carry = words
    if not sums[64]:
        sums += _bit_sums(carry, k)
    return int(np.packbits(2 * sums[:64] > sums[64], bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _keys(pieces: int) -> list[str]:
    """SQL for the ring keys of a fingerprint.

    Segments lie on a ring. With 4 segments and at most 3 differing bits, some segment is equal and the chain of it and its
    successor differs in at most one bit (2 * 3 / 4 rounded down). Of `pieces` equal parts of the successor all but one are then
    equal, so a key is the segment and the successor with one part masked.
    """
    width, mask, out = SEGMENT_BITS // pieces, (1 << SEGMENT_BITS) - 1, []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        first, second = (f"(shiftrightunsigned(fp, {SEGMENT_BITS * x}) & {mask})" for x in (i, j))
        for p in range(pieces):
            keep = mask & ~(((1 << width) - 1) << (p * width))
            out.append(f"shiftleft(cast({i * pieces + p} as bigint), 32) | shiftleft({first}, {SEGMENT_BITS}) | ({second} & {keep}L)")
    return out


def _linked(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Boolean matrix: x[i] and y[j] pass the ring's chain budgets and differ in at most `bits` bits."""
    diff = x[:, None] ^ y[None, :]
    d = [np.bitwise_count((diff >> np.uint64(SEGMENT_BITS * s)) & np.uint64((1 << SEGMENT_BITS) - 1)) for s in range(SEGMENTS)]
    some = np.zeros(diff.shape, bool)
    for i in range(SEGMENTS):
        total, ok = np.zeros(diff.shape, np.uint8), np.ones(diff.shape, bool)
        for n in range(1, SEGMENTS):
            total = total + d[(i + n - 1) % SEGMENTS]
            ok &= total <= n * bits // SEGMENTS
        some |= ok
    i, j = np.nonzero(some)
    some[i, j] = np.bitwise_count(diff[i, j]) <= bits
    return some


class _Forest:
    """Union-find over ids, smaller root wins; take() gives spanning edges and forgets the sets.

    Members of a set are tied as a tree with `fan` children a node: no node gets more than fan + 1 edges however large the set is, so no
    later join by node has a hot key, and few levels lie between any two members. The root is drawn from the members' sum, so that
    overlapping sets of several tasks have different roots; equal sets have equal trees.
    """

    def __init__(self, fan: int = 16) -> None:
        self.up: dict[int, int] = {}
        self.fan = fan

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def take(self) -> list[tuple[int, int]]:
        sets: dict[int, list[int]] = {}
        for x in sorted(self.up):
            sets.setdefault(self.find(x), []).append(x)
        self.up = {}
        out = []
        for m in sets.values():
            root = sum(m) % len(m)
            m = m[root:] + m[:root]
            out += [(m[i], m[(i - 1) // self.fan]) for i in range(1, len(m))]
        return out


def _tie(forest: _Forest, fps: np.ndarray, ids: np.ndarray, bits: int, tile: int = 512) -> None:
    for a in range(0, len(fps), tile):
        for b in range(a, len(fps), tile):
            hit = _linked(fps[a : a + tile], fps[b : b + tile], bits)
            for i, j in zip(*(v.tolist() for v in np.nonzero(np.triu(hit, 1) if a == b else hit))):
                forest.join(int(ids[a + i]), int(ids[b + j]))


_EDGES = "a long, b long, key long, fp long"


def _batch(edges: list[tuple[int, int]], spill: list[tuple[int, int, int]]) -> pa.RecordBatch:
    rows = [(a, b, None, None) for a, b in edges] + [(r, None, k, f) for k, f, r in spill]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(4)], ["a", "b", "key", "fp"])


def _runs(bits: int, block: int, keys: int = 1):
    """For rows (keys..., fp, rep) sorted by the keys: edges that span the links of each run of equal keys.

    A run of over `block` rows is handed on unsolved, as rows with its key; memory holds one block and the forest of one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, at, over = _Forest(), [], None, False
        for b in batches:
            key, rest = [b.column(i).to_numpy() for i in range(keys)], [b.column(keys + i).to_numpy() for i in (0, 1)]
            cuts = np.concatenate(([0], np.nonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))[0] + 1, [b.num_rows])) if b.num_rows else []
            spill: list[tuple[int, int, int]] = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                k = tuple(int(c[s]) for c in key)
                if k != at:
                    if held and sum(len(h[0]) for h in held) > 1:
                        _tie(forest, np.concatenate([h[0] for h in held]).view(np.uint64), np.concatenate([h[1] for h in held]), bits)
                    held, at, over = [], k, False
                if e - s == 1 and e < b.num_rows and s and not held:
                    continue
                held.append((rest[0][s:e], rest[1][s:e]))
                if over or sum(len(h[0]) for h in held) > block:
                    spill += [(k[0], int(f), int(r)) for h in held for f, r in zip(*h)]
                    held, over = [], True
            if b.num_rows:
                yield _batch(forest.take(), spill)
        if held and sum(len(h[0]) for h in held) > 1:
            _tie(forest, np.concatenate([h[0] for h in held]).view(np.uint64), np.concatenate([h[1] for h in held]), bits)
            yield _batch(forest.take(), [])

    return run


def _spread(spill: DataFrame, block: int, salts: int = 64) -> DataFrame:
    """Rows of oversized runs, copied to each pair of blocks of their run: (key, x, y, fp, rep). Every pair meets in some block pair."""
    sizes = spill.groupBy("key").agg(F.ceil(2 * F.count("*") / F.lit(block)).cast("int").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    rows = spill.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(salts)).cast("int")).join(sizes, ["key", "salt"]).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp", F.col("a").alias("rep"))


def near_duplicates(docs: DataFrame, bits: int = 3, k: int = 3, pieces: int = 4, block: int = 4096) -> DataFrame:
    """Components of documents whose SimHash fingerprints link at `bits` (3 at most) or fewer differing bits.

    Args: docs with doc_id and text (other columns are ignored); pieces: 2, 4, 8 or 16 parts of the key's second segment: more
    parts make longer keys, for more fingerprints; block: fingerprints compared in one tile before a key's rows are spread.

    Returns (doc_id, fp, component_id), one row per input row; component_id is the smallest doc_id reachable. Equal fingerprints are
    one node, so copies cost no pairs; only distinct fingerprints are compared and each task hands on a spanning forest, never all
    pairs. Null and blank texts have fingerprint 0 and link like any other. Rows with a null doc_id get the component of the others
    with their fingerprint, null if there is none. Repeated rows stay repeated. An empty table gives no rows.
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3")
    fps = cut(fingerprints(docs, k))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    keyed = classes.select(F.explode(F.array(*map(F.expr, _keys(pieces)))).alias("key"), "fp", "rep")
    found = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(bits, block), _EDGES))
    again = _spread(found.where("key is not null"), block).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    more = again.mapInArrow(_runs(bits, 1 << 40, 3), _EDGES)
    tied = components(found.where("key is null").select("a", "b").unionAll(more.select("a", "b")))
    named = cut(classes.join(tied, classes.rep == tied.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the near-duplicates: of each component the rows with the smallest doc_id stay, one row of them if rows repeat.

    All columns stay as they are. Rows with a null doc_id stay. Null and blank texts share fingerprint 0, so one row of them stays. An empty
    table gives an empty one.
    """
    name = fresh(docs, "kept_id")
    first = near_duplicates(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionAll(docs.where("doc_id is null"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all documents; see near_duplicates for nulls, empty texts, repeated rows and empty tables."""
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
