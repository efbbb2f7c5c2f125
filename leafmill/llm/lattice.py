"""Embedding near-duplicates by lattice hashing: rotated blocks decoded to E8 points, neighbouring cells probed, cosines verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import components, cut, load
from leafmill.llm.simhash import _Forest


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: all (+-1, +-1, 0...) and all (+-1/2)^8 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [[s / 2 for s in signs] for signs in product((1, -1), repeat=8) if np.prod(signs) > 0]
    return np.array(out)


_NEAR = _minimal_vectors()


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer of the nearest points of D8 and of D8 shifted by one half."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.nonzero(r.sum(1) % 2)[0]
        if len(odd):
            gap = y[odd] - r[odd]
            k = np.abs(gap).argmax(1)
            r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cell(points: np.ndarray) -> np.ndarray:
    """A 64-bit name of each lattice point."""
    h = np.full(len(points), 0x243F6A8885A308D3, np.uint64)
    for c in np.rint(2 * points).astype(np.int64).T:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Lattice:
    """8 tables over a random rotation's 8 blocks of 8 dimensions: a table's cell is made of `span` blocks that follow each other on a
    ring; `probes` neighbouring cells a block."""

    def __init__(self, dim: int, cosine: float, span: int = 2, probes: int = 1, width: float = 4.5, seed: int = 11) -> None:
        blocks = 8
        self.dim, self.size = dim, max(64, dim)
        q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.size, self.size)))
        self.rotation = q[: 8 * blocks, :dim].T  # dim x 64
        #: A block of the difference of two vectors at the threshold has about this norm.
        self.step = width * np.sqrt((2 - 2 * cosine) * 8 / max(dim, 64))
        self.tables, self.probes = [tuple((t + i) % blocks for i in range(span)) for t in range(blocks)], probes

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables) names of the home cells and (n, tables, probes) names of probed ones."""
        y = (unit @ self.rotation / self.step).reshape(len(unit), 8, 8)
        home, near = np.empty((len(unit), 8), np.uint64), np.empty((len(unit), 8, self.probes), np.uint64)
        for b in range(8):
            p = decode_e8(y[:, b])
            home[:, b] = _cell(p)
            best = np.argpartition(-((y[:, b] - p) @ _NEAR.T), self.probes, axis=1)[:, : self.probes] if self.probes else np.zeros((len(unit), 0), int)
            for k in range(self.probes):
                near[:, b, k] = _cell(p + _NEAR[best[:, k]])

        def joined(parts: list[np.ndarray], t: int) -> np.ndarray:
            h = np.full(len(unit), t + 1, np.uint64)
            for c in parts:
                h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            return h

        homes = np.stack([joined([home[:, b] for b in bs], t) for t, bs in enumerate(self.tables)], axis=1)
        probed = [[joined([near[:, b, k] if i == j else home[:, b] for j, b in enumerate(bs)], t) for i in range(len(bs)) for k in range(self.probes)] for t, bs in enumerate(self.tables)]
        return homes, np.stack([np.stack(p, axis=1) if p else np.zeros((len(unit), 0), np.uint64) for p in probed], axis=1)


def _salted(names: np.ndarray, labels: np.ndarray) -> np.ndarray:
    salt = (labels.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = names ^ salt.reshape(-1, *[1] * (names.ndim - 1))
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def _cell_rows(cosine: float, kind: str, packed: bool, options: dict):
    """Rows (key, role, tab, rep) for each cell that a class lies in (role 0) or probes (role 1); packed: one row (rep, n, v, cells) a class
    with the lower halves of its cells' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Lattice] = {}
        for b in batches:
            reps, labels, counts, raw = (b.column(i) for i in range(4))
            lengths = np.array([len(v.as_py()) for v in raw], np.int64)
            for size in np.unique(lengths):
                for at in range(0, len(pick := np.nonzero(lengths == size)[0]), 2000):
                    part = pick[at : at + 2000]
                    vectors = [raw[i].as_py() for i in part]
                    unit = _units(vectors, kind)
                    lattice = known.setdefault(int(size), Lattice(unit.shape[1], cosine, **options))
                    home, near = (_salted(n, labels.to_numpy()[part]) for n in lattice.cells(unit))
                    keys = np.concatenate([home[:, :, None], near], axis=2)  # classes x tables x (1 + probes)
                    n, tables, each = keys.shape
                    if packed:
                        cells = [k.tobytes() for k in keys.reshape(n, -1).astype(np.uint32)]
                        yield pa.RecordBatch.from_arrays([reps.take(pa.array(part)), counts.take(pa.array(part)), pa.array(vectors, pa.binary()), pa.array(cells, pa.binary())], ["rep", "n", "v", "cells"])
                        continue
                    cols = [
                        keys.reshape(-1).view(np.int64),
                        np.tile(np.tile(np.arange(each) > 0, tables).astype(np.int32), n),
                        np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), n),
                        np.repeat(reps.to_numpy()[part], tables * each),
                    ]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["key", "role", "tab", "rep"])

    return run


def _verify(cosine: float, kind: str, each: int, tile: int = 1024):
    """For rows (key, x, y, own, role, tab, rep, n, v, cells) sorted by (key, x, y): link counts and spanning edges of each run.

    A pair counts in the first table where it meets; there, where each lies in a cell that the other probes, in the smaller cell.
    """

    def pairs(role: np.ndarray, own: np.ndarray, cross: bool, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(unit), tile):
            for b in range(a, len(unit), tile):
                hit = unit[a : a + tile] @ unit[b : b + tile].T >= cosine
                hit &= (role[a : a + tile, None] == 0) | (role[None, b : b + tile] == 0)
                if cross:
                    hit &= own[a : a + tile, None] != own[None, b : b + tile]
                if a == b:
                    hit = np.triu(hit, 1)
                i, j = np.nonzero(hit)
                for s in range(0, len(i), 50_000):
                    yield a + i[s : s + 50_000], b + j[s : s + 50_000]

    def solve(rows: list[tuple], links: dict[int, int], forest: _Forest) -> None:
        key, x, y, own, role, tab, rep, n, v, cells = zip(*rows)
        if len(set(rep)) < 2:
            return
        sizes = np.array([len(q) for q in v])
        role, own, rep, n = (np.array(c, np.int64) for c in (role, own, rep, n))
        for size in np.unique(sizes):
            at = np.nonzero(sizes == size)[0]
            unit = _units([v[i] for i in at], kind)
            names = np.frombuffer(b"".join([cells[i] for i in at]), np.uint32).reshape(len(at), -1, each)
            t, k = tab[0], np.uint32(key[0] & 0xFFFFFFFF)
            for i, j in pairs(role[at], own[at], x[0] != y[0], unit):
                a, b = names[i], names[j]
                keep = rep[at][i] != rep[at][j]
                for s in range(t):
                    keep &= ~((a[:, s, :1] == b[:, s]).any(1) | (a[:, s] == b[:, s, :1]).any(1))
                mine, yours = a[:, t, 0], b[:, t, 0]
                mutual = (mine != yours) & (a[:, t, 1:] == yours[:, None]).any(1) & (b[:, t, 1:] == mine[:, None]).any(1)
                keep &= ~mutual | (k == np.minimum(mine, yours))
                i, j = at[i[keep]], at[j[keep]]
                for one, other in ((i, j), (j, i)):
                    who, where = np.unique(rep[one], return_inverse=True)
                    for r, c in zip(who.tolist(), np.bincount(where, n[other]).tolist()):
                        links[r] = links.get(r, 0) + int(c)
                # A star around each first member spans what it links with.
                order = np.lexsort((rep[j], rep[i]))
                for p, q in zip(rep[i][order].tolist(), rep[j][order].tolist()):
                    forest.join(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(links: dict[int, int], forest: _Forest) -> pa.RecordBatch:
            rows = [(r, None, c) for r, c in links.items()] + [(a, b, None) for a, b in forest.take()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "b", "links"])

        for batch in batches:
            links, forest = {}, _Forest()
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if held and held[0][:3] != keys[s]:
                    if len(held) > 1:
                        solve(held, links, forest)
                    held = []
                if e - s > 1 or held or e == len(keys):
                    held += list(zip(*[c.to_pylist() for c in batch.slice(s, e - s).columns]))
            yield out(links, forest)
        links, forest = {}, _Forest()
        if len(held) > 1:
            solve(held, links, forest)
        yield out(links, forest)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, span: int = 2, probes: int = 1, width: float = 4.5, block: int = 2000) -> DataFrame:
    """Links of cosine >= `cosine` between the vectors of a label: (vec_id, n_links, component_id, kept), one row per input row.

    Args: vectors(vec_id, embedding, label); span: blocks of 8 dimensions in a table's cell, more for more than some hundred thousand
    vectors a label; width: size of a cell; block: rows of a cell that are compared in one task, larger cells go to tasks by pairs of
    blocks.

    Cells are first looked at by ids alone; those with one class go. Only to what is left the vectors are joined.
    The rotation keeps distances, so of the 8 tables of a linked pair one at least differs by no more than its share, and a pair is
    found if any table's cells meet. Equal vectors are one class, so copies cost no pairs. Found pairs are counted where they are
    found and never written; tasks hand on counts and spanning edges.

    Null labels, null, empty and zero vectors and those with null or non-finite components link with nothing, nor do rows with a null
    vec_id (whose component_id is null and kept false); vectors of different lengths don't link. Repeated rows count as rows and share
    their vec_id. An empty table gives no rows. Other columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    options = {"span": span, "probes": probes, "width": width}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ident, vec, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                v = vec.as_py()
                data = None
                if ident is not None and label is not None and v and None not in v:
                    x = np.array(v, kind)
                    data = x.tobytes() if np.isfinite(x).all() and x.any() else None
                    if data is not None:
                        data = (x + np.zeros(1, kind)).tobytes()  # one zero sign
                out.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["vec_id", "label", "v"])

    packed = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long")).mapInArrow(pack, "vec_id long, label long, v binary")
    packed = cut(packed.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b"|"), F.col("v")), 256))))
    classes = cut(packed.where("v is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.count("*").alias("n"), F.first("v").alias("v")))
    plain = classes.select("rep", "label", "n", "v")
    light = plain.mapInArrow(_cell_rows(cosine, kind, False, options), "key long, role int, tab int, rep long")
    sizes = light.groupBy("key").agg(F.count("*").alias("count"), F.min("role").alias("least")).where("count > 1 and least = 0")
    sizes = sizes.select("key", F.when(F.col("count") > block, F.ceil(2 * F.col("count") / block)).otherwise(1).cast("int").alias("parts"))
    rows = light.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    full = plain.mapInArrow(_cell_rows(cosine, kind, True, options), "rep long, n long, v binary, cells binary")
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "role", "tab", "rep").join(full, "rep")
    rows = rows.select("key", "x", "y", "own", "role", "tab", "rep", "n", "v", "cells")
    each = 1 + probes * span
    found = cut(rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_verify(cosine, kind, each), "a long, b long, links long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    tied = components(found.where("b is not null").select("a", "b"))
    named = classes.select("key", "rep", "n").join(counts, "rep", "left").join(tied, F.col("rep") == F.col("node"), "left")
    named = cut(named.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = packed.join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links among all embeddings; see near_vectors for nulls, odd vectors, repeated rows and empty tables."""
    return near_vectors(load(spark, sf_dir, "embeddings"))


OP5_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
ok as (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, c) as (select vec_id, vec_id from v union select r.vec_id, p.b from r join p on p.a = r.c),
c as (select vec_id, min(c) as component_id from r group by vec_id),
n as (select a as vec_id, count(*) as n from p group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept from v join c on c.vec_id = v.vec_id left join n on n.vec_id = v.vec_id
"""
