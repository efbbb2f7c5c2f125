"""Vectors: embedding, scoring, top-k search and upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, BucketedRandomProjectionLSH, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from leafmill.operators.common import kept

#: Queries and vectors that meet in one task.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 50_000


def scope(df: DataFrame, root_id: int | None = None) -> DataFrame:
    return df if root_id is None else df.where(F.col("root_id") == root_id)


def min_score(df: DataFrame, t: float = 0.0) -> DataFrame:
    return df.where(F.col("score") >= t)


def top_k(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of each query with their rank; ties go by chunk_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (row numbers, unit vectors)} of the finite vectors that aren't zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    ends, out = np.cumsum(sizes), {}
    for n in set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == n)
        x = flat.reshape(-1, n) if len(at) == len(sizes) else np.stack([flat[ends[i] - n : ends[i]] for i in at])
        norm = np.linalg.norm(x, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        out[n] = at[good], x[good] / norm[good, None]
    return out


def _best(k: int):
    """For a block of queries and a block of vectors: the k best rows of each query that reach its least score, ties by chunk_id."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        names = np.array(vectors.column("chunk_id").to_pylist(), object)
        place = np.empty(len(names), np.int64)
        place[np.argsort(names.astype(str), kind="stable")] = np.arange(len(names))
        least = queries.column("least").to_numpy()
        asked, held = _matrix(queries.column("embedding")), _matrix(vectors.column("embedding"))
        for n in asked.keys() & held.keys():
            (qs, q), (vs, v) = asked[n], held[n]
            for at in range(0, len(q), 256) if len(v) else ():
                score = q[at : at + 256] @ v.T
                low = np.partition(score, len(v) - min(k, len(v)), axis=1)[:, len(v) - min(k, len(v))] - 1e-11
                i, j = np.nonzero(score >= np.maximum(low, least[qs[at : at + 256]])[:, None])
                near = np.round(score[i, j], 11)  # equal vectors tie, wherever they lie
                order = np.lexsort((place[vs[j]], -near, i))
                i, j, near = i[order], j[order], near[order]
                first = np.searchsorted(i, i, "left")
                keep = np.arange(len(i)) - first < k
                found.append((qs[at + i[keep]], vs[j[keep]], near[keep]))
        i, j, score = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(i, pa.int64())), "chunk_id": vectors.column("chunk_id").take(pa.array(j, pa.int64())), "root_id": vectors.column("root_id").take(pa.array(j, pa.int64())), "score": pa.array(score, pa.float64())})

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float = -1.0, scoped: bool = False, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, chunk_id, root_id, score, rank): the k most cosine-similar vectors of each query.

    queries(query_id, root_id, embedding) against vectors(chunk_id, root_id, embedding). Both are dealt by hash into blocks of about
    query_block and vector_block rows; each block of queries meets each block of vectors in a task of its own, which hands on the k best
    of each query, so that no task or driver holds all of either and no pairs are written. Equal queries are asked once. scoped: only vectors of the query's root,
    blocks being made inside each root. Scores have 11 digits; ties go by chunk_id.

    Null, empty and zero vectors and those with null or non-finite components match nothing; vectors of different lengths aren't compared.
    Rows with a null root_id count as root -1.
    """
    asked, held = _clean(queries, "query_id"), _clean(vectors, "chunk_id")
    area = F.col("root_id") if scoped else F.lit(0).cast("long")
    who = asked.select("query_id", "embedding", area.alias("area"))
    once = kept(who.select("embedding", "area").distinct().withColumn("number", F.monotonically_increasing_id()))
    hits = top_k(_meet(once.select(F.col("number").alias("query_id"), "embedding", "area", F.lit(float(threshold)).alias("least")), held.withColumn("area", area), k, query_block, vector_block, whole=not scoped), k)
    return who.join(once, ["embedding", "area"]).select("query_id", "number").join(hits.withColumnRenamed("query_id", "number"), "number").drop("number")


def _clean(df: DataFrame, ident: str) -> DataFrame:
    return df.select(ident, F.coalesce("root_id", F.lit(-1)).cast("long").alias("root_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0 and not exists(embedding, x -> x is null)")


def _meet(asked: DataFrame, held: DataFrame, k: int, query_block: int, vector_block: int, whole: bool = False) -> DataFrame:
    """The k best of each query in each pair of blocks; blocks are made inside each area. whole: there is one area."""
    blocks = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    kinds = dict(asked.dtypes)["query_id"], dict(held.dtypes)["chunk_id"]
    if whole:
        counts = {"qs": max(1, -(-asked.count() // query_block)), "vs": max(1, -(-held.count() // vector_block))}
        asked, held = (df.withColumns({c: F.lit(n) for c, n in counts.items()}) for df in (asked, held))
    else:
        sizes = asked.groupBy("area").agg(blocks(F.count("*"), query_block).alias("qs")).join(held.groupBy("area").agg(blocks(F.count("*"), vector_block).alias("vs")), "area")
        asked, held = asked.join(sizes, "area"), held.join(sizes, "area")
    own = lambda ident, n: F.pmod(F.xxhash64(ident), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.select("query_id", "embedding", "least", "area", own("query_id", "qs").alias("qb"), every("vs").alias("vb"))
    right = held.select("chunk_id", "root_id", "embedding", "area", every("qs").alias("qb"), own("chunk_id", "vs").alias("vb"))
    keys = ["area", "qb", "vb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), f"query_id {kinds[0]}, chunk_id {kinds[1]}, root_id long, score double")


#: The centres of cells hold at most so many numbers (32 MB) and go to all tasks; vectors too long for that get no centre.
CENTRE_NUMBERS = 4_000_000
#: For rounding, in angles and in cosines.
ANGLE_SLACK, COSINE_SLACK = 1e-6, 1e-9
_NO_CENTRE = (1 << 20) - 1


def cell_centres(vectors: DataFrame, centres: int = 256) -> dict[int, np.ndarray]:
    """{length: unit vectors}: `centres` rows of vectors(chunk_id, embedding) chosen by the hash of their ids.

    The choice decides how much a search can leave out, never what it finds. A query is sent to `centres` cells at most, so that what is
    sent grows with the queries alone.
    """
    held = _clean(vectors.withColumn("root_id", F.lit(0)), "chunk_id")
    rows = held.where(F.size("embedding") <= CENTRE_NUMBERS // centres).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(centres).select("embedding").toArrow()
    return {size: unit for size, (_, unit) in _matrix(rows.column("embedding")).items() if len(unit)}


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def in_cells(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(chunk_id, root_id, embedding, area, angle): the area is the cell of the nearest centre of the vector's length, angle the
    distance to that centre. Vectors of a length without centres share an area of that length; those that match nothing are left out."""
    held = _clean(vectors, "chunk_id")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            area, angle = np.full(part.num_rows, -1, np.int64), np.zeros(part.num_rows)
            for n, (at, unit) in _matrix(part.column("embedding")).items():
                area[at] = n << 20 | _NO_CENTRE
                for i in range(0, len(at), 1024) if n in centres else ():
                    far = _angles(unit[i : i + 1024], centres[n])
                    near, some = far.argmin(axis=1), at[i : i + 1024]
                    angle[some] = far[np.arange(len(near)), near]
                    area[some] = n << 20 | near
            cols = [*part.columns, pa.array(area), pa.array(angle)]
            yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names, "area", "angle"]).filter(pa.array(area >= 0))

    return held.mapInArrow(run, f"chunk_id {dict(held.dtypes)['chunk_id']}, root_id long, embedding array<double>, area long, angle double")


def _reach(asked: DataFrame, centres: dict[int, np.ndarray], areas: dict[int, np.ndarray], k: int, first: bool) -> DataFrame:
    """(query_id, embedding, least, area) of each query and the areas that it must meet.

    areas: {length: rows of centre, least angle, greatest angle, number of vectors}. first: the nearest areas that hold k vectors between
    them. Else all others that can hold a vector of the query's least score: by the triangle inequality of angles no vector of an area is
    nearer than the gap between the query's angle to the centre and the angles of the area.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            reach = np.arccos(np.clip(part.column("least").to_numpy() - COSINE_SLACK, -1, 1)) + ANGLE_SLACK
            for n, (at, unit) in _matrix(part.column("embedding")).items():
                rows, marks = [at] if first else [], [np.full(len(at), n << 20 | _NO_CENTRE)] if first else []
                if n in areas:
                    low, high, count = areas[n][:, 1:].T
                    centre = areas[n][:, 0].astype(np.int64)
                    for i in range(0, len(at), 1024):
                        far = _angles(unit[i : i + 1024], centres[n][centre])
                        gap = np.maximum(np.maximum(far - high, low - far), 0)
                        order = np.lexsort((far, gap), axis=1)
                        met = np.zeros(gap.shape, bool)
                        np.put_along_axis(met, order, np.cumsum(count[order], axis=1) - count[order] < k, axis=1)
                        if not first:
                            met = ~met & (gap <= reach[at[i : i + 1024], None])
                        q, a = np.nonzero(met)
                        rows.append(at[i : i + 1024][q])
                        marks.append(n << 20 | centre[a])
                which, area = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, marks))
                for i in range(0, len(which), 10_000):
                    some = part.take(pa.array(which[i : i + 10_000]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(area[i : i + 10_000])], names=[*some.schema.names, "area"])

    return asked.select("query_id", "embedding", "least").mapInArrow(run, f"query_id {dict(asked.dtypes)['query_id']}, embedding array<double>, least double, area long")


def search_cells(queries: DataFrame, cells: DataFrame, centres: dict[int, np.ndarray], k: int = 5, threshold: float = -1.0, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(hits, met): the rows of search, without comparing all; met(query_id, area, n) are the areas that each query was compared with.

    cells: what in_cells gave for the same centres, stored; it is read and never copied, but for areas that more than query_block queries
    meet. Each query first meets the nearest areas that hold k vectors. The k-th score found there is a distance within which its k best
    must lie, so that only areas that reach into it are met then, and only better hits handed on. Exact for any data; how much is left out depends on them: vectors in
    groups leave most out, vectors in all directions alike nothing. Nulls, zero vectors, lengths and ties as in search; scopes are not for
    it, since search makes its blocks inside them.
    """
    asked = _clean(queries.withColumn("root_id", F.lit(0)), "query_id").withColumn("least", F.lit(float(threshold)))
    per_area = cells.groupBy("area").agg(F.min("angle"), F.max("angle"), F.count("*").alias("n"))
    areas: dict[int, list] = {}
    for area, low, high, n in per_area.where(F.col("area").bitwiseAND(_NO_CENTRE) != _NO_CENTRE).collect():  # a row a centre
        areas.setdefault(area >> 20, []).append((area & _NO_CENTRE, low, high, n))
    packed = {n: np.array(sorted(rows), np.float64) for n, rows in areas.items()}
    near = kept(_reach(asked, centres, packed, k, True))
    found = kept(top_k(_meet(near, cells, k, query_block, vector_block), k))
    last = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - COSINE_SLACK).alias("last"))
    bounded = asked.alias("q").join(last.alias("l"), F.col("q.query_id").eqNullSafe(F.col("l.query_id")), "left").select("q.query_id", "q.embedding", F.greatest("last", "least").alias("least"))
    more = kept(_reach(bounded, centres, packed, k, False))
    hits = top_k(found.drop("rank").unionByName(_meet(more, cells, k, query_block, vector_block)), k)
    met = near.unionByName(more).select("query_id", "area").join(per_area.select("area", "n"), "area")
    return hits, met


def embed_hashing(chunks: DataFrame, size: int = 256) -> DataFrame:
    """chunks(chunk_id, text) with a unit-length hashed TF-IDF vector `embedding`."""
    words = RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\W+").transform(chunks.withColumn("text", F.coalesce("text", F.lit(""))))
    counts = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=size).transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(counts).transform(counts)
    unit = Normalizer(inputCol="_idf", outputCol="_v", p=2.0).transform(weighted)
    return unit.select(*chunks.columns, vector_to_array("_v", "float32").alias("embedding"))


def embed(chunks: DataFrame, fn: Callable[[pd.Series], list]) -> DataFrame:
    """chunks with `embedding` by a user function that takes a batch of texts."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(fn(texts)))

    return chunks.withColumn("embedding", run(F.coalesce("text", F.lit(""))))


@F.pandas_udf(ArrayType(LongType()))
def _bucket_numbers(rows: pd.Series) -> pd.Series:
    """The bucket in each table; none for vectors that aren't finite, which nothing is near."""
    numbers = rows.map(lambda hs: [h["values"][0] for h in hs])
    return numbers.map(lambda ns: [int(n) for n in ns] if np.isfinite(ns).all() else [])


def _within(distance: float):
    """For a block of queries and one of vectors of a bucket: the pairs at less than the distance whose first common bucket this is."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and vectors.num_rows:
            table = queries.column("t")[0].as_py()
            (q, v), (qk, vk) = ([np.stack(t.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for t in (queries, vectors)] for c in ("embedding", "keys"))
            square = (v * v).sum(axis=1)
            for at in range(0, len(q), 128):
                some = q[at : at + 128]
                rough = (some * some).sum(axis=1)[:, None] + square - 2 * (some @ v.T)
                i, j = np.nonzero(rough < distance * distance * (1 + 1e-9) + 1e-9 * (1 + square.max()))
                for k in range(0, len(i), 100_000):  # exactly, for the pairs that may be near
                    x, y = at + i[k : k + 100_000], j[k : k + 100_000]
                    far = np.sqrt(((q[x] - v[y]) ** 2).sum(axis=1))
                    first = (far < distance) & ~(qk[x, :table] == vk[y, :table]).any(axis=1)
                    out.append((x[first], y[first], far[first]))
        x, y, far = (np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3))
        take = lambda t, rows: t.column("id").take(pa.array(rows.astype(np.int64)))
        return pa.table({"query_id": take(queries, x), "chunk_id": take(vectors, y), "distance": pa.array(far, pa.float64())})

    return run


def _near(asked: DataFrame, held: DataFrame, distance: float, query_block: int, vector_block: int) -> DataFrame:
    """Pairs of asked and held(id, embedding, keys) that share a bucket of a table. A bucket's rows are dealt into blocks, and each pair of
    blocks is a task's; what is shuffled are vectors and never pairs."""
    blocks = lambda size: F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int")
    asked, held = (df.select("id", "embedding", "keys", F.posexplode("keys").alias("t", "bucket")) for df in (asked, held))
    sizes = asked.groupBy("t", "bucket").agg(blocks(query_block).alias("qs")).join(held.groupBy("t", "bucket").agg(blocks(vector_block).alias("vs")), ["t", "bucket"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, ["t", "bucket"]).select("id", "embedding", "keys", "t", "bucket", own("qs").alias("qb"), every("vs").alias("vb"))
    right = held.join(sizes, ["t", "bucket"]).select("id", "embedding", "keys", "t", "bucket", every("qs").alias("qb"), own("vs").alias("vb"))
    by, kinds = ["t", "bucket", "qb", "vb"], (dict(asked.dtypes)["id"], dict(held.dtypes)["id"])
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_within(distance), f"query_id {kinds[0]}, chunk_id {kinds[1]}, distance double")


def lsh_candidates(queries: DataFrame, vectors: DataFrame, distance: float, tables: int = 6, width: float | None = None, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, chunk_id, distance) of pairs within a Euclidean distance, for two large sides: the pairs that share a bucket of one table.

    width: length of a bucket along a random direction; by default twice the distance over the root of the dimension, which a pair at the
    distance overcomes with about two fifths chance a table. Not all pairs are found; see search for those that must be.
    """
    from pyspark.ml.functions import array_to_vector

    if width is None:
        first = vectors.where("size(embedding) > 0").select(F.size("embedding")).first()
        width = 2 * distance / max(first[0] if first else 1, 1) ** 0.5
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=5)
    a, b = (df.where("embedding is not null").withColumn("v", array_to_vector(F.col("embedding").cast("array<double>"))) for df in (queries.select("query_id", "embedding"), vectors.select("chunk_id", "embedding")))
    found = model.fit(b)
    hashed = lambda df, ident: kept(found.transform(df).select(F.col(ident).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), _bucket_numbers("h").alias("keys")))
    return _near(hashed(a, "query_id"), hashed(b, "chunk_id"), distance, query_block, vector_block)


def upsert_vectors(new: DataFrame, old: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with the rows of new in place of those with their key; of several new rows with a key one stays."""
    fresh = new.dropDuplicates([key])
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*old.columns))


def delete_pages(vectors: DataFrame, pages: DataFrame) -> DataFrame:
    return vectors.join(pages.select("page_id").distinct(), "page_id", "left_anti")


def vector_documents(chunks: DataFrame) -> DataFrame:
    """Flat documents: id, text, chunk fields, and the metadata struct's fields, which win over chunk fields of the same name."""
    meta = chunks.schema["metadata"].dataType.names
    plain = [c for c in chunks.columns if c not in ("metadata", "chunk_id", "text")]
    both = [F.coalesce(F.col(f"metadata.{c}"), F.col(c)).alias(c) if c in meta else F.col(c) for c in plain]
    return chunks.select(F.col("chunk_id").alias("id"), "text", *both, *[F.col(f"metadata.{c}").alias(c) for c in meta if c not in plain])
