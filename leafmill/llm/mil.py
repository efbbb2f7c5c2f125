"""Document quality by gated-attention multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import blocks_of, fold_of, load

PASSAGE_WORDS = 64
_HASHED = 16
_GAP, _LINE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _SHOUT, _STOP, _OTHER, _HIGH = range(10)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.int64)
    for chars, k in ((b" \t\x0b\x0c\r", _GAP), (b"\n", _LINE), (b"#*$%&|<>", _SYMBOL), (b"!", _SHOUT), (b".,;:?", _STOP), (b"0123456789", _DIGIT)):
        kind[list(chars)] = k
    kind[97:123], kind[65:91], kind[128:] = _LOWER, _UPPER, _HIGH
    return kind


_KIND = _byte_classes()
N_FEATURES = 10 + 5 + _HASHED


def _block_features(data: bytes) -> np.ndarray:
    words = data.split()
    n = len(words)
    count = max(1, -(-n // PASSAGE_WORDS))
    out = np.zeros((count, N_FEATURES), np.float32)
    if not n:
        return out
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    gap = kind <= _LINE
    begins = ~gap
    begins[1:] &= gap[:-1]
    at = np.maximum(np.cumsum(begins) - 1, 0) // PASSAGE_WORDS
    size = np.bincount(at, minlength=count).astype(np.float32)
    out[:, :10] = np.bincount(at * 10 + kind, minlength=count * 10).reshape(count, 10) / size[:, None]
    if len(raw) > 1:
        pair = (raw[:-1].astype(np.int64) * 31 + raw[1:].astype(np.int64) * 17) % _HASHED
        out[:, 15:] = np.bincount(at[:-1] * _HASHED + pair, minlength=count * _HASHED).reshape(count, _HASHED) / size[:, None]
    ids = np.fromiter(map(hash, words), np.int64, n)
    heads = np.arange(0, n, PASSAGE_WORDS)
    per = np.diff(np.append(heads, n)).astype(np.float32)
    same = np.zeros(n, np.float32)
    same[1:] = ids[1:] == ids[:-1]
    lengths = np.fromiter(map(len, words), np.float32, n)
    out[:, 10] = per / PASSAGE_WORDS
    out[:, 11] = np.add.reduceat(lengths, heads) / per / 10
    out[:, 12] = np.minimum(np.maximum.reduceat(lengths, heads), 60) / 20
    out[:, 13] = np.add.reduceat(same, heads) / per
    out[:, 14] = np.array([len(set(words[i : i + PASSAGE_WORDS])) for i in heads.tolist()], np.float32) / per
    return out


def passage_features(text: str | None) -> np.ndarray:
    """A row of features for each passage of 64 words of the whole text; one row of zeros for null and blank texts."""
    return np.concatenate([_block_features(b) for b in blocks_of((text or "").encode("utf-8", "surrogatepass"))])


@dataclass
class MilModel:
    """Encoder h = tanh(W x + b), gated attention softmax(w . (tanh(V h) * sigmoid(U h))), score sigmoid(c . z + d) of z = sum a h."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    prior: float

    def scores(self, x: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Scores of the documents whose passages are the rows of x from each of heads on."""
        if self.weights is None:
            return np.full(len(heads), self.prior)
        return _forward(self.weights, (x - self.mean) / self.scale, heads)["p"]


def _forward(w: dict, x: np.ndarray, heads: np.ndarray) -> dict:
    sizes = np.diff(np.append(heads, len(x)))
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
    e = (t * g) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), sizes))
    a = e / np.repeat(np.add.reduceat(e, heads), sizes)
    z = np.add.reduceat(a[:, None] * h, heads, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"][0], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "sizes": sizes}


def _gradient(w: dict, x: np.ndarray, heads: np.ndarray, y: np.ndarray) -> dict:
    """Derivatives of the mean cross-entropy of the labels y by each weight."""
    f = _forward(w, x, heads)
    err = (f["p"] - y) / len(y)
    rep = lambda q: np.repeat(q, f["sizes"], axis=0)
    dz = err[:, None] * w["c"]
    da = (rep(dz) * f["h"]).sum(1)
    de = f["a"] * (da - rep(np.add.reduceat(f["a"] * da, heads)))
    dt, dg = de[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * rep(dz) + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (de[:, None] * f["t"] * f["g"]).sum(0), "c": err @ f["z"], "d": err.sum(keepdims=True)}


def train(x: np.ndarray, heads: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> MilModel:
    """Fits the model to document labels y by Adam on the whole sample; the attention weights are learned from those labels alone."""
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return MilModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, prior)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    shape = {"W": (x.shape[1], hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
    m, v = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    for step in range(1, steps + 1):
        grad = _gradient(w, x, heads, y)
        for k, g in grad.items():
            g = g + decay * w[k] / 10
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * min(1, 3 * (1 - step / (steps + 1))) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel(mean, scale, w, prior)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000) -> MilModel:
    """Trains on at most max_docs labelled documents, those with the smallest hash of their id; all if there are fewer.

    labels(doc_id, quality): null qualities are ignored, several labels of a document are averaged. Passages of a document are all
    used. With no labels, or labels of one kind, the model gives their mean (0.5 with none).
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [passage_features(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")  # max_docs rows at most
    rows = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y double, x binary").toPandas().sort_values(["doc_id", "x"])
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in rows.x]
    sizes = [len(b) for b in bags]
    heads = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if bags else np.zeros(0, np.int64)
    return train(np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, N_FEATURES)), heads, rows.y.to_numpy(np.float64))


def score_quality(docs: DataFrame, model: MilModel) -> DataFrame:
    """(doc_id, score) for each row of docs(doc_id, text). Null and blank texts are scored as one empty passage.

    Rows are scored alone, without a shuffle; repeated rows stay; an empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, bags, rows = [], [], 0

            def flush() -> None:
                heads = np.concatenate(([0], np.cumsum([len(x) for x in bags])[:-1])).astype(np.int64)
                out.append(shared.value.scores(np.concatenate(bags).astype(np.float64), heads))

            for t in b.column(1):
                bags.append(passage_features(t.as_py()))
                rows += len(bags[-1])
                if rows > 20_000:
                    flush()
                    bags, rows = [], 0
            if bags:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held: int = 2) -> DataFrame:
    """docs whose score reaches the threshold, with all their columns; the model learns from labels outside the held fold.

    Rows with a null doc_id are scored like others, null and blank texts as one empty passage, very long ones whole. Repeated rows are
    judged alike. An empty table gives an empty one.
    """
    model = fit(docs, labels.where(fold_of(F.col("doc_id"), folds) != held))
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for t in b.column(names.index("text")):
                x = passage_features(t.as_py()).astype(np.float64)
                keep.append(bool(shared.value.scores(x, np.zeros(1, np.int64))[0] >= threshold))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned outside the held fold; see score_quality for nulls, empty texts and empty tables."""
    docs, held = load(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 4) == 2
    model = fit(docs, load(spark, sf_dir, "labels").where(~held))
    out = score_quality(docs, model).withColumn("held_out", held)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
