"""Alignment of two tokenizers' tokens over distinct texts, with corpus-wide counts of aligned pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import load, stored
from leafmill.llm.packing import ByteEncoder

#: Groups with more links than this are counted by distinct ids instead of link by link.
_WIDE = 64


class ByteTokens:
    """Ids and bytes of a byte-level BPE file of the tokenizers library; the names of special tokens inside texts are plain text.

    Files that fit it are run by tiktoken, which gives the same ids in a fifth of the time (see ByteEncoder), others by the library itself.
    """

    def __init__(self, path: str) -> None:
        encoder = ByteEncoder(path)
        self.fast, self.model = encoder.fast, encoder.whole
        self.model.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        names = {i: t for t, i in self.model.get_vocab(with_added_tokens=True).items()}
        self.bytes = [bytes(byte[c] for c in names.get(i, "") if c in byte) for i in range(max(names) + 1)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text behind a blank."""
        if self.fast is not None:
            return [self.fast.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceTokens:
    """Ids and bytes of a SentencePiece model, which puts the blank before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def align(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes], whole: bytes) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(group of each A token, group of each B token, number of groups): both are cut where tokens of both end. None unless both spell `whole`."""
    parts = [[*map(table.__getitem__, ids)] for ids, table in ((a, a_bytes), (b, b_bytes))]
    if not a or not b or b"".join(parts[0]) != whole or b"".join(parts[1]) != whole:
        return None
    ends = [np.cumsum(np.fromiter(map(len, p), np.int64, len(p))) for p in parts]
    both = np.zeros(len(whole) + 1, np.int8)
    both[ends[0]] = 1
    both[ends[1]] += 1
    before = np.cumsum(both == 2)  # groups that end at a byte or before it
    return before[ends[0] - 1], before[ends[1] - 1], int(before[-1])


def links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times): the distinct pairs A id << 32 | B id of all A and B tokens that share a group, and how often each occurs."""
    first_a, first_b = np.searchsorted(group_a, np.arange(groups + 1)), np.searchsorted(group_b, np.arange(groups + 1))
    size_a, size_b = np.diff(first_a), np.diff(first_b)
    narrow = size_a * size_b <= _WIDE
    # Every A token of a narrow group once for each B token of the group.
    of_a = np.flatnonzero(narrow[group_a])
    times = size_b[group_a[of_a]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pairs, count = np.unique((np.repeat(a[of_a], times) << 32) | b[np.repeat(first_b[group_a[of_a]], times) + step], return_counts=True)
    parts = [(pairs, count)]
    for g in np.flatnonzero(~narrow).tolist():
        (ids_a, n_a), (ids_b, n_b) = (np.unique(x[f[g] : f[g + 1]], return_counts=True) for x, f in ((a, first_a), (b, first_b)))
        parts.append((((ids_a[:, None] << 32) | ids_b[None, :]).ravel(), (n_a[:, None] * n_b[None, :]).ravel()))
    if len(parts) > 1:
        pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, at, np.concatenate([c for _, c in parts]))
    return pairs, count


def spelled(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, table: list[str]) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group in order. table: see _spellings."""
    part = np.concatenate((2 * group_a, 2 * group_b + 1))
    order = np.argsort(part, kind="stable")
    part, ids = part[order], np.concatenate((a, b))[order]
    ends = np.append(np.where(part[1:] == part[:-1], 0, np.where(part[1:] & 1, 1, 2)), 3)
    return "".join(map(table.__getitem__, (4 * ids + ends).tolist()))


def _spellings(ids: int) -> list[str]:
    """Each id's number before a comma, a bar, a semicolon and the end."""
    return [f"{i}{sep}" for i in range(ids) for sep in (",", "|", ";", "")]


_BUNCH = "bunch long, digest array<binary>, copies array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, held array<long>, size array<int>, slot binary, times binary"


def _bunches(a_path: str, b_path: str, bunch_bytes: int):
    """Rows of distinct texts (text, digest, copies) aligned, a row a bunch of about bunch_bytes: measures of each text, the bunch's distinct pairs
    and how many documents hold each, and for each text its number of distinct pairs, their slots and times."""
    names = ["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def packed(rows: list[tuple], number: int) -> pa.RecordBatch:
        sizes = [len(r[7]) for r in rows]
        pairs, slot = np.unique(np.concatenate([r[7] for r in rows]), return_inverse=True)
        held = np.zeros(len(pairs), np.int64)
        np.add.at(held, slot, np.repeat([r[1] for r in rows], sizes))
        times = np.concatenate([r[8] for r in rows])
        kinds = [pa.binary(), *[pa.int64()] * 5, pa.string()]
        lists = [pa.array([[r[i] for r in rows]], pa.list_(k)) for i, k in enumerate(kinds)]
        tail = [pa.array([pairs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([slot.astype("<u4").tobytes()], pa.binary()), pa.array([times.astype("<u8").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *tail], ["bunch", *names, "pairs", "held", "size", "slot", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one, two = ByteTokens(a_path), PieceTokens(b_path)
        table = _spellings(max(len(one.bytes), len(two.bytes)))
        rows: list[tuple] = []
        size, number = 0, TaskContext.get().partitionId() << 32
        none = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(0).to_pylist()
                for text, digest, copies, a, b in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist(), one.encode(texts), two.encode(texts)):
                    data = text.encode()
                    found = align(a, b, one.bytes, two.bytes, b" " + data) if data else None
                    if found is None:
                        rows.append((digest, copies, 0, 0, 0, 0, "", none, none))
                    else:
                        a, b, (in_a, in_b, groups) = np.array(a), np.array(b), found
                        pairs, times = links(a, b, in_a, in_b, groups)
                        rows.append((digest, copies, len(a), len(b), groups, int(times.sum()), hashlib.sha256(spelled(a, b, in_a, in_b, table).encode()).hexdigest(), pairs, times))
                    size += len(data) + 100
                    if size >= bunch_bytes:
                        yield packed(rows, number)
                        rows, size, number = [], 0, number + 1
        if rows:
            yield packed(rows, number)

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a text of bunches joined with `known`, the slots of their pairs in order with count and whether it is its A id's highest."""
    names = ["digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    for b in batches:
        col = dict(zip(b.schema.names, b.columns))
        for i in range(b.num_rows):
            sizes = col["size"][i].values.to_numpy()
            slot, times = np.frombuffer(col["slot"][i].as_py(), "<u4").astype(np.int64), np.frombuffer(col["times"][i].as_py(), "<u8").astype(np.int64)
            known = col["known"][i]
            n = len(col["pairs"][i].values)
            count, best = np.zeros(n, np.int64), np.zeros(n, bool)
            if known.is_valid:
                at = known.values.field("slot").to_numpy()
                count[at], best[at] = known.values.field("count").to_numpy(), known.values.field("best").to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(sizes)), sizes)
            sums = []
            for value in (times * best[slot], times * count[slot]):
                total = np.zeros(len(sizes), np.int64)
                np.add.at(total, text, value)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*(col[c][i].values for c in names), *sums], [*names, "n_best", "count_sum"])


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, bunch_bytes: int = 1 << 21) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of docs(doc_id, text), a row for each of its rows.

    Passes:
    1. Texts are shuffled whole, equal ones counted before and after, and each distinct text is tokenised and aligned once.
    2. Pair counts: each bunch of texts gives a row a distinct pair with the number of documents that hold it, copies included; these are summed,
       and each A id's highest is marked.
    3. Each bunch gets the counts of its pairs back, one row a pair, and measures its texts.
    4. Measures go to the documents by the SHA-256 digest of the text. Adaptive execution splits the rows of a text with very many copies.

    Null and empty texts, and texts that the tokens don't spell (those that hold U+2581, for one), have zeros and an empty digest. Repeated rows
    count as documents of their own. A null doc_id is a document as well. An empty table gives no rows. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    distinct = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    distinct = distinct.select("text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "copies")
    bunches = stored(distinct.mapInArrow(_bunches(a_path, b_path, bunch_bytes), _BUNCH))
    pairs = bunches.select("bunch", F.posexplode(F.arrays_zip("pairs", "held")).alias("slot", "pair")).select("bunch", "slot", "pair.pairs", "pair.held")
    counts = pairs.groupBy("pairs").agg(F.sum("held").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pairs", 32)))
    counts = stored(counts.withColumn("best", F.col("count") == highest))
    known = pairs.select("bunch", "slot", "pairs").join(counts, "pairs").groupBy("bunch").agg(F.collect_list(F.struct("slot", "count", "best")).alias("known"))
    measures = bunches.drop("copies", "held").join(known, "bunch", "left")
    kinds = "digest binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    measures = stored(measures.mapInArrow(_measured, kinds))
    ids = texts.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    return ids.join(measures, "digest").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' alignment; see aligned_documents for nulls, repeated rows and empty tables."""
    import public_tokenizers as files

    return aligned_documents(load(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))
