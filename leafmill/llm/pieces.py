"""SentencePiece encoding of merge-type vocabularies by backtracking, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import load

SPACE = "▁"


class PieceEncoder:
    """Exact ids of a merge-type (BPE) SentencePiece model with byte fallback.

    Text is cut into units: a run of spaces and what follows up to the next space. No piece holds a space after another character, so
    no merge crosses units. A unit is encoded by taking the longest piece at each place (Aho-Corasick), testing each adjacent pair by
    undoing merges (two pieces may stand together only if no earlier merge would have joined their ends), and stepping back to a
    shorter piece where none fits; a bit per place marks those from which no encoding goes on, so none is tried twice. Units with
    several spaces, whose pieces tie in score, are merged step by step. Units are remembered per worker, up to a bound.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = schema.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        trained, norm = spec.trainer_spec, spec.normalizer_spec
        if trained.model_type != schema.TrainerSpec.BPE or not trained.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("needs a BPE model with byte fallback and the identity normaliser")
        kinds = schema.ModelProto.SentencePiece
        normal = [(p.piece, i, p.score) for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL]
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in normal) or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("pieces with inner spaces, user-defined and unused pieces aren't supported")
        self.code = {p: i.to_bytes(4, "little") for p, i, _ in normal}
        self.byte_code = {int(p.piece[3:5], 16): i.to_bytes(4, "little") for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.score = {p: s for p, _, s in normal}
        #: Place in the order of merges; single characters come before all of them.
        order = sorted(normal, key=lambda x: (len(x[0]) > 1, -x[2], x[1]))
        self.rank = {p: r for r, (p, _, _) in enumerate(order)}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p, _, _ in normal:
            parts = self._merge(p, keep_last=True)
            if len(p) == 1 or len(parts) == 2:
                self.split[p] = (parts[0], parts[1]) if len(p) > 1 else None
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.split), None) for p in self.split}
        known = "".join(re.escape(p) for p in self.split if len(p) == 1)
        self.parts = re.compile(f"[{known}]+|[^{known}]", re.S)
        self.clean = re.compile(f"[{known}]+", re.S).fullmatch
        self.most, self.known = most, {}
        #: Whether a piece can follow another, as far as asked; held counts the answers.
        self.fits: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.held = 0

    def _merge(self, text: str, keep_last: bool = False) -> list[str]:
        """Pieces by merging the best-scored adjacent pair again and again, leftmost of equals first; keep_last: without the merge to all of text."""
        sym: list[str | None] = list(text)
        after, before = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)]
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            joined = sym[i] + sym[j]
            if joined in self.score and not (keep_last and len(joined) == len(text)):
                heapq.heappush(heap, (-self.score[joined], i, j, joined))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or after[i] != j or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in sym if s is not None]

    def _fit(self, a: str, b: str) -> bool:
        """Whether pieces a and b can stand side by side: no merge over their border comes before the merges that made them."""
        rank, split, first, second, limit = self.rank, self.split, a, b, 1 << 30
        while True:
            if (joined := rank.get(first + second)) is not None and joined < limit:
                return False
            x, y = rank[first], rank[second]
            left, right = split[first], split[second]
            if x > y and left or not right:
                if not left:
                    return True
                limit, first = x, left[1]
            else:
                limit, second = y + 1, right[0]

    def _backtrack(self, text: str) -> list[str]:
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, piece in self.automaton.iter(text):
            longest[end - len(piece) + 1] = piece  # longer ones of a start come later
        dead = bytearray(n // 8 + 1)  # a bit per place: set if no encoding goes on from there
        fits, shorter, out = self.fits, self.shorter, []
        at, piece, after = 0, longest[0], None
        while True:
            while piece is not None:
                end = at + len(piece)
                if not dead[end >> 3] >> (end & 7) & 1:
                    if after is None:
                        break
                    ok = after.get(piece)
                    if ok is None:
                        ok = after[piece] = self._fit(out[-1], piece)
                        self.held += 1
                    if ok:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                if end == n:
                    return out
                at, after = end, fits[piece]
                piece = longest[at]
            else:
                dead[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                after = fits[out[-1]] if out else None

    def _unit(self, unit: str) -> bytes:
        if SPACE * 2 not in unit and self.clean(unit):
            return b"".join([self.code[p] for p in self._backtrack(unit)])
        out = []
        for m in self.parts.finditer(unit):
            part = m[0]
            if part[0] not in self.code:
                out += [self.byte_code[b] for b in part.encode("utf-8")]
            else:
                out += [self.code[p] for p in (self._merge(part) if SPACE * 2 in part else self._backtrack(part))]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        units = text.split(" ")
        if "" in units:
            units = [m[0][1:] for m in re.finditer(" +[^ ]*", " " + text)]  # further spaces stay in the unit
        out = []
        for at in range(0, len(units), 50_000):
            part = units[at : at + 50_000]
            known = self.known
            if len(known) > self.most:
                known.clear()
            if self.held > 2 * self.most:
                self.fits.clear()
                self.held = 0
            for u in {u for u in part if u not in known}:
                known[u] = self._unit(SPACE + u.replace(" ", SPACE))
            out += map(known.__getitem__, part)
        return b"".join(out)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of docs(doc_id, text), with begin and end ids. Null texts count as empty.

    Rows are encoded alone, without a shuffle: ties, repeated rows and other columns change nothing; an empty table gives no rows.
    """
    return _encoded(docs, model, full=True)


def _encoded(docs: DataFrame, model: str, full: bool) -> DataFrame:
    names = ["doc_id", "ids", "decoded"] if full else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.string()] if full else [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model)
        bos, eos = (np.array([x], "<u4").tobytes() for x in (encoder.model.bos_id(), encoder.model.eos_id()))
        for b in batches:
            rows = []
            for text in b.column(1):
                data = bos + encoder.encode(text.as_py() or "") + eos
                ids = np.frombuffer(data, "<u4")
                decoded = encoder.model.decode(ids.tolist())
                rows.append((ids.astype(np.int32), decoded) if full else (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[1:])]], names)

    schema = "doc_id long, ids array<int>, decoded string" if full else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids; see encode_pieces for nulls, empty texts and empty tables."""
    import public_tokenizers

    return _encoded(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), full=False)
