"""Phrase collocation mining: three-way quicksort of suffix pointers, routed by leading words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import load, stored

LONGEST = 3
LEAST = 10
TOP = 2000
#: Bytes that end a piece become one that no UTF-8 text holds, A-Z become lower case, and tabs blanks.
_FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK = b"\xff"
#: Words that a task holds before it sorts pointers to them; those of the language with most of them are sorted at once.
_FLUSH = 800_000
#: Partitions of fewer suffixes are sorted out in one go.
_SMALL = 4096
_END = 0


# ---------------------------------------------------------------- quicksort


def frequent(words: list[np.ndarray], weight: np.ndarray, least: int, partial: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, counts) of the word ids in `words`, one array a depth, 0 where a suffix has ended; phrases has a column a word.

    Multikey quicksort to the full depth: suffixes part by their word at a depth into smaller, equal and larger ones; the sum of an equal part's
    weights is the count of its phrase, and it goes on one word deeper. Parts that weigh less than `least` are abandoned. partial[d] marks
    suffixes whose phrase of d + 1 words is also counted elsewhere: these parts are kept whatever they weigh.
    """
    depths = len(words)
    stack = [(np.arange(len(weight)), 0, ())]
    while stack:
        rows, depth, prefix = stack.pop()
        if weight[rows].sum() < least and not (partial and partial[depth][rows].any()):
            continue
        if len(rows) <= _SMALL:
            yield from _sorted_out(words, weight, least, partial, rows, depth, prefix)
            continue
        x = words[depth][rows]
        some = np.sort(x[:: len(x) // 31])
        pivot = some[len(some) // 2]
        stack += [(rows[x < pivot], depth, prefix), (rows[x > pivot], depth, prefix)]
        if pivot != _END:
            same = rows[x == pivot]
            count = weight[same].sum()
            if count >= least or partial and partial[depth][same[0]]:
                yield np.array([[*prefix, pivot]]), np.array([count])
                if depth + 1 < depths:
                    stack.append((same, depth + 1, (*prefix, pivot)))


def _sorted_out(words, weight, least, partial, rows, depth, prefix) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """frequent for a small part: one sort by the remaining words, then the runs of equal prefixes."""
    rows = rows[np.lexsort([w[rows] for w in words[:depth:-1]] + [words[depth][rows]])]
    change = np.zeros(len(rows), bool)
    change[:1] = True
    for d in range(depth, len(words)):
        x = words[d][rows]
        change[1:] |= x[1:] != x[:-1]
        head = np.flatnonzero(change)
        count = np.add.reduceat(weight[rows], head)
        good = (x[head] != _END) & ((count >= least) | (partial[d][rows[head]] if partial else False))
        if good.any():
            at = rows[head[good]]
            yield np.column_stack([np.full(len(at), p) for p in prefix] + [words[k][at] for k in range(depth, d + 1)]), count[good]


# ---------------------------------------------------------------- suffixes


def _word_runs(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[tuple[str, np.ndarray, pa.Array, int]]:
    """(lang, ids, words, n) of some texts of one language: word ids in text order, 0 where a piece ends, words naming those from 1 on. Suffixes
    begin at the first n places; the `ahead` places behind them are begun in the next run."""
    held: defaultdict[str, list[bytes]] = defaultdict(list)
    total = 0

    def runs(lang: str, words: list[bytes]) -> Iterator[tuple[str, np.ndarray, pa.Array, int]]:
        for at in range(0, len(words), _FLUSH):
            part = pa.array([_BREAK, *words[at : at + _FLUSH + ahead]], pa.binary()).dictionary_encode()
            yield lang, part.indices.to_numpy()[1:].astype(np.int64), part.dictionary[1:], min(_FLUSH, len(words) - at)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = (text.as_py() or b"").translate(_FOLD).replace(_BREAK, b" \xff ").split()
            words.append(_BREAK)
            held[lang] += words
            total += len(words)
            if total >= _FLUSH:
                most = max(held, key=lambda x: len(held[x]))
                total -= len(held[most])
                yield from runs(most, held.pop(most))
    for lang, words in held.items():
        yield from runs(lang, words)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, ids, words, n in _word_runs(batches, 0):
        count = np.bincount(ids[:n], minlength=len(words) + 1)[1:]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.cast(pa.string()), pa.array(count, pa.int64())], ["lang", "phrase", "n"])


class WordFilter:
    """Which words may be frequent, by bits (four a word) in a table of at most 32 MB; which are hot, by name."""

    def __init__(self, bits: np.ndarray, hot: frozenset[tuple[str, bytes]]) -> None:
        self.bits, self.hot = bits, hot

    @staticmethod
    def places(lang: str, words: list[bytes], size: int) -> np.ndarray:
        import xxhash

        seed = xxhash.xxh32_intdigest(lang.encode())
        h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (h[:, None] + step[:, None] * np.arange(4, dtype=np.uint64)) & np.uint64(size - 1)

    def frequent(self, lang: str, words: list[bytes]) -> np.ndarray:
        at = self.places(lang, words, 8 * len(self.bits))
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def word_filter(words: DataFrame, hot: DataFrame, most_bits: int = 1 << 28) -> WordFilter:
    """The filter of words(lang, phrase), 16 bits a word up to most_bits: beyond that it lets more through, which costs time but no result."""
    bits = 1 << 10
    count = words.count()
    while bits < min(16 * count, most_bits):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = defaultdict(list)
            for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows[lang].append(word.encode())
            for lang, some in rows.items():
                at = np.unique(WordFilter.places(lang, some, bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["slot", "bits"])

    found = words.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most bits / 64 rows
    table = np.zeros(bits // 64, np.int64)
    table[found["slot"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return WordFilter(table.view(np.uint8), frozenset((r.lang, r.phrase.encode()) for r in hot.select("lang", "phrase").toLocalIterator()))


def _suffixes(filter_: Broadcast, longest: int):
    """(key, suffix, n): distinct suffixes of 2 to `longest` words that may be frequent, "lang\\tword word", with their counts. The key is of the
    leading words: the first one, and each further one as long as all before it are hot and it is hot too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for lang, ids, words, n in _word_runs(batches, longest - 1):
            names = words.to_pylist()
            good = np.concatenate(([False], filter_.value.frequent(lang, names))) if names else np.zeros(1, bool)
            x = np.where(good[ids], ids, _END)
            cols = [np.concatenate((x[d:], np.full(d, _END)))[:n] for d in range(longest)]
            for d in range(1, longest):
                cols[d] = np.where(cols[d - 1] == _END, _END, cols[d])
            some = cols[1] != _END
            cols = [c[some] for c in cols]
            if not len(cols[0]):
                continue
            code, first = cols[0], None
            for c in cols[1:]:
                code = code * (len(names) + 1) + c
                if longest > 2:
                    _, first, code, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
                else:
                    _, first, count = np.unique(code, return_index=True, return_counts=True)
            cols = [c[first] for c in cols]
            hot = np.array([False, *((lang, w) in filter_.value.hot for w in names)])
            seed, table = quote(lang, safe="").encode() + b"\t", [b"", *names]
            keys, out = [], []
            for row in zip(*(c.tolist() for c in cols)):
                taken = [table[i] for i in row if i]
                out.append(seed + b" ".join(taken))
                lead = 1
                if hot[row[0]]:
                    lead = next((k for k in range(2, len(taken)) if not hot[row[k - 1]]), len(taken))
                keys.append(xxhash.xxh3_64_intdigest(seed + b" ".join(taken[:lead])) - (1 << 63))
            for at in range(0, len(out), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.int64()), pa.array(out[part], pa.binary()), pa.array(count[part], pa.int64())], ["key", "suffix", "n"])

    return run


def _counted(filter_: Broadcast, longest: int, least: int, shard: int):
    """Of suffixes sorted by key: (lang, phrase, n) by quicksort, for about `shard` suffixes of whole keys at a time."""

    def solve(suffix: pa.Array, weight: np.ndarray) -> pa.RecordBatch:
        parts = pc.split_pattern(pc.replace_substring(suffix.cast(pa.string()), "\t", " "), " ")
        size = pc.list_value_length(parts).to_numpy() - 1
        flat = parts.flatten().dictionary_encode()
        ids, names = flat.indices.to_numpy().astype(np.int64) + 1, flat.dictionary.to_pylist()
        begin = np.cumsum(size + 1) - size - 1
        lang = ids[begin]
        words = [np.where(size > d, ids[np.minimum(begin + 1 + d, len(ids) - 1)], _END) for d in range(longest)]
        hot_of = defaultdict(list)
        for language, word in filter_.value.hot:
            hot_of[quote(language, safe="")].append(word.decode())
        hot = np.zeros((len(weight), longest), bool)
        for i in np.unique(lang).tolist():
            is_hot = np.zeros(len(names) + 1, bool)
            is_hot[pc.index_in(pa.array(hot_of[names[i - 1]], pa.string()), flat.dictionary).drop_null().to_numpy() + 1] = True
            for d in range(longest):
                hot[:, d] |= (lang == i) & is_hot[words[d]]
        # A phrase of hot words is counted under several keys, unless it is of the greatest length.
        partial = [hot[:, : d + 1].all(axis=1) & (d + 1 < longest) for d in range(longest)]
        out: list[tuple[str, str, int]] = []
        for phrases, counts in frequent([lang, *words], weight, least, [np.ones(len(weight), bool), *partial]):
            if phrases.shape[1] > 2:
                out += [(unquote(names[p[0] - 1]), " ".join([names[i - 1] for i in p[1:]]), c) for p, c in zip(phrases.tolist(), counts.tolist())]
        kinds = [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < shard:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            key = whole.column(0).to_numpy()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0  # the last key may go on in the next batch
            if last:
                yield solve(whole.column(1).chunk(0).slice(0, last), whole.column(2).to_numpy()[:last])
            held = whole.slice(last).to_batches()
            size = whole.num_rows - last
        if size:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield solve(whole.column(1).chunk(0), whole.column(2).to_numpy())

    return run


# ---------------------------------------------------------------- operator


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, hot_share: int = 10_000, hot_min: int = 1000, shard: int = 400_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all words and of all phrases of 2 to `longest` words that occur `least` times or more; see collocations for the edges.

    Passes:
    1. Words are counted, summed per run of texts first. Words with a share of over 1 / hot_share of all (and over hot_min) are hot; there are
       at most hot_share of them. A filter of fixed greatest size holds the words that occur `least` times.
    2. Suffixes go to partitions by their leading words, equal ones of a run of texts as one pointer with a weight; they end before the first word
       that surely isn't frequent. Suffixes under a hot word are routed by their second word too, and so on, so no key holds more than a
       share 1 / hot_share of all places, or one row a run of texts.
    3. A partition is sorted by quicksort in shards of whole keys. Phrases of hot words only, met under several keys, are summed afterwards.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    words = stored(texts.mapInArrow(_word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = words.where(F.col("n") > max(hot_min, total // hot_share))
    filter_ = docs.sparkSession.sparkContext.broadcast(word_filter(words.where(F.col("n") >= least), hot))
    suffixes = texts.mapInArrow(_suffixes(filter_, longest), "key long, suffix binary, n long")
    found = suffixes.repartition("key").sortWithinPartitions("key").mapInArrow(_counted(filter_, longest, least, shard), "lang string, phrase string, n long")
    return words, found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, held_percent: int = 50, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs(text, lang): per language the phrases of 2 to `longest` words that hold together best.

    a is a phrase's count (`least` at least), n the language's number of words. Cut after its first k words a phrase scores
    floor(10^6 a^2 / (l r)), l and r being the counts of its parts; the lowest cut counts, the first of equals. Phrases inside a longer one that has
    held_percent of their count are dropped. top: the number of rows a language, None for all.

    Null texts hold nothing, a null lang is `und`. Texts are taken row by row: repeated rows count as often as they come. Ties rank by count, then
    by the phrase's bytes. An empty table gives no rows. Other columns are ignored.
    """
    words, found = phrase_counts(docs, longest, least, **options)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = stored(found.withColumn("words", F.split("phrase", " ")))
    counts = words.where(F.col("n") >= least).select("lang", "phrase", "n").unionByName(phrases.select("lang", "phrase", "n"))
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("tail"))
    heads, tails = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    score = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(16, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.where(F.size("words") > 2).select("lang", "n", F.explode(F.array(F.expr("array_join(slice(words, 1, size(words) - 1), ' ')"), F.expr("array_join(slice(words, 2, size(words)), ' ')"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < held_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language in all documents; see collocations for nulls, ties, repeated rows and empty tables."""
    return collocations(load(spark, sf_dir, "documents"))


OP11_SQL = """
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as ws from p),
s as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select lang, k, ws[i : i + k - 1] as ws from (select lang, ws, i, unnest([1, 2, 3]) as k from s) where i + k - 1 <= len(ws)),
f as (select lang, k, array_to_string(ws, ' ') as phrase, any_value(ws) as ws, count(*)::hugeint as n from g group by 1, 2, 3),
t as (select lang, sum(n)::bigint as n from f where k = 1 group by lang),
c as (select lang, phrase, ws, k, n as a from f where k > 1 and n >= 10),
u as (select lang, phrase, a, j, array_to_string(ws[1 : j], ' ') as head, array_to_string(ws[j + 1 : k], ' ') as tail from (select *, unnest(range(1, k)) as j from c)),
v as (select u.lang, u.phrase, u.a, u.j, x.n as l, y.n as r, (1000000::hugeint * u.a * u.a) // (x.n * y.n) as score from u join f x on x.lang = u.lang and x.phrase = u.head join f y on y.lang = u.lang and y.phrase = u.tail),
b as (select * from v qualify row_number() over (partition by lang, phrase order by score, j) = 1),
i as (select lang, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) as phrase, a from c where k = 3),
m as (select lang, phrase, max(a) as longer from i group by 1, 2),
d as (select b.* from b left join m on m.lang = b.lang and m.phrase = b.phrase where longer is null or 100 * longer < 50 * a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from d)
select r.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, t.n, score::bigint as score from r join t on t.lang = r.lang where rank <= 2000
"""
