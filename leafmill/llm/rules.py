"""Quality rules: one threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import load, words_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for on with as was by be this are or an at not from have has you "
    "le la les de des du un une et en est que qui dans pour pas sur au par avec ce il ne se "
    "der die das und ist von den mit zu ein eine nicht auf für sich dem des im auch es "
    "el los las del que y en un una por con para no se su lo como más al"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes where low <= sum of factor * measure <= high; a missing bound is open."""

    name: str
    terms: dict[str, int]
    low: int | None = None
    high: int | None = None


#: Whole numbers only (shares in thousandths of the total), so that any engine gives the same verdict.
RULES = (
    Rule("word_length", {"word_chars": 1000, "n_words": -1500}, low=0),
    Rule("long_words", {"word_chars": 1, "n_words": -25}, high=0),
    Rule("symbols", {"n_symbols": 1000, "n_words": -300}, high=0),
    Rule("shouting", {"n_exclaims": 1000, "n_words": -300}, high=0),
    Rule("stop_words", {"n_stop_words": 1000, "n_words": -5}, low=0),
    Rule("dup_lines", {"n_dup_lines": 1000, "n_lines": -500}, high=0),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column, k: int = 3) -> Column:
    """How many words lie in k-word windows that the text holds twice or more.

    Windows are hashed, sorted with their places, and compared with their neighbours in that order; the places found are sorted
    and their coverage added up, so the work is n log n also for texts that repeat throughout.
    """
    n = F.size(words)

    def window_hashes(ws: Column) -> Column:
        tails = [F.slice(ws, F.lit(i + 1), F.greatest(F.size(ws) - k + 1, F.lit(0))) for i in range(k)]
        return F.transform(F.arrays_zip(*[t.alias(f"w{i}") for i, t in enumerate(tails)]), lambda s, i: F.struct(F.xxhash64(*[s[f"w{j}"] for j in range(k)]).alias("h"), i.alias("at")))

    def places(s: Column) -> Column:
        m = F.size(s)
        after = F.transform(F.slice(s, F.lit(2), m), lambda x: x["h"])
        hashes = F.transform(s, lambda x: x["h"])
        before = F.concat(F.array(F.lit(None).cast("long")), F.slice(hashes, F.lit(1), m - 1))
        zipped = F.arrays_zip(s.alias("s"), after.alias("after"), before.alias("before"))
        found = F.filter(zipped, lambda z: (z["s"]["h"] == z["after"]) | (z["s"]["h"] == z["before"]))
        return F.sort_array(F.transform(found, lambda z: z["s"]["at"]))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(k)), F.lit(k)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    counted = _let(F.sort_array(window_hashes(words)), lambda s: _let(places(s), covered))
    return F.when(n < k + 1, F.lit(0).cast("long")).otherwise(counted)


def measures(text: Column) -> Column:
    """struct of the counts that rules may use. Null texts count as empty."""
    t = F.coalesce(text, F.lit(""))
    gone = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    ws = words_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    stops = F.array(*map(F.lit, sorted(set(STOP_WORDS))))
    return _let(
        F.struct(ws.alias("ws"), lines.alias("ls")),
        lambda x: F.struct(
            F.size(x["ws"]).cast("long").alias("n_words"),
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            gone(SYMBOLS).alias("n_symbols"),
            gone("!").alias("n_exclaims"),
            F.size(x["ls"]).cast("long").alias("n_lines"),
            (F.size(x["ls"]) - F.size(F.array_distinct(x["ls"]))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x["ws"], lambda w: F.lower(w).isin(sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
            _repeated(x["ws"]).alias("n_repeat_words"),
        ),
    )


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    """array<string> of the names of the rules that the measures m break."""
    checks = []
    for r in rules:
        value = reduce(add, [m[k] * F.lit(f).cast("long") for k, f in r.terms.items()])
        bad = [value < r.low] * (r.low is not None) + [value > r.high] * (r.high is not None)
        checks.append(F.when(reduce(or_, bad), F.lit(r.name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def verdict(text: Column, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """struct(measures, base_failed, broken, kept): one expression, so that the measures are taken once however often they are used."""

    def judge(m: Column) -> Column:
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
        broken = compile_rules(rules, m)
        return F.struct(m.alias("measures"), failed.alias("base_failed"), broken.alias("broken"), (~failed & (F.size(broken) == 0)).alias("kept"))

    return _let(measures(text), judge)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with the struct column `verdict`: measures, base_failed, broken (names of the broken rules) and kept.

    base_failed: under min_words words, or over max_repeat_percent percent of the words in repeated 3-word windows. kept: not
    base_failed and no rule broken. One projection of built-in functions and no shuffle: rows are judged alone, so ties, repeated
    rows and hot sources change nothing. Null and blank texts have no words and fail. An empty table gives no rows. Columns of docs
    stay, but one named verdict is replaced.
    """
    return docs.withColumn("verdict", verdict(F.col("text").cast("string"), rules, min_words, max_repeat_percent))


def keep_passing(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Null and blank texts go, whatever their doc_id; repeated rows are judged
    alike. An empty table gives an empty one."""
    return docs.where(verdict(F.col("text").cast("string"), **options)["kept"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents; see quality_rules for nulls, repeated rows and empty tables."""
    out = quality_rules(load(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"verdict.measures.{n}").alias(n) for n in names], "verdict.base_failed", "verdict.kept")


_STOPS_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_VALUE_SQL = {r.name: " + ".join(f"{f} * {k}" for k, f in r.terms.items()) for r in RULES}
_BROKEN_SQL = " or ".join(f"({_VALUE_SQL[r.name]}) {op} {bound}" for r in RULES for op, bound in (("<", r.low), (">", r.high)) if bound is not None)

OP8_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') as ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as ls from t),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) > 2),
h as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as s from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as c from h) where c > 1),
n as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[ \t-\r]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g'))::bigint as n_exclaims, len(ls)::bigint as n_lines,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    len(list_filter(ws, lambda x: lower(x) in ({_STOPS_SQL})))::bigint as n_stop_words,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join n on w.doc_id = n.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {_BROKEN_SQL} as broken from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not broken as kept from b
"""
