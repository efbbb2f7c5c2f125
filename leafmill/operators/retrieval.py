"""Hits, context, answers and sources of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import hit_title, meta_string, no_blank, score_of, truncate


# Texts for queries without hits, and the head of answers made without a model.
NO_CONTEXT = "(no relevant context found)"
NO_HITS = "No relevant content found"
NO_MODEL = "LLM chat model is not configured. Showing top matching excerpts:\n\n"


def validate_queries(queries: DataFrame, max_k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) queries(query, top_k, threshold): text not blank and at most 4000 characters, 1 <= top_k <= max_k, 0 <= threshold
    <= 1; a missing top_k or threshold is fine."""
    ok = (
        F.col("query").rlike(r"\S") & (F.length("query") <= 4000)
        & F.coalesce(F.col("top_k").between(1, max_k), F.lit(True)) & F.coalesce(F.col("threshold").between(0, 1), F.lit(True))
    )
    ok = F.coalesce(ok, F.lit(False))
    return queries.where(ok), queries.where(~ok)


def enrich_hits(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """hits with a blank title or address filled from the manifest row of their root and page."""
    m = manifest.select("root_id", "page_id", F.col("title").alias("_t"), F.col("web_url").alias("_u"))
    out = hits.join(m, ["root_id", "page_id"], "left")
    return out.withColumns({"title": meta_string(F.col("title"), F.col("_t")), "web_url": meta_string(F.col("web_url"), F.col("_u"))}).drop("_t", "_u")


def hits(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """found with title, address and a score: its own or one minus its distance."""
    return enrich_hits(found, manifest).withColumn("score", score_of(F.col("score"), F.col("distance")))


def _block() -> F.Column:
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("--- Source "), F.col("rank").cast("string"), F.lit(" ---\n"), line("Page", "title"), line("Section", "heading_path"), line("URL", "web_url"), F.coalesce("text", F.lit("")), F.lit("\n\n"))


def rag_context(queries: DataFrame, hit_rows: DataFrame) -> DataFrame:
    """(query_id, context): the hits' texts with their headers in rank order; a fixed line for queries without hits."""
    per = hit_rows.select("query_id", "rank", _block().alias("b")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), "").alias("context"))
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))


def retrieval_answer(queries: DataFrame, hit_rows: DataFrame) -> DataFrame:
    """(query_id, success, answer): bullets with excerpts, or an error row for queries without hits."""
    bullet = F.concat(F.lit("• "), hit_title(F.col("title"), F.col("heading_path")), F.lit("\n"), truncate(F.col("text"), 500))
    per = hit_rows.select("query_id", "rank", bullet.alias("b")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), "\n\n").alias("a"))
    out = queries.select("query_id").join(per, "query_id", "left")
    answer = F.concat(F.lit(NO_MODEL), F.col("a"))
    return out.select("query_id", F.col("a").isNotNull().alias("success"), F.coalesce(answer, F.lit(NO_HITS)).alias("answer"))


def sources(hit_rows: DataFrame) -> DataFrame:
    """(query_id, sources): array of title, web_url, heading_path, score and excerpt in rank order."""
    s = F.struct("rank", F.struct("title", "web_url", "heading_path", "score", truncate(F.col("text"), 300).alias("excerpt")).alias("s"))
    return hit_rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["s"]).alias("sources"))


def titled(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.withColumn("title_line", hit_title(no_blank(F.col("title")), F.col("heading_path")))
