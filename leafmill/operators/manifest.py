"""The manifest: pending pages, merges, stage outcomes and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import no_blank, truncate

THRESHOLD = 2
STATUS = ("markdown_extracted", "chunked", "vector_ingested", "last_error", "no_of_retries")


def effective_retries(retries: Column, error: Column) -> Column:
    """Retries so far; a page with an error and none counted has one."""
    n = F.coalesce(retries, F.lit(0))
    return F.when((n > 0) | no_blank(error).isNull(), F.greatest(F.lit(0), n)).otherwise(F.lit(1))


def _open(threshold: int) -> Column:
    return effective_retries(F.col("no_of_retries"), F.col("last_error")) < threshold


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def is_pending(stage: str, threshold: int = THRESHOLD) -> Column:
    """stage: transform, chunk or vector."""
    ready = {"transform": ~_is("markdown_extracted"), "chunk": _is("markdown_extracted") & ~_is("chunked"), "vector": _is("chunked") & ~_is("vector_ingested")}[stage]
    return ready & _open(threshold)


def pending_transform(manifest: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return manifest.where(is_pending("transform", threshold))


def pending_chunk(manifest: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return manifest.where(is_pending("chunk", threshold))


def pending_vector(manifest: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return manifest.where(is_pending("vector", threshold))


def next_batch(manifest: DataFrame, stage: str, n: int = 100, order: str = "page_id") -> DataFrame:
    return manifest.where(is_pending(stage)).orderBy(order).limit(n)


def summarize(manifest: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per root: pages, extracted pages, pages pending for transform, pages that have failed (these overlap the others)."""
    failed = effective_retries(F.col("no_of_retries"), F.col("last_error")) > 0
    return manifest.groupBy("root_id").agg(F.count("*").alias("total"), F.count_if(_is("markdown_extracted")).alias("ingested"), F.count_if(is_pending("transform", threshold)).alias("pending"), F.count_if(failed).alias("failed"))


def pending_counts(manifest: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return manifest.groupBy("root_id").agg(*[F.count_if(is_pending(s, threshold)).alias(f"pending_{s}") for s in ("transform", "chunk", "vector")])


def dedupe_pages(crawl: DataFrame, order: str = "crawl_order") -> DataFrame:
    """One row per page, the first in crawl order; blank ids go."""
    cols = [c for c in crawl.columns if c not in ("root_id", "page_id")]
    named = crawl.where(no_blank(F.col("page_id").cast("string")).isNotNull())
    return named.groupBy("root_id", "page_id").agg(F.min_by(F.struct(*cols), order).alias("r")).select("root_id", "page_id", "r.*")


def merge_manifest(crawl: DataFrame, old: DataFrame) -> DataFrame:
    """crawl's pages with the status that old has of them; pages that crawl lacks go, titles and addresses are crawl's."""
    kept = old.select("root_id", "page_id", F.struct(*STATUS).alias("s"))
    defaults = {"markdown_extracted": F.lit(False), "chunked": F.lit(False), "vector_ingested": F.lit(False), "last_error": F.lit(None).cast("string"), "no_of_retries": F.lit(0)}
    status = [F.coalesce(F.col("s")[c], d).alias(c) for c, d in defaults.items()]
    return crawl.select("root_id", "page_id", "title", "web_url").join(kept, ["root_id", "page_id"], "left").select("root_id", "page_id", "title", "web_url", *status)


def manifest_diff(crawl: DataFrame, old: DataFrame) -> DataFrame:
    """(root_id, page_id, change): pages that vanished and pages that are new."""
    key = ["root_id", "page_id"]
    gone = old.select(*key).join(crawl.select(*key), key, "left_anti").withColumn("change", F.lit("vanished"))
    return gone.unionByName(crawl.select(*key).join(old.select(*key), key, "left_anti").withColumn("change", F.lit("new")))


def apply_state(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """manifest with each page's latest state row (by updated_at) in place of its status; unknown pages are ignored."""
    latest = state.groupBy("root_id", "page_id").agg(F.max_by(F.struct(*STATUS), F.struct("updated_at", "stage")).alias("s"))
    rest = [c for c in manifest.columns if c not in STATUS]
    status = [F.when(F.col("s").isNotNull(), F.col("s")[c]).otherwise(F.col(c)).alias(c) for c in STATUS]
    return manifest.join(latest, ["root_id", "page_id"], "left").select(*rest, *status)


def apply_outcomes(manifest: DataFrame, outcomes: DataFrame, stage: str) -> DataFrame:
    """manifest after one stage: outcomes(root_id, page_id, success, error, title, web_url), one row a page.

    Success sets the stage's flag and clears error and retries (and, for transform, refreshes title and address); failure adds a retry
    and keeps the error, at most 2000 characters of it.
    """
    flag = {"transform": "markdown_extracted", "chunk": "chunked", "vector": "vector_ingested"}[stage]
    got = outcomes.select("root_id", "page_id", F.struct("success", "error", "title", "web_url").alias("o"))
    ok, failed = F.coalesce(F.col("o.success"), F.lit(False)), F.coalesce(~F.col("o.success"), F.lit(False))
    new = {
        flag: F.when(ok, F.lit(True)).otherwise(F.col(flag)),
        "last_error": F.when(ok, F.lit(None)).when(failed, F.substring("o.error", 1, 2000)).otherwise(F.col("last_error")),
        "no_of_retries": F.when(ok, F.lit(0)).when(failed, effective_retries(F.col("no_of_retries"), F.col("last_error")) + 1).otherwise(F.col("no_of_retries")),
    }
    if stage == "transform":
        new |= {c: F.when(ok, F.coalesce(F.col("o")[c], F.col(c))).otherwise(F.col(c)) for c in ("title", "web_url")}
    return manifest.join(got, ["root_id", "page_id"], "left").select(*[new.get(c, F.col(c)).alias(c) for c in manifest.columns])


def run_progress(outcomes: DataFrame, pending: DataFrame) -> DataFrame:
    """Per root and phase: attempts, failures, and what remains of pending(root_id, phase, pending)."""
    done = outcomes.groupBy("root_id", "phase").agg(F.count("*").alias("processed"), F.count_if(~F.col("success")).alias("failed"))
    return done.join(pending, ["root_id", "phase"], "left").select("root_id", "phase", "processed", "failed", F.greatest(F.lit(0), F.coalesce("pending", F.lit(0)) - F.col("processed")).cast("long").alias("remaining"))


def run_status(roots: DataFrame, ticks: DataFrame, manifest: DataFrame) -> DataFrame:
    """A line per root: the latest status of each phase of ticks(root_id, phase, status, ts), and whether a manifest exists."""
    last = ticks.groupBy("root_id", "phase").agg(F.max_by("status", "ts").alias("status"))
    lines = last.groupBy("root_id").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("phase", "status"))), lambda t: F.when(t["phase"] == "CRAWL", F.concat(F.lit("crawl="), t["status"])).otherwise(F.concat(F.lit("batch("), t["phase"], F.lit(")="), t["status"])))).alias("line"))
    has = manifest.select("root_id").distinct().withColumn("there", F.lit("manifest present"))
    out = roots.join(lines, "root_id", "left").join(has, "root_id", "left")
    return out.select("root_id", F.concat_ws("; ", no_blank(F.col("line")), F.coalesce("there", F.lit("manifest absent"))).alias("message"))


def run_pipeline(manifest: DataFrame, stages: dict) -> DataFrame:
    """manifest after its pending pages went through stages {"transform": f, "chunk": f, "vector": f}, each f giving outcome rows.

    A stage sees only rows that are pending for it, those included that the stage before has just made ready.
    """
    for stage in ("transform", "chunk", "vector"):
        if stage in stages:
            manifest = apply_outcomes(manifest, stages[stage](manifest.where(is_pending(stage))), stage)
    return manifest


def error_text(error: Column, n: int = 500) -> Column:
    return truncate(error, n)
