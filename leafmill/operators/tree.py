"""The page tree: descendants and crawl order by pointer doubling, in rounds that grow with the logarithm of the depth."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.common import cut, kept


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`, the sum of value over the rows before each row in order over all rows.

    Rows are sorted in ranges, each range is summed by a task of its own, and the sums of the ranges before are added, of which the driver
    sees one number a range. order should be distinct, so that one hot value can be divided between ranges.
    """
    ranged = kept(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    start, before = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("_part").agg(F.sum("_value")).collect())):
        before.append((part, start))
        start += n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _start long"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, "_part").withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(w), F.lit(0))).drop("_value", "_part", "_start")


def _doubled(state: DataFrame, root: int, amount: str) -> DataFrame:
    """One round for state(page_id, above, amount): pages that aren't at the root yet go on to where their `above` is, amounts added.

    Pages whose way ends elsewhere than in the root drop out.
    """
    far = state.select(F.col("page_id").alias("above"), F.col("above").alias("to"), F.col(amount).alias("more"))
    on = state.where(F.col("above") != root).join(far, "above").select("page_id", F.col("to").alias("above"), (F.col(amount) + F.col("more")).alias(amount))
    return kept(state.where(F.col("above") == root).unionByName(on))


def _ancestry(inner: DataFrame, root: int) -> list[DataFrame]:
    """(page_id, above, depth) after 0, 1, 2, ... rounds: above is the page 2^rounds up, or the root, depth pages away.

    Ends when all pages are at the root, or when 2^rounds is the number of pages: those left then go round in a cycle.
    """
    rounds = [kept(inner.select("page_id", F.col("parent_id").alias("above"), F.lit(1).cast("long").alias("depth")))]
    pages = rounds[0].count()
    while 1 << (len(rounds) - 1) < pages and not rounds[-1].where(F.col("above") != root).isEmpty():
        rounds.append(_doubled(rounds[-1], root, "depth"))
    return rounds


def _preorder(inner: DataFrame, rounds: list[DataFrame], root: int) -> DataFrame:
    """(page_id, pre): the places of pages in preorder among inner(page_id, parent_id, position), which lie below root; the root has 0."""
    size = inner.select("page_id", F.lit(1).cast("long").alias("size"))
    for k, state in enumerate(rounds[:-1]):  # pages less than 2^k below are in; now those of the pages 2^k below
        below = state.where((F.col("depth") == 1 << k) & (F.col("above") != root)).join(size, "page_id").groupBy(F.col("above").alias("page_id")).agg(F.sum("size").alias("more"))
        size = kept(size.join(below, "page_id", "left").select("page_id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    # A page's place: its parent's, one, and the sizes of the pages before it under its parent.
    left = running_total(inner.join(size, "page_id"), ["parent_id", "position", "page_id"], F.col("size"), "total")
    first = left.groupBy("parent_id").agg(F.min("total").alias("first"))
    state = kept(left.join(first, "parent_id").select("page_id", F.col("parent_id").alias("above"), (F.col("total") - F.col("first") + 1).alias("pre")))
    for _ in rounds[1:]:
        state = _doubled(state, root, "pre")
    return state.select("page_id", "pre")


def _walk(edges: DataFrame, root: int) -> DataFrame:
    """(page_id, parent_id, parent_path, position, depth) of each way down from root that meets no page twice, a job a level."""
    e = cut(edges.select("parent_id", "child_id", "position"))
    at = F.lit(root).cast("long")
    level = e.where(F.col("parent_id") == at).select(F.col("child_id").alias("page_id"), "parent_id", F.array().cast("array<int>").alias("parent_path"), "position", F.lit(1).cast("long").alias("depth"), F.array(at, "child_id").alias("seen"))
    below = None
    for depth in count(2):
        level = cut(level)
        below = level if below is None else below.unionAll(level)
        if level.isEmpty():
            return below.drop("seen")
        if depth % 32 == 0:  # few parts, so that the plan stays small
            below = cut(below)
        up = level.select(F.col("page_id").alias("parent_id"), F.col("parent_path").alias("path"), F.col("position").alias("place"), "seen")
        new = up.join(e, "parent_id").where(~F.array_contains("seen", F.col("child_id")))
        level = new.select(F.col("child_id").alias("page_id"), "parent_id", F.concat("path", F.array(F.col("place").cast("int"))).alias("parent_path"), "position", F.lit(depth).cast("long").alias("depth"), F.concat("seen", F.array("child_id")).alias("seen"))


def _tree(edges: DataFrame, root: int) -> tuple[DataFrame, DataFrame, list[DataFrame]] | None:
    """(edges below root with depth, those between pages that have children, their ancestry); None if a page has two parents or more."""
    e = edges.where((F.col("child_id") != root) & F.col("parent_id").isNotNull())
    one = kept(e.groupBy(F.col("child_id").alias("page_id")).agg(F.first("parent_id").alias("parent_id"), F.first("position").alias("position"), F.count("*").alias("ways")))
    if not one.where("ways > 1").isEmpty():
        return None
    one = one.drop("ways")
    inner = kept(one.join(one.select(F.col("parent_id").alias("page_id")).distinct(), "page_id", "left_semi"))
    rounds = _ancestry(inner, root)
    found = rounds[-1].where(F.col("above") == root).select("page_id", "depth")
    level = found.select(F.col("page_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"))
    first = edges.sparkSession.sql(f"select cast({root} as bigint) as parent_id, cast(1 as bigint) as depth")
    return one.join(level.unionByName(first), "parent_id").select("page_id", "parent_id", "position", "depth"), inner.join(found.select("page_id"), "page_id"), rounds


def descendants(edges: DataFrame, root: int) -> DataFrame:
    """(page_id, parent_id, position, depth) of all pages below root; edges(parent_id, child_id, position).

    Where each page has one parent, the number of jobs grows with the logarithm of the depth and rows hold no paths; only pages that have
    children take part in the rounds. A page with several parents appears once for each way to it and is walked to a level a job. A page
    that is its own ancestor is not followed again; edges with a null end are left out.
    """
    tree = _tree(edges, root)
    return _walk(edges, root).drop("parent_path") if tree is None else tree[0]


def crawl_order(edges: DataFrame, root: int) -> DataFrame:
    """(page_id, crawl_order, depth): the root is 0; a page's children come together, the leftmost page's own children first.

    Children at equal positions come by page_id.
    """
    tree = _tree(edges, root)
    if tree is None:
        rows, order = _walk(edges, root), ["parent_path", "position", "page_id"]
    else:
        below, inner, rounds = tree
        pre = _preorder(inner, rounds, root).select(F.col("page_id").alias("parent_id"), "pre")
        rows, order = below.join(pre, "parent_id", "left").withColumn("pre", F.coalesce("pre", F.lit(0))), ["pre", "position", "page_id"]
    numbered = running_total(rows.select("page_id", "depth", *order[:2]), order, F.lit(1), "n").select("page_id", (F.col("n") + 1).alias("crawl_order"), "depth")
    first = edges.sparkSession.sql(f"select cast({root} as bigint) as page_id, cast(0 as bigint) as crawl_order, cast(0 as bigint) as depth")
    return first.unionByName(numbered)


def crawl_rows(edges: DataFrame, root: int) -> DataFrame:
    """crawl_order with a page that is reached twice once, at its first place."""
    return crawl_order(edges, root).groupBy("page_id").agg(F.min("crawl_order").alias("crawl_order"), F.min_by("depth", "crawl_order").alias("depth"))
