"""Balanced sharding by label propagation under capacity quotas, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, load

_UNIT = float(1 << 63)


def _share(*cols: Column) -> Column:
    """A number in [0, 1) drawn from the columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1).cast("double") / F.lit(_UNIT)


def _accepted(requests: dict[tuple[int, int], int], load: list[int], capacity: int) -> dict[tuple[int, int], float]:
    """The share of each (from, to) request that may move so that no shard's load passes its capacity."""
    share = {k: 1.0 for k in requests}
    for _ in range(50):
        after = list(map(float, load))
        for (i, j), n in requests.items():
            after[i] -= share[i, j] * n
            after[j] += share[i, j] * n
        over = [s for s, x in enumerate(after) if x > capacity + 0.5 and any(j == s and share[i, j] for (i, j) in requests)]
        if not over:
            break
        for s in over:
            moving = sum(share[k] * n for k, n in requests.items() if k[1] == s)
            keep = max(0.0, 1 - (after[s] - capacity) / moving) if moving else 0.0
            for k in requests:
                if k[1] == s:
                    share[k] *= keep
    return share


def propagate(bundles: DataFrame, shards: int, rounds: int, capacity: int) -> DataFrame:
    """Moves of linked documents: bundles(grp, shard, n), n documents of one link group in one shard, towards each group's fullest shard.

    A round joins every bundle with the shard that holds most of its group, of those with room, and asks to move there; the larger part of
    a group in a full shard stays. The driver sees the requests by (from, to), at
    most shards * shards numbers, and grants shares within the quotas: a shard takes what it gives plus its room up to `capacity` linked
    documents (unlinked ones are left to even the counts later). Small bundles move
    whole, drawn by hash; of large ones the granted part moves, so a group that is larger than a shard settles in several.
    """
    for turn in range(rounds):
        load = [0] * shards
        for r in bundles.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # at most a row per shard
            load[r["shard"]] = r["n"]
        full = [s for s in range(shards) if load[s] >= capacity]
        best = bundles.where(~F.col("shard").isin(full)).groupBy("grp").agg(F.max(F.struct("n", F.xxhash64("grp", "shard").alias("draw"), "shard")).alias("best"))
        stays = F.col("best").isNull() | (F.col("shard").isin(full) & (F.col("best.n") < F.col("n")))
        asked = bundles.join(best, "grp", "left").withColumn("to", F.when(stays, F.col("shard")).otherwise(F.col("best.shard"))).drop("best")
        flow = asked.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # at most shards * shards rows
        requests = {(r["shard"], r["to"]): r["n"] for r in flow if r["shard"] != r["to"]}
        if not requests:
            break
        share = _accepted(requests, load, capacity)
        granted = F.element_at(F.create_map(*[x for (i, j), f in sorted(share.items()) for x in (F.lit(i * shards + j), F.lit(f))]), F.col("shard") * shards + F.col("to"))
        part = F.when(F.col("shard") == F.col("to"), F.lit(0.0)).otherwise(granted)
        whole = F.when(_share("grp", "shard", F.lit(turn)) < part, F.col("n")).otherwise(F.lit(0))
        moved = F.when(F.col("n") >= 64, F.floor(F.col("n") * part)).otherwise(whole).cast("long")
        halves = F.array(F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")), F.struct("shard", (F.col("n") - F.col("moved")).alias("n")))
        split = asked.withColumn("moved", moved).select("grp", F.explode(halves).alias("h")).select("grp", "h.shard", "h.n").where("n > 0")
        bundles = cut(split.groupBy("grp", "shard").agg(F.sum("n").alias("n")))
    return bundles


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): documents in `shards` shards whose counts differ by one at most, few equal texts apart.

    Documents with equal texts are linked. They start where their id hashes to, then labels propagate (see propagate). Last, all
    documents are put in one order (shard; within it half of the unlinked documents, the linked ones by group, the other half) and cut
    into equal parts, so that what the quotas left uneven is evened by unlinked documents first.

    Null texts count as empty, and as equal to empty ones. Rows with a null doc_id and repeated rows are placed like others. A group
    with a third of all rows is spread by the hash of doc_id over the shards that hold it, and its join is split by adaptive execution.
    An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("grp"),
    ).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    rows = cut(rows)
    parts = cut(rows.groupBy("grp", "shard").agg(F.count("*").alias("n")))
    linked = parts.join(parts.groupBy("grp").agg(F.sum("n").alias("all")).where("all > 1"), "grp").select("grp", "shard", "n")
    capacity = -(-rows.count() // shards)
    settled = cut(propagate(cut(linked), shards, rounds, capacity))
    held = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
    room = [max(0, capacity - held.get(s, 0)) for s in range(shards)]
    alone, upto = F.col("shard"), sum(room)
    for s in reversed(range(shards)):  # unlinked documents go where linked ones have left room, in proportion
        upto -= room[s]
        if room[s]:
            alone = F.lit(s) if upto + room[s] == sum(room) else F.when(_share("doc_id", F.lit(5)) < (upto + room[s]) / sum(room), F.lit(s)).otherwise(alone)
    # Per group its shards with the running share of documents up to each, at most `shards` entries.
    spans = settled.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("held"), F.sum("n").alias("all"))
    spans = cut(spans.select("grp", F.transform("held", lambda h, i: F.struct(h["shard"].alias("shard"), (F.aggregate(F.slice("held", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["n"]) / F.col("all")).alias("upto"))).alias("spans")))
    draw = _share("doc_id", F.lit(3))
    chosen = F.coalesce(F.element_at(F.filter("spans", lambda s: s["upto"] > draw), 1)["shard"], F.element_at("spans", -1)["shard"])
    where = F.when(F.col("spans").isNull(), F.when(_share("doc_id", F.lit(4)) < 0.5, 0).otherwise(2)).otherwise(1)
    placed = rows.join(spans, "grp", "left").select("doc_id", "size", "text_crc32", F.coalesce(chosen, alone).alias("near"), where.alias("zone"), "grp")
    keys = ["near", "zone", "grp", "doc_id"]
    ranked = cut(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "size", "text_crc32", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    # One row per partition of the sort.
    counts = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    total = ranked.count()
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = ranked.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", rank)
    out = out.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - first).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents; see shard_documents for nulls, repeated rows and empty tables."""
    out = shard_documents(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
