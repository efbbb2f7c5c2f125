"""Progress ticks of a stream against a loop that keeps the last written stretches."""

import random

from leafmill.streaming import jobs


def looped(ticks, every):
    last, out = {}, []
    for root, seq, processed, discovered, *rest in ticks:
        found, seen = (discovered or 0) // every, (processed or 0) // every
        d, p = last.get(root, (0, 0))
        if found > d or seen > p:
            last[root] = found, seen
            out.append((root, seq))
    return out


def test_ticks_equal_a_loop_over_batches_and_restarts(spark, tmp_path):
    rng, at, batches = random.Random(6), {r: [0, 0] for r in (1, 2, None)}, []
    for b in range(3):
        batch = []
        for seq in range(200 * b, 200 * b + 200):
            root = rng.choice([1, 1, 1, 2, None])
            at[root] = [0, 0] if rng.random() < 0.02 else [at[root][0] + rng.randint(0, 3), at[root][1] + rng.randint(0, 6)]
            batch.append((root, seq, None if at[root][0] == 0 else at[root][0], at[root][1], None if seq % 3 else f"p{seq}", "t"))
        batches.append(batch)
        spark.createDataFrame(rng.sample(batch, len(batch)), jobs.TICK).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        out = jobs.crawl_ticks(jobs.job_stream(spark, str(tmp_path / "in"), jobs.TICK), every=10)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = looped([t for b in batches for t in b], 10)
    assert sorted((r.root_id, r.seq) for r in got if r.root_id is not None) == sorted(w for w in want if w[0] is not None)
    assert sorted(r.seq for r in got if r.root_id is None) == sorted(s for r, s in want if r is None)
    by_seq = {t[1]: t for b in batches for t in b}
    assert all(r.page_id == by_seq[r.seq][4] and r.discovered == by_seq[r.seq][3] for r in got)
