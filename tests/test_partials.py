"""Mergeable states against rollups of all swaps."""

import random

from pyspark.sql import functions as F

from ledgerlake.operators import partials, rollups
from ledgerlake.operators.upsert import upsert
from ledgerlake.streaming import index

SWAPS = "id string, pool string, timestamp long, amount0 string, amount1 string, amountUSD string, block_number long, log_order long"


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def swaps_of(rng, n):
    usd = lambda: rng.choice([f"{rng.randint(0, 10**6)}.{rng.randint(0, 10**18 - 1):018d}", "-2.5", "junk", None] + (["9" * 30] if rng.random() < 0.05 else []))
    return [(f"s{k}", f"p{rng.randint(0, 3)}", 400 * (b := rng.randint(0, 999)), str(rng.randint(-(2**255), 2**255)) if rng.random() < 0.9 else "0", str(rng.randint(-999, 999)), usd(), b, rng.randint(0, 3)) for k in range(n)]


def test_states_merge_in_any_grouping(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame(swaps_of(rng, 600), SWAPS)
    pools = spark.createDataFrame([(f"p{k}", f"t{k % 2}", "t9", 3000 if k else None) for k in range(4)], "id string, token0 string, token1 string, feeTier long")
    parts = [rows.where(F.col("block_number") % 7 == k) for k in range(7)]
    for make, key in ((partials.pool_states, "pool"), (lambda x: partials.token_states(x, pools), "token")):
        states = make(parts[0])
        for p in parts[1:]:
            states = states.unionByName(make(p))
        assert rows_of(partials.merge_states(states, key, "hour")) == rows_of(partials.merge_states(make(rows), key, "hour"))
        if key == "pool":
            days = partials.merge_periods(states, "pool")
            assert rows_of(partials.pool_totals(days, pools)) == rows_of(partials.pool_totals(states, pools)) == rows_of(rollups.pool_totals(rows, pools))
            for seconds in (rollups.DAY, rollups.HOUR):
                assert rows_of(partials.pool_period(states, pools, seconds)) == rows_of(rollups.pool_period(rows, pools, seconds))
        else:
            assert rows_of(partials.token_period(states)) == rows_of(rollups.token_period(rows, pools))


def test_increments_and_a_replay_read_their_own_spans(spark, tmp_path):
    """Random increments, one of them again: states equal those of all swaps, and other spans keep their files."""
    rng = random.Random(8)
    swaps, path, states = swaps_of(rng, 120), str(tmp_path / "swaps"), str(tmp_path / "states")
    rng.shuffle(swaps)
    increments = [swaps[k : k + 12] for k in range(0, 120, 12)]
    increments.append(increments[2])
    for part in increments:
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "states").rglob("*.parquet")}
        index.merge_batch(spark.createDataFrame(part, SWAPS), path, derived={states: partials.pool_states}, span=50)
        after = {p: p.stat().st_mtime_ns for p in (tmp_path / "states").rglob("*.parquet")}
        touched = {f"bucket={r[6] // 50}" for r in part}
        assert {p.parent.name for p in set(before.items()) ^ set(after.items()) for p in [p[0]]} == touched
    pools = spark.createDataFrame([(f"p{k}", 3000) for k in range(4)], "id string, feeTier long")
    kept, every = index.read_table(spark, states), upsert(None, spark.createDataFrame(swaps, SWAPS))
    assert kept.count() > 60
    assert rows_of(partials.pool_totals(kept, pools)) == rows_of(rollups.pool_totals(every, pools))
    assert rows_of(partials.pool_period(kept, pools)) == rows_of(rollups.pool_period(every, pools))


def test_provider_sketches(spark):
    """Exact while small, within five standard errors beyond, and the same in any grouping."""
    mints = spark.range(60_000).select((F.col("id") % 2).cast("string").alias("pool"), (F.col("id") * 997 % (86_400 * 9)).alias("timestamp"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("o"), (F.col("id") % 40_000).cast("string"))).alias("owner"), F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("sender"))
    exact = {r["pool"]: r["n"] for r in mints.groupBy("pool").agg(F.count_distinct(F.coalesce("owner", "sender")).alias("n")).collect()}
    days = rollups.provider_sketches(mints)
    assert days.count() == 18
    for merged in (rollups.merge_providers(days, "pool"), rollups.merge_providers(rollups.merge_providers(days.withColumn("week", F.col("date") > 86_400 * 4), "pool", "week"), "pool")):
        for r in merged.collect():
            assert abs(r["providers"] / exact[r["pool"]] - 1) < 5 / 64
    few = rollups.merge_providers(rollups.provider_sketches(mints.where("id < 900")), "pool")
    counts = {r["pool"]: r["n"] for r in mints.where("id < 900").groupBy("pool").agg(F.count_distinct(F.coalesce("owner", "sender")).alias("n")).collect()}
    assert {r["pool"]: r["providers"] for r in few.collect()} == counts
    pair = few.groupBy().pivot("pool", ["0", "1"]).agg(F.first("sketch")).select(rollups.shared_providers("`0`", "`1`").alias("n")).first()["n"]
    own = [{r[0] for r in mints.where(f"id < 900 AND pool = '{p}'").select(F.coalesce("owner", "sender")).distinct().collect()} for p in "01"]
    assert pair == len(own[0] & own[1])


def test_batches_upserted_at_once(spark):
    from ledgerlake.operators.upsert import upsert_all

    rng = random.Random(9)
    parts = [spark.createDataFrame(swaps_of(rng, 60), SWAPS) for _ in range(3)]
    one_by_one = upsert(upsert(upsert(None, parts[0]), parts[1]), parts[2])
    assert rows_of(upsert_all(parts[0], [parts[2], parts[1], parts[1]])) == rows_of(one_by_one)
    assert upsert_all(None, parts)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_days_by_two_stateful_operators(spark, tmp_path):
    """Closed days of pools, tokens and the factory equal the batch's, late swaps within the watermark included."""
    rng = random.Random(10)
    rows = [(f"s{k}", f"p{rng.randint(0, 2)}", t := rng.randint(0, 3 * 86_400 - 1), str(rng.randint(1, 99)), str(rng.randint(-99, 99)), f"{rng.randint(0, 99)}.5", t // 10, k) for k in range(300)]
    rows.sort(key=lambda r: r[2] + rng.randint(0, 3 * 3600))  # up to three hours late
    for k, part in enumerate((rows[:100], rows[100:200], rows[200:], [("end", "p0", 9 * 86_400, "1", "1", "1", 10**6, 0)])):
        spark.createDataFrame(part, SWAPS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    pools = spark.createDataFrame([(f"p{k}", f"t{k % 2}", "t9", 3000) for k in range(3)], "id string, token0 string, token1 string, feeTier long")
    every = spark.createDataFrame(rows, SWAPS)
    pool_days = rollups.pool_period(every, pools)
    want = {"pool": pool_days, "token": rollups.token_period(every, pools), "factory": rollups.factory_period(pool_days)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for kind, batch in want.items():
            stream = index.watermarked(spark.readStream.schema(SWAPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")), "4 hours")
            query = index.day_stream(stream, pools, kind).writeStream.format("memory").queryName(f"days_{kind}").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None and rows_of(spark.table(f"days_{kind}")) == rows_of(batch), kind
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
