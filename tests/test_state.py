"""Keyed state and joined streams against the batch, for any split of the logs into files."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import enrich, snapshots
from ledgerlake.streaming import state

ACTIONS = "id string, kind string, token string, user string, isFrozen boolean, amount string, block_number long, log_order long"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    state.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers by processing time would ask for batches for ever
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def actions_of(rng, blocks):
    """Wide amounts, several logs a block, ties of block and log order with different ids."""
    out = []
    for b in blocks:
        for n in range(rng.randint(1, 3)):
            token, user, kind = f"t{rng.randint(0, 1)}", rng.choice(["u0", "u1", None]), rng.choice(["AddressFrozen", "TokensFrozen", "TokensUnfrozen", "Paused"])
            out.append((f"{b}:{n}", kind, token, user, rng.random() < 0.5 if kind == "AddressFrozen" else None, str(rng.randint(0, 2**250)) if kind.startswith("Tokens") else None, b, n // 2))
    return out


def run(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def write(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_state_equals_the_batch_for_any_split(spark, tmp_path, rocksdb):
    rng = random.Random(5)
    old, new = actions_of(rng, range(1, 15)), actions_of(rng, range(15, 45))
    dealt = new + rng.sample(new, 20)  # repeated logs too
    rng.shuffle(dealt)
    for k in range(3):
        write(spark, dealt[k::3], ACTIONS, f"{tmp_path}/in", k)
    start = state.snapshot_state(spark.createDataFrame(old, ACTIONS))
    for _ in range(2):  # the second run has nothing new
        run(state.freeze_changes(source(spark, f"{tmp_path}/in", ACTIONS), start), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = state.current_freezes(spark.read.parquet(f"{tmp_path}/out"))
    every = spark.createDataFrame(old + new, ACTIONS)
    touched = {(r[2], r[3]) for r in new}
    for name, want in (("accounts", snapshots.frozen_accounts(every)), ("tokens", snapshots.frozen_tokens(every))):
        assert rows_of(got[name]) == rows_of(want.where(F.concat_ws(":", "token", "user").isin(*[":".join(x for x in k if x) for k in touched])).where("updated >= 15")), name
    assert rows_of(got["totals"]) == rows_of(snapshots.frozen_totals(every).where("block_number >= 15"))


def test_old_logs_are_folded_and_idle_keys_end(spark, tmp_path, rocksdb):
    rows = [(f"{b}", "TokensFrozen", "t", "u", None, "10", b, 0) for b in range(1, 9)]
    other = [("x", "TokensFrozen", "t", "v", None, "1", 1, 0)]
    stream = lambda: state.freeze_changes(source(spark, f"{tmp_path}/in", ACTIONS), horizon=3, idle=1)
    for k, part in enumerate((rows[:4], rows[4:] + rows[3:5], other, rows[6:] + [("new", "TokensUnfrozen", "t", "u", None, "5", 9, 0)])):
        write(spark, part, ACTIONS, f"{tmp_path}/in", k)
        run(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    changes = spark.read.parquet(f"{tmp_path}/out")
    totals = {r["id"]: r["total"] for r in state.current_freezes(changes)["totals"].collect()}
    assert totals == {str(b): str(10 * b) for b in range(1, 9)} | {"x": "1", "new": "75"}
    assert {(r["user"], r["total"]) for r in changes.where("change = 'idle'").collect()} == {("u", "80"), ("v", "1")}
    assert sorted(r["id"] for r in changes.where("change = 'closed'").collect()) == ["7", "8"]  # repeated after their key was folded
    left = spark.read.format("statestore").option("stateVarName", "open").option("batchId", 2).load(f"{tmp_path}/cp")
    assert {r["key"]["user"] for r in left.select("key").distinct().collect()} <= {"v"}


def test_pools_announced_by_the_stream(spark, tmp_path, rocksdb):
    rng = random.Random(6)
    pools = [(f"p{k}", 3 * k) for k in range(20)] + [("p3", 30)]
    logs = [(f"p{rng.randint(0, 25)}", b, n) for b in range(70) for n in range(4)]
    kinds = ("address string, block_number long, log_order long", "id string, created_block long")
    want = rows_of(enrich.from_announced_pools(spark.createDataFrame(logs, kinds[0]), spark.createDataFrame(pools, kinds[1])))
    for trial, (split, known) in enumerate(((3, 0), (2, 8))):
        folder = f"{tmp_path}/{trial}"
        shuffled = rng.sample(logs, len(logs))
        for k in range(split):
            write(spark, shuffled[k::split], kinds[0], f"{folder}/logs", k)
            write(spark, pools[known:][k::split][::-1] or [("none", 0)], kinds[1], f"{folder}/pools", k)
        table = spark.createDataFrame(pools[:known], kinds[1]) if known else None
        joined = state.announced_stream(source(spark, f"{folder}/logs", kinds[0]), source(spark, f"{folder}/pools", kinds[1]), late=100, span=100, known=table)
        run(joined, f"{folder}/out", f"{folder}/cp")
        assert rows_of(spark.read.parquet(f"{folder}/out")) == want
    # the watermark ends the state: rows of blocks far below the newest are gone from the store
    for k, b in enumerate((1, 2000, 4000)):
        write(spark, [(f"p{k}", b, 0)], kinds[0], f"{tmp_path}/w/logs", k)
        write(spark, [(f"p{k}", b)], kinds[1], f"{tmp_path}/w/pools", k)
        run(state.announced_stream(source(spark, f"{tmp_path}/w/logs", kinds[0]), source(spark, f"{tmp_path}/w/pools", kinds[1]), late=10, span=50), f"{tmp_path}/w/out", f"{tmp_path}/w/cp")
    assert spark.read.parquet(f"{tmp_path}/w/out").count() == 3
    kept = spark.read.format("statestore").option("joinSide", "right").load(f"{tmp_path}/w/cp")
    assert {r["value"]["p_id"] for r in kept.select("value").collect()} <= {"p1", "p2"}
