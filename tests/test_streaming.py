"""Streams give what batches give."""

import json

from ledgerlake import schemas
from ledgerlake import topics as t
from ledgerlake.decode import amm, defi, securities
from ledgerlake.operators import rollups, snapshots
from ledgerlake.operators.upsert import upsert
from ledgerlake.sources import logs as lg
from ledgerlake.streaming import index


def write_logs(folder, name, rows):
    folder.mkdir(exist_ok=True)
    keys = [f.name for f in schemas.RAW_LOG.fields]
    (folder / name).write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in rows))


def word(x):
    return f"{x:064x}"


def log(topics, words, block, tx, i=0, address="0xpool"):
    return (address, topics, "0x" + "".join(map(word, words)), hex(block), tx, hex(i), "0x0")


def swap(tx, i, block, amount):
    return log([t.SWAP_V2, "0x" + "0" * 64], [amount, 0, 0, 0], block, tx, i)


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def run(spark, source, tables, out, checkpoint):
    query = index.index_stream(lg.stream_logs(spark, str(source)), tables, str(out), str(checkpoint), buckets=4)
    query.awaitTermination(120)
    assert query.exception() is None


def batch_logs(spark, source):
    return lg.normalise(lg.read_logs(spark, str(source)))


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    write_logs(source, "a.json", [swap("0xa", 1, 5, 10), swap("0xb", 2, 6, 20)])
    run(spark, source, {"swaps": amm.swaps_v2}, out, tmp_path / "cp")
    write_logs(source, "b.json", [swap("0xa", 1, 5, 10), swap("0xa", 1, 7, 11), swap("0xc", 16, 8, 30)])
    run(spark, source, {"swaps": amm.swaps_v2}, out, tmp_path / "cp")
    run(spark, source, {"swaps": amm.swaps_v2}, out, tmp_path / "cp")  # nothing new
    streamed = index.read_table(spark, f"{out}/swaps")
    batch = upsert(None, amm.swaps_v2(lg.known_events(batch_logs(spark, source))))
    assert rows_of(streamed) == rows_of(batch)
    assert sorted((r["id"], r["amount0"], r["timestamp"]) for r in streamed.collect()) == [("0xa#0x1", "11", 7), ("0xb#0x2", "20", 6), ("0xc#0x10", "30", 8)]
    index.merge_batch(amm.swaps_v2(batch_logs(spark, source).where("block_number = 5")), f"{out}/swaps", buckets=4)  # an old batch again
    assert rows_of(index.read_table(spark, f"{out}/swaps")) == rows_of(batch)


def test_a_new_checkpoint_goes_on_with_the_table(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    for k in range(3):
        write_logs(source, f"{k}.json", [swap(f"0x{k}", 1, 5 + k, 10)])
        run(spark, source, {"swaps": amm.swaps_v2}, out, tmp_path / "cp")
    write_logs(source, "new.json", [swap("0xd", 1, 50, 7)])
    run(spark, source, {"swaps": amm.swaps_v2}, out, tmp_path / "another")
    assert index.read_table(spark, f"{out}/swaps").count() == 4


def test_a_governance_stream(spark, tmp_path):
    """Signatures that the exchange indexer does not ask for reach their decoders."""
    source, out = tmp_path / "in", tmp_path / "out"
    who = "0x" + word(11)
    write_logs(source, "a.json", [log([t.VOTE_CAST, who], [7, 1, 2**130], 5, "0xa"), log([t.STAKED, who], [4, 1, 9], 6, "0xb"), log([t.FEES_RECEIVED, who, who], [1, 2, 3], 7, "0xc"), log(["0x" + "12" * 32], [1], 8, "0xd")])
    by_log = ("contract", "tx_hash", "log_index")
    run(spark, source, {"votes": index.Table(defi.votes, by_log), "stakes": index.Table(defi.stakes, by_log), "liquid": index.Table(defi.liquid, by_log)}, out, tmp_path / "cp")
    assert [r["weight"] for r in index.read_table(spark, f"{out}/votes").collect()] == [str(2**130)]
    assert index.read_table(spark, f"{out}/stakes").count() == index.read_table(spark, f"{out}/liquid").count() == 1


def test_events_by_spans_of_blocks(spark, tmp_path):
    """A batch of late blocks leaves earlier spans as they are; the same logs again change nothing."""
    source, out = tmp_path / "in", tmp_path / "out"
    tables = {"swaps": index.Table(amm.swaps_v2, span=100)}
    write_logs(source, "a.json", [swap(f"0x{k}", 1, 40 * k, k) for k in range(6)])
    run(spark, source, tables, out, tmp_path / "cp")
    before = {p: p.stat().st_mtime_ns for p in (out / "swaps").rglob("*.parquet")}
    write_logs(source, "b.json", [swap("0x5", 1, 200, 5), swap("0x9", 1, 260, 9)])
    run(spark, source, tables, out, tmp_path / "cp")
    after = {p: p.stat().st_mtime_ns for p in (out / "swaps").rglob("*.parquet")}
    assert {p.parent.name for p in set(before) - set(after)} == {"bucket=2"}
    assert rows_of(index.read_table(spark, f"{out}/swaps")) == rows_of(upsert(None, amm.swaps_v2(batch_logs(spark, source))))


def test_streamed_snapshots_equal_those_of_the_batch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    users = ["0x" + word(k) for k in range(5)]

    def freeze(k, block):
        signature, words = ((t.TOKENS_FROZEN, [100 + k]), (t.TOKENS_UNFROZEN, [k]), (t.ADDRESS_FROZEN, []))[k % 3]
        more = ["0x" + word(k % 2), users[0]] if signature == t.ADDRESS_FROZEN else []
        return log([signature, users[k % 5], *more], words, block, f"0x{k:x}", address=f"0xt{k % 2}")

    by_user = ("token", "user")
    derived = {"accounts": snapshots.frozen_accounts, "tokens": snapshots.frozen_tokens, "totals": snapshots.frozen_totals}
    tables = {"actions": index.Table(securities.transfer_agent_actions, by=by_user, derived=derived)}
    for n, part in enumerate(([*range(20, 40)], [*range(0, 12)], [*range(10, 25)])):  # late and repeated logs too
        write_logs(source, f"{n}.json", [freeze(k, k) for k in part])
        run(spark, source, tables, out, tmp_path / "cp")
    actions = upsert(None, securities.transfer_agent_actions(batch_logs(spark, source)))
    assert rows_of(index.read_table(spark, f"{out}/actions")) == rows_of(actions)
    for name, make in derived.items():
        assert rows_of(index.read_table(spark, f"{out}/{name}")) == rows_of(make(actions)), name


def test_a_batch_touches_its_partitions_only_and_a_cut_one_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"k{n}", n, 1, 0) for n in range(40)], "id string, v long, block_number long, log_order long")
    index.merge_batch(rows, path, buckets=8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    index.merge_batch(rows.where("id = 'k3'").selectExpr("id", "99L AS v", "2L AS block_number", "log_order"), path, buckets=8)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert len({p.parent.name for p in set(before) - set(after)}) == 1
    assert index.read_table(spark, path).where("id = 'k3'").first()["v"] == 99 and index.read_table(spark, path).count() == 40
    # a batch that was complete in its folder when the driver went
    index.read_table(spark, path).where("id = 'k5'").selectExpr("id", "7L AS v", "3L AS block_number", "log_order").withColumn("bucket", index._bucket(("id",), 8)).write.partitionBy("bucket").parquet(f"{path}/_pending")
    index.merge_batch(rows.where("id = 'k6'"), path, buckets=8)
    assert index.read_table(spark, path).where("id = 'k5'").first()["v"] == 7


def test_hourly_rollup_and_replays(spark, tmp_path):
    rows = [("a", "p", 3600, "1.5", "2", "4", 1, 0), ("b", "p", 3700, "2", "1", "5", 2, 0), ("c", "p", 7300, "4", "1", "6", 3, 0), ("a", "p", 3600, "1.5", "2", "4", 1, 0), ("e", "p", 90_000, "1", "1", "1", 9, 0)]
    schema = "id string, pool string, timestamp long, amountUSD string, amount0 string, amount1 string, block_number long, log_order long"
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    pools = spark.createDataFrame([("p", 3000)], "id string, feeTier long")
    stream = lambda: index.watermarked(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")))
    fields = ("periodStartUnix", "txCount", "open", "high", "low", "close")

    def out(name, rolled, mode):
        query = rolled.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        return spark.table(name).collect()

    once = out("once", index.rollup_stream(index.drop_replays(stream()), pools), "append")
    assert sorted(tuple(r[f] for f in fields) for r in once) == [(3600, 2, 2.0, 5.0, 2.0, 5.0), (7200, 1, 6.0, 6.0, 6.0, 6.0)]  # the last window is still open
    assert {str(r["volumeUSD"]) for r in once} == {"3.500000000000000000", "4.000000000000000000"} and {float(r["feesUSD"]) for r in once} == {0.0105, 0.012}
    every = out("every", index.rollup_stream(stream(), pools), "complete")
    batch = rollups.pool_period(spark.createDataFrame(rows, schema), pools, rollups.HOUR, "periodStartUnix")
    names = sorted(batch.columns)
    assert sorted(tuple(r[n] for n in names) for r in every) == sorted(tuple(r[n] for n in names) for r in batch.collect())
