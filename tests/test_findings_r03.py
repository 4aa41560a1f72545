"""Small cases of the third round's findings."""

from pyspark.sql import functions as F

from ledgerlake import topics as t
from ledgerlake.decode import amm
from ledgerlake.operators import partials, rollups
from ledgerlake.plans import streams
from ledgerlake.plans.registry import QUERIES
from ledgerlake.sources import synth
from ledgerlake.sources.bucketed import buckets_for
from ledgerlake.sources.logs import normalise
from ledgerlake.streaming import index

SWAPS = "id string, pool string, timestamp long, amount0 string, amount1 string, amountUSD string, block_number long, log_order long"


def test_an_hour_in_two_spans_counts_once_when_one_of_them_comes_again(spark, tmp_path):
    path = str(tmp_path)
    both = spark.createDataFrame([("a", "p", 60, "1", "2", "3", 5, 0), ("b", "p", 120, "1", "2", "3", 15, 0)], SWAPS)
    for part in (both, both.where("block_number = 15")):
        index.merge_batch(part, f"{path}/swaps", derived={f"{path}/states": lambda rows: partials.pool_states(rows, 10)}, span=10)
    merged = partials.merge_states(index.read_table(spark, f"{path}/states"), "pool", "hour").first()
    assert (merged["txCount"], merged["volumeUSD"]) == (2, 6)


def test_increments_are_decoded_once(spark, sf_dir, monkeypatch):
    """What is merged reads files, not the logs' encoding and upsert again."""
    plans, merge = [], index.merge_batch
    monkeypatch.setattr(index, "merge_batch", lambda part, *a, **k: (plans.append(part._jdf.queryExecution().optimizedPlan().toString()), merge(part, *a, **k)))
    streams._stored_states(spark, sf_dir, partials.pool_states, "test")
    assert len(plans) == 4 and not any("Aggregate" in p or "Join" in p for p in plans)


def test_buckets_grow_with_the_rows(spark):
    assert [buckets_for(spark.range(n), 100) for n in (0, 800, 801, 5_000)] == [8, 8, 9, 50]


def test_streams_keep_state_on_disk(spark, tmp_path):
    """The store that a stream was started with stands in its checkpoint."""
    folder, before = str(tmp_path), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = streams.as_stream(spark.range(20).select((F.col("id") % 4).alias("k")), f"{folder}/in").dropDuplicates(["k"])
    assert streams.run_to_the_end(stream, folder).count() == 4
    assert "RocksDB" in "".join(p.read_text() for p in (tmp_path / "checkpoint" / "offsets").iterdir() if not p.name.startswith("."))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_tables_are_read_with_code_that_the_jvm_compiles(spark, sf_dir):
    synth.table(spark, sf_dir, "lineitem")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8_000


def test_copies_of_a_row_do_not_grow_with_the_table():
    """Rows of one size: every block meets every block, so a row is copied once for each."""
    from ledgerlake.llm.simhash import rows_of_block

    assert [-(-n // rows_of_block(n)) for n in (32_000, 160_000, 1_600_000)] == [8, 8, 8]


def test_words_are_neither_padded_nor_searched_digit_by_digit(spark, sf_dir):
    """Encoding and decoding a log as queries do: no pattern, no padding and no lower case of whole data."""
    plan = amm.swaps_v4(synth.swap_v4_logs(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f in plan.lower() for f in ("lpad(substring", "lpad(lower(hex", "rlike", "regexp_replace"))


def test_digits_of_words_are_taken_for_wide_differences_only(spark):
    topics = [t.SWAP_V2, "0x" + "0" * 64]
    data = [[2**255, 5, 2**200 + 3, 2**130], [7, 2**123, 9, 2**123 - 1], [0, 2**256 - 1, 2**124, 0], [3, 0, 3, 2**60]]
    rows = [("0xa", topics, "0x" + "".join(f"{x:064X}" for x in words), "0x1", "0xt", hex(k), "0x0") for k, words in enumerate(data)]
    raw = spark.createDataFrame(rows, "address string, topics array<string>, data string, blockNumber string, transactionHash string, logIndex string, transactionIndex string")
    swaps = amm.swaps_v2(normalise(raw))
    assert [(r["amount0"], r["amount1"]) for r in swaps.orderBy("log_order").collect()] == [(str(a - c), str(b - d)) for a, b, c, d in data]
    assert "_wide" in swaps._jdf.queryExecution().optimizedPlan().toString()


def test_rollups_carry_what_they_read(spark, sf_dir):
    """Senders decide no tie between the columns that a rollup reads, so they need not travel."""
    plan = QUERIES["pair_days"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sender" not in plan


def test_liquidity_of_a_position_is_summed_once(spark):
    mints = spark.createDataFrame([("p", 0, 60, "5"), ("p", 0, 60, str(2**200)), ("p", 60, 120, "7"), ("p", 60, 60, "2"), ("q", 0, 60, None)], "pool string, tickLower long, tickUpper long, amount string")
    burns = spark.createDataFrame([("p", 0, 60, "1")], mints.schema)
    ticks = rollups.tick_liquidity(mints, burns)
    got = {(r["pool"], r["tick"]): (int(r["liquidityGross"]), int(r["liquidityNet"])) for r in ticks.collect()}
    a = 5 + 2**200
    assert got == {("p", 0): (a + 1, a - 1), ("p", 60): (a + 1 + 7 + 4, 7 - a + 1), ("p", 120): (7, -7), ("q", 0): (0, 0), ("q", 60): (0, 0)}
    assert ticks._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
