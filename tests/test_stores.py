"""Stored logs: twelve tables by one pass, and folders that an address or a range of blocks leaves unread."""

from pyspark.sql import functions as F

from ledgerlake import topics as t
from ledgerlake.decode import defi
from ledgerlake.operators import enrich, entities
from ledgerlake.operators.upsert import as_documents, read_entities, upsert, upsert_stored_entities
from ledgerlake.plans.events import _ONE_OF_EACH
from ledgerlake.sources import bucketed, synth
from ledgerlake.sources import logs as lg


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def files_read(df):
    """Files that the plan's scans have read."""
    df.count()
    plan = df.groupBy().count()._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            found += node.metrics().apply("numFiles").value()
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        todo += inner + [children.apply(k) for k in range(children.size())]
    return found


def test_twelve_tables_by_one_pass(spark, sf_dir, tmp_path):
    every = [s for name in defi.TABLES for s in defi.TABLES[name].layout()[0]]
    logs = synth.order_logs(spark, sf_dir, *every, t.TRANSFER).union(synth.vote_logs(spark, sf_dir).withColumn("data", F.lit("0x12"))).union(synth.order_logs(spark, sf_dir, *_ONE_OF_EACH.values()).withColumn("topics", F.slice("topics", 1, 2)))
    stored = str(tmp_path / "logs")
    logs.write.parquet(stored)
    logs = spark.read.parquet(stored)
    plan = defi.parse_once(logs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    defi.write_parsed(logs, str(tmp_path / "parsed"))
    for name, rows in defi.parse_all(logs).items():
        got = defi.read_parsed(spark, str(tmp_path / "parsed"), name)
        assert got.schema.names == rows.schema.names and rows_of(got) == rows_of(rows) and rows.count() > 0, name
    assert {p.name for p in (tmp_path / "parsed").glob("table=*")} == {f"table={n}" for n in defi.TABLES}
    assert files_read(defi.read_parsed(spark, str(tmp_path / "parsed"), "StakeEvent")) == len(list((tmp_path / "parsed" / "table=StakeEvent").glob("*.parquet")))
    defi.write_parsed(logs.limit(0), str(tmp_path / "none"))


def test_an_address_leaves_most_files_unread(spark, tmp_path):
    rows = spark.range(40_000).select(
        synth.addr(F.col("id") % 300).alias("address"), F.array(F.lit(t.SWAP_V2), F.lit("0x0")).alias("topics"), F.lit("0x").alias("data"), ((F.col("id") * 7919) % 2_000_000).alias("block_number"),
        F.col("id").cast("string").alias("tx_hash"), F.lit("0x0").alias("log_index"), F.lit(0).cast("long").alias("tx_index"), F.when(F.col("id") % 3 == 0, t.SYNC).otherwise(t.SWAP_V2).alias("topic0"), F.col("id").alias("log_order"),
    )
    sorted_at, plain_at = str(tmp_path / "zones"), str(tmp_path / "plain")
    lg.write_logs_by_address(rows, sorted_at)
    lg.write_logs(rows, plain_at, blocks_per_folder=lg.BLOCKS_PER_ZONE)
    one = synth.addr(F.lit(77))
    rules = spark.range(1).select(F.lit("s").alias("source"), F.lit("h").alias("handler"), F.lit(t.SWAP_V2).alias("topic0"), one.alias("address"), F.lit(1000).cast("long").alias("start_block"))
    routed, plain = enrich.route_stored(spark, sorted_at, rules), enrich.route(lg.read_stored(spark, plain_at).drop("block_bucket"), rules)
    assert rows_of(routed) == rows_of(plain) and routed.count() > 50
    assert files_read(routed) < 0.1 * files_read(lg.read_by_address(spark, sorted_at))
    every = lg.read_by_address(spark, sorted_at)
    assert rows_of(every) == rows_of(rows)
    part = lg.read_by_address(spark, sorted_at, [t.SYNC], None, 300_000, 399_999)
    assert rows_of(part) == rows_of(rows.where((F.col("topic0") == t.SYNC) & F.col("block_number").between(300_000, 399_999)))
    assert files_read(part) < 0.06 * files_read(every)
    both = rules.union(rules.withColumn("address", F.lit(None).cast("string")).withColumn("topic0", F.lit(t.SYNC)).withColumn("handler", F.lit("any")))
    assert rows_of(enrich.route_stored(spark, sorted_at, both)) == rows_of(enrich.route(rows, both))
    assert enrich.route_stored(spark, sorted_at, rules.limit(0)).count() == 0


def test_documents_of_unknown_fields(spark, tmp_path):
    path = str(tmp_path / "d")
    kind = "entity_type string, id string, data string, block_number long, log_order long"
    docs = lambda *r: as_documents(spark.createDataFrame(list(r), kind))
    upsert_stored_entities(docs(("A", "1", '{"n": 10, "o": {"k": "x"}}', 1, 0), ("A", "2", '{"n": "9", "o": {"k": "y"}}', 1, 0), ("A", "3", '{"o": 5}', 1, 0), ("A", "4", "junk", 1, 0), ("B", "1", '{"z": [1]}', 1, 0)), path)
    upsert_stored_entities(docs(("A", "2", '{"n": 90.5, "o": {"k": "y"}}', 2, 0), ("A", "5", '{"n": "text"}', 2, 0)), path)
    stored = read_entities(spark, path, "variant")
    ids = lambda **k: [r["id"] for r in entities.list_documents(stored, "A", **k).collect()]
    assert ids(order="n", direction="DESC") == ["2", "1", "5", "3", "4"] and ids() == ["1", "2", "3", "4", "5"] and ids(first=2) == ["1", "2"]
    assert ids(conditions={"n_gt": 9}) == ["1", "2", "5"] and ids(conditions={"o.k": "y"}) == ["2"] and ids(conditions={"o.k": "y", "n_lt": "90"}) == []
    assert ids(conditions={"missing": 1}) == [] and ids(conditions={"n_gte": "90.5"}) == ["2", "5"]
    schemas = {r["entity_type"]: (r["documents"], r["schema"]) for r in entities.document_schemas(stored).collect()}
    assert schemas["A"][0] == 5 and "n: " in schemas["A"][1] and schemas["B"] == (1, "OBJECT<z: ARRAY<BIGINT>>")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def on_table(df):
    """Whether an exchange stands between the table in buckets and the join."""
    return "Bucketed: true" not in df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_stay_where_they_are(spark, tmp_path):
    name = lambda k: f"t_{k}_{abs(hash(str(tmp_path)))}"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(500).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), (F.col("id") % 50).alias("block_number"), F.lit(0).cast("bigint").alias("log_order"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("pool"), F.lit(None).cast("bigint").alias("timestamp"))
        batch = rows.where("block_number % 3 = 0").select("id", (F.col("block_number") + F.when(F.col("block_number") % 2 == 0, 1).otherwise(-1)).alias("block_number"), "log_order", F.lit("px").alias("pool"), "timestamp").unionByName(rows.limit(3)).unionByName(rows.limit(1).withColumn("id", F.lit("new")))
        table = bucketed.write_bucketed(rows, name("swaps"), ["id"], 4, f"{tmp_path}/swaps")
        merged = bucketed.upsert_bucketed(table, batch, 4)
        assert rows_of(merged) == rows_of(upsert(rows, batch)) and exchanges(merged) == 1 and not on_table(merged)  # the batch's own
        stored = bucketed.merge_into(spark, name("swaps"), batch, ["id"], 4, name("next"), f"{tmp_path}/next")
        assert rows_of(stored) == rows_of(merged) and len(list((tmp_path / "next").glob("*.parquet"))) == 4
        assert rows_of(bucketed.upsert_bucketed(stored, batch, 4)) == rows_of(stored)
        blocks = bucketed.write_bucketed(spark.range(50).select(F.col("id").alias("number"), (F.col("id") * 10).alias("timestamp")), name("blocks"), ["number"], 4, f"{tmp_path}/blocks")
        by_block = bucketed.write_bucketed(rows, name("by_block"), ["block_number"], 4, f"{tmp_path}/by_block")
        timed = enrich.with_block_time(by_block, blocks)
        assert exchanges(timed) == 0 and timed.where("timestamp = block_number * 10").count() == 500
        tokens = spark.createDataFrame([("t0", "S0", "N0", 18), ("t1", "S1", "N1", 6)], "id string, symbol string, name string, decimals long")
        pools = spark.range(6).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit("t0").alias("token0"), F.lit("t1").alias("token1"), F.lit(500).cast("bigint").alias("feeTier"))
        by_pool = bucketed.write_bucketed(rows, name("by_pool"), ["pool"], 4, f"{tmp_path}/by_pool")
        full = enrich.with_pools(by_pool, pools, tokens)
        plan = full._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "Exchange" in x and "pool_id" in x] and "Bucketed: true" in plan
        assert rows_of(full.select("id", "pool.token0.symbol")) == rows_of(enrich.with_pools(rows, pools, tokens).select("id", "pool.token0.symbol"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
