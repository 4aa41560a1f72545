"""Small cases of the third round's findings on growth (F8 to F18)."""

from pyspark.sql import functions as F

from ledgerlake.decode import amm
from ledgerlake.functions import hexwords as hx
from ledgerlake.operators.upsert import upsert
from ledgerlake.plans import streams
from ledgerlake.sources import synth
from ledgerlake.sources.logs import read_stored, write_logs
from ledgerlake.streaming import index


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_steps_read_stored_logs(spark, sf_dir, monkeypatch):
    """a step reads its blocks, and encodes no table again."""
    plans, merge = [], index.merge_batch
    monkeypatch.setattr(index, "merge_batch", lambda part, *a, **k: (plans.append(_plan(part)), merge(part, *a, **k)))
    assert streams.indexed_steps(spark, sf_dir).count() == len(plans) > 1
    assert not any("o_orderkey" in p for p in plans)


def test_topics_are_counted_without_building_them(spark, sf_dir):
    """F16: the filters on the number of topics built all of them, twice."""
    plan = _plan(amm.swaps_v2(synth.swap_v2_logs(spark, sf_dir)))
    assert "size(array(" not in plan
    lists = spark.createDataFrame([(0, None), (1, []), (2, [None]), (3, ["a"]), (4, ["a", None]), (5, [None, "b"])], "k int, topics array<string>")
    for n in (1, 2):
        got, want = ([r[0] for r in lists.where(c).orderBy("k").collect()] for c in (hx.has_topics(n), F.size("topics") >= n))
        assert got == want


def test_decoding_has_few_levels_and_copies_no_topics(spark, sf_dir, tmp_path):
    """F16: every level of columns copies its rows."""
    write_logs(synth.liquidity_logs(spark, sf_dir).limit(50), str(tmp_path))
    burns = amm.burns(read_stored(spark, str(tmp_path))).where("owner IS NOT NULL")
    projects = [line for line in _plan(burns).splitlines() if "Project [" in line]
    assert len(projects) <= 6 and sum("topics#" in line for line in projects) <= 2


def test_rows_of_rare_keys_are_sorted_once(spark):
    """ids of logs begin alike, and were sorted by their text on both sides of the shuffle."""
    rows = spark.range(600).select(F.concat(F.lit("0x00000000"), (F.col("id") % 40).cast("string")).alias("id"), (F.col("id") % 7).alias("block_number"), F.lit(0).cast("long").alias("log_order"), (F.col("id") * 31 % 11).cast("string").alias("x"), F.when(F.col("id") % 3 > 0, "y").alias("y"))
    rows = rows.unionByName(rows.limit(5).withColumn("id", F.lit(None).cast("string")))
    once, twice = upsert(None, rows, hot=False), upsert(None, rows)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 41
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = upsert(None, rows, hot=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Sort [") == 1 and "Sort [xxhash64" in plan.replace("_groupingexpression", "xxhash64")
