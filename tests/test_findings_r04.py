"""Small cases of the fourth round's findings: streams and stores that took too long on larger tables."""

from pyspark.sql import functions as F

from ledgerlake.operators import partials
from ledgerlake.plans import streams
from ledgerlake.streaming import index


def _numbers(folder):
    return sorted(int(p.name) for p in folder.iterdir() if p.name.isdigit())


def test_a_batch_of_a_stream_fills_the_cores_and_the_mark_has_none_of_its_own(spark, sf_dir, tmp_path, monkeypatch):
    """of eight cores three read a batch, one more batch held the mark, and every batch loaded as many stores as the session has shuffle partitions."""
    monkeypatch.setattr(streams, "scratch", lambda *_: str(tmp_path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        streams.streamed_pool_days(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    cores = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 3 * cores
    assert _numbers(tmp_path / "checkpoint" / "offsets") == [0, 1, 2, 3]  # three batches, and one without rows that closes the days
    assert _numbers(tmp_path / "checkpoint" / "state" / "0") == list(range(cores))


def test_stores_grow_with_the_rows(spark, tmp_path):
    """a task's state is bounded, whatever the session's shuffle partitions are."""
    spark.range(1_000).write.parquet(str(tmp_path / "in"))
    cores = spark.sparkContext.defaultParallelism
    assert [streams.stores_for(spark, str(tmp_path / "in"), each) for each in (10, 1_000)] == [cores * -(-100 // cores), cores]


def test_an_increment_reads_its_own_files_and_is_upserted_once(spark, sf_dir, monkeypatch):
    """each of four merges read the swaps of all increments, which had been upserted before; states held ten sums that days do not read."""
    files, merge = [], index.merge_batch
    monkeypatch.setattr(index, "merge_batch", lambda part, *a, **k: (files.append({r[0] for r in part.select(F.input_file_name()).distinct().collect()}), merge(part, *a, **k)))
    plans, write = [], streams.written
    monkeypatch.setattr(streams, "written", lambda rows, *a: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, *a))[1])
    states = streams._stored_states(spark, sf_dir, lambda swaps, span: partials.pool_states(swaps, span, amounts=()), "test")
    assert files[3] == files[0] and len(files[0] | files[1] | files[2]) == sum(map(len, files[:3]))
    assert not any("Aggregate" in p for p in plans)
    assert not [c for c in states.columns if c.startswith("amount")]


def test_pending_partitions_are_put_in_place_without_being_read(spark, tmp_path):
    """what a merge had written was read and written again. A move that was cut short goes on where it stopped."""
    path, pending = tmp_path / "t", tmp_path / "t" / "_pending"
    rows = spark.range(40).selectExpr("id AS v", "CAST(id % 4 AS INT) AS bucket").coalesce(1)
    rows.where("bucket < 3").write.partitionBy("bucket").parquet(str(path))
    rows.selectExpr("v + 100 AS v", "bucket").write.partitionBy("bucket").parquet(str(pending))
    files = {p.name for p in pending.rglob("*.parquet")}
    (path / "bucket=3").mkdir()
    for p in (pending / "bucket=3").iterdir():  # this folder had been moved
        p.rename(path / "bucket=3" / p.name)
    (pending / "bucket=3").rmdir()
    index._finish(spark, str(path))
    assert {p.name for p in path.rglob("*.parquet")} == files and not pending.exists()
    assert sorted(r["v"] for r in index.read_table(spark, str(path)).collect()) == list(range(100, 140))


def test_a_join_keeps_one_store_a_partition(spark, sf_dir, tmp_path, monkeypatch):
    """a join had four stores for each of the session's shuffle partitions, whatever it kept, and every batch committed all of them."""
    monkeypatch.setattr(streams, "scratch", lambda *_: str(tmp_path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        streams.streamed_announced_swaps(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    kept = tmp_path / "checkpoint" / "state" / "0"
    assert _numbers(kept) == list(range(spark.sparkContext.defaultParallelism))
    assert not [p for k in _numbers(kept) for p in (kept / str(k)).iterdir() if p.name.startswith(("left-", "right-"))]
