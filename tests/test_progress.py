"""Progress that is stored, and goes on by itself."""

import time

from pyspark.sql import functions as F

from ledgerlake.decode import amm
from ledgerlake.operators.upsert import upsert
from ledgerlake.sources import synth
from ledgerlake.streaming import index, progress
from tests.test_streaming import run, swap, write_logs


def test_a_second_run_without_new_blocks_is_a_no_op(spark, sf_dir, tmp_path):
    logs = synth.swap_v2_logs(spark, sf_dir)
    newest = logs.agg(F.max("block_number")).first()[0]
    path, table, written = str(tmp_path / "progress"), str(tmp_path / "swaps"), []

    def write(step):
        written.append(1)
        index.merge_batch(amm.swaps_v2(step), table, span=1000)

    half = logs.where(F.col("block_number") <= newest // 2)
    first = progress.index_new_blocks(half, path, "swaps", write, step=500)
    assert first == len(written) > 1 and progress.index_new_blocks(half, path, "swaps", write, step=500) == 0 and len(written) == first
    top = half.agg(F.max("block_number")).first()[0]
    assert progress.last_block(spark, path, "swaps") == top and progress.last_block(spark, path, "other") is None
    assert progress.index_new_blocks(logs, path, "swaps", write, step=5000) == 1 + (newest - top - 1) // 5001
    rows = [tuple(r) for r in progress.read_progress(spark, path).orderBy("first_block").select("first_block", "last_block", "events", "lag").collect()]
    assert rows[0][0] == 0 and all(b[0] == a[1] + 1 for a, b in zip(rows, rows[1:], strict=False)) and rows[-1][1] == newest and rows[-1][3] == 0
    assert sum(r[2] for r in rows) == logs.count()
    assert sorted(r["id"] for r in index.read_table(spark, table).select("id").collect()) == sorted(r["id"] for r in upsert(None, amm.swaps_v2(logs)).select("id").collect())
    assert progress.index_new_blocks(logs.limit(0), path, "none", write) == 0


def test_a_run_that_dies_does_its_step_again(spark, sf_dir, tmp_path):
    logs, path = synth.swap_v2_logs(spark, sf_dir), str(tmp_path / "progress")

    def dies(step):
        raise OSError("executor lost")

    try:
        progress.index_new_blocks(logs, path, "swaps", dies)
    except OSError:
        pass
    assert progress.last_block(spark, path, "swaps") is None


def test_a_stream_stores_its_progress(spark, tmp_path):
    source, out, path = tmp_path / "in", tmp_path / "out", str(tmp_path / "progress")
    listener = progress.ProgressListener(spark, path)
    spark.streams.addListener(listener)
    try:
        for k, rows in enumerate(([swap("0xa", 1, 5, 10), swap("0xb", 2, 6, 20)], [swap("0xc", 1, 9, 10)])):
            write_logs(source, f"{k}.json", rows)
            run(spark, source, {"swaps": amm.swaps_v2}, out, tmp_path / "cp")
        for _ in range(60):  # listeners are told a little later
            if progress.read_progress(spark, path).count() == 2:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(tuple(r)[1:4] for r in progress.read_progress(spark, path).collect()) == [(0, 6, 2), (7, 9, 1)]
