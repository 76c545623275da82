import uuid
from datetime import datetime

from quillmesh.operators import references as r
from quillmesh.streaming import incremental as inc


def test_reference_state_over_batches(spark, tmp_path):
    t = datetime(2024, 1, 1)
    src = str(tmp_path / "edges")
    schema = "key string, ref_time timestamp"
    for part in ([("a", t), ("b", t)], [("a", t), ("c", t)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    state = inc.ReferenceState(spark, str(tmp_path / "state"))

    def take(df, n):
        state.apply(r.reference_deltas(df), n)
        state.apply(r.reference_deltas(df), n)  # a repeat counts once

    q = inc.run_once(inc.read_new(spark, src, spark.read.parquet(src).schema, 1), f"refs-{uuid.uuid4().hex}", take)
    q.awaitTermination()
    assert q.exception() is None
    got = state.read(1)
    assert {(x.key, x.refs) for x in got.collect()} == {("a", 2), ("b", 1), ("c", 1)}
    full = r.apply_deltas(None, r.reference_deltas(spark.read.parquet(src)))
    assert sorted(map(str, got.collect())) == sorted(map(str, full.collect()))


def test_change_counts(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h), "INITIAL" if h % 2 else "DELETED") for h in range(6)] + [(datetime(2024, 1, 3), "INITIAL")]
    src = str(tmp_path / "h")
    spark.createDataFrame(rows, "scanned_at timestamp, change_type string").write.parquet(src)
    s = inc.change_counts(inc.read_new(spark, src, spark.read.parquet(src).schema))
    q = s.writeStream.outputMode("complete").format("memory").queryName("cc").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(x.change_type, x.n) for x in spark.sql("select * from cc").collect()} == {("INITIAL", 3), ("DELETED", 3), ("INITIAL", 1)}
