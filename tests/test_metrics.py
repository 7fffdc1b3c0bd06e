"""Recording of runs, and the log as a stream."""

import json
from datetime import datetime

import pytest

from tessera.operators.metrics import metrics_summary, read_metrics, record_run
from tessera.streaming import metrics as stream


def line(minute, operation="retrieve", **more):
    return json.dumps({"timestamp": f"2024-05-01T{10 + minute // 60:02}:{minute % 60:02}:00Z", "operation": operation, "success": True, "duration_ms": 5, "total_tokens": 10, "baseline_bytes": 400, "delivered_tokens": 20, **more})


FIRST = [line(0), line(5, success=False), "{broken", "", line(90), json.dumps({"operation": "x"})]
SECOND = [line(10), line(80), "[1]", line(95, cost=0.5)]


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(FIRST))
    return tmp_path


def run(spark, at):
    stream.record_stream(spark, f"file://{at}/in", f"file://{at}/sink", f"file://{at}/checkpoint").awaitTermination()


def test_stream_totals_equal_the_batch(spark, logs):
    run(spark, logs)
    (logs / "in/b.jsonl").write_text("\n".join(SECOND))
    run(spark, logs)
    run(spark, logs)  # nothing new
    rows = stream.recorded(spark, f"file://{logs}/sink")
    assert metrics_summary(rows).collect() == metrics_summary(read_metrics(spark, f"file://{logs}/in").where("operation is not null and timestamp is not null")).collect()
    assert sorted(r.malformed for r in stream.malformed(spark, f"file://{logs}/sink").collect()) == ['[1]', '{"operation": "x"}', "{broken"]
    late = [r.timestamp for r in rows.where("late").collect()]
    assert late == [datetime(2024, 5, 1, 10, 10)]  # 80 minutes behind the first file's newest; the run at 80 is not late


def test_a_replayed_batch_changes_nothing(spark, logs):
    write = stream.batch_writer(f"file://{logs}/sink")
    first, second = (spark.createDataFrame([(x,) for x in lines], "value string") for lines in (FIRST, SECOND))
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0), (second, 1)):
        write(batch, number)
    rows = stream.recorded(spark, f"file://{logs}/sink")
    assert rows.count() == 6 and rows.where("late").count() == 1 and stream.malformed(spark, f"file://{logs}/sink").count() == 3


def test_windows_of_the_stream(spark, logs):
    query = stream.metrics_stream(spark, f"file://{logs}/in").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.start.hour, r.start.minute, r.operations, r.failed, r.total_tokens) for r in spark.table("windows").where("start is not null").collect()) == [(10, 0, 2, 1, 20), (11, 30, 1, 0, 10)]


def test_runs_are_recorded(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert record_run(spark, path, "retrieve", lambda: ("done", {"files": 3, "input_bytes": 40, "total_tokens": 7, "cost": 0.25}), "m1") == "done"

    def fails():
        raise RuntimeError("worker request failed: secret /path timed out")

    with pytest.raises(RuntimeError):
        record_run(spark, path, "scan", fails)
    rows = {r.operation: r for r in read_metrics(spark, path).collect()}
    assert (rows["retrieve"].success, rows["retrieve"].files, rows["retrieve"].model, rows["retrieve"].error_kind) == (True, 3, "m1", None)
    assert (rows["scan"].success, rows["scan"].error_kind, rows["scan"].input_bytes) == (False, "timeout", 0)
    assert "secret" not in str(rows)
    assert record_run(spark, "nowhere://x", "retrieve", lambda: (1, {})) == 1
