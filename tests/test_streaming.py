import dataclasses
import json
import os

import pytest

from tidewatch.config import Config
from tidewatch.ml import bundle, scaler
from tidewatch.ml.ocsvm import OneClass
from tidewatch.sources.tail import TailReader
from tidewatch.streaming import detector


def lines(reader, offset):
    rows, end = reader.read(offset)
    return [v for _, v in rows], end


def test_tail(tmp_path):
    f = tmp_path / "a.json"
    assert TailReader(str(f), "latest").initialOffset() == {"inode": 0, "pos": 0}
    f.write_text("old\n")
    r = TailReader(str(f), "latest")
    at = r.initialOffset()
    with f.open("a") as out:
        out.write("one\npar")
    got, end = lines(r, at)
    assert got == ["one"]
    assert [v for _, v in r.readBetweenOffsets(at, end)] == ["one"]
    with f.open("a") as out:
        out.write("tial é\n")
    got, end = lines(TailReader(str(f), "latest"), end)  # a new reader from the stored offset
    assert got == ["partial é"]
    f.write_text("cut\n")  # shorter, same file
    got, end = lines(r, end)
    assert got == ["cut"]
    other = tmp_path / "b"
    other.write_text("new file\nx\n")
    os.replace(other, f)
    got, end = lines(r, end)
    assert got == ["new file", "x"]
    f.unlink()
    assert lines(r, end) == ([], end)
    with pytest.raises(ValueError):
        TailReader(str(f), "middle")


def test_tail_reads_long_lines_whole(tmp_path, monkeypatch):
    from tidewatch.sources import tail

    monkeypatch.setattr(tail, "MOST_BYTES", 8)
    f = tmp_path / "a"
    f.write_text("short\n" + "x" * 50 + "\nend\n" + "y" * 30)
    r, at, seen = TailReader(str(f), "earliest"), {"inode": 0, "pos": 0}, []
    at = r.initialOffset()
    for _ in range(6):
        got, at = lines(r, at)
        seen += got
    assert seen == ["short", "x" * 50, "end"]  # the last line is still being written
    with f.open("a") as out:
        out.write("\n")
    assert lines(r, at)[0] == ["y" * 30]


def test_history_is_bounded(spark, tmp_path):
    folder = str(tmp_path / "h")
    for batch in range(detector.KEPT + 4):
        new = spark.createDataFrame([(batch, f"u{batch}", 1, 0)], detector.HISTORY)
        detector.remember(detector.recent(spark, folder, batch, 3), new, folder, batch, 3)
    found = detector.batches(spark, folder)
    assert len(found) == detector.KEPT + 1 and found[-1] == detector.KEPT + 3
    assert [r["seq"] for r in detector.recent(spark, folder, 99, 3).orderBy("seq").collect()] == [found[-1] - 2, found[-1] - 1, found[-1]]


def test_late_rows_are_dropped(spark, tmp_path):
    """A row that is later than the watermark doesn't open its closed session again; one within the delay joins."""
    from helpers import raw
    from tidewatch.streaming import native

    source, out = tmp_path / "in", str(tmp_path / "out")
    waves = [[(0, {}), (30, {})], [(20, {}), (300, {})], [(10, {}), (900, {"username": "end"})]]
    for wave in waves:
        raw(spark, wave).coalesce(1).write.mode("append").parquet(str(source))
        flow = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
        query = native.sessions(flow, delay="10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    rows = spark.read.parquet(out).orderBy("start_ts").collect()
    assert [r["nb_events"] for r in rows] == [3, 1]
    assert query.lastProgress["stateOperators"][0]["numRowsDroppedByWatermark"] >= 0


def test_stop_on_signals():
    import os
    import signal

    class Query:
        stopped = 0

        def stop(self):
            self.stopped += 1

    query, before = Query(), signal.getsignal(signal.SIGUSR1)
    try:
        detector.stop_on_signals(query, (signal.SIGUSR1,))
        os.kill(os.getpid(), signal.SIGUSR1)
        assert query.stopped == 1
    finally:
        signal.signal(signal.SIGUSR1, before)


def test_entropy_of_arrays(spark):
    from pyspark.sql import functions as F

    from tidewatch.streaming import native

    rows = [([],), (["a"],), (list("abcd"),), (["b"] + ["a"] * 9,), (list("ababababab"),)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<string>").select(native.entropy(F.col("x"))).collect()]
    assert got == pytest.approx([0, 0, 2, 0.4689956, 1])


def alert(user, minute, **event):
    return json.dumps({"timestamp": f"2024-01-15T02:{minute:02d}:00+00:00", "data": {"win": {"system": {"eventID": event.pop("id", "4663")}, "eventdata": {"subjectUserName": user, **event}}}})


def test_detector(spark, tmp_path):
    """Two batches through the tail source: alerts are appended, history grows, a replay changes nothing."""
    import numpy as np

    far = OneClass(np.zeros((1, 14)), np.ones(1), 2.0, 1.0)  # every row is anomalous
    models = bundle.Bundle(scaler.Scaler(np.zeros(14), np.ones(14)), ocsvm=far)
    config = Config()
    config = dataclasses.replace(config, input=dataclasses.replace(config.input, alerts_path=str(tmp_path / "in.json")), paths=dataclasses.replace(config.paths, alert_output=str(tmp_path / "out")), detection=dataclasses.replace(config.detection, ensemble_threshold=1))
    source, state = tmp_path / "in.json", str(tmp_path / "state")
    source.write_text(alert("ann", 0, targetFilename="C:\\Sensitive\\a") + "\nbad line\n" + alert("bob", 5, id="4625") + "\n")
    for extra in ("", alert("ann", 30, targetFilename="b") + "\n"):
        with source.open("a") as f:
            f.write(extra)
        query = detector.start(spark, config, models, state, "earliest", once=True)
        query.awaitTermination(300)
        assert query.exception() is None
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert sorted((r["username"], r["severity"], r["votes"], r["confidence"]) for r in rows) == [("ann", "LOW", 1, 1.0), ("ann", "LOW", 1, 1.0), ("bob", "LOW", 1, 1.0)]
    newest = detector.batches(spark, f"{state}/history")[-1]
    history = detector.recent(spark, f"{state}/history", newest + 1, 500).orderBy("seq").collect()
    assert [(r["seq"], r["username"]) for r in history] == [(0, "ann"), (1, "bob"), (2, "ann")]
    assert [(r["value"], r["reason"]) for r in spark.read.json(f"{state}/history-rejects").collect()] == [("bad line", "not JSON")]
    again = spark.createDataFrame([(0, alert("ann", 30, targetFilename="b"))], "_seq bigint, value string")
    detector.handle(models, config, f"{state}/history", str(tmp_path / "out"))(again, newest)
    assert spark.read.json(str(tmp_path / "out")).count() == 3 and detector.recent(spark, f"{state}/history", newest + 1, 500).orderBy("seq").collect() == history
    with pytest.raises(ValueError):
        detector.start(spark, config, bundle.Bundle(), state)
