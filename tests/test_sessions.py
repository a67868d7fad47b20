import math
from collections import Counter

import pytest
from helpers import raw
from pyspark.sql import functions as F

from tidewatch.operators import baseline, sessions
from tidewatch.sources.telemetry import raw_events

SF = "/root/testdata/sf0.001"


def found(spark, events, **options):
    return [r.asDict() for r in sessions.session_features(raw(spark, events), minutes=60, **options).orderBy("username", "start_ts").collect()]


CASES = {
    "one": ([0, 30], 1), "two": ([0, 121], 2), "exact": ([0, 60], 1), "over": ([0, 60 + 1e-6 / 60], 2), "long": ([i * 50 for i in range(60)], 1), "alice": ([0], 1), "bob": ([5], 1),
}


@pytest.mark.parametrize("split", [None, "day", "hour"])
def test_gaps(spark, split):
    rows = found(spark, [(m, {"username": u}) for u, (at, _) in CASES.items() for m in at], split=split)
    assert Counter(r["username"] for r in rows) == {u: n for u, (_, n) in CASES.items()}


def test_no_events(spark):
    assert sessions.session_features(raw(spark, [(0, {})]).limit(0)).collect() == []


def path(p):
    return {"event_id": "4663", "file_path": p}


def test_features(spark):
    doc = path("C:\\Users\\a")
    events = [(0, doc), (5, doc), (10, doc), (20, doc), (30, doc)]
    events += [(m, {"username": "night"}) for m in (-480, -450)] + [(5 * 1440, {"username": "weekend"})]
    events += [(m, c | {"username": "mix"}) for m, c in [(0, path("c:\\SENSITIVE\\x")), (1, path("")), (2, {"event_id": "3", "bytes_sent": 7}), (2, {"event_id": "4625"}), (3, {"event_id": "4624", "src_ip": "9.9.9.9", "bytes_sent": 5}), (3, {"event_id": "4624"})]]
    row = {r["username"]: r for r in found(spark, events)}
    u = row["u1"]
    assert (u["nb_files_accessed"], u["velocity"], u["session_duration_min"], u["nb_sensitive_files"], u["hour"], u["is_night"], u["is_weekend"]) == (5, 0.1667, 30.0, 0, 10, 0, 0)
    assert (row["night"]["hour"], row["night"]["is_night"], row["weekend"]["is_weekend"]) == (2, 1, 1)
    u = row["mix"]
    assert (u["nb_sensitive_files"], u["sensitive_path_access"], u["nb_files_accessed"], u["bytes_sent"], u["nb_failed_logins"], u["new_ip"]) == (1, 1, 1, 7, 1, 1)


def command(c, p="p.exe"):
    return {"event_id": "4688", "command_line": c, "process_name": p}


ENTROPY = {"none": ([], 0.0), "one": (["a"], 0.0), "same": (["a", "a"], 0.0), "four": (list("abcd"), 2.0), "nine": (["a"] * 9 + ["b"], 0.469), "half": (["a"] * 5 + ["b"] * 5, 1.0)}


def test_entropy(spark):
    rows = {r["username"]: r for r in found(spark, [e for u, (commands, _) in ENTROPY.items() for e in [(0, {"username": u}), *[(k, command(c) | {"username": u}) for k, c in enumerate(commands)]]])}
    for u, (commands, expected) in ENTROPY.items():
        assert rows[u]["entropy_commands"] == pytest.approx(expected, abs=1e-4)
        assert math.copysign(1, rows[u]["entropy_commands"]) == 1
        assert (rows[u]["command_line"], rows[u]["process_name"]) == ((commands[0], "p.exe") if commands else ("", ""))


def zs(spark, rows):
    return [r.asDict() for r in baseline.user_zscores(spark.createDataFrame(rows, "username string, nb_files_accessed bigint, nb_failed_logins bigint")).orderBy("nb_files_accessed").collect()]


def test_zscores(spark):
    rows = zs(spark, [*[("u1", a, b) for a, b in zip((10, 12, 8, 11, 100), (0, 0, 1, 0, 0), strict=True)], ("single", 3, 4), *[("flat", 3, 4)] * 3])
    assert rows[-1]["z_score_files"] == 1.7876  # the most that 5 rows can reach is 4 / sqrt(5)
    assert {r["z_score_files"] for r in rows if r["username"] != "u1"} == {0.0}


def test_missing_source_column(spark):
    rows = baseline.user_zscores(spark.createDataFrame([("u", 1)], "username string, nb_files_accessed bigint")).collect()
    assert rows[0]["z_score_logins"] == 0.0


def test_split_plan_and_order(spark, minutes=720):
    events = raw_events(spark.read.parquet(f"{SF}/events.parquet"))
    plain = sessions.session_features(events, minutes=minutes)
    split = sessions.session_features(events.orderBy(F.rand(3)), minutes=minutes, split="day")
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()
    assert sessions.sessions(events, minutes).agg(F.sum("nb_events")).first()[0] == events.count()
    a, b = baseline.user_zscores(plain), baseline.user_zscores(plain, skewed=True)
    assert a.exceptAll(b.select(*a.columns)).isEmpty()


def test_one_shuffle_on_the_user(spark):
    plan = sessions.session_features(raw_events(spark.read.parquet(f"{SF}/events.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rolling(spark):
    rows = spark.createDataFrame([(k, "u" if k % 2 else "v", k * k, 0) for k in range(10)], "seq bigint, username string, nb_files_accessed bigint, nb_failed_logins bigint")
    got = {r["seq"]: r["z_score_files"] for r in baseline.rolling_zscores(rows, 4).collect()}
    assert got[0] == got[1] == 0.0
    x = [9 * 9, 7 * 7, 5 * 5]
    mean = sum(x) / 3
    assert got[9] == round((81 - mean) / (sum((v - mean) ** 2 for v in x) / 2) ** 0.5, 4)


def test_split_follows_the_busiest_user(spark):
    events = raw(spark, [(60 * k, {}) for k in range(200)] + [(5, {"username": "other"})])
    assert sessions.split_for(events) is None and sessions.split_for(events.limit(0)) is None
    assert [sessions.split_for(events, n) for n in (199, 170, 30, 1)] == ["week", "week", "day", "hour"]


def test_export_program(spark, tmp_path, monkeypatch):
    import json

    from tidewatch.plans import export
    from tidewatch.sources import tables

    alerts = [{"timestamp": f"2024-01-15T{h:02d}:00:00Z", "data": {"id": "4624", "srcuser": u}} for h in (8, 9, 20) for u in ("ann", "bob")]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, alerts)))
    for n, split in enumerate(("auto", "day")):
        assert export.main(["--input", str(tmp_path / "a.json"), "--output", str(tmp_path / f"out{n}"), "--split", split, "--single", "--verbose", "--log-file", str(tmp_path / "log")]) == 0
    both = [tables.read_csv(spark, str(tmp_path / f"out{n}")).drop("ts") for n in range(2)]
    assert both[0].count() == 4 and both[0].exceptAll(both[1]).isEmpty()
    said = (tmp_path / "log").read_text()
    assert "4 sessions of 2 users" in said and "ann: 2 sessions" in said
    (tmp_path / "empty.json").write_text("")
    assert export.main(["--input", str(tmp_path / "empty.json"), "--output", str(tmp_path / "none")]) == 1
