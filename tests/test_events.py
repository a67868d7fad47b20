import json

from tidewatch.sources import alerts

BASE = {
    "timestamp": "2024-01-15T10:00:00+00:00",
    "data": {"win": {"system": {"eventID": "4624"}, "eventdata": {"targetUserName": "user_normal", "targetFilename": "", "image": "chrome.exe", "commandLine": "", "ipAddress": "192.168.1.10"}}},
    "rule": {"id": "60106"},
    "agent": {"name": "WIN"},
}


def flat(spark, *docs):
    lines = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "_seq bigint, value string")
    return [r.asDict() for r in alerts.raw_events(alerts.parse(lines)).orderBy("_seq").collect()]


def test_valid_alert(spark):
    (row,) = flat(spark, BASE)
    assert (row["username"], row["event_id"], row["process_name"], row["src_ip"], row["rule_id"], row["agent_name"]) == ("user_normal", "4624", "chrome.exe", "192.168.1.10", "60106", "WIN")
    assert (row["bytes_sent"], row["dst_ip"], row["command_line"]) == (0, "", "")


def test_dropped(spark):
    bad = [{}, {"timestamp": ""}, {"timestamp": "not-a-date"}, {"timestamp": "2024"}, {"timestamp": None, "data": 3}, "[]", "3", '"x"', "{broken", "null", ""]
    assert flat(spark, *bad) == []


def test_times(spark):
    rows = flat(spark, *[BASE | {"timestamp": t} for t in ("2024-01-15T23:30:00+02:00", "2024-01-15T10:00:00Z", "2024-01-15T10:00:00", "2024-01-15T10:00:00.123+0000", "20240115T101112", "2024-01-15")], {"@timestamp": "2024-01-15T10:00:00Z"})
    assert [(r["ts_local"].hour, r["ts_utc"].hour) for r in rows] == [(23, 21), (10, 10), (10, 10), (10, 10), (10, 10), (0, 0), (10, 10)]


def test_coalesced_fields(spark):
    event = lambda **e: {"win": {"eventdata": e}}
    cases = [
        ({"data": event(subjectUserName="ADMINISTRATOR", targetUserName="x")}, "administrator"),
        ({"data": event(subjectUserName="", targetUserName=" Bob\t")}, "bob"),
        ({"data": {"srcuser": "Eve"}}, "eve"),
        ({"predecoder": {"user": "p"}}, "p"),
        ({"data": {"srcuser": "  "}}, ""),
        ({"data": {"win": None}}, "unknown"),
        ({"data": [1]}, "unknown"),
    ]
    odd = {"data": {"id": 7, "srcip": "1.1.1.1", "process": {"name": "p"}, "win": {"system": {"eventID": None}, "eventdata": {"objectName": "o", "destinationIp": "2.2.2.2"}}}}
    rows = flat(spark, *[{"timestamp": "2024-01-15T10:00:00Z", **c} for c in [*[c for c, _ in cases], odd]])
    assert [r["username"] for r in rows[:-1]] == [u for _, u in cases]
    row = rows[-1]
    assert (row["event_id"], row["src_ip"], row["process_name"], row["file_path"], row["dst_ip"]) == ("7", "1.1.1.1", "p", "o", "2.2.2.2")


def test_bytes(spark):
    rows = flat(spark, *[BASE | {"data": {"bytes_sent": b}} for b in ("12", "x", "12.5", None, 40, " 9 ")])
    assert [r["bytes_sent"] for r in rows] == [12, 0, 0, 0, 40, 9]


def test_files(spark, tmp_path):
    def users(path):
        return sorted(r["username"] for r in alerts.raw_events(alerts.load(spark, str(path))).collect())

    one, two = (BASE | {"data": {"srcuser": u}} for u in "ab")
    (tmp_path / "n.json").write_text(f"{json.dumps(one)}\n\n  \nnot json\n{json.dumps(two)}\n")
    (tmp_path / "a.json").write_text(json.dumps([one, two, 5], indent=2))
    (tmp_path / "l.json").write_text(json.dumps([one, two]))
    (tmp_path / "broken.json").write_text("[\n" + json.dumps(one) + "\n")
    (tmp_path / "empty.json").write_text("")
    assert users(tmp_path / "n.json") == users(tmp_path / "a.json") == users(tmp_path / "l.json") == ["a", "b"]
    assert users(tmp_path / "broken.json") == ["a"]
    assert users(tmp_path / "empty.json") == users(tmp_path / "missing.json") == []
